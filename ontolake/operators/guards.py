"""What stands around the operators: dispatch over kinds, providers of ontologies, stores that may be searched together, and
bounds on the time of Spark's work."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ..errors import ResourceLimitError
from ..model import KIND, KINDS, Obj
from .structural import imports_closure

T = TypeVar("T")


def dispatch(o: Obj, handlers: Mapping[str, Callable[[Obj], T]], category: str | None = None) -> T:
    """The handler's answer for an object's kind. Handlers must be there for every kind (of the category, if one is named), also
    for those that do not occur: what is missing shows at the first call."""
    wanted = [k.kind for k in KINDS if category is None or k.category == category]
    if o.kind not in KIND or o.kind not in wanted:
        raise TypeError(f"{o.kind} is no {category or 'known'} kind")
    missing = [k for k in wanted if not callable(handlers.get(k))]
    if missing:
        raise TypeError(f"no handler for {missing[0]}")
    return handlers[o.kind](o)


def closure_provider(store, root: str) -> Callable[[], DataFrame]:
    """A callable that gives the members of an ontology's import closure as they are when it is called."""
    return lambda: imports_closure(store, root).select("member")


def searched(stores: Iterable, search: Callable[..., DataFrame], *arguments) -> DataFrame:
    """A search over several stores with bag semantics. Stores that follow different behaviours (their `behavior`; none is the
    normative one) are not searched together, since their answers would not mean the same."""
    stores = list(stores)
    if len({getattr(s, "behavior", None) or "normative" for s in stores}) > 1:
        raise ValueError("stores of different behaviours cannot be searched together")
    return reduce(DataFrame.unionByName, (search(s, *arguments) for s in stores))


@contextmanager
def within(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Spark jobs that this thread starts inside are cancelled when the time is over, which raises. Nothing that they would have
    written counts: Spark commits whole jobs."""
    context, tag, over = spark.sparkContext, f"within-{uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise ResourceLimitError(f"not done after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
