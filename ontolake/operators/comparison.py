"""Comparison of ontologies up to the names of anonymous individuals, and of RDF graphs up to blank nodes."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceLimitError
from ..model import KIND, Obj

_BLANK = r"_:[^\s()]+"


def ground_difference(left: DataFrame, right: DataFrame, column: str = "axiom_key") -> DataFrame:
    """side, axiom_key of axioms without anonymous individuals that one side lacks."""
    plain = lambda d, side: d.where(~F.col(column).rlike(_BLANK)).select(column).distinct().withColumn("side", F.lit(side))
    both = plain(left, "left").union(plain(right, "right"))
    return both.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("side")).where("n = 1").select("side", F.col(column).alias("axiom_key"))


def fingerprints(axioms: DataFrame, column: str = "axiom_key") -> DataFrame:
    """fingerprint, n: axioms with anonymous individuals, their names left out. Equal ontologies have equal counts."""
    return axioms.where(F.col(column).rlike(_BLANK)).select(column).distinct().groupBy(F.regexp_replace(column, _BLANK, "_:").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


def same(left: Iterable[str], right: Iterable[str], steps: int = 100_000) -> dict[str, str] | None:
    """A renaming of anonymous individuals that turns one set of keys into another, or None. By colour refinement, then
    search within the colours; more than `steps` tries raise."""
    a, b = set(left), set(right)
    if len(a) != len(b):
        return None
    names = [sorted({m for k in s for m in re.findall(_BLANK, k)}) for s in (a, b)]
    if len(names[0]) != len(names[1]):
        return None

    def refine(keys: set[str], mine: list[str], fixed: dict[str, str]) -> dict[str, str]:
        colour = {n: fixed.get(n, "") for n in mine}
        hold = {n: [k for k in keys if n in set(re.findall(_BLANK, k))] for n in mine}
        for _ in range(len(mine) + 1):
            new = {}
            for n in mine:
                seen = sorted(re.sub(_BLANK, lambda m, n=n: "@self" if m[0] == n else colour[m[0]] or "_", k) for k in hold[n])
                new[n] = hashlib.sha256((colour[n] + "|" + "|".join(seen)).encode()).hexdigest()
            if len(set(new.values())) == len(set(colour.values())):
                return new
            colour = new
        return colour

    left_over = [steps]

    def search(fa: dict[str, str], fb: dict[str, str]) -> dict[str, str] | None:
        left_over[0] -= 1
        if left_over[0] < 0:
            raise ResourceLimitError("too many ways to match")
        ca, cb = refine(a, names[0], fa), refine(b, names[1], fb)
        if Counter(ca.values()) != Counter(cb.values()):
            return None
        by: dict[str, tuple[list[str], list[str]]] = {}
        for c, i in ((ca, 0), (cb, 1)):
            for n, v in c.items():
                by.setdefault(v, ([], []))[i].append(n)
        open_ = [v for v in by.values() if len(v[0]) > 1]
        if not open_:
            back = {v[0][0]: v[1][0] for v in by.values()}
            return back if {re.sub(_BLANK, lambda m: back[m[0]], k) for k in a} == b else None
        xs, ys = min(open_, key=lambda v: len(v[0]))
        tag = f"#{len(fa)}"
        for y in ys:
            found = search({**ca, xs[0]: tag}, {**cb, y: tag})
            if found is not None:
                return found
        return None

    return search({}, {})


def compare(left: Iterable[Obj], right: Iterable[Obj]) -> bool:
    """Do two sets of axioms say the same, whatever their anonymous individuals are called. Sets inside axioms are put in
    order by key, which depends on names; so keys are compared with their sets' members sorted by what is left of them."""
    left, right = list(left), list(right)
    return {a.key for a in left} == {a.key for a in right} or same(stable(left), stable(right)) is not None


def stable(axioms: Iterable[Obj]) -> list[str]:
    def text(o: Obj) -> str:
        if o.kind in ("OWLLiteral", "OWLAnonymousIndividual") or o.iri is not None:
            return o.key
        parts = sorted(map(text, o.annotations))
        for spec, v in zip(KIND[o.kind].fields, o.fields):
            if isinstance(v, tuple):
                many = list(map(text, v))
                parts.append("(" + " ".join(many if spec.startswith("[") else sorted(many, key=lambda t: re.sub(_BLANK, "_:", t))) + ")")
            else:
                parts.append(v if isinstance(v, str) else text(v))
        return f"{KIND[o.kind].keyword}({' '.join(parts)})"

    return [text(a) for a in axioms]
