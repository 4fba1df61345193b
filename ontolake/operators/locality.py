"""Syntactic locality and module extraction.

Locality of an axiom against a signature is a two-valued evaluation of its expressions, children first. An axiom's
subtree is of bounded size and independent of all others, so the test runs in Arrow batches over axiom rows; the module
is a fixed point whose state, the signature, is a table. Candidates of a round are the axioms that hold an entity that is
new, found by a join with the signature index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BUILTIN_DATATYPES, DATATYPES, ENTITY_KINDS, KIND, NOTHING, RDFS, THING, Obj, walk
from ..staging import stored

BOTTOM, TOP, STAR = "BOTTOM", "TOP", "STAR"
_FINITE = {d.iri for d in DATATYPES if d.finite}
_NEVER = {"DisjointUnion", "SubDataPropertyOf", "DataPropertyDomain", "DataPropertyRange", "SameIndividual", "DifferentIndividuals"}


def _inhabited(r: Obj) -> bool:
    return r.kind == "OWLDatatype" and (r.iri in BUILTIN_DATATYPES or r.iri == RDFS + "Literal")


def _infinite(r: Obj) -> bool:
    return _inhabited(r) and r.iri not in _FINITE


class Evaluator:
    """Bottom and top of class expressions for a signature of entity keys."""

    def __init__(self, signature: set[str], mode: str) -> None:
        self.signature, self.low = signature, mode == BOTTOM
        self.memo: dict[str, tuple[bool, bool]] = {}

    def absent(self, p: Obj) -> bool:
        return (p.fields[0] if p.kind == "OWLObjectInverseOf" else p).key not in self.signature

    def bot(self, c: Obj) -> bool:
        return self.both(c)[0]

    def top(self, c: Obj) -> bool:
        return self.both(c)[1]

    def both(self, c: Obj) -> tuple[bool, bool]:
        if c.key not in self.memo:
            self.memo[c.key] = self._both(c)
        return self.memo[c.key]

    def _both(self, c: Obj) -> tuple[bool, bool]:
        k, f, low = KIND[c.kind].keyword, c.fields, self.low
        if k == "Class":
            free = c.key not in self.signature
            return c.iri == NOTHING or low and c.iri != THING and free, c.iri == THING or not low and c.iri != NOTHING and free
        if k == "ObjectIntersectionOf":  # observed rule: bottom (top) where no operand is
            return not any(map(self.bot, f[0])), not any(map(self.top, f[0]))
        if k == "ObjectUnionOf":
            return any(map(self.bot, f[0])), any(map(self.top, f[0]))
        if k == "ObjectComplementOf":
            return self.top(f[0]), self.bot(f[0])
        if k == "ObjectOneOf":
            return not f[0], False
        card = "Cardinality" in k
        props = (f[1],) if card else f[0] if isinstance(f[0], tuple) else (f[0],)
        out = all(map(self.absent, props))
        if k in ("ObjectHasSelf", "ObjectHasValue", "DataHasValue"):
            return low and out, not low and out
        n = int(f[0]) if card else 0
        r = f[2] if card else f[1]
        if k.startswith("Object"):
            b, t = self.both(r)
            empty = b or low and out
            full = not low and out and t
            return {
                "ObjectSomeValuesFrom": (empty, full),
                "ObjectAllValuesFrom": (not low and out and b, t or low and out),
                "ObjectMinCardinality": (n > 0 and empty, n == 0 or full),
                "ObjectMaxCardinality": (n > 0 and full, empty),
                "ObjectExactCardinality": (n > 0 and (empty or full), n == 0 and empty),
            }[k]
        every = r.kind == "OWLDatatype" and r.iri == RDFS + "Literal"
        if k == "DataSomeValuesFrom":
            return False, not low and out and _inhabited(r)
        if k == "DataAllValuesFrom":
            return not low and out and not every, every or low and out
        if k == "DataMinCardinality":
            return low and n > 0 and out, n == 0 or out and (_inhabited(r) if n == 1 else _infinite(r))
        if k == "DataMaxCardinality":
            return not low and out and n <= 1 and _inhabited(r), low and out
        return (n > 0 and out if low else out and (_inhabited(r) if n == 0 else _infinite(r))), low and n == 0 and out


def is_local(a: Obj, signature: set[str], mode: str) -> bool:
    """Does an axiom say nothing about a signature, all else read as empty (BOTTOM) or as everything (TOP)."""
    k, f, e = KIND[a.kind].keyword, a.fields, Evaluator(signature, mode)
    low = e.low
    if not KIND[a.kind].logical or k in ("DatatypeDefinition", "HasKey"):
        return True
    if k in _NEVER:
        return False
    if k == "SubClassOf":
        return e.bot(f[0]) or e.top(f[1])
    if k == "EquivalentClasses":
        ops = f[0]
        return len(ops) < 2 or all(map(e.bot, ops) if e.bot(ops[0]) else map(e.top, ops))
    if k == "DisjointClasses":
        return sum(not e.bot(c) for c in f[0]) <= 1
    if k == "SubObjectPropertyOf":
        return e.absent(f[0] if low else f[1])
    if k == "SubPropertyChainOf":
        return any(map(e.absent, f[0])) if low else e.absent(f[1])
    if k in ("EquivalentObjectProperties", "EquivalentDataProperties"):
        return len(f[0]) < 2 or all(map(e.absent, f[0]))
    if k in ("DisjointObjectProperties", "DisjointDataProperties"):
        return low and sum(not e.absent(p) for p in f[0]) <= 1
    if k == "InverseObjectProperties":
        return all(map(e.absent, f[0]))
    if k in ("ObjectPropertyDomain", "ObjectPropertyRange"):
        return e.top(f[1]) or low and e.absent(f[0])
    if k in ("SymmetricObjectProperty", "TransitiveObjectProperty"):
        return e.absent(f[0])
    if k == "ClassAssertion":
        return e.top(f[0])
    if k in ("ReflexiveObjectProperty", "ObjectPropertyAssertion", "DataPropertyAssertion"):
        return not low and e.absent(f[0])
    return low and e.absent(f[0])


def entities(o: Obj) -> set[str]:
    return {x.key for x, _ in walk(o) if x.kind in ENTITY_KINDS}


def extract(axioms: Iterable[Obj], seed: Iterable[str], mode: str) -> list[Obj]:
    """The module of a seed (entity keys) on the driver; for documents and tests. STAR takes turns, BOTTOM first, until
    nothing more goes."""
    axioms = list(axioms)
    seed = set(seed)
    if not seed:
        return []
    index: dict[str, list[int]] = {}
    for i, a in enumerate(axioms):
        for e in entities(a):
            index.setdefault(e, []).append(i)
    missing = seed - set(index)
    if missing:
        raise ValueError(f"not in the signature: {sorted(missing)[0]}")

    def module(pool: set[int], kind: str) -> set[int]:
        signature, out, new = set(seed), set(), set(seed)
        # Axioms without an entity that is asked for can still be non-local.
        todo = {i for i in pool if not is_local(axioms[i], signature, kind)}
        while todo or new:
            add = {i for i in todo if i not in out and not is_local(axioms[i], signature, kind)}
            out |= add
            new = {e for i in add for e in entities(axioms[i])} - signature
            signature |= new
            todo = {i for e in new for i in index.get(e, ()) if i in pool and i not in out}
            if not new:
                break
        return out

    pool = set(range(len(axioms)))
    if mode != STAR:
        return [axioms[i] for i in sorted(module(pool, mode))]
    while True:
        size = len(pool)
        pool = module(module(pool, BOTTOM), TOP)
        if len(pool) == size:
            return [axioms[i] for i in sorted(pool)]


class ModuleExtractor:
    """Modules of one pool of axioms. axioms and reach: as in module_frame; mode: BOTTOM, TOP or STAR."""

    def __init__(self, spark: SparkSession, axioms: DataFrame, reach: DataFrame, mode: str) -> None:
        if mode not in (BOTTOM, TOP, STAR):
            raise ValueError(f"{mode} is no class of locality")
        self.spark, self.axioms, self.reach, self.locality_class = spark, axioms, reach, mode

    def axiom_base(self) -> DataFrame:
        """All axioms of the pool, those that are not logical too."""
        return self.axioms.select("axiom_key").distinct()

    def contains_axiom(self, axiom_key: str) -> bool:
        return not self.axioms.where(F.col("axiom_key") == axiom_key).isEmpty()

    def extract(self, seed: list[str], where: Column | None = None) -> DataFrame:
        """axiom_key of the module of a seed. where: a condition on the axioms, which holds before anything is propagated, so
        that what it leaves out brings nothing in. A seed that is in no axiom of the pool is an error."""
        wanted = self.spark.createDataFrame([(x,) for x in seed], "node_key string")
        absent = wanted.join(self.reach, "node_key", "left_anti").first()
        if absent:
            raise ValueError(f"not in the signature: {absent['node_key']}")
        pool = self.axioms if where is None else self.axioms.where(where)
        return module_frame(self.spark, pool, self.reach, seed, self.locality_class)


def module_frame(spark: SparkSession, axioms: DataFrame, reach: DataFrame, seed: list[str], mode: str, rounds: int = 100) -> DataFrame:
    """axiom_key of the module, distributed. axioms: axiom_key and text (functional notation with full IRIs); reach:
    root_key, node_key of the entities inside. Each round tests only axioms that hold an entity new to the signature,
    with the part of the signature that lies inside them, so no task needs the whole signature."""
    if not seed:
        return axioms.select("axiom_key").limit(0)

    def test(kind: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from ..sources.functional import Reader

            for pdf in batches:
                keep = [not is_local(Reader(t).axiom(), set(s), kind) for t, s in zip(pdf["text"], pdf["inside"])]
                yield pdf.loc[keep, ["axiom_key"]]

        return run

    def one(pool: DataFrame, kind: str) -> DataFrame:
        index = reach.select(F.col("root_key").alias("axiom_key"), "node_key").distinct().join(pool.select("axiom_key"), "axiom_key", "left_semi")
        signature = new = stored(spark.createDataFrame([(s,) for s in seed], "node_key string"), "signature")
        inside = pool.select("axiom_key")  # the first round tests all
        out = None
        for _ in range(rounds):
            known = index.join(signature, "node_key", "left_semi").groupBy("axiom_key").agg(F.collect_list("node_key").alias("inside"))
            todo = pool.join(inside, "axiom_key", "left_semi").join(known, "axiom_key", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<string>")))
            if out is not None:
                todo = todo.join(out, "axiom_key", "left_anti")
            add = stored(todo.select("axiom_key", "text", "inside").mapInPandas(test(kind), "axiom_key string"), "module")
            out = add if out is None else out.union(add)
            new = stored(index.join(add, "axiom_key", "left_semi").select("node_key").distinct().join(signature, "node_key", "left_anti"), "signature")
            if new.isEmpty():
                break
            signature = signature.union(new)
            inside = index.join(new, "node_key", "left_semi").select("axiom_key").distinct()
        return pool.join(out, "axiom_key", "left_semi")

    if mode != STAR:
        return one(axioms, mode).select("axiom_key")
    pool, size = axioms, axioms.count()
    while True:
        pool = stored(one(stored(one(pool, BOTTOM), "module"), TOP), "module")
        now = pool.count()
        if now == size:
            return pool.select("axiom_key")
        size = now
