"""Documents as a store: the frames that all operators take, over parsed ontologies.

Each document is parsed once, for all frames: its head (id, imports, counts, or the error) is one row, and each axiom another,
with its direct fields, inner objects and literals nested in it, so that position lookups and steps between fields need no join
here either. A document that fails has a head alone; `failures()` lists them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KIND, Obj, Ontology, height, walk
from ..operators.revisions import resolve_imports
from ..staging import stored
from .registry import _documents, _names, _parsed

_EDGES = "array<struct<parent_key:string,parent_kind:string,field:string,ord:int,child_key:string,child_kind:string,in_axiom:boolean>>"
_REACH = "array<struct<node_key:string,node_kind:string,in_annotation:boolean>>"
_NODES = "array<struct<node_key:string,kind:string,iri:string,lexical:string,lang:string,datatype_iri:string,node_id:string,cardinality:string,height:int>>"
_HEAD = "struct<ontology_iri:string,version_iri:string,format:string,imports:array<string>,n_axioms:int,n_annotations:int,n_unconsumed:int,error:string>"
ROW = f"doc string, part string, axiom_key string, key_noann string, kind string, is_logical boolean, edges {_EDGES}, reach {_REACH}, nodes {_NODES}, head {_HEAD}"


def _node(x: Obj) -> dict:
    lit = x.fields if x.kind == "OWLLiteral" else (None, None, None)
    return dict(zip(("node_key", "kind", "iri", "lexical", "lang", "datatype_iri", "node_id", "cardinality", "height"), (x.key, x.kind, x.iri, *lit, x.fields[0] if x.kind == "OWLAnonymousIndividual" else None, x.fields[0] if x.kind.endswith("Cardinality") else None, height(x))))


def _row(doc: str, part: str, a: Obj) -> tuple:
    edges, reach, nodes, seen = [], [], [], set()
    for x, ann in walk(a):
        if x is not a:
            reach.append({"node_key": x.key, "node_kind": x.kind, "in_annotation": ann})
        if (x.key, x.kind) not in seen:
            seen.add((x.key, x.kind))
            nodes.append(_node(x))
            edges += [{"parent_key": x.key, "parent_kind": x.kind, "field": f, "ord": i, "child_key": c.key, "child_kind": c.kind, "in_axiom": x is a} for f, i, c in x.children()]
    return doc, part, a.key, a.key_noann, a.kind, KIND[a.kind].logical, edges, reach, nodes, None


def _head(doc: str, o: Ontology | None, key: str | None, error: str | None = None) -> tuple:
    what = (o.iri, o.version, key, o.imports, len(o.axioms), len(o.annotations), len(getattr(o, "unconsumed", []))) if o else (None, None, key, [], 0, 0, 0)
    names = ("ontology_iri", "version_iri", "format", "imports", "n_axioms", "n_annotations", "n_unconsumed", "error")
    return doc, "head", None, None, None, None, [], [], [], dict(zip(names, (*what, error)))


class DocumentStore:
    """Frames over all documents under a path; ont_id is the document. mapping: (import_iri, document_iri) for imports."""

    def __init__(self, spark: SparkSession, path: str, mapping: DataFrame | None = None) -> None:
        def rows(doc: str, o: Ontology, key: str) -> Iterator[tuple]:
            yield _head(doc, o, key)
            for a in o.axioms:
                yield _row(doc, "axiom", a)
            for a in o.annotations:
                yield _row(doc, "annotation", a)

        self.spark = spark
        failed = lambda doc, e: _head(doc, None, None, f"{getattr(e, 'code', 'ERROR')}: {e}")
        self._rows = stored(_documents(spark, path).mapInPandas(lambda it: _parsed(it, rows, _names(ROW), failed), ROW), "documents")
        self._heads = self._rows.where("part = 'head'").select("doc", "head.*")
        self._mapping = mapping

    def _axioms(self, kinds: Iterable[str] | None, onts: Iterable[str] | None) -> DataFrame:
        df = self._rows.where("part = 'axiom'").withColumnRenamed("doc", "ont_id")
        df = df if kinds is None else df.where(F.col("kind").isin(*kinds))
        return df if onts is None else df.where(F.col("ont_id").isin(*onts))

    def axioms(self, kinds=None, onts=None) -> DataFrame:
        return self._axioms(kinds, onts).select("ont_id", "axiom_key", "key_noann", "kind", "is_logical")

    def unique_axioms(self, kinds=None, onts=None, by=("axiom_key",)) -> DataFrame:
        return self.axioms(kinds, onts).dropDuplicates(list(by))

    def axiom_counts(self, kinds=None, onts=None) -> DataFrame:
        return self._axioms(kinds, onts).groupBy("ont_id", "kind", "is_logical").agg(F.count(F.lit(1)).alias("n"))

    def edges(self, kinds=None, fields=None, onts=None, nested: bool = False, key: str | None = None) -> DataFrame:
        df = self._axioms(None if nested else kinds, onts).select("ont_id", F.inline("edges"))
        df = df if nested else df.where("in_axiom")
        df = df.where(F.col("parent_kind").isin(*kinds)) if kinds is not None else df
        df = df.where(F.col("field").isin(*fields)) if fields is not None else df
        df = df.where(F.col("child_key") == key) if key else df
        return df.distinct() if nested else df

    def rows(self, kinds, fields, onts=None) -> DataFrame:
        def at(field: str, what: str):
            return F.get(F.filter("edges", lambda e: e["in_axiom"] & (e["field"] == field)), F.lit(0))[f"child_{what}"].alias(f"{field}_{what}")

        return self._axioms(list(kinds), onts).select("ont_id", "axiom_key", "kind", *(at(f, w) for f in fields for w in ("key", "kind")))

    def pairs(self, kinds, left: str, right: str, onts=None) -> DataFrame:
        names = {f"{f}_{x}": f"{side}_{x}" for f, side in ((left, "left"), (right, "right")) for x in ("key", "kind")}
        return self.rows(kinds, [left, right], onts).withColumnsRenamed(names)

    def reach(self, kinds=None, onts=None, node_kinds=None, key: str | None = None) -> DataFrame:
        df = self._axioms(kinds, onts).select("ont_id", F.col("axiom_key").alias("root_key"), F.col("kind").alias("root_kind"), F.inline("reach"))
        df = df.where(F.col("node_kind").isin(*node_kinds)) if node_kinds is not None else df
        return df.where(F.col("node_key") == key) if key else df

    def entities(self, node_kinds, kinds=None, onts=None, repeats: bool = False) -> DataFrame:
        out = self.reach(kinds, onts, node_kinds).select("ont_id", "node_kind", "node_key")
        return out if repeats else out.distinct()

    def literals(self, kinds=None) -> DataFrame:
        df = self._axioms(kinds, None).select("ont_id", F.col("axiom_key").alias("root_key"), F.explode("nodes").alias("n")).where("n.kind = 'OWLLiteral'")
        return df.select("ont_id", "root_key", "n.lexical", "n.lang", "n.datatype_iri")

    def nodes(self) -> DataFrame:
        return self._rows.where("part <> 'head'").select(F.inline("nodes")).distinct()

    def ontologies(self) -> DataFrame:
        return self._heads.where("error IS NULL").select(F.col("doc").alias("ont_id"), "ontology_iri", "version_iri")

    def imports(self) -> DataFrame:
        return resolve_imports(self._heads, self._mapping).select(F.col("doc").alias("ont_id"), "import_iri", "target")

    def annotations(self) -> DataFrame:
        return self._rows.where("part = 'annotation'").select(F.col("doc").alias("ont_id"), F.col("axiom_key").alias("ann_key"), F.inline("reach")).select("ont_id", "ann_key", "node_key", "node_kind")

    def failures(self) -> DataFrame:
        return self._heads.where("error IS NOT NULL").select("doc", "error")
