"""Asserted structural queries over a Store: sets of axioms, positions, signatures, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXIOM_KINDS, ENTITY_KINDS, KIND, XSD
from ..plans.projection import Store
from .graph import reachable


def imports_closure(s: Store, root: str | None = None) -> DataFrame:
    """(root, member): the root and what it imports, over resolved imports only; cycles are no matter."""
    edges = s.imports().where("target IS NOT NULL").select(F.col("ont_id").alias("src"), F.col("target").alias("dst"))
    own = s.ontologies().select(F.col("ont_id").alias("src"), F.col("ont_id").alias("dst"))
    out = reachable(edges).union(own).distinct()
    return (out.where(F.col("src") == root) if root else out).select(F.col("src").alias("root"), F.col("dst").alias("member"))


def members(s: Store, root: str) -> list[str]:
    """The closure of one ontology as a list, by steps along its imports; each asks only for the imports of what is new."""
    edges = s.imports().where("target IS NOT NULL")
    found, new = {root}, [root]
    while new:
        new = sorted({r["target"] for r in edges.where(F.col("ont_id").isin(new)).select("target").distinct().collect()} - found)
        found.update(new)
    return sorted(found)


def axioms_of(s: Store, root: str, included: bool = False, kinds=None) -> DataFrame:
    """The axiom set of an ontology, or of its closure without repeats."""
    if not included:
        return s.axioms(kinds, [root])
    return s.unique_axioms(kinds, members(s, root))


def by_position(s: Store, kind: str, fields: tuple[str, ...], key: str | None = None) -> DataFrame:
    """Axioms of a kind with, for each value in one of the fields, that value; nested occurrences do not count."""
    return s.edges([kind], fields, key=key).select("ont_id", "child_key", F.col("parent_key").alias("axiom_key"))


def contains(s: Store, wanted: DataFrame, ignoring_annotations: bool = False, kinds=None) -> DataFrame:
    """wanted: axiom_key, key_noann. Adds `found`."""
    by = "key_noann" if ignoring_annotations else "axiom_key"
    have = s.axioms(kinds).select(F.col(by).alias("_have")).distinct()
    return wanted.join(have, wanted[by] == have["_have"], "left").select("axiom_key", F.col("_have").isNotNull().alias("found"))


def counts(s: Store, root: str, included: bool = False, logical: bool = False, kinds=None) -> DataFrame:
    """Stored count of each member; the closure's count is their sum, without taking repeats out."""
    a = s.axiom_counts(kinds, members(s, root) if included else [root])
    return (a.where("is_logical") if logical else a).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_axioms"))


def signature(s: Store, kinds=ENTITY_KINDS, onts=None, axiom_kinds=None, columns=("ont_id", "node_kind", "node_key")) -> DataFrame:
    """Distinct columns of (ont_id, node_kind, node_key) of entities anywhere in axioms and ontology annotations. One
    exchange, of the columns asked for."""
    a = s.annotations().where(F.col("node_kind").isin(*kinds)).select("ont_id", "node_kind", "node_key")
    a = a if onts is None else a.where(F.col("ont_id").isin(*onts))
    return s.entities(kinds, axiom_kinds, onts, repeats=True).union(a).select(*columns).distinct()


def entity_iri(key: str = "node_key"):
    """The IRI of an entity's key."""
    return F.regexp_extract(key, r"\(<(.*)>\)$", 1)


def punned(s: Store, onts=None, axiom_kinds=None) -> DataFrame:
    sig = signature(s, onts=onts, axiom_kinds=axiom_kinds, columns=("node_kind", entity_iri().alias("iri")))
    return sig.groupBy("iri").agg(F.count(F.lit(1)).alias("n_kinds")).where("n_kinds > 1")


def referencing(s: Store, key: str, iri: str | None = None, kinds=AXIOM_KINDS) -> DataFrame:
    """Axioms that hold a value at any depth. For an IRI, its literals of type anyURI in data and annotation assertions
    count too."""
    from ..model import BY_KEYWORD

    word = key.partition("(")[0]
    of = [BY_KEYWORD[word].kind] if word in BY_KEYWORD else ["OWLAnonymousIndividual"] if key.startswith("_:") else ["OWLLiteral"] if key.startswith('"') else ["IRI"]
    out = s.reach(kinds, node_kinds=of, key=key).select("ont_id", F.col("root_key").alias("axiom_key"))
    if iri is not None:
        some = [k for k in ("OWLDataPropertyAssertionAxiom", "OWLNegativeDataPropertyAssertionAxiom", "OWLAnnotationAssertionAxiom") if k in kinds]
        lit = s.literals(some).where((F.col("datatype_iri") == XSD + "anyURI") & (F.col("lexical") == iri))
        out = out.union(lit.select("ont_id", F.col("root_key").alias("axiom_key")))
    return out.distinct()


def check_kind(kind: str, *allowed: str) -> None:
    """Arguments of a wrong kind are a TypeError."""
    if kind not in KIND or (allowed and kind not in allowed):
        raise TypeError(f"{kind} is not one of {', '.join(allowed) or 'the kinds'}")
