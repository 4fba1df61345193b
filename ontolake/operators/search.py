"""Asserted search, one step, with bag semantics: what several ontologies say comes back as often as they say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.projection import Store

FAMILY = {
    "sub": ("OWLSubObjectPropertyOfAxiom", "OWLSubDataPropertyOfAxiom", "OWLSubAnnotationPropertyOfAxiom"),
    "domain": ("OWLObjectPropertyDomainAxiom", "OWLDataPropertyDomainAxiom", "OWLAnnotationPropertyDomainAxiom"),
    "range": ("OWLObjectPropertyRangeAxiom", "OWLDataPropertyRangeAxiom", "OWLAnnotationPropertyRangeAxiom"),
}
CHARACTERISTICS = {
    "functional": ("OWLFunctionalObjectPropertyAxiom", "OWLFunctionalDataPropertyAxiom"),
    "inverse_functional": ("OWLInverseFunctionalObjectPropertyAxiom",),
    "transitive": ("OWLTransitiveObjectPropertyAxiom",),
    "symmetric": ("OWLSymmetricObjectPropertyAxiom",),
    "asymmetric": ("OWLAsymmetricObjectPropertyAxiom",),
    "reflexive": ("OWLReflexiveObjectPropertyAxiom",),
    "irreflexive": ("OWLIrreflexiveObjectPropertyAxiom",),
}


def super_classes(s: Store) -> DataFrame:
    """(ont_id, entity, result): the superclasses that axioms give a named class."""
    p = s.pairs(["OWLSubClassOfAxiom"], "subClass", "superClass").where("left_kind = 'OWLClass'")
    return p.select("ont_id", F.col("left_key").alias("entity"), F.col("right_key").alias("result"))


def sub_classes(s: Store) -> DataFrame:
    p = s.pairs(["OWLSubClassOfAxiom"], "subClass", "superClass").where("right_kind = 'OWLClass'")
    return p.select("ont_id", F.col("right_key").alias("entity"), F.col("left_key").alias("result"))


def fellow_members(s: Store, kind: str, field: str, with_self: bool) -> DataFrame:
    """Members of the n-ary axioms that hold an entity, itself left out or kept. The members of an axiom sit in one array
    first, so that pairing them is an explode of the axiom's row and not a join of all axioms."""
    m = s.edges([kind], [field]).groupBy("ont_id", "parent_key").agg(F.collect_list(F.struct("ord", "child_key", "child_kind")).alias("ms"))
    x = m.select("ont_id", "ms", F.explode("ms").alias("a")).select("ont_id", "a", F.explode("ms").alias("b"))
    x = x.where("a.child_kind = 'OWLClass'")
    return (x if with_self else x.where("a.child_key <> b.child_key")).select("ont_id", F.col("a.child_key").alias("entity"), F.col("b.child_key").alias("result"))


def equivalent_classes(s: Store) -> DataFrame:
    return fellow_members(s, "OWLEquivalentClassesAxiom", "classExpressions", with_self=False)


def disjoint_classes(s: Store) -> DataFrame:
    return fellow_members(s, "OWLDisjointClassesAxiom", "classExpressions", with_self=True)


def sub_properties(s: Store) -> DataFrame:
    p = s.pairs(FAMILY["sub"], "subProperty", "superProperty")
    return p.select("ont_id", F.col("right_key").alias("entity"), F.col("left_key").alias("result"))


def super_properties(s: Store) -> DataFrame:
    p = s.pairs(FAMILY["sub"], "subProperty", "superProperty")
    return p.select("ont_id", F.col("left_key").alias("entity"), F.col("right_key").alias("result"))


def domains(s: Store) -> DataFrame:
    p = s.pairs(FAMILY["domain"], "property", "domain")
    return p.select("ont_id", F.col("left_key").alias("entity"), F.col("right_key").alias("result"))


def ranges(s: Store) -> DataFrame:
    p = s.pairs(FAMILY["range"], "property", "range")
    return p.select("ont_id", F.col("left_key").alias("entity"), F.col("right_key").alias("result"))


def inverses(s: Store) -> DataFrame:
    """The other end; a property that is its own inverse gives itself."""
    m = s.edges(["OWLInverseObjectPropertiesAxiom"], ["properties"]).groupBy("ont_id", "parent_key").agg(F.min_by("child_key", "ord").alias("a"), F.max_by("child_key", "ord").alias("b"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return m.select("ont_id", F.explode(ends).alias("x")).select("ont_id", F.col("x.a").alias("entity"), F.col("x.b").alias("result"))


def characteristic(s: Store, name: str) -> DataFrame:
    """Properties that some ontology says have a characteristic."""
    return s.edges(CHARACTERISTICS[name], ["property"]).select(F.col("child_key").alias("entity")).distinct()


def annotation_objects(s: Store, prop: str | None = None) -> DataFrame:
    """(ont_id, subject_key, property_key, value_key) of annotation assertions, for one property or all."""
    out = s.rows(["OWLAnnotationAssertionAxiom"], ["subject", "property", "value"])
    return (out.where(F.col("property_key") == prop) if prop else out).select("ont_id", "subject_key", "property_key", "value_key")
