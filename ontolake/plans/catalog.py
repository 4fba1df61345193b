"""The registered queries over the projected ontologies, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AXIOM_KINDS, ENTITY_KINDS, LOGICAL_KINDS, RDFS, XSD
from ..operators import graph, search, structural
from . import projection as p
from .projection import EX, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a Store, and its SQL."""

    def add(f: Callable[[Store], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Store(spark, sf_dir))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return add


def ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts.items())


def k(*keywords: str) -> list[str]:
    from ..model import BY_KEYWORD

    return [BY_KEYWORD[x].kind for x in keywords]


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def pair_sql(kinds, left: str, right: str, left_name: str = "entity", right_name: str = "result", where: str = "") -> str:
    return ctes(edge=p.edge_sql(kinds, [left, right])) + f"""
SELECT a.ont_id, a.child_key AS {left_name}, b.child_key AS {right_name}
FROM edge a JOIN edge b ON a.ont_id = b.ont_id AND a.parent_key = b.parent_key AND a.parent_kind = b.parent_kind
WHERE a.field = '{left}' AND b.field = '{right}' {where}"""


# Q: ontologies, axiom sets, positions, signatures


@query(ctes(o=p.ontology_sql()) + " SELECT ont_id, ontology_iri, version_iri FROM o")
def ontology_ids(s: Store) -> DataFrame:
    return s.ontologies()


@query(ctes(axiom=p.axiom_sql()) + " SELECT DISTINCT ont_id, axiom_key FROM axiom")
def axioms_direct(s: Store) -> DataFrame:
    return s.unique_axioms(by=("ont_id", "axiom_key")).select("ont_id", "axiom_key")


_CLOSURE = f"""e AS (SELECT ont_id AS src, target AS dst FROM (SELECT * FROM (VALUES {", ".join(f"('{a}', {chr(39) + c + chr(39) if c else 'NULL'})" for a, _, c in p.import_rows())}) t(ont_id, target)) WHERE target IS NOT NULL),
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
closure AS (SELECT src AS root, dst AS member FROM r UNION SELECT ont_id, ont_id FROM (VALUES {", ".join(f"('{o[0]}')" for o in p.ONTOLOGIES)}) t(ont_id))"""


@query("WITH RECURSIVE " + _CLOSURE + " SELECT root, member FROM closure")
def imports_closure(s: Store) -> DataFrame:
    return structural.imports_closure(s)


@query("WITH RECURSIVE " + _CLOSURE + f", axiom AS ({p.axiom_sql()}) SELECT DISTINCT axiom_key FROM axiom JOIN closure ON ont_id = member WHERE root = 'trade'")
def closure_union_distinct(s: Store) -> DataFrame:
    return structural.axioms_of(s, "trade", True).select("axiom_key")


@query(ctes(axiom=p.axiom_sql(k("SubClassOf"))) + " SELECT ont_id, axiom_key FROM axiom")
def axioms_by_type(s: Store) -> DataFrame:
    return s.axioms(k("SubClassOf")).select("ont_id", "axiom_key")


@query(ctes(axiom=p.axiom_sql()) + " SELECT ont_id, axiom_key FROM axiom WHERE is_logical")
def logical_axioms(s: Store) -> DataFrame:
    return s.axioms(LOGICAL_KINDS).select("ont_id", "axiom_key")


@query(ctes(axiom=p.axiom_sql()) + " SELECT kind, count(*) AS n_axioms FROM axiom GROUP BY kind")
def axioms_by_kind(s: Store) -> DataFrame:
    return s.axiom_counts().groupBy("kind").agg(F.sum("n").alias("n_axioms"))


_WANTED = [(f"SubClassOf(Class(<{EX}Customer>) Class(<{EX}Party>))",) * 2, (f"SubClassOf(Class(<{EX}nation/3>) Class(<{EX}region/1>))",) * 2, (f"SubClassOf(Class(<{EX}Party>) Class(<{EX}Customer>))",) * 2, (f'SubClassOf(Annotation(AnnotationProperty(<{RDFS}comment>) "x"^^<{XSD}string>) Class(<{EX}Supplier>) Class(<{EX}Party>))', f"SubClassOf(Class(<{EX}Supplier>) Class(<{EX}Party>))")]
_WANTED_SQL = p.values_sql(_WANTED, "axiom_key string, key_noann string")


@query(ctes(wanted=_WANTED_SQL, axiom=p.axiom_sql(k("SubClassOf"))) + " SELECT axiom_key, EXISTS (SELECT 1 FROM axiom a WHERE a.axiom_key = wanted.axiom_key) AS found FROM wanted")
def contains_axiom(s: Store) -> DataFrame:
    return structural.contains(s, p.local(s.spark, _WANTED, "axiom_key string, key_noann string"), kinds=k("SubClassOf"))


@query(ctes(wanted=_WANTED_SQL, axiom=p.axiom_sql(k("SubClassOf"))) + " SELECT axiom_key, EXISTS (SELECT 1 FROM axiom a WHERE a.key_noann = wanted.key_noann) AS found FROM wanted")
def contains_axiom_ignoring_annotations(s: Store) -> DataFrame:
    return structural.contains(s, p.local(s.spark, _WANTED, "axiom_key string, key_noann string"), True, k("SubClassOf"))


@query(ctes(axiom=p.axiom_sql(k("SubClassOf"))) + " SELECT key_noann, count(*) AS n_variants, min(axiom_key) AS least FROM axiom GROUP BY key_noann HAVING count(*) > 1")
def axioms_ignoring_annotations(s: Store) -> DataFrame:
    """Axioms that are equal but for their annotations, grouped."""
    return s.axioms(k("SubClassOf")).groupBy("key_noann").agg(F.count(F.lit(1)).alias("n_variants"), F.min("axiom_key").alias("least")).where("n_variants > 1")


#: name of the query -> kinds, fields: lookups by direct position
POSITIONS: dict[str, tuple[list[str], tuple[str, ...]]] = {
    "declaration_axioms": (k("Declaration"), ("entity",)),
    "subclass_axioms_for_subclass": (k("SubClassOf"), ("subClass",)),
    "subclass_axioms_for_superclass": (k("SubClassOf"), ("superClass",)),
    "equivalent_classes_axioms": (k("EquivalentClasses"), ("classExpressions",)),
    "disjoint_classes_axioms": (k("DisjointClasses"), ("classExpressions",)),
    "disjoint_union_axioms": (k("DisjointUnion"), ("owlClass",)),
    "object_subproperty_axioms_for_sub": (k("SubObjectPropertyOf"), ("subProperty",)),
    "object_subproperty_axioms_for_super": (k("SubObjectPropertyOf"), ("superProperty",)),
    "object_property_domain_axioms": (k("ObjectPropertyDomain"), ("property",)),
    "object_property_range_axioms": (k("ObjectPropertyRange"), ("property",)),
    "inverse_object_property_axioms": (k("InverseObjectProperties"), ("properties",)),
    "data_subproperty_axioms_for_sub": (k("SubDataPropertyOf"), ("subProperty",)),
    "data_subproperty_axioms_for_super": (k("SubDataPropertyOf"), ("superProperty",)),
    "data_property_domain_axioms": (k("DataPropertyDomain"), ("property",)),
    "data_property_range_axioms": (k("DataPropertyRange"), ("property",)),
    "sub_annotation_property_axioms": (k("SubAnnotationPropertyOf"), ("subProperty",)),
    "annotation_property_domain_axioms": (k("AnnotationPropertyDomain"), ("property",)),
    "annotation_property_range_axioms": (k("AnnotationPropertyRange"), ("property",)),
    "functional_object_property_axioms": (k("FunctionalObjectProperty"), ("property",)),
    "inverse_functional_property_axioms": (k("InverseFunctionalObjectProperty"), ("property",)),
    "symmetric_property_axioms": (k("SymmetricObjectProperty"), ("property",)),
    "asymmetric_property_axioms": (k("AsymmetricObjectProperty"), ("property",)),
    "reflexive_property_axioms": (k("ReflexiveObjectProperty"), ("property",)),
    "irreflexive_property_axioms": (k("IrreflexiveObjectProperty"), ("property",)),
    "transitive_property_axioms": (k("TransitiveObjectProperty"), ("property",)),
    "functional_data_property_axioms": (k("FunctionalDataProperty"), ("property",)),
    "negative_object_assertion_axioms": (k("NegativeObjectPropertyAssertion"), ("subject",)),
    "negative_data_assertion_axioms": (k("NegativeDataPropertyAssertion"), ("subject",)),
    "same_individual_axioms": (k("SameIndividual"), ("individuals",)),
    "different_individuals_axioms": (k("DifferentIndividuals"), ("individuals",)),
    "has_key_axioms": (k("HasKey"), ("classExpression",)),
    "datatype_definition_axioms": (k("DatatypeDefinition"), ("datatype",)),
    "class_assertion_axioms_of_individual": (k("ClassAssertion"), ("individual",)),
    "class_assertion_axioms_of_class": (k("ClassAssertion"), ("classExpression",)),
    "object_property_assertion_axioms": (k("ObjectPropertyAssertion"), ("subject",)),
    "data_property_assertion_axioms": (k("DataPropertyAssertion"), ("subject",)),
    "annotation_assertion_axioms": (k("AnnotationAssertion"), ("subject",)),
}
for _name, (_kinds, _fields) in POSITIONS.items():
    query(ctes(edge=p.edge_sql(_kinds, _fields)) + " SELECT ont_id, child_key, parent_key AS axiom_key FROM edge", _name)(lambda s, kinds=_kinds, fields=_fields: structural.by_position(s, kinds[0], fields))

@query(ctes(i=p.import_sql()) + " SELECT ont_id, import_iri FROM i")
def imports_declarations(s: Store) -> DataFrame:
    return s.imports().select("ont_id", "import_iri")


@query(ctes(a=p.annot_sql()) + " SELECT DISTINCT ont_id, ann_key FROM a")
def ontology_annotations(s: Store) -> DataFrame:
    return s.annotations().select("ont_id", "ann_key").distinct()


def _signature_sql(kinds, node_kinds) -> str:
    return ctes(reach=p.reach_sql(kinds), ann=p.annot_sql(), sig=f"SELECT DISTINCT ont_id, node_kind, node_key FROM (SELECT ont_id, node_kind, node_key FROM reach UNION ALL SELECT ont_id, node_kind, node_key FROM ann) WHERE node_kind IN ({quoted(node_kinds)})")


for _kind, _name in (("OWLClass", "classes"), ("OWLObjectProperty", "object_properties"), ("OWLDataProperty", "data_properties"), ("OWLAnnotationProperty", "annotation_properties"), ("OWLNamedIndividual", "individuals"), ("OWLDatatype", "datatypes")):
    query(_signature_sql(AXIOM_KINDS, [_kind]) + " SELECT ont_id, node_key FROM sig", f"{_name}_in_signature")(lambda s, kind=_kind: structural.signature(s, [kind], axiom_kinds=AXIOM_KINDS).select("ont_id", "node_key"))


@query(_signature_sql(AXIOM_KINDS, ENTITY_KINDS) + " SELECT node_kind, count(DISTINCT node_key) AS n_entities FROM sig GROUP BY node_kind")
def signature_by_kind(s: Store) -> DataFrame:
    return structural.signature(s, columns=("node_kind", "node_key")).groupBy("node_kind").agg(F.count(F.lit(1)).alias("n_entities"))


@query(_signature_sql(AXIOM_KINDS, ENTITY_KINDS) + f" SELECT DISTINCT node_kind, node_key FROM sig WHERE node_key LIKE '%(<{EX}source>)'")
def entities_in_signature(s: Store) -> DataFrame:
    """Entities of every kind that share one IRI."""
    return structural.signature(s).where(structural.entity_iri() == EX + "source").select("node_kind", "node_key").distinct()


@query(_signature_sql(AXIOM_KINDS, ENTITY_KINDS) + f", w AS ({p.values_sql([(f'Class(<{EX}Party>)',), (f'Class(<{EX}alice>)',), (f'NamedIndividual(<{EX}customer/9>)',)], 'node_key string')}) SELECT node_key, EXISTS (SELECT 1 FROM sig WHERE sig.node_key = w.node_key) AS found FROM w")
def contains_entity(s: Store) -> DataFrame:
    w = p.local(s.spark, [(f"Class(<{EX}Party>)",), (f"Class(<{EX}alice>)",), (f"NamedIndividual(<{EX}customer/9>)",)], "node_key string")
    have = structural.signature(s).select(F.col("node_key").alias("have")).join(F.broadcast(w), F.col("have") == F.col("node_key"), "left_semi").distinct()
    return w.join(have, F.col("node_key") == F.col("have"), "left").select("node_key", F.col("have").isNotNull().alias("found"))


@query(_signature_sql(AXIOM_KINDS, ENTITY_KINDS) + r" SELECT regexp_extract(node_key, '\(<(.*)>\)$', 1) AS iri, count(DISTINCT node_kind) AS n_kinds FROM sig GROUP BY 1 HAVING count(DISTINCT node_kind) > 1")
def punned_iris(s: Store) -> DataFrame:
    return structural.punned(s)


@query(ctes(reach=p.reach_sql()) + " SELECT DISTINCT ont_id, node_key FROM reach WHERE node_kind = 'OWLAnonymousIndividual'")
def referenced_anonymous_individuals(s: Store) -> DataFrame:
    return structural.signature(s, ["OWLAnonymousIndividual"]).select("ont_id", "node_key")


@query(ctes(reach=p.reach_sql(LOGICAL_KINDS)) + f" SELECT DISTINCT ont_id, root_key AS axiom_key FROM reach WHERE node_key = 'Class(<{EX}nation/7>)'")
def referencing_axioms_entity(s: Store) -> DataFrame:
    return structural.referencing(s, f"Class(<{EX}nation/7>)", kinds=LOGICAL_KINDS)


_ANY = k("DataPropertyAssertion", "NegativeDataPropertyAssertion", "AnnotationAssertion")


@query(ctes(reach=p.reach_sql(AXIOM_KINDS, ["schema", "text"]), lit=p.literal_sql(_ANY)) + f" SELECT ont_id, root_key AS axiom_key FROM reach WHERE node_key = '<{EX}alice>' UNION SELECT ont_id, root_key FROM lit WHERE datatype_iri = '{XSD}anyURI' AND lexical = '{EX}alice'")
def referencing_axioms_anyuri(s: Store) -> DataFrame:
    """Axioms that refer to an IRI, literals of type anyURI included."""
    return structural.referencing(s, f"<{EX}alice>", EX + "alice", AXIOM_KINDS)


@query(ctes(lit=p.literal_sql(k("AnnotationAssertion"))) + f" SELECT lexical AS iri, count(*) AS n_axioms FROM lit WHERE datatype_iri = '{XSD}anyURI' GROUP BY lexical")
def anyuri_references(s: Store) -> DataFrame:
    """How many annotation assertions refer to each IRI by an anyURI literal."""
    return s.literals(k("AnnotationAssertion")).where(F.col("datatype_iri") == XSD + "anyURI").groupBy(F.col("lexical").alias("iri")).agg(F.count(F.lit(1)).alias("n_axioms"))


@query(ctes(reach=p.reach_sql(AXIOM_KINDS), one="SELECT ont_id, root_kind, root_key, node_kind, count(DISTINCT node_key) AS n FROM reach GROUP BY ont_id, root_kind, root_key, node_kind") + " SELECT ont_id, root_kind, node_kind, count(*) AS n_axioms, CAST(sum(n) AS BIGINT) AS n_nodes, max(n) AS most FROM one GROUP BY ont_id, root_kind, node_kind")
def structural_traversal(s: Store) -> DataFrame:
    """Distinct nodes inside each axiom, by kind; summed over the axioms of a kind of each ontology. What is inside an axiom of a
    table is known from the branch, so its axioms are only counted."""
    found, rest = s.reach_parts(AXIOM_KINDS)
    one = rest.groupBy("ont_id", "root_kind", "root_key", "node_kind").agg(F.countDistinct("node_key").alias("n"))
    out = one.groupBy("ont_id", "root_kind", "node_kind").agg(F.count(F.lit(1)).alias("n_axioms"), F.sum("n").alias("n_nodes"), F.max("n").alias("most"))
    for x in found:
        b, by = x.branch, {}
        for key, kind, _ in p.inside(b):
            by.setdefault(kind, []).append(key)
        counts = {kind: s.distinct_count(x, keys) for kind, keys in by.items()}
        whole = x.rows.agg(F.count(F.lit(1)).alias("n_axioms"), *(F.expr(f"{f}(CAST({c} AS BIGINT))").alias(f"{f}_{kind}") for kind, c in counts.items() for f in ("sum", "max"))).where("n_axioms > 0")
        rows = ", ".join(f"struct('{b.ont}' AS ont_id, '{b.kind}' AS root_kind, '{kind}' AS node_kind, n_axioms, sum_{kind} AS n_nodes, max_{kind} AS most)" for kind in counts)
        out = out.union(whole.select(F.expr(f"inline(array({rows}))")))
    return out.groupBy("ont_id", "root_kind", "node_kind").agg(F.sum("n_axioms").alias("n_axioms"), F.sum("n_nodes").alias("n_nodes"), F.max("most").alias("most"))


# E: asserted search

query(pair_sql(k("SubClassOf"), "subClass", "superClass", where="AND a.child_kind = 'OWLClass'"), "super_classes")(search.super_classes)
query(pair_sql(k("SubClassOf"), "superClass", "subClass", where="AND a.child_kind = 'OWLClass'"), "sub_classes")(search.sub_classes)
_MEMBERS = " SELECT a.ont_id, a.child_key AS entity, b.child_key AS result FROM edge a JOIN edge b ON a.ont_id = b.ont_id AND a.parent_key = b.parent_key WHERE a.child_kind = 'OWLClass'"
query(ctes(edge=p.edge_sql(k("EquivalentClasses"), ["classExpressions"])) + _MEMBERS + " AND a.child_key <> b.child_key", "equivalent_classes_excl_self")(search.equivalent_classes)
query(ctes(edge=p.edge_sql(k("DisjointClasses"), ["classExpressions"])) + _MEMBERS, "disjoint_classes_incl_self")(search.disjoint_classes)
query(pair_sql(search.FAMILY["sub"], "superProperty", "subProperty"), "sub_properties")(search.sub_properties)
query(pair_sql(search.FAMILY["sub"], "subProperty", "superProperty"), "super_properties")(search.super_properties)
query(pair_sql(search.FAMILY["domain"], "property", "domain"), "domains")(search.domains)
query(pair_sql(search.FAMILY["range"], "property", "range"), "ranges")(search.ranges)
query(ctes(edge=p.edge_sql(k("InverseObjectProperties"), ["properties"])) + " SELECT a.ont_id, a.child_key AS entity, b.child_key AS result FROM edge a JOIN edge b ON a.ont_id = b.ont_id AND a.parent_key = b.parent_key WHERE a.ord <> b.ord AND (a.child_key <> b.child_key OR a.ord < b.ord)", "inverses")(search.inverses)
for _c, _kinds in search.CHARACTERISTICS.items():
    query(ctes(edge=p.edge_sql(_kinds, ["property"])) + " SELECT DISTINCT child_key AS entity FROM edge", f"is_{_c}")(lambda s, c=_c: search.characteristic(s, c))


@query(ctes(edge=p.edge_sql(k("AnnotationAssertion"))) + f""" SELECT s.ont_id, s.child_key AS subject_key, q.child_key AS property_key, v.child_key AS value_key
FROM edge s JOIN edge q ON s.ont_id = q.ont_id AND s.parent_key = q.parent_key JOIN edge v ON s.ont_id = v.ont_id AND s.parent_key = v.parent_key
WHERE s.field = 'subject' AND q.field = 'property' AND v.field = 'value' AND q.child_key = 'AnnotationProperty(<{EX}quality>)'""")
def annotation_objects(s: Store) -> DataFrame:
    return search.annotation_objects(s, f"AnnotationProperty(<{EX}quality>)")


_ALL_ANN = ctes(edge=p.edge_sql(k("AnnotationAssertion"), nested=True), nested=p.edge_sql(["OWLAnnotation"], nested=True)) + """,
own AS (SELECT s.parent_key AS axiom_key, s.child_key AS subject_key, q.child_key AS property_key, v.child_key AS value_key
  FROM edge s JOIN edge q ON s.parent_key = q.parent_key JOIN edge v ON s.parent_key = v.parent_key
  WHERE s.field = 'subject' AND q.field = 'property' AND v.field = 'value' AND s.in_axiom AND q.in_axiom AND v.in_axiom),
more AS (SELECT own.subject_key, q.child_key AS property_key, v.child_key AS value_key
  FROM own JOIN edge a ON a.parent_key = own.axiom_key AND a.field = 'annotations'
  JOIN nested q ON q.parent_key = a.child_key AND q.field = 'property' JOIN nested v ON v.parent_key = a.child_key AND v.field = 'value')
SELECT subject_key, property_key, value_key FROM own UNION SELECT subject_key, property_key, value_key FROM more"""


@query(_ALL_ANN)
def annotations_with_nested(s: Store) -> DataFrame:
    """Annotations of each subject: what assertions say, and the assertions' own annotations besides."""
    own = s.rows(k("AnnotationAssertion"), ["subject", "property", "value"])
    at = lambda f: F.max(F.when(F.col("field") == f, F.col("child_key")))
    parts = s.edges(["OWLAnnotation"], ["property", "value"], nested=True).groupBy(F.col("parent_key").alias("ann")).agg(at("property").alias("property_key"), at("value").alias("value_key"))
    nested = s.edges(k("AnnotationAssertion"), ["annotations"]).select(F.col("parent_key").alias("axiom_key"), F.col("child_key").alias("ann"))
    more = nested.join(own.select("axiom_key", "subject_key"), "axiom_key").join(parts, "ann")
    return own.select("subject_key", "property_key", "value_key").union(more.select("subject_key", "property_key", "value_key")).distinct()


# A: aggregations

_COUNT = "WITH RECURSIVE " + _CLOSURE + ", axiom AS ({}) SELECT count(*) AS n_axioms FROM axiom JOIN closure ON ont_id = member WHERE root = 'trade'"


@query(_COUNT.format(p.axiom_sql()))
def axiom_count_closure(s: Store) -> DataFrame:
    return structural.counts(s, "trade", True)


@query(_COUNT.format(p.axiom_sql(LOGICAL_KINDS)))
def logical_axiom_count_closure(s: Store) -> DataFrame:
    return structural.counts(s, "trade", True, kinds=LOGICAL_KINDS)


@query(ctes(axiom=p.axiom_sql()) + " SELECT ont_id, count(*) AS n_axioms, sum(CASE WHEN is_logical THEN 1 ELSE 0 END) AS n_logical FROM axiom GROUP BY ont_id")
def axiom_counts(s: Store) -> DataFrame:
    return s.axiom_counts().groupBy("ont_id").agg(F.sum("n").alias("n_axioms"), F.sum(F.when(F.col("is_logical"), F.col("n")).otherwise(0)).alias("n_logical"))


@query(ctes(edge=p.edge_sql(k("ClassAssertion"), ["classExpression"])) + " SELECT child_key, count(*) AS n_axioms FROM edge GROUP BY child_key")
def positions_grouped(s: Store) -> DataFrame:
    """The inverted index of one position: axioms for each value."""
    return s.edges(k("ClassAssertion"), ["classExpression"]).groupBy("child_key").agg(F.count(F.lit(1)).alias("n_axioms"))


@query(ctes(edge=p.edge_sql(k("AnnotationAssertion"), ["property", "subject"])) + " SELECT q.child_key AS property_key, count(DISTINCT s.child_key) AS n_subjects, count(*) AS n_annotations FROM edge s JOIN edge q ON s.ont_id = q.ont_id AND s.parent_key = q.parent_key WHERE s.field = 'subject' AND q.field = 'property' GROUP BY q.child_key")
def annotations_grouped(s: Store) -> DataFrame:
    return s.pairs(k("AnnotationAssertion"), "property", "subject").groupBy(F.col("left_key").alias("property_key")).agg(F.countDistinct("right_key").alias("n_subjects"), F.count(F.lit(1)).alias("n_annotations"))


@query(ctes(n=p.node_sql()) + " SELECT kind, count(*) AS n_nodes, max(height) AS max_height FROM n GROUP BY kind")
def node_heights(s: Store) -> DataFrame:
    return s.nodes().groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("height").alias("max_height"))


@query(ctes(reach=p.reach_sql(k("ObjectPropertyAssertion"))) + " SELECT node_key, count(*) AS n_edges FROM reach WHERE node_kind = 'OWLAnonymousIndividual' GROUP BY node_key")
def anonymous_edge_counts(s: Store) -> DataFrame:
    return s.reach(k("ObjectPropertyAssertion")).where("node_kind = 'OWLAnonymousIndividual'").groupBy("node_key").agg(F.count(F.lit(1)).alias("n_edges"))


@query(ctes(edge=p.edge_sql(k("DatatypeDefinition"), ["datatype"])) + " SELECT child_key, count(DISTINCT parent_key) AS n_definitions FROM edge GROUP BY child_key")
def datatype_definition_counts(s: Store) -> DataFrame:
    return s.edges(k("DatatypeDefinition"), ["datatype"]).groupBy("child_key").agg(F.countDistinct("parent_key").alias("n_definitions"))


# G: fixed points


def _edges_up(s: Store) -> DataFrame:
    sub = s.pairs(k("SubClassOf"), "subClass", "superClass").where("left_kind = 'OWLClass' AND right_kind = 'OWLClass'")
    return sub.select(F.col("left_key").alias("src"), F.col("right_key").alias("dst"))


_UP = f"""WITH RECURSIVE edge AS ({p.edge_sql(k('SubClassOf'), ['subClass', 'superClass'])}),
up AS (SELECT DISTINCT a.child_key AS src, b.child_key AS dst FROM edge a JOIN edge b ON a.parent_key = b.parent_key WHERE a.field = 'subClass' AND b.field = 'superClass' AND a.child_kind = 'OWLClass' AND b.child_kind = 'OWLClass'),
r(src, dst) AS (SELECT src, dst FROM up UNION SELECT r.src, up.dst FROM r JOIN up ON r.dst = up.src)"""


@query(_UP + " SELECT src AS sub, dst AS sup FROM r")
def class_hierarchy(s: Store) -> DataFrame:
    return graph.reachable(_edges_up(s)).select(F.col("src").alias("sub"), F.col("dst").alias("sup"))


_ASSERT = p.edge_sql(k("ClassAssertion"), ["classExpression", "individual"])


@query(_UP + f", c AS ({_ASSERT}), m AS (SELECT DISTINCT b.child_key AS sub, a.child_key AS cls FROM c a JOIN c b ON a.parent_key = b.parent_key WHERE a.field = 'classExpression' AND b.field = 'individual' AND a.child_kind = 'OWLClass') SELECT sub, cls AS sup FROM m UNION SELECT m.sub, r.dst FROM m JOIN r ON m.cls = r.src UNION SELECT src, dst FROM r")
def class_ancestors(s: Store) -> DataFrame:
    """All classes above every class and individual: the closure of the class graph alone is a fixed point; individuals
    then need one join, whatever their number."""
    up = graph.reachable(_edges_up(s))
    m = s.pairs(k("ClassAssertion"), "classExpression", "individual").where("left_kind = 'OWLClass'").select(F.col("right_key").alias("sub"), F.col("left_key").alias("sup"))
    above = m.join(up, F.col("sup") == F.col("src")).select("sub", F.col("dst").alias("sup"))
    return m.union(above).union(up.select("src", "dst")).distinct()


# U: set operations


@query("WITH RECURSIVE " + _CLOSURE + f", axiom AS ({p.axiom_sql(LOGICAL_KINDS)}) SELECT DISTINCT axiom_key FROM axiom JOIN closure ON ont_id = member WHERE root = 'trade' AND is_logical")
def merge_logical_only(s: Store) -> DataFrame:
    """A merged ontology's logical axioms: direct axioms of all members once, annotations and imports left behind."""
    return structural.axioms_of(s, "trade", True, LOGICAL_KINDS).select("axiom_key")


@query(ctes(axiom=p.axiom_sql(k("Declaration", "SubClassOf"))) + " SELECT axiom_key FROM axiom WHERE ont_id IN ('geo', 'schema')")
def union_all_search(s: Store) -> DataFrame:
    return s.axioms(k("Declaration", "SubClassOf"), ["geo", "schema"]).select("axiom_key")


@query(ctes(a=p.axiom_sql(k("ClassAssertion"))) + " SELECT axiom_key FROM a WHERE ont_id = 'trade' EXCEPT SELECT axiom_key FROM a WHERE ont_id <> 'trade'")
def axiom_difference(s: Store) -> DataFrame:
    # Parts are apart from all other axioms, so only the rest can be on both sides.
    found, rest = s.unique_parts(k("ClassAssertion"))
    out = rest.where("ont_id = 'trade'").select("axiom_key").subtract(rest.where("ont_id <> 'trade'").select("axiom_key"))
    for x in found:
        out = out.union(p.axioms_of(x).select("axiom_key")) if x.branch.ont == "trade" else out
    return out


# P: profile rules

from ..operators import profiles  # noqa: E402

for _rule in profiles.RULES:
    query(_rule.duckdb(), _rule.name)(_rule.spark)

# The rules over the property hierarchy and over datatypes, against what follows from the schema by hand: a list of names, read
# from the rules' definitions and the schema's text, that no code of this package has part in.

from ..operators import hierarchy, positions  # noqa: E402


def _listed(columns: str, rows: list[str]) -> str:
    """SQL of rows written as text, their cells parted by a bar."""
    cells = (", ".join("'" + c.strip().replace("'", "''") + "'" for c in r.split("|")) for r in rows)
    return f"SELECT * FROM (VALUES {', '.join(f'({c})' for c in cells)}) t({columns})"


_NOT_SIMPLE = "partOf locatedIn hasPart trades dealsWith reaches bends loops flips".split()
_BOTH_ENDS = ["ObjectProperty(<http://www.w3.org/2002/07/owl#topObjectProperty>)", "ObjectProperty(<http://www.w3.org/2002/07/owl#bottomObjectProperty>)"]
query(_listed("property", [f"ObjectProperty(<urn:ex:{x}>)" for x in _NOT_SIMPLE] + [f"ObjectInverseOf(ObjectProperty(<urn:ex:{x}>))" for x in _NOT_SIMPLE] + _BOTH_ENDS), "nonsimple_properties")(hierarchy.nonsimple_properties)
query(
    _listed("parent_key, child_key", [
        "ObjectMinCardinality(10 ObjectProperty(<urn:ex:hasPart>) Class(<urn:ex:Product>)) | ObjectProperty(<urn:ex:hasPart>)",
        "FunctionalObjectProperty(ObjectProperty(<urn:ex:reaches>)) | ObjectProperty(<urn:ex:reaches>)",
        "InverseFunctionalObjectProperty(ObjectProperty(<urn:ex:partOf>)) | ObjectProperty(<urn:ex:partOf>)",
        "AsymmetricObjectProperty(ObjectProperty(<urn:ex:hasPart>)) | ObjectProperty(<urn:ex:hasPart>)",
        "AsymmetricObjectProperty(ObjectProperty(<urn:ex:locatedIn>)) | ObjectProperty(<urn:ex:locatedIn>)",
    ]), "nonsimple_uses")(hierarchy.nonsimple_uses)
query(_listed("datatype", ["Datatype(<urn:ex:loopA>)", "Datatype(<urn:ex:loopB>)", "Datatype(<urn:ex:selfish>)"]), "cyclic_datatypes")(hierarchy.cyclic_datatypes)
query(_listed("lower, upper", ["+urn:ex:loops | +urn:ex:bends"]), "irregular_hierarchy")(hierarchy.irregular_hierarchy)
_XSD, _RDF, _OWL = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#"
query(
    _listed("datatype, facet, lexical, value_type, status", [x.replace("xsd:", _XSD).replace("rdf:", _RDF).replace("owl:", _OWL) for x in (
        "xsd:decimal | xsd:minInclusive | 5000 | xsd:decimal | valid",
        "xsd:decimal | xsd:minInclusive | 0 | xsd:decimal | valid",
        "xsd:decimal | xsd:maxExclusive | 1000000 | xsd:decimal | valid",
        "xsd:decimal | xsd:minInclusive | 1/3 | owl:rational | invalid",
        "xsd:decimal | xsd:minInclusive | 1/4 | owl:rational | valid",
        "xsd:byte | xsd:maxInclusive | 300 | xsd:byte | invalid",
        "xsd:byte | xsd:maxInclusive | 300 | xsd:integer | invalid",
        "xsd:string | xsd:length | 5.0 | xsd:decimal | valid",
        "xsd:string | xsd:length | -5 | xsd:integer | invalid",
        "xsd:string | xsd:pattern | a[bc]+ | xsd:string | valid",
        "xsd:string | xsd:pattern | a[ | xsd:string | invalid",
        "rdf:PlainLiteral | rdf:langRange | de-* | xsd:string | invalid",
        "rdf:PlainLiteral | rdf:langRange | de-AT | xsd:string | valid",
        "xsd:dateTimeStamp | xsd:minInclusive | 2024-01-01T00:00:00 | xsd:dateTime | invalid",
        "xsd:dateTimeStamp | xsd:minInclusive | 2024-01-01T00:00:00Z | xsd:dateTime | valid",
        "xsd:double | xsd:minInclusive | 1 | xsd:decimal | invalid",
        "xsd:boolean | xsd:length | 1 | xsd:integer | invalid",
    )]), "facet_statuses")(positions.facet_frame)
query(profiles.FOREST_SQL, "anonymous_forest")(profiles.anonymous_forest)

_TREELESS = "SELECT component, CASE WHEN is_tree THEN 'ANONYMOUS_TREE_WITHOUT_ROOT' ELSE 'ANONYMOUS_GRAPH_NOT_FOREST' END AS code FROM {} WHERE NOT is_tree OR n_named = 0"


@query(f"{_TREELESS.format('(' + profiles.FOREST_SQL + ')')}")
def anonymous_violations(s: Store) -> DataFrame:
    """Components of anonymous individuals that are no trees, and trees that hang on no named individual."""
    return s.spark.sql(_TREELESS.format("{forest}"), forest=profiles.anonymous_forest(s))
query(profiles.EL_CHAIN_SQL, "el_chain_ranges")(profiles.el_chain_ranges)


# C, T: change logs and transformations

from ..functions.literals import DUCKDB, SPARK, escaped, file_extension, java_trim, media_type, normal_cardinality, short_form  # noqa: E402
from ..model import RDF  # noqa: E402
from ..operators import changes  # noqa: E402

_LOG = f"log AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, {changes.LOG} AS axiom_key FROM events)"
_LAST = "SELECT axiom_key, op FROM (SELECT axiom_key, op, row_number() OVER (PARTITION BY axiom_key ORDER BY ts DESC, seq DESC) AS nth FROM {}) WHERE nth = 1"


@query(f"WITH {_LOG}, last AS ({_LAST.format('log')}) SELECT axiom_key FROM last WHERE op = 'add'")
def apply_changes(s: Store) -> DataFrame:
    log = changes.event_log(s)
    return changes.applied(log.select("axiom_key").where("FALSE"), log)


@query(f"WITH {_LOG}, early AS (SELECT * FROM log WHERE seq % 2 = 0), a AS ({_LAST.format('early')}), b AS ({_LAST.format('log')}) SELECT CASE WHEN b.axiom_key IS NULL THEN 'remove' ELSE 'add' END AS op, coalesce(a.axiom_key, b.axiom_key) AS axiom_key FROM (SELECT * FROM a WHERE op = 'add') a FULL OUTER JOIN (SELECT * FROM b WHERE op = 'add') b ON a.axiom_key = b.axiom_key WHERE a.axiom_key IS NULL OR b.axiom_key IS NULL")
def net_changes(s: Store) -> DataFrame:
    """What a commit of the whole log changes against a revision that holds its even entries."""
    log = changes.event_log(s)
    none = log.select("axiom_key").where("FALSE")
    return changes.net_changes(changes.applied(none, log.where("seq % 2 = 0")), changes.applied(none, log))


@query(f"WITH {_LOG}, b AS (SELECT DISTINCT axiom_key FROM log WHERE seq % 7 = 0), x AS (SELECT *, lag(op) OVER (PARTITION BY axiom_key ORDER BY ts, seq) AS before FROM log) SELECT seq, x.axiom_key, op, CASE WHEN (op = 'add') <> CASE WHEN before IS NULL THEN b.axiom_key IS NOT NULL ELSE before = 'add' END THEN 'SUCCESSFULLY' ELSE 'NO_OPERATION' END AS status FROM x LEFT JOIN b ON x.axiom_key = b.axiom_key")
def change_statuses(s: Store) -> DataFrame:
    """Every change of the log, applied one by one to a base that holds some axioms, with what became of it."""
    log = changes.event_log(s)
    return changes.applied_one_by_one(log.where("seq % 7 = 0"), log)


@query(f"WITH {_LOG} SELECT axiom_key, count(*) AS n_changes, sum(CASE WHEN op = 'add' THEN 1 ELSE 0 END) AS n_adds FROM log GROUP BY axiom_key")
def change_counts(s: Store) -> DataFrame:
    return changes.event_log(s).groupBy("axiom_key").agg(F.count(F.lit(1)).alias("n_changes"), F.sum((F.col("op") == "add").cast("int")).alias("n_adds"))


def _rename_sql(old: str, new: str) -> str:
    return f" SELECT 'remove' AS op, axiom_key FROM axiom WHERE position('{old}' IN axiom_key) > 0 UNION SELECT 'add', replace(axiom_key, '{old}', '{new}') FROM axiom WHERE position('{old}' IN axiom_key) > 0"


@query(ctes(axiom=p.axiom_sql(AXIOM_KINDS)) + _rename_sql(f"<{EX}nation/7>", f"<{EX}country/7>"))
def rename_changes(s: Store) -> DataFrame:
    return changes.rename(s.axioms(AXIOM_KINDS), f"{EX}nation/7", f"{EX}country/7")


@query(ctes(axiom=p.axiom_sql(AXIOM_KINDS)) + _rename_sql(f"ObjectProperty(<{EX}source>)", f"ObjectProperty(<{EX}origin>)"))
def rename_changes_typed(s: Store) -> DataFrame:
    """One kind of a punned IRI renamed; the annotation property of that IRI stays."""
    return changes.rename(s.axioms(AXIOM_KINDS), f"{EX}source", f"{EX}origin", "ObjectProperty")


@query(ctes(reach=p.reach_sql(AXIOM_KINDS), edge=p.edge_sql(k("AnnotationAssertion"), ["subject"])) + f" SELECT * FROM (SELECT DISTINCT ont_id, root_key AS axiom_key FROM reach WHERE node_key = 'Class(<{EX}Customer>)') UNION ALL SELECT ont_id, parent_key FROM edge WHERE child_key = '<{EX}Customer>'")
def remove_changes(s: Store) -> DataFrame:
    return changes.removal(s, f"Class(<{EX}Customer>)", f"{EX}Customer", AXIOM_KINDS)


_DUPLICATED = "axiom_key"
for _a, _b in sorted(changes.RENAMED.items()):
    _DUPLICATED = f"replace({_DUPLICATED}, '<{_a}>', '<{_b}>')"


@query(ctes(axiom=p.axiom_sql(AXIOM_KINDS)) + rf" SELECT DISTINCT regexp_replace({_DUPLICATED}, '(_:[^\s()@]+)@schema', '\1@copy', 'g') AS axiom_key FROM axiom")
def duplicate_axioms(s: Store) -> DataFrame:
    return changes.duplicate_of(s, AXIOM_KINDS, changes.RENAMED, "schema", "copy")


@query(ctes(axiom=p.axiom_sql(AXIOM_KINDS)) + " SELECT DISTINCT key_noann FROM axiom")
def axioms_without_annotations(s: Store) -> DataFrame:
    return s.unique_axioms(AXIOM_KINDS, by=("key_noann",)).select("key_noann")


_LABELS = [f"AnnotationProperty(<{RDFS}label>)", f"AnnotationProperty(<{EX}source>)"]
_LANGS = {_LABELS[0]: ["en", "de"]}
_ANN = k("AnnotationAssertion")


def _annotation_values(s: Store) -> DataFrame:
    parts = []
    for b in p.chosen(_ANN, None):
        f = {x.name: x for x in b.fields}
        parts.append(s._rows(b, {"subject_key": f["subject"].key, "property_key": f["property"].key, "value_key": f["value"].key, "value_kind": f"'{f['value'].kind}'", "lexical": f["value"].lexical, "lang": f["value"].language}))
    return s._union([p.local(s.spark, _annotation_rows(), _ANN_SHAPE), *parts], _ANN_SHAPE)


_ANN_SHAPE = "subject_key string, property_key string, value_key string, value_kind string, lexical string, lang string"


def _annotation_rows() -> list[tuple]:
    lit = {n[0]: n for n in p.schema_rows()["node"] if n[1] == "OWLLiteral"}
    at: dict[str, dict[str, tuple[str, str]]] = {}
    for r in p.schema_rows()["edge"]:
        if r[2] == _ANN[0] and r[7]:
            at.setdefault(r[1], {})[r[3]] = (r[5], r[6])
    return [(v["subject"][0], v["property"][0], *v["value"], *(lit[v["value"][0]][3:5] if v["value"][0] in lit else (None, None))) for v in at.values()]


def _ann_sql() -> str:
    parts = [p.values_sql(_annotation_rows(), _ANN_SHAPE)]
    for b in p.chosen(_ANN, None):
        f = {x.name: x for x in b.fields}
        parts.append(f"SELECT {f['subject'].key}, {f['property'].key}, {f['value'].key}, '{f['value'].kind}', {f['value'].lexical}, {f['value'].language} {p._from(b)}")
    return "\nUNION ALL ".join(parts)


def _short_sql(column: str) -> str:
    return short_form(DUCKDB, f"substr({column}, 2, length({column}) - 2)")


@query(
    ctes(a=_ann_sql())
    + f""", r AS (SELECT *, CASE WHEN property_key = '{_LABELS[0]}' THEN 1 ELSE 2 END AS o,
  CASE WHEN value_kind = 'IRI' THEN -2 WHEN property_key = '{_LABELS[0]}' THEN CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 END ELSE 0 END AS rank
  FROM a WHERE property_key IN ('{_LABELS[0]}', '{_LABELS[1]}')),
lit AS (SELECT subject_key, o, lexical AS text, row_number() OVER (PARTITION BY subject_key, o ORDER BY rank, value_key) AS nth FROM r WHERE rank >= 0),
iri AS (SELECT subject_key, o, {_short_sql('value_key')} AS text, row_number() OVER (PARTITION BY subject_key, o ORDER BY value_key DESC) AS nth FROM r WHERE rank = -2),
c AS (SELECT s.subject_key, s.o, coalesce(l.text, i.text) AS text FROM (SELECT DISTINCT subject_key, o FROM r) s LEFT JOIN (SELECT * FROM lit WHERE nth = 1) l USING (subject_key, o) LEFT JOIN (SELECT * FROM iri WHERE nth = 1) i USING (subject_key, o)),
b AS (SELECT subject_key, text, row_number() OVER (PARTITION BY subject_key ORDER BY CASE WHEN text IS NULL THEN 9 ELSE o END) AS nth FROM c)
SELECT subject_key, coalesce(text, {_short_sql('subject_key')}) AS label FROM b WHERE nth = 1"""
)
def preferred_label(s: Store) -> DataFrame:
    return changes.preferred_labels(_annotation_values(s), _LABELS, _LANGS)


@query(ctes(reach=p.reach_sql(AXIOM_KINDS)) + f" SELECT DISTINCT node_key, {short_form(DUCKDB, profiles._IRI)} AS short_form FROM reach WHERE node_kind IN ('OWLClass', 'OWLObjectProperty', 'OWLDatatype')")
def short_forms(s: Store) -> DataFrame:
    r = s.entities(["OWLClass", "OWLObjectProperty", "OWLDatatype"], AXIOM_KINDS).select("node_key").distinct()
    return r.select("node_key", F.expr(short_form(SPARK, profiles._IRI)).alias("short_form"))


@query(f"SELECT page_id, {short_form(DUCKDB, 'url')} AS short_form, {file_extension(DUCKDB, 'url')} AS extension, {media_type(chr(39) + ' Text/HTML; charset=utf-8' + chr(39))} AS media_type FROM pages")
def page_source_hints(s: Store) -> DataFrame:
    """What format selection looks at for each page: the IRI's last name, the file's extension, the media type."""
    return s.table("pages").select("page_id", F.expr(short_form(SPARK, "url")).alias("short_form"), F.expr(file_extension(SPARK, "url")).alias("extension"), F.expr(media_type("' Text/HTML; charset=utf-8'")).alias("media_type"))


@query(f"SELECT doc_id, sha256({java_trim(DUCKDB, escaped('text'))}) AS literal_sha256, length({java_trim(DUCKDB, 'text')}) AS n_trimmed FROM documents")
def literal_texts(s: Store) -> DataFrame:
    """The text of each document as a literal is written: escaped, trimmed as Java trims."""
    return s.table("documents").select("doc_id", F.sha2(F.expr(java_trim(SPARK, escaped("text"))), 256).alias("literal_sha256"), F.expr(f"length({java_trim(SPARK, 'text')})").alias("n_trimmed"))


@query(ctes(n=p.node_sql()) + f" SELECT DISTINCT kind, {normal_cardinality(DUCKDB, chr(39) + '00' + chr(39) + ' || cardinality')} AS cardinality FROM n WHERE cardinality IS NOT NULL")
def cardinalities(s: Store) -> DataFrame:
    return s.nodes().where("cardinality IS NOT NULL").select("kind", F.expr(normal_cardinality(SPARK, "'00' || cardinality")).alias("cardinality")).distinct()


def _type_index_sql() -> str:
    from ..model import TYPE_INDEX

    return "CASE kind " + " ".join(f"WHEN '{x}' THEN {i}" for x, i in TYPE_INDEX.items() if x in AXIOM_KINDS) + " END"


@query(ctes(axiom=p.axiom_sql(AXIOM_KINDS)) + f" SELECT ont_id, axiom_key, row_number() OVER (PARTITION BY ont_id ORDER BY {_type_index_sql()}, axiom_key) AS place FROM axiom")
def display_order(s: Store) -> DataFrame:
    return changes.display_order(s.axioms(AXIOM_KINDS))


# M: RDF

_NAMED = r"^([A-Za-z]+\()?<[^<>]*>\)?$"
_FIXED = {"SubClassOf": ("subClass", "superClass", f"<{RDFS}subClassOf>"), "SubObjectPropertyOf": ("subProperty", "superProperty", f"<{RDFS}subPropertyOf>"), "SubDataPropertyOf": ("subProperty", "superProperty", f"<{RDFS}subPropertyOf>"), "ClassAssertion": ("individual", "classExpression", f"<{RDF}type>"), "ObjectPropertyDomain": ("property", "domain", f"<{RDFS}domain>"), "DataPropertyDomain": ("property", "domain", f"<{RDFS}domain>"), "ObjectPropertyRange": ("property", "range", f"<{RDFS}range>"), "DataPropertyRange": ("property", "range", f"<{RDFS}range>")}


def _plain(x: str) -> str:
    return rf"regexp_replace({x}, '^[A-Za-z]+\((<.*>)\)$', '\1')"


def _triples_sql(onts=None) -> str:
    parts = []
    for kw, (a, b, pred) in _FIXED.items():
        parts.append(f"SELECT {_plain('x.child_key')} AS subject, '{pred}' AS predicate, {_plain('y.child_key')} AS object, x.ont_id AS graph FROM f x JOIN f y ON x.ont_id = y.ont_id AND x.parent_key = y.parent_key WHERE x.parent_kind = '{k(kw)[0]}' AND y.parent_kind = x.parent_kind AND x.field = '{a}' AND y.field = '{b}' AND regexp_matches(x.child_key, '{_NAMED}') AND regexp_matches(y.child_key, '{_NAMED}')")
    parts.append(f"SELECT {_plain('a.child_key')}, {_plain('b.child_key')}, {_plain('c.child_key')}, a.ont_id FROM g a JOIN g b ON a.ont_id = b.ont_id AND a.parent_key = b.parent_key JOIN g c ON a.ont_id = c.ont_id AND a.parent_key = c.parent_key WHERE a.field = 'subject' AND b.field = 'property' AND c.field = 'value'")
    fields = sorted({x for a, b, _ in _FIXED.values() for x in (a, b)})
    return ctes(f=p.edge_sql(k(*_FIXED), fields, onts=onts), g=p.edge_sql(k("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion"), ["property", "subject", "value"], onts=onts), t="\nUNION ".join(parts))


@query(_triples_sql() + " SELECT subject, predicate, object, graph FROM t")
def owl_to_rdf(s: Store) -> DataFrame:
    return changes.triples(s)


@query(_triples_sql() + " SELECT graph, count(*) AS n_triples FROM t GROUP BY graph")
def graph_selection(s: Store) -> DataFrame:
    """Triples of each graph, which graph selection decides by."""
    return changes.triples(s).groupBy("graph").agg(F.count(F.lit(1)).alias("n_triples"))


@query(_triples_sql(["schema", "geo"]) + " SELECT DISTINCT subject, predicate, object FROM t WHERE graph IN ('schema', 'geo')")
def graph_merge(s: Store) -> DataFrame:
    return changes.triples(s, ["schema", "geo"]).select("subject", "predicate", "object").distinct()


@query(_triples_sql(["geo", "trade"]) + f" SELECT 'ClassAssertion(Class(' || object || ') NamedIndividual(' || subject || '))' AS axiom_key FROM t WHERE graph = 'trade' AND predicate = '<{RDF}type>'")
def rdf_to_class_assertions(s: Store) -> DataFrame:
    t = changes.triples(s, ["geo", "trade"]).where((F.col("graph") == "trade") & (F.col("predicate") == f"<{RDF}type>"))
    return t.select(F.concat(F.lit("ClassAssertion(Class("), "object", F.lit(") NamedIndividual("), "subject", F.lit("))")).alias("axiom_key"))


_HEADERS = [("d1", "urn:a:long", "urn:a"), ("d1", "urn:a", "urn:a"), ("d2", "urn:bb", "urn:none"), ("d2", "urn:c", "urn:none"), ("d2", "urn:b", "urn:none"), ("d3", "urn:x", "urn:x")]
_HEADER_SHAPE = "doc string, header string, document_iri string"


@query(ctes(h=p.values_sql(_HEADERS, _HEADER_SHAPE)) + " SELECT doc, header FROM (SELECT doc, header, row_number() OVER (PARTITION BY doc ORDER BY header <> document_iri, length(header), header) AS nth FROM h) WHERE nth = 1")
def header_choice(s: Store) -> DataFrame:
    """Of several headers the document's own, then the shortest, then the first by code point."""
    h = p.local(s.spark, _HEADERS, _HEADER_SHAPE)
    order = F.struct(F.col("header") != F.col("document_iri"), F.length("header"), "header")
    return h.groupBy("doc").agg(F.min_by("header", order).alias("header"))


_CHAIN = "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations"


@query(f"WITH c AS ({_CHAIN}), h AS (SELECT conv_id, min(turn) AS head FROM conversations GROUP BY conv_id) SELECT c.conv_id, CAST(c.turn - h.head AS BIGINT) AS place, c.turn AS item FROM c JOIN h USING (conv_id)")
def rdf_list_members(s: Store) -> DataFrame:
    """Lists as first/rest chains, decoded by pointer doubling: in each round every cell knows what lies twice as far ahead,
    so a list of n cells takes log n rounds."""
    from ..operators.rdf import list_members

    turns = s.table("conversations").select("conv_id", "turn")
    cell = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    after = F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
    have = turns.select(cell.alias("cell"))
    cells = turns.select(cell.alias("cell"), "turn", after.alias("rest"))
    cells = cells.join(have.select(F.col("cell").alias("rest"), F.lit(True).alias("there")), "rest", "left").select("cell", F.col("turn").cast("string").alias("first"), F.when(F.col("there"), F.col("rest")).alias("rest"))
    heads = turns.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("cell"))
    return list_members(cells, heads).select(F.split("head", "/")[0].cast("long").alias("conv_id"), "place", F.col("item").cast("long").alias("item"))


# K: axioms as text; G: locality; P: positions

from ..operators import comparison, locality, positions  # noqa: E402
from ..sources.registry import functional_text  # noqa: E402

_TEXT_KINDS = k("SubClassOf", "ClassAssertion", "SubPropertyChainOf", "EquivalentClasses", "DisjointClasses", "ObjectPropertyDomain", "DataPropertyAssertion")
_WRAP = r"\b(?:Class|Datatype|ObjectProperty|DataProperty|AnnotationProperty|NamedIndividual)\((<[^<>]*>)\)"


@query(ctes(axiom=p.axiom_sql(_TEXT_KINDS)) + rf" SELECT axiom_key, regexp_replace(regexp_replace(regexp_replace(axiom_key, '{_WRAP}', '\1', 'g'), '\bFacetRestriction\((<[^<>]*> \x22(?:[^\x22\\]|\\.)*\x22(?:@[\w-]+|\^\^<[^<>]*>))\)', '\1', 'g'), '\bSubPropertyChainOf\(\(([^()]*)\)', 'SubObjectPropertyOf(ObjectPropertyChain(\1)', 'g') AS text FROM axiom")
def functional_lines(s: Store) -> DataFrame:
    """Axioms in functional notation, by expressions alone."""
    return functional_text(s.axioms(_TEXT_KINDS).select("axiom_key"))


def _pool(s: Store) -> tuple[DataFrame, DataFrame]:
    onts = ["schema", "geo"]
    axioms = functional_text(s.axioms(AXIOM_KINDS, onts).select("axiom_key").distinct())
    scoped = F.regexp_replace("text", r"(_:[^\s()@]+)@[^\s()]*", "$1")
    reach = s.reach(AXIOM_KINDS, onts).where(F.col("node_kind").isin(*ENTITY_KINDS))
    return axioms.withColumn("text", scoped), reach


for _mode in (locality.BOTTOM, locality.TOP, locality.STAR):
    query(None, f"locality_{_mode.lower()}")(lambda s, mode=_mode: locality.module_frame(s.spark, *_pool(s), [f"Class(<{EX}Customer>)"], mode))


@query()
def profile_class_positions(s: Store) -> DataFrame:
    """profile, axiom_key: axioms with a class expression where QL or RL does not admit it."""
    some = k("SubClassOf", "EquivalentClasses", "DisjointClasses", "ObjectPropertyDomain", "DataPropertyDomain", "ObjectPropertyRange", "ClassAssertion", "HasKey")

    def run(batches):
        import pandas as pd

        from ..sources.functional import Reader

        for pdf in batches:
            rows = [(profile, key) for key, text in zip(pdf["axiom_key"], pdf["text"]) for profile in ("QL", "RL") if any(True for _ in positions.class_positions(Reader(text).axiom(), profile))]
            yield pd.DataFrame(rows, columns=["profile", "axiom_key"])

    # Axioms between named classes other than Thing and Nothing stand anywhere; only the others are parsed.
    nested = functional_text(s.axioms(some).select("axiom_key")).where(F.col("axiom_key").rlike(r"(Object|Data)[A-Z]\w+\(|owl#(Thing|Nothing)>"))
    text = F.regexp_replace("text", r"(_:[^\s()@]+)@[^\s()]*", "$1")
    return nested.withColumn("text", text).mapInPandas(run, "profile string, axiom_key string").distinct()


@query(ctes(a=p.axiom_sql(k("ClassAssertion", "SubClassOf"))) + " SELECT CASE WHEN min(side) = 'l' THEN 'left' ELSE 'right' END AS side, axiom_key FROM (SELECT DISTINCT axiom_key, 'l' AS side FROM a WHERE ont_id IN ('trade', 'geo') UNION ALL SELECT DISTINCT axiom_key, 'r' FROM a WHERE ont_id IN ('trade', 'schema')) WHERE NOT regexp_matches(axiom_key, '_:[^\\s()]+') GROUP BY axiom_key HAVING count(*) = 1")
def ontology_difference(s: Store) -> DataFrame:
    """Axioms without anonymous individuals that one of two merged ontologies lacks."""
    kinds = k("ClassAssertion", "SubClassOf")
    return comparison.ground_difference(s.axioms(kinds, ["trade", "geo"]), s.axioms(kinds, ["trade", "schema"]))


@query(ctes(a=p.axiom_sql()) + " SELECT regexp_replace(axiom_key, '_:[^\\s()]+', '_:', 'g') AS fingerprint, count(DISTINCT axiom_key) AS n FROM a WHERE regexp_matches(axiom_key, '_:[^\\s()]+') AND ont_id = 'schema' GROUP BY 1")
def anonymous_fingerprints(s: Store) -> DataFrame:
    return comparison.fingerprints(s.axioms(AXIOM_KINDS, ["schema"]))


# Streaming

from ..streaming import changelog  # noqa: E402


@query(ORACLES["apply_changes"])
def streaming_changes(s: Store) -> DataFrame:
    """The same fold as apply_changes, by a streaming query over the log."""
    return changelog.replay(s.spark, s.dir)


# S: detection

from ..sources import registry  # noqa: E402


def _detect_sql(column: str) -> str:
    found = [f"CASE WHEN regexp_matches(substr({column}, 1, {registry.PREFIX_BYTES}), '{f.match}') THEN '{f.key}' END" for f in sorted(registry.FORMATS, key=lambda f: (f.priority, f.key))]
    return f"concat_ws(',', {', '.join(found)})"


@query(f"SELECT page_id, {_detect_sql('html')} AS formats FROM pages")
def page_formats(s: Store) -> DataFrame:
    """Ontology formats that each page could be, by its first characters."""
    return registry.detected(s.table("pages"), "html").select("page_id", "formats")


_SAMPLES = [(1, "Prefix(:=<urn:x:>) Ontology()"), (2, "Prefix: : <u:x>\nOntology:"), (3, "<?xml version=''1.0''?><Ontology/>".replace("''", "'")), (4, "<rdf:RDF/>"), (5, "A ⊑ B"), (6, "(implies A B)"), (7, "(define-concept A B)"), (8, "<urn:a> <urn:b> <urn:c> ."), (9, "<urn:a> <urn:b> <urn:c> <urn:g> ."), (10, "@prefix : <urn:x:> ."), (11, '{"@id": "x:y"}'), (12, "<urn:g> { }"), (13, "")]


@query(ctes(t=p.values_sql(_SAMPLES, "id int, text string")) + f" SELECT id, {_detect_sql('text')} AS formats FROM t")
def sample_formats(s: Store) -> DataFrame:
    return registry.detected(p.local(s.spark, _SAMPLES, "id int, text string"), "text").select("id", "formats")


# G, P, O: schema rules and orders

@query(ctes(reach=p.reach_sql(AXIOM_KINDS)) + f" SELECT ont_id, root_key AS axiom_key, count(DISTINCT CASE WHEN node_kind IN ({quoted(ENTITY_KINDS)}) THEN node_key END) AS n_entities, count(DISTINCT node_kind || node_key) + 1 AS n_nodes FROM reach GROUP BY ont_id, root_key")
def locality_vectors(s: Store) -> DataFrame:
    """Entities and nodes of each axiom, which extraction works with. What is inside an axiom of a table is in the row that it is
    made of."""
    entity = F.when(F.col("node_kind").isin(*ENTITY_KINDS), F.col("node_key"))
    found, rest = s.reach_parts(AXIOM_KINDS)
    out = rest.groupBy("ont_id", F.col("root_key").alias("axiom_key")).agg(F.countDistinct(entity).alias("n_entities"), (F.countDistinct(F.concat("node_kind", "node_key")) + 1).alias("n_nodes"))
    for x in found:
        b, own = x.branch, p.inside(x.branch)
        entities = s.distinct_count(x, [key for key, kind, _ in own if kind in ENTITY_KINDS])
        nodes = [s.distinct_count(x, [key for key, kind, _ in own if kind == k_]) for k_ in dict.fromkeys(kind for _, kind, _ in own)]
        columns = {"ont_id": f"'{b.ont}'", "axiom_key": x.over(b.key), "n_entities": f"CAST({entities} AS BIGINT)", "n_nodes": f"CAST({' + '.join(nodes)} + 1 AS BIGINT)"}
        out = out.union(x.rows.select(*(F.expr(e).alias(n) for n, e in columns.items())))
    return out


@query("WITH RECURSIVE " + _CLOSURE + f", o AS ({p.ontology_sql()}) SELECT root, member, row_number() OVER (PARTITION BY root ORDER BY root <> member, ontology_iri, coalesce(version_iri, '')) AS place FROM closure JOIN o ON member = o.ont_id")
def closure_order(s: Store) -> DataFrame:
    """Members of each closure: the root first, then by ontology and version IRI. A window over an ontology's members, of
    which there are as many as documents."""
    from pyspark.sql import Window

    c = structural.imports_closure(s).join(s.ontologies(), F.col("member") == F.col("ont_id"))
    by = Window.partitionBy("root").orderBy(F.col("root") != F.col("member"), "ontology_iri", F.coalesce("version_iri", F.lit("")))
    return c.select("root", "member", F.row_number().over(by).alias("place"))


_PARTS = f"SELECT 'user/' || CAST(user_id AS VARCHAR(20)) AS ont_id, CASE event_id % 4 WHEN 0 THEN 'axiom' WHEN 1 THEN 'import' WHEN 2 THEN 'annotation' ELSE 'id' END AS part, '{EX}event/' || event_type AS key, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 3 THEN 'remove' ELSE 'add' END AS op, ts, event_id AS seq"


@query(f"WITH log AS ({_PARTS} FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY ont_id, part, key ORDER BY ts DESC, seq DESC) AS nth FROM log WHERE part <> 'id'), i AS (SELECT *, row_number() OVER (PARTITION BY ont_id ORDER BY ts DESC, seq DESC) AS nth FROM log WHERE part = 'id') SELECT ont_id, part, key FROM m WHERE nth = 1 AND op = 'add' UNION ALL SELECT ont_id, part, key FROM i WHERE nth = 1")
def ontology_changes(s: Store) -> DataFrame:
    """Axioms, imports, annotations and ids of many ontologies after one log of all their changes."""
    return changes.ontology_state(s.spark.sql(_PARTS + " FROM {events}", events=s.table("events")))


# S, K, M: readers, writers and the RDF mapping, over documents made of the tables' rows

from . import readers  # noqa: E402

for _key in (*readers.CUSTOMER, *readers.CONCEPTS):
    query(readers.customer_sql(_key), f"read_{_key}")(lambda s, key=_key: readers.read_customers(s, key))
for _key in ("functional", "owlxml", "turtle", "rdfxml"):
    query(readers.customer_sql("functional"), f"write_{_key}")(lambda s, key=_key: readers.read_customers(s, "functional", (key,)))
for _key in ("turtle", "rdfxml"):
    query(readers.nation_sql(), f"owl_to_rdf_and_back_{_key}")(lambda s, key=_key: readers.map_nations(s, (key,)))
query(readers.nation_sql(), "rewrite_in_all_syntaxes")(lambda s: readers.map_nations(s, ("owlxml", "turtle", "functional", "rdfxml")))


# P: the report of a profile

#: rule -> code, for the rules that every profile has; and what EL, QL and RL add.
_DL = {r.name: r.code for r in profiles.RULES if not r.code.startswith("PROFILE_") and not r.name.startswith("literal_status")} | {
    "cyclic_datatypes": "CYCLIC_DATATYPE_DEFINITION", "irregular_hierarchy": "IRREGULAR_PROPERTY_HIERARCHY", "nonsimple_uses": "NONSIMPLE_OBJECT_PROPERTY",
}
_MORE = {
    "DL": (),
    "EL": ("el_forbidden_axioms", "el_ql_datatypes", "data_range_not_allowed", "enumeration_not_singleton", "anonymous_not_allowed", "el_inverse_properties", "el_class_expressions"),
    "QL": ("ql_forbidden_axioms", "el_ql_datatypes", "data_range_not_allowed", "anonymous_not_allowed", "ql_class_assertion_not_atomic"),
    "RL": ("rl_forbidden_axioms", "rl_datatypes", "data_range_not_allowed", "rl_properties"),
}
#: An incomplete import closure alone leaves a profile open; anything else breaks it. So do literals and facets of no or unknown
#: value space.
_REPORTED = [(n, c, f"SELECT 1 FROM {{{n}}}") for n, c in _DL.items()] + [(n, next(r.code for r in profiles.RULES if r.name == n), f"SELECT 1 FROM {{{n}}}") for n in dict.fromkeys(x for m in _MORE.values() for x in m)]
_REPORTED += [(f"literal_status/{x}", f"LITERAL_{x.upper()}", f"SELECT 1 FROM {{literal_status}} WHERE status = '{x}'") for x in ("invalid", "unverified")] + [(f"facet_statuses/{x}", f"FACET_{x.upper()}", f"SELECT 1 FROM {{facet_statuses}} WHERE status = '{x}'") for x in ("invalid", "unverified")]
_REPORTED += [(f"anonymous_violations/{x}", x, f"SELECT 1 FROM {{anonymous_violations}} WHERE code = '{x}'") for x in ("ANONYMOUS_TREE_WITHOUT_ROOT", "ANONYMOUS_GRAPH_NOT_FOREST")]


def _reported(profile: str) -> list[tuple[str, str, str]]:
    special = {n for m in _MORE.values() for n in m}
    return [r for r in _REPORTED if r[0] not in special or r[0] in _MORE[profile]]


def _report_sql(frames: str, profile_of) -> str:
    counts = " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{code}' AS code, count(*) AS n FROM ({text}) x" for rule, code, text in _REPORTED)
    belongs = ", ".join(f"('{p_}', '{rule}')" for p_ in _MORE for rule, _, _ in profile_of(p_))
    open_ = "code = 'IMPORT_CLOSURE_INCOMPLETE' OR code LIKE '%UNVERIFIED'"
    return f"""{frames} SELECT profile, code, sum(n) AS n_findings, CASE WHEN {open_} THEN 'unverified' ELSE 'invalid' END AS weight,
  CASE WHEN sum(CASE WHEN {open_} THEN 0 ELSE sum(n) END) OVER (PARTITION BY profile) > 0 THEN 'invalid' WHEN sum(sum(n)) OVER (PARTITION BY profile) > 0 THEN 'unverified' ELSE 'valid' END AS status
FROM (SELECT * FROM (VALUES {belongs}) b(profile, rule)) b JOIN ({counts}) c USING (rule) GROUP BY profile, code"""


_RULE_NAMES = sorted({n.split("/")[0] for n, _, _ in _REPORTED})
_REPORT_SQL = _report_sql("", _reported)
for _n in _RULE_NAMES:
    _REPORT_SQL = _REPORT_SQL.replace("{" + _n + "}", "(" + ORACLES[_n] + ")")


@query(f"SELECT profile, code, CAST(n_findings AS BIGINT) AS n_findings, weight, status FROM ({_REPORT_SQL})")
def profile_report(s: Store) -> DataFrame:
    """profile, code, n_findings, weight, status: what each rule finds in all ontologies together, for each of the four profiles,
    and the profile's status: invalid if a rule finds anything, else unverified if anything is open, else valid."""
    frames = {n: QUERIES[n](s.spark, s.dir) for n in _RULE_NAMES}
    parts = []
    for rule, code, text in _REPORTED:
        name = rule.split("/")[0]
        parts.append(s.spark.sql(f"SELECT '{rule}' AS rule, '{code}' AS code, count(*) AS n FROM ({text}) x", **{name: frames[name]}))
    counts = parts[0]
    for x in parts[1:]:
        counts = counts.union(x)
    belongs = p.local(s.spark, [(name, rule) for name in _MORE for rule, _, _ in _reported(name)], "profile string, rule string")
    one = belongs.join(counts, "rule").groupBy("profile", "code").agg(F.sum("n").alias("n_findings"))
    one = one.withColumn("weight", F.when((F.col("code") == "IMPORT_CLOSURE_INCOMPLETE") | F.col("code").endswith("UNVERIFIED"), "unverified").otherwise("invalid"))
    whole = one.groupBy("profile").agg(F.sum(F.when(F.col("weight") == "invalid", F.col("n_findings")).otherwise(0)).alias("bad"), F.sum("n_findings").alias("every"))
    status = F.when(F.col("bad") > 0, "invalid").when(F.col("every") > 0, "unverified").otherwise("valid")
    return one.join(whole, "profile").select("profile", "code", "n_findings", "weight", status.alias("status"))
