"""Profile rules: one statement a rule, over the frames of a Store. `{edge}`, `{reach}` and so on stand for frames; the
same text, with the frames as common table expressions, is the rule's SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions.literals import ABSOLUTE_IRI, DUCKDB, SPARK, Dialect, status
from ..model import AT_LEAST_TWO, AXIOM_KINDS, BUILTINS, BY_KEYWORD, DATATYPES, ENTITY_KINDS, KINDS, OWL, RDF, RDFS, XSD
from ..plans import projection as p
from ..plans.projection import Store
from .graph import components, reachable


class Rule(NamedTuple):
    name: str
    code: str
    sql: Callable[[Dialect], str]
    frames: dict[str, tuple[Callable[[Store], DataFrame], str]]

    def spark(self, s: Store) -> DataFrame:
        return s.spark.sql(self.sql(SPARK), **{n: f(s) for n, (f, _) in self.frames.items()})

    def duckdb(self) -> str:
        text = self.sql(DUCKDB)
        for n in self.frames:
            text = text.replace("{" + n + "}", n)
        return "WITH " + ",\n".join(f"{n} AS ({q})" for n, (_, q) in self.frames.items()) + "\n" + text.replace("{{", "{").replace("}}", "}")


def kinds(*keywords: str) -> list[str]:
    return [BY_KEYWORD[k].kind for k in keywords]


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def edge(some=None, fields=None, nested: bool = False, onts=None):
    return (lambda s: s.edges(some, fields, onts, nested)), p.edge_sql(some, fields, nested, onts)


def reach(some=None, onts=None):
    return (lambda s: s.reach(some, onts)), p.reach_sql(some, onts)


def sig(node_kinds):
    """Objects of some kinds, where only they matter and not the axioms they are in."""
    return (lambda s: s.entities(node_kinds, AXIOM_KINDS)), p.reach_sql(AXIOM_KINDS)


def within(node_kinds):
    return (lambda s: s.reach(AXIOM_KINDS, node_kinds=node_kinds)), p.reach_sql(AXIOM_KINDS)


def literal(some=None):
    return (lambda s: s.literals(some)), p.literal_sql(some)


def axiom(some=None):
    return (lambda s: s.axioms(some)), p.axiom_sql(some)


RESERVED = (OWL, RDF, RDFS, XSD)
_ENTITY = f"node_kind IN ({quoted(ENTITY_KINDS)})"


def _reserved(x: str) -> str:
    return "(" + " OR ".join(f"{x} LIKE '{ns}%'" for ns in RESERVED) + ")"


def _builtin_rows() -> list[tuple[str, str]]:
    return [(k, f"{next(x.keyword for x in KINDS if x.kind == k)}(<{i}>)") for k, iris in sorted(BUILTINS.items()) for i in sorted(iris)]


_BUILTIN = ((lambda s: p.local(s.spark, _builtin_rows(), "kind string, entity string")), p.values_sql(_builtin_rows(), "kind string, entity string"))
_IMPORTS = ((lambda s: s.imports()), p.import_sql())
_ONTOLOGIES = ((lambda s: s.ontologies()), p.ontology_sql())




_SETS = " OR ".join(f"(parent_kind = '{BY_KEYWORD[k].kind}' AND field = '{f}')" for k, f in AT_LEAST_TWO.items())
_CATEGORIES = ("OWLObjectProperty", "OWLDataProperty", "OWLAnnotationProperty")
_IRI = "substr(node_key, position('(<' IN node_key) + 2, length(node_key) - position('(<' IN node_key) - 3)"
_EL_RANGES = [d.iri for d in DATATYPES if d.el_ql]
_RL_RANGES = [d.iri for d in DATATYPES if d.rl]
_EL_CLASSES = kinds("Class", "ObjectIntersectionOf", "ObjectOneOf", "ObjectSomeValuesFrom", "ObjectHasValue", "ObjectHasSelf", "DataSomeValuesFrom", "DataHasValue")
_CLASS_KINDS = [k.kind for k in KINDS if k.category == "class"]


def _same(text: str) -> Callable[[Dialect], str]:
    return lambda d: text


def _forbidden(profile: str) -> list[str]:
    return [k.kind for k in KINDS if profile in k.forbidden.split()]


RULES: tuple[Rule, ...] = (
    Rule("import_closure_incomplete", "IMPORT_CLOSURE_INCOMPLETE", _same("SELECT ont_id, import_iri FROM {imports} WHERE target IS NULL"), {"imports": _IMPORTS}),
    Rule("reserved_ontology_iri", "RESERVED_ONTOLOGY_IRI", _same(f"SELECT ont_id FROM {{onts}} WHERE {_reserved('ontology_iri')} OR {_reserved('version_iri')}"), {"onts": _ONTOLOGIES}),
    Rule("iri_invalid", "IRI_INVALID", lambda d: f"SELECT DISTINCT node_kind, node_key FROM {{reach}} WHERE {_ENTITY} AND NOT {d.match(_IRI, ABSOLUTE_IRI.replace('{', '{{').replace('}', '}}'))}", {"reach": sig(ENTITY_KINDS)}),
    Rule("reserved_iris", "RESERVED_ENTITY_IRI", _same(f"SELECT DISTINCT node_kind, node_key FROM {{reach}} WHERE {_ENTITY} AND {_reserved(_IRI)} AND NOT EXISTS (SELECT 1 FROM {{builtin}} b WHERE b.entity = node_key)"), {"reach": sig(ENTITY_KINDS), "builtin": _BUILTIN}),
    Rule(
        "anonymous_individual_position", "ANONYMOUS_INDIVIDUAL_POSITION",
        _same("SELECT DISTINCT root_key AS parent_key, node_key FROM {reach} WHERE node_kind = 'OWLAnonymousIndividual' UNION SELECT DISTINCT parent_key, child_key FROM {edge} WHERE child_kind = 'OWLAnonymousIndividual'"),
        {"reach": reach(kinds("SameIndividual", "DifferentIndividuals", "NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion")), "edge": edge(kinds("ObjectOneOf", "ObjectHasValue"), nested=True)},
    ),
    Rule("set_arity", "SET_CONSTRUCTOR_ARITY", _same(f"SELECT parent_kind, parent_key, count(*) AS n_members FROM {{edge}} WHERE {_SETS} GROUP BY ont_id, parent_kind, parent_key HAVING count(*) < 2"), {"edge": edge(kinds(*AT_LEAST_TWO), list(set(AT_LEAST_TWO.values())), nested=True)}),
    Rule("top_data_property_position", "TOP_DATA_PROPERTY_POSITION", _same(f"SELECT parent_kind, parent_key FROM {{edge}} WHERE child_key = 'DataProperty(<{OWL}topDataProperty>)' AND NOT (parent_kind = 'OWLSubDataPropertyOfAxiom' AND field = 'superProperty')"), {"edge": edge(None, ["property", "properties", "subProperty", "superProperty", "dataProperties"], nested=True)}),
    Rule("data_range_arity", "DATA_RANGE_ARITY", _same("SELECT parent_key, count(*) AS n_properties FROM {edge} GROUP BY parent_key HAVING count(*) > 1"), {"edge": edge(kinds("DataSomeValuesFrom", "DataAllValuesFrom"), ["properties"], nested=True)}),
    Rule("category_collisions", "PROPERTY_CATEGORY_COLLISION", _same(f"SELECT {_IRI} AS iri, count(DISTINCT node_kind) AS n_categories FROM {{reach}} WHERE node_kind IN ({quoted(_CATEGORIES)}) GROUP BY {_IRI} HAVING count(DISTINCT node_kind) > 1"), {"reach": sig(_CATEGORIES)}),
    Rule("class_datatype_collision", "CLASS_DATATYPE_COLLISION", _same(f"SELECT {_IRI} AS iri FROM {{reach}} WHERE node_kind IN ('OWLClass', 'OWLDatatype') GROUP BY {_IRI} HAVING count(DISTINCT node_kind) > 1"), {"reach": sig(("OWLClass", "OWLDatatype"))}),
    Rule(
        "datatype_definition_count", "DATATYPE_DEFINITION_COUNT",
        _same("SELECT u.node_key, count(DISTINCT d.parent_key) AS n_definitions FROM (SELECT DISTINCT node_key FROM {reach} WHERE node_kind = 'OWLDatatype') u LEFT JOIN {defined} d ON d.child_key = u.node_key LEFT JOIN {builtin} b ON b.entity = u.node_key GROUP BY u.node_key, b.entity HAVING (b.entity IS NULL AND count(DISTINCT d.parent_key) <> 1) OR (b.entity IS NOT NULL AND count(DISTINCT d.parent_key) > 0)"),
        {"reach": sig(("OWLDatatype",)), "defined": edge(kinds("DatatypeDefinition"), ["datatype"]), "builtin": _BUILTIN},
    ),
    Rule(
        "undeclared_entities", "UNDECLARED_ENTITY",
        _same("SELECT DISTINCT ont_id, node_kind, node_key FROM {reach} r WHERE node_kind IN ('OWLClass', 'OWLDatatype', 'OWLObjectProperty', 'OWLDataProperty', 'OWLAnnotationProperty') AND NOT EXISTS (SELECT 1 FROM {builtin} b WHERE b.entity = r.node_key) AND NOT EXISTS (SELECT 1 FROM {declared} d WHERE d.child_key = r.node_key)"),
        {"reach": sig(("OWLClass", "OWLDatatype", "OWLObjectProperty", "OWLDataProperty", "OWLAnnotationProperty")), "declared": edge(kinds("Declaration"), ["entity"]), "builtin": _BUILTIN},
    ),
    Rule("defined_datatype_literal", "DEFINED_DATATYPE_LITERAL", _same("SELECT DISTINCT l.root_key AS axiom_key, l.lexical, l.datatype_iri FROM {literal} l JOIN {defined} d ON d.child_key = 'Datatype(<' || l.datatype_iri || '>)' WHERE d.field = 'datatype'"), {"literal": literal(AXIOM_KINDS), "defined": edge(kinds("DatatypeDefinition"), ["datatype"])}),
    Rule("literal_status", "LITERAL", lambda d: f"SELECT lexical, lang, datatype_iri, {status(d).replace('{', '{{').replace('}', '}}')} AS status FROM (SELECT DISTINCT lexical, lang, datatype_iri FROM {{literal}}) l", {"literal": literal(AXIOM_KINDS)}),
    Rule("literal_status_counts", "LITERAL", lambda d: f"SELECT datatype_iri, {status(d).replace('{', '{{').replace('}', '}}')} AS status, count(*) AS n_literals FROM {{literal}} GROUP BY 1, 2", {"literal": literal(AXIOM_KINDS)}),
    Rule("defined_datatype_restriction", "DEFINED_DATATYPE_RESTRICTION", _same("SELECT DISTINCT parent_key, child_key FROM {edge} e WHERE NOT EXISTS (SELECT 1 FROM {builtin} b WHERE b.entity = e.child_key)"), {"edge": edge(kinds("DatatypeRestriction"), ["datatype"], nested=True), "builtin": _BUILTIN}),
    *(Rule(f"{q.lower()}_forbidden_axioms", "PROFILE_AXIOM_NOT_ALLOWED", _same("SELECT ont_id, kind, count(*) AS n_axioms FROM {axiom} GROUP BY ont_id, kind"), {"axiom": axiom(_forbidden(q))}) for q in ("EL", "QL", "RL")),
    *(
        Rule(f"{q}_datatypes", "PROFILE_DATATYPE_NOT_ALLOWED", _same(f"SELECT DISTINCT node_key FROM {{reach}} WHERE node_kind = 'OWLDatatype' AND NOT in_annotation AND node_key NOT IN ({quoted(f'Datatype(<{i}>)' for i in allowed)})"), {"reach": within(("OWLDatatype",))})
        for q, allowed in (("el_ql", _EL_RANGES), ("rl", _RL_RANGES))
    ),
    Rule("data_range_not_allowed", "PROFILE_DATA_RANGE_NOT_ALLOWED", _same("SELECT DISTINCT node_kind, node_key FROM {reach} WHERE NOT in_annotation AND node_kind IN ('OWLDataUnionOf', 'OWLDataComplementOf', 'OWLDatatypeRestriction')"), {"reach": within(("OWLDataUnionOf", "OWLDataComplementOf", "OWLDatatypeRestriction"))}),
    Rule("enumeration_not_singleton", "PROFILE_OBJECT_ENUMERATION_NOT_SINGLETON", _same("SELECT parent_kind, parent_key, count(*) AS n_members FROM {edge} GROUP BY parent_kind, parent_key HAVING count(*) <> 1"), {"edge": edge(kinds("ObjectOneOf", "DataOneOf"), ["individuals", "values"], nested=True)}),
    Rule("anonymous_not_allowed", "PROFILE_ANONYMOUS_INDIVIDUAL_NOT_ALLOWED", _same("SELECT DISTINCT root_key AS axiom_key, node_key FROM {reach} WHERE node_kind = 'OWLAnonymousIndividual' AND NOT in_annotation AND root_kind <> 'OWLAnnotationAssertionAxiom'"), {"reach": within(("OWLAnonymousIndividual",))}),
    Rule("el_inverse_properties", "PROFILE_INVERSE_PROPERTY_NOT_ALLOWED", _same("SELECT DISTINCT root_key AS axiom_key, node_key FROM {reach} WHERE node_kind = 'OWLObjectInverseOf'"), {"reach": within(("OWLObjectInverseOf",))}),
    Rule("el_class_expressions", "PROFILE_CLASS_EXPRESSION_NOT_ALLOWED", _same(f"SELECT DISTINCT node_kind, node_key FROM {{reach}} WHERE node_kind IN ({quoted(x for x in _CLASS_KINDS if x not in _EL_CLASSES)})"), {"reach": sig(_CLASS_KINDS)}),
    Rule("rl_properties", "PROFILE_PROPERTY_NOT_ALLOWED", _same(f"SELECT DISTINCT root_key AS axiom_key, node_key FROM {{reach}} WHERE node_key IN ({quoted(f'{kw}(<{OWL}{side}{kw}>)' for kw in ('ObjectProperty', 'DataProperty') for side in ('top', 'bottom'))})"), {"reach": within(("OWLObjectProperty", "OWLDataProperty"))}),
    Rule("ql_class_assertion_not_atomic", "PROFILE_CLASS_ASSERTION_NOT_ATOMIC", _same("SELECT parent_key AS axiom_key, child_kind FROM {edge} WHERE child_kind <> 'OWLClass'"), {"edge": edge(kinds("ClassAssertion"), ["classExpression"])}),
    Rule("multiple_anonymous_edges", "MULTIPLE_ANONYMOUS_EDGE_ASSERTIONS", _same("SELECT least(a.child_key, b.child_key) AS x, greatest(a.child_key, b.child_key) AS y, count(*) AS n_axioms FROM {edge} a JOIN {edge} b ON a.parent_key = b.parent_key WHERE a.field = 'subject' AND b.field = 'value' AND a.child_kind = 'OWLAnonymousIndividual' AND b.child_kind = 'OWLAnonymousIndividual' GROUP BY 1, 2 HAVING count(*) > 1"), {"edge": edge(kinds("ObjectPropertyAssertion"), ["subject", "value"])}),
    Rule("range_category_collision", "SOURCE_RANGE_CATEGORY_COLLISION", _same("SELECT iri FROM (SELECT substr(child_key, position('(<' IN child_key) + 2) AS iri, parent_kind FROM {edge} WHERE field = 'property') GROUP BY iri HAVING count(DISTINCT parent_kind) > 1"), {"edge": edge(kinds("ObjectPropertyRange", "DataPropertyRange"), ["property"])}),
)


def anonymous_forest(s: Store) -> DataFrame:
    """Components of anonymous individuals under object property assertions: nodes, edges, named edges, and whether the
    component is a tree and has at most one link to a named individual."""
    pairs = s.pairs(kinds("ObjectPropertyAssertion"), "subject", "value")
    blank = lambda side: f"{side}_kind = 'OWLAnonymousIndividual'"
    inner = pairs.where(f"{blank('left')} AND {blank('right')}").selectExpr("least(left_key, right_key) AS src", "greatest(left_key, right_key) AS dst").distinct()
    named = pairs.where(f"({blank('left')}) <> ({blank('right')})").selectExpr(f"CASE WHEN {blank('left')} THEN left_key ELSE right_key END AS node").groupBy("node").count()
    comp = components(inner)
    edges = inner.join(comp, inner.src == comp.node).groupBy("component").count().withColumnRenamed("count", "n_edges")
    nodes = comp.join(named, "node", "left").groupBy("component").agg({"node": "count", "count": "sum"}).selectExpr("component", "`count(node)` AS n_nodes", "coalesce(`sum(count)`, 0) AS n_named")
    return nodes.join(edges, "component").selectExpr("component", "n_nodes", "n_edges", "n_named", "n_edges = n_nodes - 1 AS is_tree")


FOREST_SQL = f"""WITH RECURSIVE e AS ({p.edge_sql(kinds('ObjectPropertyAssertion'), ['subject', 'value'])}),
x AS (SELECT a.child_key AS l, a.child_kind AS lk, b.child_key AS r, b.child_kind AS rk FROM e a JOIN e b ON a.parent_key = b.parent_key WHERE a.field = 'subject' AND b.field = 'value'),
i AS (SELECT DISTINCT least(l, r) AS src, greatest(l, r) AS dst FROM x WHERE lk = 'OWLAnonymousIndividual' AND rk = 'OWLAnonymousIndividual'),
g AS (SELECT src, dst FROM i UNION SELECT dst, src FROM i), c(node, other) AS (SELECT src, src FROM g UNION SELECT c.node, g.dst FROM c JOIN g ON c.other = g.src),
m AS (SELECT node, min(other) AS component FROM c GROUP BY node),
nm AS (SELECT CASE WHEN lk = 'OWLAnonymousIndividual' THEN l ELSE r END AS node, count(*) AS n FROM x WHERE (lk = 'OWLAnonymousIndividual') <> (rk = 'OWLAnonymousIndividual') GROUP BY 1),
n AS (SELECT component, count(*) AS n_nodes, coalesce(sum(n), 0) AS n_named FROM m LEFT JOIN nm USING (node) GROUP BY component),
k AS (SELECT component, count(*) AS n_edges FROM i JOIN m ON i.src = m.node GROUP BY component)
SELECT component, n_nodes, n_edges, n_named, n_edges = n_nodes - 1 AS is_tree FROM n JOIN k USING (component)"""


def el_chain_ranges(s: Store) -> DataFrame:
    """Ranges that a chain's head has and its last property, with all that stand above it, lacks."""
    sub = s.pairs(kinds("SubObjectPropertyOf"), "subProperty", "superProperty").selectExpr("left_key AS src", "right_key AS dst")
    own = s.spark.sql("SELECT DISTINCT child_key AS src FROM {e} UNION SELECT DISTINCT child_key FROM {r}", e=s.edges(kinds("SubPropertyChainOf"), ["chain", "superProperty"]), r=s.edges(kinds("ObjectPropertyRange"), ["property"]))
    above = reachable(sub).select("src", "dst").union(own.selectExpr("src", "src AS dst")).distinct()
    ranges = s.pairs(kinds("ObjectPropertyRange"), "property", "range").selectExpr("left_key AS property", "right_key AS range")
    text = """WITH imposed AS (SELECT DISTINCT a.src AS property, r.range FROM {above} a JOIN {ranges} r ON r.property = a.dst),
    last AS (SELECT parent_key, max_by(child_key, ord) AS property FROM {chain} WHERE field = 'chain' GROUP BY parent_key),
    head AS (SELECT parent_key, child_key AS property FROM {chain} WHERE field = 'superProperty')
    SELECT h.parent_key AS axiom_key, i.range FROM head h JOIN imposed i ON i.property = h.property JOIN last l ON l.parent_key = h.parent_key
    WHERE NOT EXISTS (SELECT 1 FROM imposed j WHERE j.property = l.property AND j.range = i.range)"""
    return s.spark.sql(text, above=above, ranges=ranges, chain=s.edges(kinds("SubPropertyChainOf"), ["chain", "superProperty"]))


EL_CHAIN_SQL = f"""WITH RECURSIVE s AS ({p.edge_sql(kinds('SubObjectPropertyOf'), ['subProperty', 'superProperty'])}), r AS ({p.edge_sql(kinds('ObjectPropertyRange'), ['property', 'range'])}), chain AS ({p.edge_sql(kinds('SubPropertyChainOf'), ['chain', 'superProperty'])}),
up AS (SELECT a.child_key AS src, b.child_key AS dst FROM s a JOIN s b ON a.parent_key = b.parent_key WHERE a.field = 'subProperty' AND b.field = 'superProperty'),
above(src, dst) AS (SELECT child_key, child_key FROM chain UNION SELECT child_key, child_key FROM r WHERE field = 'property' UNION SELECT above.src, up.dst FROM above JOIN up ON above.dst = up.src),
ranges AS (SELECT a.child_key AS property, b.child_key AS range FROM r a JOIN r b ON a.parent_key = b.parent_key WHERE a.field = 'property' AND b.field = 'range'),
imposed AS (SELECT DISTINCT a.src AS property, r.range FROM above a JOIN ranges r ON r.property = a.dst),
last AS (SELECT parent_key, max_by(child_key, ord) AS property FROM chain WHERE field = 'chain' GROUP BY parent_key),
head AS (SELECT parent_key, child_key AS property FROM chain WHERE field = 'superProperty')
SELECT h.parent_key AS axiom_key, i.range FROM head h JOIN imposed i ON i.property = h.property JOIN last l ON l.parent_key = h.parent_key
WHERE NOT EXISTS (SELECT 1 FROM imposed j WHERE j.property = l.property AND j.range = i.range)"""
