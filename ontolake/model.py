"""The structural model: kinds and their fields, structural objects and their keys, and the rows they become.

An object is a kind and its field values. Its key is a text that two objects share exactly if they are equal; sets are
written without repeats and in order, lists as they stand. Keys follow the functional notation, with entities wrapped in
the keyword of their kind, so that one IRI used as a class and as an individual gives two keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, NamedTuple

RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
THING, NOTHING, RDFS_LITERAL = OWL + "Thing", OWL + "Nothing", RDFS + "Literal"


class Kind(NamedTuple):
    kind: str
    keyword: str
    category: str  # axiom, class, range, entity, property, individual, value, part
    fields: tuple[str, ...]  # name, "{name}" a set, "[name]" a list, "{{name}}" a sorted pair that keeps repeats
    logical: bool = False
    forbidden: str = ""  # profiles that do not admit an axiom of this kind


def _k(kind: str, keyword: str, category: str, fields: str, logical: bool = False, forbidden: str = "") -> Kind:
    return Kind(kind, keyword, category, tuple(fields.split()), logical, forbidden)


#: The kinds of the structural model, in order of their type index.
KINDS: tuple[Kind, ...] = (
    _k("OWLClass", "Class", "entity", "iri"),
    _k("OWLDatatype", "Datatype", "entity", "iri"),
    _k("OWLObjectProperty", "ObjectProperty", "entity", "iri"),
    _k("OWLDataProperty", "DataProperty", "entity", "iri"),
    _k("OWLAnnotationProperty", "AnnotationProperty", "entity", "iri"),
    _k("OWLNamedIndividual", "NamedIndividual", "entity", "iri"),
    _k("OWLAnonymousIndividual", "AnonymousIndividual", "individual", "node scope"),
    _k("IRI", "IRI", "value", "iri"),
    _k("OWLLiteral", "Literal", "value", "lexical language datatype"),
    _k("OWLObjectInverseOf", "ObjectInverseOf", "property", "inverse"),
    _k("OWLObjectIntersectionOf", "ObjectIntersectionOf", "class", "{operands}"),
    _k("OWLObjectUnionOf", "ObjectUnionOf", "class", "{operands}"),
    _k("OWLObjectComplementOf", "ObjectComplementOf", "class", "operand"),
    _k("OWLObjectOneOf", "ObjectOneOf", "class", "{individuals}"),
    _k("OWLObjectSomeValuesFrom", "ObjectSomeValuesFrom", "class", "property filler"),
    _k("OWLObjectAllValuesFrom", "ObjectAllValuesFrom", "class", "property filler"),
    _k("OWLObjectHasValue", "ObjectHasValue", "class", "property individual"),
    _k("OWLObjectHasSelf", "ObjectHasSelf", "class", "property"),
    _k("OWLObjectMinCardinality", "ObjectMinCardinality", "class", "cardinality property filler"),
    _k("OWLObjectMaxCardinality", "ObjectMaxCardinality", "class", "cardinality property filler"),
    _k("OWLObjectExactCardinality", "ObjectExactCardinality", "class", "cardinality property filler"),
    _k("OWLDataSomeValuesFrom", "DataSomeValuesFrom", "class", "[properties] filler"),
    _k("OWLDataAllValuesFrom", "DataAllValuesFrom", "class", "[properties] filler"),
    _k("OWLDataHasValue", "DataHasValue", "class", "property value"),
    _k("OWLDataMinCardinality", "DataMinCardinality", "class", "cardinality property filler"),
    _k("OWLDataMaxCardinality", "DataMaxCardinality", "class", "cardinality property filler"),
    _k("OWLDataExactCardinality", "DataExactCardinality", "class", "cardinality property filler"),
    _k("OWLDataIntersectionOf", "DataIntersectionOf", "range", "{operands}"),
    _k("OWLDataUnionOf", "DataUnionOf", "range", "{operands}"),
    _k("OWLDataComplementOf", "DataComplementOf", "range", "operand"),
    _k("OWLDataOneOf", "DataOneOf", "range", "{values}"),
    _k("OWLDatatypeRestriction", "DatatypeRestriction", "range", "datatype {facetRestrictions}"),
    _k("OWLFacetRestriction", "FacetRestriction", "part", "facet value"),
    _k("OWLAnnotation", "Annotation", "part", "property value"),
    _k("OWLDeclarationAxiom", "Declaration", "axiom", "entity"),
    _k("OWLSubClassOfAxiom", "SubClassOf", "axiom", "subClass superClass", True),
    _k("OWLEquivalentClassesAxiom", "EquivalentClasses", "axiom", "{classExpressions}", True),
    _k("OWLDisjointClassesAxiom", "DisjointClasses", "axiom", "{classExpressions}", True),
    _k("OWLDisjointUnionAxiom", "DisjointUnion", "axiom", "owlClass {classExpressions}", True, "EL QL RL"),
    _k("OWLSubObjectPropertyOfAxiom", "SubObjectPropertyOf", "axiom", "subProperty superProperty", True),
    _k("OWLSubPropertyChainOfAxiom", "SubPropertyChainOf", "axiom", "[chain] superProperty", True, "QL"),
    _k("OWLEquivalentObjectPropertiesAxiom", "EquivalentObjectProperties", "axiom", "{properties}", True),
    _k("OWLDisjointObjectPropertiesAxiom", "DisjointObjectProperties", "axiom", "{properties}", True, "EL"),
    _k("OWLObjectPropertyDomainAxiom", "ObjectPropertyDomain", "axiom", "property domain", True),
    _k("OWLObjectPropertyRangeAxiom", "ObjectPropertyRange", "axiom", "property range", True),
    _k("OWLInverseObjectPropertiesAxiom", "InverseObjectProperties", "axiom", "{{properties}}", True, "EL"),
    _k("OWLFunctionalObjectPropertyAxiom", "FunctionalObjectProperty", "axiom", "property", True, "EL QL"),
    _k("OWLInverseFunctionalObjectPropertyAxiom", "InverseFunctionalObjectProperty", "axiom", "property", True, "EL QL"),
    _k("OWLReflexiveObjectPropertyAxiom", "ReflexiveObjectProperty", "axiom", "property", True, "RL"),
    _k("OWLIrreflexiveObjectPropertyAxiom", "IrreflexiveObjectProperty", "axiom", "property", True, "EL"),
    _k("OWLSymmetricObjectPropertyAxiom", "SymmetricObjectProperty", "axiom", "property", True, "EL"),
    _k("OWLAsymmetricObjectPropertyAxiom", "AsymmetricObjectProperty", "axiom", "property", True, "EL"),
    _k("OWLTransitiveObjectPropertyAxiom", "TransitiveObjectProperty", "axiom", "property", True, "QL"),
    _k("OWLSubDataPropertyOfAxiom", "SubDataPropertyOf", "axiom", "subProperty superProperty", True),
    _k("OWLEquivalentDataPropertiesAxiom", "EquivalentDataProperties", "axiom", "{properties}", True),
    _k("OWLDisjointDataPropertiesAxiom", "DisjointDataProperties", "axiom", "{properties}", True, "EL"),
    _k("OWLDataPropertyDomainAxiom", "DataPropertyDomain", "axiom", "property domain", True),
    _k("OWLDataPropertyRangeAxiom", "DataPropertyRange", "axiom", "property range", True),
    _k("OWLFunctionalDataPropertyAxiom", "FunctionalDataProperty", "axiom", "property", True, "QL"),
    _k("OWLDatatypeDefinitionAxiom", "DatatypeDefinition", "axiom", "datatype dataRange", True, "RL"),
    _k("OWLHasKeyAxiom", "HasKey", "axiom", "classExpression {objectProperties} {dataProperties}", True, "QL"),
    _k("OWLSameIndividualAxiom", "SameIndividual", "axiom", "{individuals}", True, "QL"),
    _k("OWLDifferentIndividualsAxiom", "DifferentIndividuals", "axiom", "{individuals}", True),
    _k("OWLClassAssertionAxiom", "ClassAssertion", "axiom", "classExpression individual", True),
    _k("OWLObjectPropertyAssertionAxiom", "ObjectPropertyAssertion", "axiom", "property subject value", True),
    _k("OWLNegativeObjectPropertyAssertionAxiom", "NegativeObjectPropertyAssertion", "axiom", "property subject value", True, "QL"),
    _k("OWLDataPropertyAssertionAxiom", "DataPropertyAssertion", "axiom", "property subject value", True),
    _k("OWLNegativeDataPropertyAssertionAxiom", "NegativeDataPropertyAssertion", "axiom", "property subject value", True, "QL"),
    _k("OWLAnnotationAssertionAxiom", "AnnotationAssertion", "axiom", "property subject value"),
    _k("OWLSubAnnotationPropertyOfAxiom", "SubAnnotationPropertyOf", "axiom", "subProperty superProperty"),
    _k("OWLAnnotationPropertyDomainAxiom", "AnnotationPropertyDomain", "axiom", "property domain"),
    _k("OWLAnnotationPropertyRangeAxiom", "AnnotationPropertyRange", "axiom", "property range"),
)
#: Kinds whose sets or lists need brackets of their own in a key.
BRACKETED = ("HasKey", "SubPropertyChainOf")
KIND = {k.kind: k for k in KINDS}
BY_KEYWORD = {k.keyword: k for k in KINDS}
TYPE_INDEX = {k.kind: i for i, k in enumerate(KINDS)}
AXIOM_KINDS = tuple(k.kind for k in KINDS if k.category == "axiom")
LOGICAL_KINDS = tuple(k.kind for k in KINDS if k.logical)
ENTITY_KINDS = tuple(k.kind for k in KINDS if k.category == "entity")
ANNOTATION_AXIOMS = tuple(k for k in AXIOM_KINDS if "Annotation" in k)
#: Sets that need two members.
AT_LEAST_TWO = {
    "ObjectIntersectionOf": "operands", "ObjectUnionOf": "operands", "DataIntersectionOf": "operands", "DataUnionOf": "operands", "EquivalentClasses": "classExpressions",
    "DisjointClasses": "classExpressions", "DisjointUnion": "classExpressions", "EquivalentObjectProperties": "properties", "DisjointObjectProperties": "properties",
    "EquivalentDataProperties": "properties", "DisjointDataProperties": "properties", "SameIndividual": "individuals", "DifferentIndividuals": "individuals",
}


class Datatype(NamedTuple):
    iri: str
    low: str | None
    high: str | None
    el_ql: bool
    rl: bool
    finite: bool
    facets: str  # order, length, lang or none


def _d(prefix: str, name: str, el_ql: int, rl: int, finite: int, facets: str, low: str | None = None, high: str | None = None) -> Datatype:
    return Datatype({"xsd": XSD, "owl": OWL, "rdf": RDF, "rdfs": RDFS}[prefix] + name, low, high, bool(el_ql), bool(rl), bool(finite), facets)


#: The datatype map.
DATATYPES: tuple[Datatype, ...] = (
    _d("xsd", "integer", 1, 1, 0, "order"),
    _d("xsd", "nonNegativeInteger", 1, 1, 0, "order", "0"),
    _d("xsd", "positiveInteger", 0, 1, 0, "order", "1"),
    _d("xsd", "nonPositiveInteger", 0, 1, 0, "order", None, "0"),
    _d("xsd", "negativeInteger", 0, 1, 0, "order", None, "-1"),
    _d("xsd", "long", 0, 1, 1, "order", "-9223372036854775808", "9223372036854775807"),
    _d("xsd", "int", 0, 1, 1, "order", "-2147483648", "2147483647"),
    _d("xsd", "short", 0, 1, 1, "order", "-32768", "32767"),
    _d("xsd", "byte", 0, 1, 1, "order", "-128", "127"),
    _d("xsd", "unsignedLong", 0, 1, 1, "order", "0", "18446744073709551615"),
    _d("xsd", "unsignedInt", 0, 1, 1, "order", "0", "4294967295"),
    _d("xsd", "unsignedShort", 0, 1, 1, "order", "0", "65535"),
    _d("xsd", "unsignedByte", 0, 1, 1, "order", "0", "255"),
    _d("xsd", "decimal", 1, 1, 0, "order"),
    _d("xsd", "float", 0, 1, 1, "order"),
    _d("xsd", "double", 0, 1, 1, "order"),
    _d("xsd", "boolean", 0, 1, 1, "none"),
    _d("xsd", "string", 1, 1, 0, "length"),
    _d("xsd", "normalizedString", 1, 1, 0, "length"),
    _d("xsd", "token", 1, 1, 0, "length"),
    _d("xsd", "language", 0, 1, 1, "length"),
    _d("xsd", "Name", 1, 1, 0, "length"),
    _d("xsd", "NCName", 1, 1, 0, "length"),
    _d("xsd", "NMTOKEN", 1, 1, 0, "length"),
    _d("xsd", "hexBinary", 1, 1, 0, "octets"),
    _d("xsd", "base64Binary", 1, 1, 0, "octets"),
    _d("xsd", "anyURI", 1, 1, 0, "length"),
    _d("xsd", "dateTime", 1, 1, 0, "order"),
    _d("xsd", "dateTimeStamp", 1, 1, 0, "order"),
    _d("owl", "real", 1, 0, 0, "order"),
    _d("owl", "rational", 1, 0, 0, "order"),
    _d("rdf", "PlainLiteral", 1, 1, 0, "lang"),
    _d("rdf", "langString", 0, 0, 0, "lang"),
    _d("rdf", "XMLLiteral", 1, 1, 0, "none"),
    _d("rdfs", "Literal", 1, 1, 0, "none"),
)
BUILTIN_DATATYPES = frozenset(d.iri for d in DATATYPES)
#: Built-in entities that need no declaration, by kind.
BUILTINS = {
    "OWLClass": frozenset({THING, NOTHING}),
    "OWLObjectProperty": frozenset({OWL + "topObjectProperty", OWL + "bottomObjectProperty"}),
    "OWLDataProperty": frozenset({OWL + "topDataProperty", OWL + "bottomDataProperty"}),
    "OWLDatatype": BUILTIN_DATATYPES,
    "OWLAnnotationProperty": frozenset({RDFS + x for x in ("label", "comment", "seeAlso", "isDefinedBy")} | {OWL + x for x in ("versionInfo", "deprecated", "priorVersion", "backwardCompatibleWith", "incompatibleWith")}),
    "OWLNamedIndividual": frozenset(),
}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"')


@dataclass(frozen=True, eq=False)
class Obj:
    """A structural object. fields: objects, tuples of objects, or texts, one for each field of the kind. An axiom or an
    annotation may have annotations of its own."""

    kind: str
    fields: tuple[Any, ...]
    annotations: tuple[Obj, ...] = field(default=())

    @cached_property
    def key(self) -> str:
        return self._text(True)

    @cached_property
    def key_noann(self) -> str:
        return self._text(False) if self.annotations else self.key

    def _text(self, annotated: bool) -> str:
        k = KIND[self.kind]
        if self.kind == "OWLLiteral":
            lexical, language, datatype = self.fields
            return f'"{escape(lexical)}"' + (f"@{language}" if language else f"^^<{datatype}>")
        if self.kind == "OWLAnonymousIndividual":
            return f"_:{self.fields[0]}@{self.fields[1]}"
        if self.kind == "IRI":
            return f"<{self.fields[0]}>"
        if k.category == "entity":
            return f"{k.keyword}(<{self.fields[0]}>)"
        parts = [a.key for a in self.annotations] if annotated else []
        for value in self.fields:
            many = " ".join(v.key for v in value) if isinstance(value, tuple) else None
            parts.append(value if isinstance(value, str) else value.key if many is None else f"({many})" if k.keyword in BRACKETED else many)
        return f"{k.keyword}({' '.join(parts)})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Obj) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __repr__(self) -> str:
        return self.key

    def children(self) -> Iterator[tuple[str, int, Obj]]:
        """(field, place, child) of direct fields, annotations last."""
        for name, value in zip(KIND[self.kind].fields, self.fields):
            name = name.strip("{}[]")
            if isinstance(value, Obj):
                yield name, 0, value
            elif isinstance(value, tuple):
                for i, v in enumerate(value):
                    yield name, i, v
        if self.kind == "OWLLiteral":
            yield "datatype", 0, Obj("OWLDatatype", (self.fields[2],))
        for i, a in enumerate(self.annotations):
            yield "annotations", i, a

    @property
    def iri(self) -> str | None:
        return self.fields[0] if self.kind == "IRI" or KIND[self.kind].category == "entity" else None


def _set(values: Iterable[Obj]) -> tuple[Obj, ...]:
    values = tuple(values)
    return values if len(values) < 2 else tuple({v.key: v for v in sorted(values, key=lambda v: v.key)}.values())


def make(kind: str, *values: Any, annotations: Iterable[Obj] = ()) -> Obj:
    """An object of a kind, by name or keyword; sets are put in order, without repeats."""
    k = KIND.get(kind) or BY_KEYWORD[kind]
    if len(values) != len(k.fields):
        raise TypeError(f"{k.kind} takes {k.fields}, not {len(values)} values")
    out = []
    for spec, v in zip(k.fields, values):
        if spec.startswith("{{"):
            v = tuple(sorted(v, key=lambda x: x.key))
        elif spec.startswith("{"):
            v = _set(v)
        elif spec.startswith("["):
            v = tuple(v)
        out.append(v)
    return Obj(k.kind, tuple(out), _set(annotations))


def iri(value: str) -> Obj:
    return Obj("IRI", (value,))


def entity(keyword: str, value: str) -> Obj:
    return Obj(BY_KEYWORD[keyword].kind, (value,))


def anonymous(node: str, scope: str = "") -> Obj:
    return Obj("OWLAnonymousIndividual", (node, scope))


def literal(lexical: str, language: str = "", datatype: str = "") -> Obj:
    return Obj("OWLLiteral", (lexical, language, RDF + "langString" if language else datatype or XSD + "string"))


def cardinality(n: int | str) -> str:
    text = str(n).strip()
    if not text.isdigit():
        raise ValueError(f"not a cardinality: {n}")
    return text.lstrip("0") or "0"


def with_annotations(axiom: Obj, more: Iterable[Obj]) -> Obj:
    """Annotations added, never replaced."""
    return Obj(axiom.kind, axiom.fields, _set([*axiom.annotations, *more]))


def without_annotations(axiom: Obj) -> Obj:
    return Obj(axiom.kind, axiom.fields)


@dataclass
class Ontology:
    """What a document says: id, imports, annotations and axioms, with the prefixes it used."""

    iri: str | None = None
    version: str | None = None
    imports: list[str] = field(default_factory=list)
    annotations: list[Obj] = field(default_factory=list)
    axioms: list[Obj] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)

    def distinct(self) -> Ontology:
        return Ontology(self.iri, self.version, sorted(set(self.imports)), list(_set(self.annotations)), list(_set(self.axioms)), self.prefixes)


def walk(root: Obj) -> Iterator[tuple[Obj, bool]]:
    """Every object in root, itself included, once for each of being in an annotation or not."""
    todo, seen = [(root, False)], set()
    while todo:
        o, ann = todo.pop()
        if (o.key, o.kind, ann) not in seen:
            seen.add((o.key, o.kind, ann))
            yield o, ann
            for name, _, child in o.children():
                todo.append((child, ann or name == "annotations" or o.kind in ("OWLAnnotation", "OWLAnnotationAssertionAxiom") and name == "value"))


def height(root: Obj) -> int:
    """Longest path down; iterative, so that depth is no limit."""
    done: dict[str, int] = {}
    todo = [(root, False)]
    while todo:
        o, ready = todo.pop()
        if ready:
            done[o.key] = 1 + max((done[c.key] for _, _, c in o.children()), default=-1)
        elif o.key not in done:
            todo.append((o, True))
            todo += [(c, False) for _, _, c in o.children() if c.key not in done]
    return done[root.key]
