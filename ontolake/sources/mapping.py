"""OWL to RDF and back, after the W3C mapping of OWL 2 to RDF graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from ..errors import OWLSyntaxError
from ..model import BUILTIN_DATATYPES, BUILTINS, KIND, NOTHING, OWL, RDF, RDFS, THING, XSD, Obj, Ontology, anonymous, cardinality, entity, iri, literal, make
from .rdf_terms import Quad, Term, blank, iri_term, lit_term

TYPE, FIRST, REST, NIL = (RDF + x for x in ("type", "first", "rest", "nil"))
_DECLARED = {"Class": OWL + "Class", "Datatype": RDFS + "Datatype", "ObjectProperty": OWL + "ObjectProperty", "DataProperty": OWL + "DatatypeProperty", "AnnotationProperty": OWL + "AnnotationProperty", "NamedIndividual": OWL + "NamedIndividual"}
_CHARACTER = {k: OWL + v for k, v in {"FunctionalObjectProperty": "FunctionalProperty", "FunctionalDataProperty": "FunctionalProperty", "InverseFunctionalObjectProperty": "InverseFunctionalProperty", "ReflexiveObjectProperty": "ReflexiveProperty", "IrreflexiveObjectProperty": "IrreflexiveProperty", "SymmetricObjectProperty": "SymmetricProperty", "AsymmetricObjectProperty": "AsymmetricProperty", "TransitiveObjectProperty": "TransitiveProperty"}.items()}
_BINARY = {
    "SubClassOf": RDFS + "subClassOf", "SubObjectPropertyOf": RDFS + "subPropertyOf", "SubDataPropertyOf": RDFS + "subPropertyOf", "SubAnnotationPropertyOf": RDFS + "subPropertyOf",
    "ObjectPropertyDomain": RDFS + "domain", "DataPropertyDomain": RDFS + "domain", "AnnotationPropertyDomain": RDFS + "domain",
    "ObjectPropertyRange": RDFS + "range", "DataPropertyRange": RDFS + "range", "AnnotationPropertyRange": RDFS + "range", "DatatypeDefinition": OWL + "equivalentClass",
}
#: n-ary kinds: predicate between two, type and list predicate for more ("" : a chain of pairs instead)
_NARY = {
    "EquivalentClasses": (OWL + "equivalentClass", "", ""), "EquivalentObjectProperties": (OWL + "equivalentProperty", "", ""), "EquivalentDataProperties": (OWL + "equivalentProperty", "", ""), "SameIndividual": (OWL + "sameAs", "", ""),
    "DisjointClasses": (OWL + "disjointWith", OWL + "AllDisjointClasses", OWL + "members"), "DisjointObjectProperties": (OWL + "propertyDisjointWith", OWL + "AllDisjointProperties", OWL + "members"),
    "DisjointDataProperties": (OWL + "propertyDisjointWith", OWL + "AllDisjointProperties", OWL + "members"), "DifferentIndividuals": (OWL + "differentFrom", OWL + "AllDifferent", OWL + "members"),
}


class Writer:
    """Quads of an ontology; every expression gets a fresh blank node."""

    def __init__(self, graph: Term | None = None) -> None:
        self.quads: list[Quad] = []
        self.graph, self.count = graph, 0
        self.labels: dict[tuple[str, str], Term] = {}

    def fresh(self) -> Term:
        self.count += 1
        return blank(f"x{self.count}")

    def add(self, s: Term, p: str, o: Term) -> tuple[Term, str, Term]:
        self.quads.append(Quad(s, iri_term(p), o, self.graph))
        return s, p, o

    def list(self, items: Iterable[Term]) -> Term:
        head = iri_term(NIL)
        for item in reversed(list(items)):
            cell = self.fresh()
            self.add(cell, FIRST, item)
            self.add(cell, REST, head)
            head = cell
        return head

    def term(self, o: Obj) -> Term:
        if o.kind == "OWLLiteral":
            return lit_term(o.fields[0], o.fields[1], o.fields[2])
        if o.kind == "OWLAnonymousIndividual":
            return self.labels.setdefault(o.fields, blank(f"i{len(self.labels) + 1}"))
        if o.iri is not None:
            return iri_term(o.iri)
        return self.expression(o)

    def expression(self, o: Obj) -> Term:
        n, k, f = self.fresh(), KIND[o.kind].keyword, o.fields
        t, add = self.term, self.add
        data = k.startswith("Data")
        if k == "ObjectInverseOf":
            add(n, OWL + "inverseOf", t(f[0]))
            return n
        if k in ("ObjectIntersectionOf", "ObjectUnionOf", "ObjectOneOf", "DataIntersectionOf", "DataUnionOf", "DataOneOf"):
            add(n, TYPE, iri_term(RDFS + "Datatype" if data else OWL + "Class"))
            add(n, OWL + {"I": "intersectionOf", "U": "unionOf", "O": "oneOf"}[k.removeprefix("Object").removeprefix("Data")[0]], self.list(map(t, f[0])))
            return n
        if k in ("ObjectComplementOf", "DataComplementOf"):
            add(n, TYPE, iri_term(RDFS + "Datatype" if data else OWL + "Class"))
            add(n, OWL + ("datatypeComplementOf" if data else "complementOf"), t(f[0]))
            return n
        if k == "DatatypeRestriction":
            add(n, TYPE, iri_term(RDFS + "Datatype"))
            add(n, OWL + "onDatatype", t(f[0]))
            cells = []
            for x in f[1]:
                c = self.fresh()
                add(c, x.fields[0].iri, t(x.fields[1]))
                cells.append(c)
            add(n, OWL + "withRestrictions", self.list(cells))
            return n
        add(n, TYPE, iri_term(OWL + "Restriction"))
        if "Cardinality" in k:
            number = lit_term(f[0], "", XSD + "nonNegativeInteger")
            word = {"Min": "min", "Max": "max", "Exa": ""}[k.removeprefix("Object").removeprefix("Data")[:3]]
            plain = f[2].iri in (THING, RDFS + "Literal")
            name = (word + "Cardinality" if word else "cardinality") if plain else (word + "QualifiedCardinality" if word else "qualifiedCardinality")
            add(n, OWL + "onProperty", t(f[1]))
            add(n, OWL + name, number)
            if not plain:
                add(n, OWL + ("onDataRange" if data else "onClass"), t(f[2]))
            return n
        if data and isinstance(f[0], tuple) and len(f[0]) > 1:
            add(n, OWL + "onProperties", self.list(map(t, f[0])))
        else:
            add(n, OWL + "onProperty", t(f[0][0] if isinstance(f[0], tuple) else f[0]))
        if k == "ObjectHasSelf":
            add(n, OWL + "hasSelf", lit_term("true", "", XSD + "boolean"))
        else:
            add(n, OWL + {"S": "someValuesFrom", "A": "allValuesFrom", "H": "hasValue"}[k.removeprefix("Object").removeprefix("Data")[0]], t(f[1]))
        return n

    def annotate(self, triple: tuple[Term, str, Term], annotations: Iterable[Obj], kind: str = "Axiom") -> None:
        annotations = list(annotations)
        if annotations:
            n = self.fresh()
            self.add(n, TYPE, iri_term(OWL + kind))
            for name, v in zip(("annotatedSource", "annotatedProperty", "annotatedTarget"), triple):
                self.add(n, OWL + name, iri_term(v) if isinstance(v, str) else v)
            self.annotations(n, annotations)

    def annotations(self, node: Term, annotations: Iterable[Obj]) -> None:
        for a in annotations:
            self.annotate(self.add(node, a.fields[0].iri, self.term(a.fields[1])), a.annotations, "Annotation")

    def axiom(self, a: Obj) -> None:
        k, f, t, add = KIND[a.kind].keyword, a.fields, self.term, self.add
        notes = a.annotations
        if k == "Declaration":
            self.annotate(add(t(f[0]), TYPE, iri_term(_DECLARED[KIND[f[0].kind].keyword])), notes)
        elif k in _CHARACTER:
            self.annotate(add(t(f[0]), TYPE, iri_term(_CHARACTER[k])), notes)
        elif k in _BINARY:
            self.annotate(add(t(f[0]), _BINARY[k], t(f[1])), notes)
        elif k in _NARY:
            pair, kind, members = _NARY[k]
            items = [t(x) for x in f[0]]
            if len(items) == 1:
                items *= 2
            if len(items) == 2 or not kind:
                for x, y in zip(items, items[1:]):
                    self.annotate(add(x, pair, y), notes)
            else:
                n = self.fresh()
                add(n, TYPE, iri_term(kind))
                add(n, members, self.list(items))
                self.annotations(n, notes)
        elif k == "DisjointUnion":
            self.annotate(add(t(f[0]), OWL + "disjointUnionOf", self.list(map(t, f[1]))), notes)
        elif k == "SubPropertyChainOf":
            self.annotate(add(t(f[1]), OWL + "propertyChainAxiom", self.list(map(t, f[0]))), notes)
        elif k == "InverseObjectProperties":
            self.annotate(add(t(f[0][0]), OWL + "inverseOf", t(f[0][1])), notes)
        elif k == "HasKey":
            self.annotate(add(t(f[0]), OWL + "hasKey", self.list([t(x) for x in (*f[1], *f[2])])), notes)
        elif k == "ClassAssertion":
            self.annotate(add(t(f[1]), TYPE, t(f[0])), notes)
        elif k in ("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion"):
            p, s, v = f
            if p.kind == "OWLObjectInverseOf":
                p, s, v = p.fields[0], v, s
            self.annotate(add(t(s), p.iri, t(v)), notes)
        elif k.startswith("Negative"):
            n = self.fresh()
            add(n, TYPE, iri_term(OWL + "NegativePropertyAssertion"))
            add(n, OWL + "sourceIndividual", t(f[1]))
            add(n, OWL + "assertionProperty", t(f[0]))
            add(n, OWL + ("targetValue" if "Data" in k else "targetIndividual"), t(f[2]))
            self.annotations(n, notes)
        else:
            raise OWLSyntaxError(f"no RDF for {a.kind}")


def to_rdf(o: Ontology, graph: Term | None = None) -> list[Quad]:
    w = Writer(graph)
    head = iri_term(o.iri) if o.iri else blank("ontology")
    w.add(head, TYPE, iri_term(OWL + "Ontology"))
    if o.version:
        w.add(head, OWL + "versionIRI", iri_term(o.version))
    for x in o.imports:
        w.add(head, OWL + "imports", iri_term(x))
    w.annotations(head, o.annotations)
    for a in o.axioms:
        w.axiom(a)
    return list(dict.fromkeys(w.quads))


class Recovered(Ontology):
    """An ontology read from RDF: the statements that no rule took, and diagnostics."""

    unconsumed: list[Quad]
    diagnostics: list[str]


class Reader:
    """One graph's triples as an ontology. strict: a statement that no rule takes is an error."""

    def __init__(self, quads: Iterable[Quad], scope: str = "", strict: bool = False, document_iri: str | None = None, declared: dict[str, set[str]] | None = None) -> None:
        self.triples = dict.fromkeys((q.s, q.p.value, q.o) for q in quads)
        self.scope, self.strict, self.document = scope, strict, document_iri
        self.out: dict[Term, dict[str, list[Term]]] = {}
        for s, p, o in self.triples:
            self.out.setdefault(s, {}).setdefault(p, []).append(o)
        self.used: set[tuple[Term, str, Term]] = set()
        self.notes: list[str] = []
        self.types: dict[str, set[str]] = {k: set(v) for k, v in (declared or {}).items()}
        self.memo: dict[tuple[Term, str], Obj] = {}
        self.active: set[Term] = set()
        self.categories: dict[str, str] = {}
        self._ties: dict[str, set[str]] | None = None

    def get(self, s: Term, p: str) -> list[Term]:
        return self.out.get(s, {}).get(p, [])

    def one(self, s: Term, p: str, use: bool = True) -> Term | None:
        v = self.get(s, p)
        if v and use:
            self.used.add((s, p, v[0]))
        return v[0] if v else None

    def is_a(self, s: Term, t: str, use: bool = True) -> bool:
        if (s, TYPE, iri_term(t)) in self.triples:
            if use:
                self.used.add((s, TYPE, iri_term(t)))
            return True
        return False

    def items(self, head: Term) -> list[Term]:
        out, seen = [], set()
        while head.value != NIL:
            if head in seen:
                raise OWLSyntaxError("a list with a cycle")
            seen.add(head)
            first, rest = self.get(head, FIRST), self.get(head, REST)
            if len(first) != 1 or len(rest) != 1:
                if self.strict or not first:
                    raise OWLSyntaxError("a malformed list")
                self.notes.append("a list without its end")
            self.is_a(head, RDF + "List")
            out.append(self.one(head, FIRST))
            nxt = self.one(head, REST)
            if nxt is None:
                break
            head = nxt
        return out

    def has(self, name: str, keyword: str) -> bool:
        return name in self.types.get(keyword, ()) or name in BUILTINS.get({"Class": "OWLClass", "ObjectProperty": "OWLObjectProperty", "DataProperty": "OWLDataProperty", "AnnotationProperty": "OWLAnnotationProperty", "Datatype": "OWLDatatype", "NamedIndividual": "OWLNamedIndividual"}[keyword], ())

    # terms in a role

    def individual(self, t: Term) -> Obj:
        if t.kind == "literal":
            raise OWLSyntaxError(f"{t} is no individual")
        return entity("NamedIndividual", t.value) if t.kind == "iri" else anonymous(t.value, self.scope)

    def literal(self, t: Term) -> Obj:
        if t.kind != "literal":
            raise OWLSyntaxError(f"{t} is no literal")
        return literal(t.value, t.language, t.datatype)

    def value(self, t: Term) -> Obj:
        return self.literal(t) if t.kind == "literal" else iri(t.value) if t.kind == "iri" else anonymous(t.value, self.scope)

    def object(self, t: Term) -> Obj:
        if t.kind == "iri":
            return entity("ObjectProperty", t.value)
        inner = self.one(t, OWL + "inverseOf")
        if inner is None or inner.kind != "iri":
            raise OWLSyntaxError(f"{t} is no property expression")
        self.is_a(t, OWL + "ObjectProperty")
        return make("ObjectInverseOf", entity("ObjectProperty", inner.value))

    def once(self, t: Term, role: str, f: Callable[[Term], Obj]) -> Obj:
        if (t, role) not in self.memo:
            if t in self.active:
                raise OWLSyntaxError("an expression inside itself")
            self.active.add(t)
            try:
                self.memo[t, role] = f(t)
            finally:
                self.active.discard(t)
        return self.memo[t, role]

    def cls(self, t: Term) -> Obj:
        if t.kind == "iri":
            return entity("Class", t.value)
        return self.once(t, "class", self._class)

    def range(self, t: Term) -> Obj:
        if t.kind == "iri":
            return entity("Datatype", t.value)
        return self.once(t, "range", self._range)

    def _class(self, t: Term) -> Obj:
        self.is_a(t, OWL + "Class")
        self.is_a(t, RDFS + "Class")
        for p, k in (("intersectionOf", "ObjectIntersectionOf"), ("unionOf", "ObjectUnionOf")):
            if (v := self.one(t, OWL + p)) is not None:
                return make(k, [self.cls(x) for x in self.items(v)])
        if (v := self.one(t, OWL + "complementOf")) is not None:
            return make("ObjectComplementOf", self.cls(v))
        if (v := self.one(t, OWL + "oneOf")) is not None:
            return make("ObjectOneOf", [self.individual(x) for x in self.items(v)])
        self.is_a(t, OWL + "Restriction")
        many = self.one(t, OWL + "onProperties")
        p = self.one(t, OWL + "onProperty") if many is None else None
        if p is None and many is None:
            raise OWLSyntaxError(f"{t} is no class expression")
        names = self.items(many) if many is not None else [p]
        data = lambda filler: all(x.kind == "iri" and self.has(x.value, "DataProperty") for x in names) or (filler is not None and names[0].kind == "iri" and not self.has(names[0].value, "ObjectProperty") and (filler.kind == "literal" or self.is_range(filler)))
        for q, word in (("someValuesFrom", "SomeValuesFrom"), ("allValuesFrom", "AllValuesFrom")):
            if (v := self.one(t, OWL + q)) is not None:
                if data(v):
                    return make("Data" + word, [entity("DataProperty", x.value) for x in names], self.range(v))
                return make("Object" + word, self.object(names[0]), self.cls(v))
        if (v := self.one(t, OWL + "hasValue")) is not None:
            if v.kind == "literal":
                return make("DataHasValue", entity("DataProperty", names[0].value), self.literal(v))
            return make("ObjectHasValue", self.object(names[0]), self.individual(v))
        if self.one(t, OWL + "hasSelf") is not None:
            return make("ObjectHasSelf", self.object(names[0]))
        for word in ("Min", "Max", ""):
            plain = word.lower() + "Cardinality" if word else "cardinality"
            qualified = word.lower() + "QualifiedCardinality" if word else "qualifiedCardinality"
            n = self.one(t, OWL + plain)
            on = None
            if n is None and (n := self.one(t, OWL + qualified)) is not None:
                on = self.one(t, OWL + "onClass") or self.one(t, OWL + "onDataRange")
            if n is not None:
                number = cardinality(_integer(n.value))
                kind = (word or "Exact") + "Cardinality"
                if self.get(t, OWL + "onDataRange") or (not self.get(t, OWL + "onClass") and data(on)):
                    return make("Data" + kind, number, entity("DataProperty", names[0].value), self.range(on) if on else entity("Datatype", RDFS + "Literal"))
                return make("Object" + kind, number, self.object(names[0]), self.cls(on) if on else entity("Class", THING))
        raise OWLSyntaxError(f"{t} is no class expression")

    def is_range(self, t: Term) -> bool:
        if t.kind == "iri":
            return self.has(t.value, "Datatype") or t.value in BUILTIN_DATATYPES
        if (t, TYPE, iri_term(RDFS + "Datatype")) in self.triples or (t, TYPE, iri_term(OWL + "DataRange")) in self.triples:
            return True
        return any(self.get(t, OWL + p) for p in ("onDatatype", "datatypeComplementOf"))

    def _range(self, t: Term) -> Obj:
        self.is_a(t, RDFS + "Datatype")
        self.is_a(t, OWL + "DataRange")
        for p, k in (("intersectionOf", "DataIntersectionOf"), ("unionOf", "DataUnionOf")):
            if (v := self.one(t, OWL + p)) is not None:
                return make(k, [self.range(x) for x in self.items(v)])
        for p in ("datatypeComplementOf", "complementOf"):
            if (v := self.one(t, OWL + p)) is not None:
                return make("DataComplementOf", self.range(v))
        if (v := self.one(t, OWL + "oneOf")) is not None:
            values = self.items(v)
            return make("DataOneOf", [self.literal(x) for x in values]) if values else make("DataComplementOf", entity("Datatype", RDFS + "Literal"))
        if (v := self.one(t, OWL + "onDatatype")) is not None:
            facets = []
            for cell in self.items(self.one(t, OWL + "withRestrictions")):
                for p, vs in self.out.get(cell, {}).items():
                    for x in vs:
                        self.used.add((cell, p, x))
                        facets.append(make("OWLFacetRestriction", iri(p), self.literal(x)))
            return make("DatatypeRestriction", entity("Datatype", v.value), facets)
        raise OWLSyntaxError(f"{t} is no data range")

    # annotations

    def annotations_of(self, node: Term, skip: Iterable[str] = ()) -> list[Obj]:
        out = []
        for p, vs in self.out.get(node, {}).items():
            if p in skip or p.startswith((OWL, RDF)) and not self.has(p, "AnnotationProperty") or not (self.has(p, "AnnotationProperty")):
                continue
            for v in vs:
                self.used.add((node, p, v))
                out.append(make("OWLAnnotation", entity("AnnotationProperty", p), self.value(v), annotations=self.reified((node, p, v), OWL + "Annotation")))
        return out

    def reified(self, triple: tuple[Term, str, Term], kind: str = OWL + "Axiom") -> list[Obj]:
        out = []
        for n in self.about.get(triple, ()):
            if not self.is_a(n, kind):
                continue
            for p in ("annotatedSource", "annotatedProperty", "annotatedTarget"):
                self.one(n, OWL + p)
            out += self.annotations_of(n)
        return out

    def parse(self) -> Recovered:
        named: dict[str, list[str]] = {}
        for s, p, o in self.triples:
            if p == TYPE and s.kind == "iri":
                for k, v in _DECLARED.items():
                    if o.value == v:
                        self.types.setdefault(k, set()).add(s.value)
                        named.setdefault(k, []).append(s.value)
                for v in ("SymmetricProperty", "TransitiveProperty", "AsymmetricProperty", "ReflexiveProperty", "IrreflexiveProperty", "InverseFunctionalProperty"):
                    if o.value == OWL + v:
                        self.types.setdefault("ObjectProperty", set()).add(s.value)
                if o.value in (RDFS + "Class",):
                    self.types.setdefault("Class", set()).add(s.value)
                if o.value == OWL + "OntologyProperty":
                    self.types.setdefault("AnnotationProperty", set()).add(s.value)
        self.about: dict[tuple[Term, str, Term], list[Term]] = {}
        for s, p, o in self.triples:
            if p == OWL + "annotatedSource":
                q, t = self.get(s, OWL + "annotatedProperty"), self.get(s, OWL + "annotatedTarget")
                if q and t:
                    self.about.setdefault((o, q[0].value, t[0]), []).append(s)
        out = Recovered()
        self.header(out)
        add = lambda triple, kind, *values: (self.used.add(triple), out.axioms.append(make(kind, *values, annotations=self.reified(triple))))
        for k, names in named.items():
            for n in names:
                add((iri_term(n), TYPE, iri_term(_DECLARED[k])), "Declaration", entity(k, n))
        for triple in list(self.triples):
            if triple not in self.used:
                self.statement(triple, add, out)
        self.leftovers(out)
        return out

    def header(self, out: Recovered) -> None:
        heads = [s for s, p, o in self.triples if p == TYPE and o.value == OWL + "Ontology"]
        if len(heads) > 1 and self.strict:
            raise OWLSyntaxError("more than one ontology header")
        if not heads:
            return
        head = min(heads, key=lambda h: (h.value != self.document, h.kind != "iri", len(h.value), h.value))
        if len(heads) > 1:
            self.notes.append("more than one ontology header")
        for h in heads:
            self.is_a(h, OWL + "Ontology")
        out.iri = head.value if head.kind == "iri" else None
        v = self.one(head, OWL + "versionIRI")
        out.version = v.value if v else None
        for x in self.get(head, OWL + "imports"):
            self.used.add((head, OWL + "imports", x))
            out.imports.append(x.value)
        for p, vs in self.out.get(head, {}).items():
            if self.has(p, "AnnotationProperty"):
                for x in vs:
                    self.used.add((head, p, x))
                    out.annotations.append(make("OWLAnnotation", entity("AnnotationProperty", p), self.value(x), annotations=self.reified((head, p, x), OWL + "Annotation") + self.reified((head, p, x))))

    def kind_of(self, t: Term) -> str:
        """Category of a property: a blank node is an inverse; one declared category; of several, or of none but a bare
        rdf:Property, what its own range and characteristics say, then what the properties tied to it say, then data before
        object before annotation."""
        if t.kind == "blank":
            return "Object"
        if t.value not in self.categories:
            self.categories[t.value] = self._category(t.value)
        return self.categories[t.value]

    def _category(self, name: str) -> str:
        declared = [k for k in ("Data", "Object", "Annotation") if self.has(name, k + "Property")]
        if len(declared) == 1:
            return declared[0]
        if not declared and not self.is_a(iri_term(name), RDF + "Property", False):
            return ""
        seen, edge = {name}, [name]
        for _ in range(32):
            found = {e for n in edge if (e := self.evidence(n)) and (not declared or e in declared)}
            if len(found) == 1:
                return found.pop()
            if found:
                break
            edge = sorted({m for n in edge for m in self.tied(n)} - seen)
            seen.update(edge)
            if not edge:
                break
        return declared[0] if declared else ""

    def evidence(self, name: str) -> str:
        """What a property's own statements say: its ranges first, then its characteristics."""
        s = iri_term(name)
        kinds = {"Data" if self.is_range(r) else "Object" for r in self.get(s, RDFS + "range") if self.is_range(r) or r.kind == "blank" or self.has(r.value, "Class")}
        if len(kinds) == 1:
            return kinds.pop()
        only = ("SymmetricProperty", "AsymmetricProperty", "TransitiveProperty", "ReflexiveProperty", "IrreflexiveProperty", "InverseFunctionalProperty")
        return "Object" if not kinds and any(self.is_a(s, OWL + c, False) for c in only) else ""

    def tied(self, name: str) -> set[str]:
        """Sub-, super- and equivalent properties."""
        if self._ties is None:
            self._ties = {}
            for s, p, o in self.triples:
                if p in (RDFS + "subPropertyOf", OWL + "equivalentProperty") and s.kind == o.kind == "iri":
                    self._ties.setdefault(s.value, set()).add(o.value)
                    self._ties.setdefault(o.value, set()).add(s.value)
        return self._ties.get(name, set())

    def prop(self, t: Term, kind: str) -> Obj:
        return self.object(t) if kind == "Object" else entity(kind + "Property", t.value)

    def statement(self, triple: tuple[Term, str, Term], add, out: Recovered) -> None:
        s, p, o = triple
        if p == TYPE:
            self.typed(triple, add, out)
        elif p == RDFS + "subClassOf":
            add(triple, "SubClassOf", self.cls(s), self.cls(o))
        elif p == OWL + "equivalentClass":
            if s.kind == "iri" and self.has(s.value, "Datatype") or s.kind == "blank" and self.is_range(s) and self.is_range(o):
                add(triple, "DatatypeDefinition", entity("Datatype", s.value), self.range(o))
            else:
                add(triple, "EquivalentClasses", [self.cls(s), self.cls(o)])
        elif p == OWL + "disjointWith":
            add(triple, "DisjointClasses", [self.cls(s), self.cls(o)])
        elif p == OWL + "disjointUnionOf":
            add(triple, "DisjointUnion", self.cls(s), [self.cls(x) for x in self.items(o)])
        elif p == RDFS + "subPropertyOf":
            k, k2 = self.kind_of(s), self.kind_of(o)
            if k and k2 and k != k2:
                self.notes.append(f"{s} and {o} are properties of different categories")
                self.used.add(triple)
            else:
                kind = k or k2 or "Object"
                add(triple, f"Sub{kind}PropertyOf", self.prop(s, kind), self.prop(o, kind))
        elif p == OWL + "propertyChainAxiom":
            add(triple, "SubPropertyChainOf", [self.object(x) for x in self.items(o)], self.object(s))
        elif p == OWL + "equivalentProperty":
            kind = self.kind_of(s) or self.kind_of(o) or "Object"
            add(triple, f"Equivalent{kind}Properties", [self.prop(s, kind), self.prop(o, kind)])
        elif p == OWL + "propertyDisjointWith":
            kind = self.kind_of(s) or self.kind_of(o) or "Object"
            add(triple, f"Disjoint{kind}Properties", [self.prop(s, kind), self.prop(o, kind)])
        elif p in (RDFS + "domain", RDFS + "range"):
            word = "Domain" if p.endswith("domain") else "Range"
            kind = self.kind_of(s) or ("Data" if word == "Range" and self.is_range(o) else "Object")
            value = iri(o.value) if kind == "Annotation" else self.range(o) if kind == "Data" and word == "Range" else self.cls(o)
            add(triple, f"{kind}Property{word}", self.prop(s, kind), value)
        elif p == OWL + "inverseOf":
            if s.kind == "iri":
                add(triple, "InverseObjectProperties", [self.object(s), self.object(o)])
        elif p == OWL + "hasKey":
            items = self.items(o)
            data = [x for x in items if self.kind_of(x) == "Data"]
            add(triple, "HasKey", self.cls(s), [self.object(x) for x in items if x not in data], [entity("DataProperty", x.value) for x in data])
        elif p == OWL + "sameAs":
            add(triple, "SameIndividual", [self.individual(s), self.individual(o)])
        elif p == OWL + "differentFrom":
            add(triple, "DifferentIndividuals", [self.individual(s), self.individual(o)])
        elif (kind := self.kind_of(iri_term(p))) in ("Object", "Data") and not self.has(p, kind + "Property") and (kind == "Data") == (o.kind == "literal"):
            value = self.literal(o) if kind == "Data" else self.individual(o)
            add(triple, f"{kind}PropertyAssertion", entity(kind + "Property", p), self.individual(s), value)
        elif not p.startswith((OWL, RDF)) or self.has(p, "AnnotationProperty") or self.has(p, "ObjectProperty") or self.has(p, "DataProperty"):
            if self.has(p, "ObjectProperty") and o.kind != "literal":
                add(triple, "ObjectPropertyAssertion", entity("ObjectProperty", p), self.individual(s), self.individual(o))
            elif self.has(p, "DataProperty") and o.kind == "literal":
                add(triple, "DataPropertyAssertion", entity("DataProperty", p), self.individual(s), self.literal(o))
            elif self.has(p, "AnnotationProperty") and not self.annotated(s):
                add(triple, "AnnotationAssertion", entity("AnnotationProperty", p), iri(s.value) if s.kind == "iri" else anonymous(s.value, self.scope), self.value(o))

    def annotated(self, s: Term) -> bool:
        return any(self.is_a(s, OWL + t, False) for t in ("Axiom", "Annotation", "AllDisjointClasses", "AllDisjointProperties", "AllDifferent", "NegativePropertyAssertion"))

    def typed(self, triple: tuple[Term, str, Term], add, out: Recovered) -> None:
        s, _, o = triple
        name = o.value.removeprefix(OWL)
        if o.value.startswith(OWL) and name in ("AllDisjointClasses", "AllDisjointProperties", "AllDifferent"):
            head = self.one(s, OWL + "members") or self.one(s, OWL + "distinctMembers")
            items = self.items(head) if head else []
            if name == "AllDisjointClasses":
                values, kind = [self.cls(x) for x in items], "DisjointClasses"
            elif name == "AllDifferent":
                values, kind = [self.individual(x) for x in items], "DifferentIndividuals"
            else:
                k = next((self.kind_of(x) for x in items if self.kind_of(x)), "Object")
                values, kind = [self.prop(x, k) for x in items], f"Disjoint{k}Properties"
            self.used.add(triple)
            out.axioms.append(make(kind, values, annotations=self.annotations_of(s)))
        elif o.value == OWL + "NegativePropertyAssertion":
            p, i = self.one(s, OWL + "assertionProperty"), self.one(s, OWL + "sourceIndividual")
            self.used.add(triple)
            if (v := self.one(s, OWL + "targetValue")) is not None:
                out.axioms.append(make("NegativeDataPropertyAssertion", entity("DataProperty", p.value), self.individual(i), self.literal(v), annotations=self.annotations_of(s)))
            else:
                out.axioms.append(make("NegativeObjectPropertyAssertion", self.object(p), self.individual(i), self.individual(self.one(s, OWL + "targetIndividual")), annotations=self.annotations_of(s)))
        elif o.value.startswith(OWL) and name.endswith("Property") and OWL + name in _CHARACTER.values():
            kind = "Data" if name == "FunctionalProperty" and self.kind_of(s) == "Data" else "Object"
            add(triple, name.replace("Property", f"{kind}Property"), self.prop(s, kind))
        elif o.value in (RDF + "List", RDF + "Property", RDFS + "Class", OWL + "Axiom", OWL + "Annotation", OWL + "Ontology", OWL + "DeprecatedClass", OWL + "DeprecatedProperty", OWL + "OntologyProperty"):
            if o.value.startswith(OWL + "Deprecated"):
                self.used.add(triple)
                out.axioms.append(make("AnnotationAssertion", entity("AnnotationProperty", OWL + "deprecated"), iri(s.value), literal("true", "", XSD + "boolean")))
            elif o.value in (RDFS + "Class", RDF + "Property") and s.kind == "iri":
                self.used.add(triple)
        elif not (o.value.startswith((OWL, RDF, RDFS)) and o.value not in (THING, NOTHING)) and not (o.kind == "literal"):
            add(triple, "ClassAssertion", self.cls(o), self.individual(s))

    def leftovers(self, out: Recovered) -> None:
        left = [t for t in self.triples if t not in self.used]
        if left and self.strict:
            s, p, o = left[0]
            raise OWLSyntaxError(f"no rule takes {s} <{p}> {o}, and {len(left) - 1} more")
        for s, p, o in list(left):
            if not p.startswith((OWL, RDF, RDFS, XSD)) and not self.annotated(s) and not any(self.has(p, k) for k in ("ObjectProperty", "DataProperty")):
                # An unknown predicate of a statement about something named is kept as an annotation.
                self.used.add((s, p, o))
                out.axioms.append(make("AnnotationAssertion", entity("AnnotationProperty", p), iri(s.value) if s.kind == "iri" else anonymous(s.value, self.scope), self.value(o), annotations=self.reified((s, p, o))))
        out.unconsumed = [Quad(s, iri_term(p), o) for s, p, o in self.triples if (s, p, o) not in self.used]
        out.diagnostics = self.notes


def _integer(lexical: str) -> int:
    from decimal import Decimal

    n = Decimal(lexical.strip())
    if n != n.to_integral_value() or n < 0:
        raise OWLSyntaxError(f"{lexical} is no cardinality")
    return int(n)


def from_rdf(quads: Iterable[Quad], scope: str = "", strict: bool = False, document_iri: str | None = None, declared: dict[str, set[str]] | None = None) -> Recovered:
    return Reader(quads, scope, strict, document_iri, declared).parse()
