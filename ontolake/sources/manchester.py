"""Manchester syntax: reader of frames, and renderer of single objects."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..errors import OWLSyntaxError
from ..model import KIND, OWL, RDF, RDFS, RDFS_LITERAL, THING, XSD, Obj, Ontology, anonymous, cardinality, entity, escape, iri, literal, make
from .functional import DEFAULT_PREFIXES

#: Facets by their signs, frames and sections.
FACETS = {"length": "length", "minLength": "minLength", "maxLength": "maxLength", "pattern": "pattern", "langRange": None, "<=": "maxInclusive", "<": "maxExclusive", ">=": "minInclusive", ">": "minExclusive"}
FRAMES = {"Class:": "Class", "Datatype:": "Datatype", "ObjectProperty:": "ObjectProperty", "DataProperty:": "DataProperty", "AnnotationProperty:": "AnnotationProperty", "Individual:": "NamedIndividual"}
MISC = {"EquivalentClasses:": ("EquivalentClasses", "class"), "DisjointClasses:": ("DisjointClasses", "class"), "EquivalentProperties:": ("Equivalent", "property"), "DisjointProperties:": ("Disjoint", "property"), "SameIndividual:": ("SameIndividual", "individual"), "DifferentIndividuals:": ("DifferentIndividuals", "individual")}
SECTIONS = {"Annotations:", "SubClassOf:", "EquivalentTo:", "DisjointWith:", "DisjointUnionOf:", "HasKey:", "Domain:", "Range:", "Characteristics:", "SubPropertyOf:", "InverseOf:", "SubPropertyChain:", "Types:", "Facts:", "SameAs:", "DifferentFrom:", "SuperClassOf:"}
_HEAD = {"Prefix:", "Ontology:", "Import:"}
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|<[^<>"{}|^`\\\x00-\x20]+>|"(?:[^"\\]|\\.)*"|\^\^|@[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*|<=|>=|[<>,(){}\[\]]|_:[^\s,(){}\[\]]+
      |[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fF]?(?![\w:])|[^\s,(){}\[\]<>"^@]+""",
    re.X | re.S,
)
_SIMPLE = {"integer": XSD + "integer", "decimal": XSD + "decimal", "float": XSD + "float", "string": XSD + "string"}


class _Reader:
    def __init__(self, text: str, scope: str) -> None:
        self.text, self.scope, self.prefixes, self.tokens, at = text, scope, dict(DEFAULT_PREFIXES), [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise OWLSyntaxError(f"unexpected {text[at]!r}", text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at))
            if m[0].strip() and m[0][0] != "#":
                self.tokens.append((m[0], at))
            at = m.end()
        self.at, self.out = 0, Ontology(prefixes=self.prefixes)
        # Which names are data properties and datatypes shows only in their frames.
        self.known: dict[str, set[str]] = {k: set() for k in FRAMES.values()}

    def fail(self, message: str) -> None:
        at = self.tokens[min(self.at, len(self.tokens) - 1)][1] if self.tokens else 0
        raise OWLSyntaxError(message, self.text.count("\n", 0, at) + 1, at - self.text.rfind("\n", 0, at))

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self, value: str | None = None) -> str:
        t = self.peek()
        if not t or value is not None and t != value:
            self.fail(f"expected {value or 'more'}, found {t or 'the end'}")
        self.at += 1
        return t

    def accept(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def full(self, t: str | None = None) -> str:
        t = self.take() if t is None else t
        if t.startswith("<"):
            return t[1:-1]
        p, colon, rest = t.partition(":")
        if not colon:
            p, rest = "", t
            if rest in _SIMPLE:
                return _SIMPLE[rest]
        if p + ":" not in self.prefixes:
            self.at -= 1
            self.fail(f"unknown prefix {p}:" if colon else f"unknown name {t}")
        return self.prefixes[p + ":"] + rest

    def survey(self) -> None:
        """Prefixes and frames first."""
        for i, (t, _) in enumerate(self.tokens[:-1]):
            if t == "Prefix:":
                self.prefixes[self.tokens[i + 1][0]] = self.tokens[i + 2][0][1:-1]
        for i, (t, _) in enumerate(self.tokens[:-1]):
            if t in FRAMES and not self.tokens[i + 1][0].startswith("_:"):
                self.at = i + 1
                self.known[FRAMES[t]].add(self.full())
        self.at = 0

    def is_data(self, name: str) -> bool:
        return name in self.known["DataProperty"] or name in (OWL + "topDataProperty", OWL + "bottomDataProperty")

    def is_range(self, name: str) -> bool:
        return name in self.known["Datatype"] or name.startswith(XSD) or name in (RDFS_LITERAL, RDF + "PlainLiteral", RDF + "XMLLiteral", RDF + "langString", OWL + "real", OWL + "rational")

    # values

    def literal(self) -> Obj:
        t = self.take()
        if t.startswith('"'):
            lexical = re.sub(r"\\(.)", r"\1", t[1:-1], flags=re.S)
            if self.peek().startswith("@"):
                return literal(lexical, self.take()[1:])
            if self.accept("^^"):
                return literal(lexical, "", self.full())
            return literal(lexical)
        if t in ("true", "false"):
            return literal(t, "", XSD + "boolean")
        if re.fullmatch(r"[+-]?[0-9]+", t):
            return literal(t, "", XSD + "integer")
        if re.fullmatch(r"[+-]?[0-9]*\.[0-9]+", t):
            return literal(t, "", XSD + "decimal")
        if re.fullmatch(r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?[fF]", t):
            return literal(t[:-1], "", XSD + "float")
        self.at -= 1
        self.fail(f"expected a literal, found {t}")
        raise AssertionError

    def starts_literal(self) -> bool:
        return bool(re.match(r'"|[+-]?\.?[0-9]|(?:true|false)$', self.peek()))

    def individual(self) -> Obj:
        t = self.take()
        return anonymous(t[2:], self.scope) if t.startswith("_:") else entity("NamedIndividual", self.full(t))

    def property(self) -> Obj:
        if self.accept("inverse"):
            closed = self.accept("(")
            p = entity("ObjectProperty", self.full())
            if closed:
                self.take(")")
            return make("ObjectInverseOf", p)
        name = self.full()
        return entity("DataProperty" if self.is_data(name) else "ObjectProperty", name)

    def object_property(self) -> Obj:
        p = self.property()
        return entity("ObjectProperty", p.iri) if p.kind == "OWLDataProperty" else p

    def value(self) -> Obj:
        if self.starts_literal():
            return self.literal()
        t = self.take()
        return anonymous(t[2:], self.scope) if t.startswith("_:") else iri(self.full(t))

    # expressions

    def union(self, primary: Callable[[], Obj], any_: str, all_: str) -> Obj:
        def joined(word: str, inner: Callable[[], Obj], kind: str) -> Obj:
            parts = [inner()]
            while self.peek() == word or word == "and" and self.peek() == "that":
                self.take()
                parts.append(inner())
            return parts[0] if len(parts) == 1 else make(kind, parts)

        return joined("or", lambda: joined("and", primary, all_), any_)

    def cls(self) -> Obj:
        return self.union(self.class_primary, "ObjectUnionOf", "ObjectIntersectionOf")

    def range(self) -> Obj:
        return self.union(self.range_primary, "DataUnionOf", "DataIntersectionOf")

    def class_primary(self) -> Obj:
        if self.accept("not"):
            return make("ObjectComplementOf", self.class_primary())
        if self.accept("("):
            out = self.cls()
            self.take(")")
            return out
        if self.accept("{"):
            out = [self.individual()]
            while self.accept(","):
                out.append(self.individual())
            self.take("}")
            return make("ObjectOneOf", out)
        after = self.peek(4 if self.peek() == "inverse" and self.peek(1) == "(" else 2 if self.peek() == "inverse" else 1)
        if after in ("some", "only", "value", "Self", "min", "max", "exactly"):
            return self.restriction()
        return entity("Class", self.full())

    def restriction(self) -> Obj:
        p = self.property()
        word = self.take()
        data = p.kind == "OWLDataProperty"
        if word == "Self":
            return make("ObjectHasSelf", p)
        if word == "value":
            if self.starts_literal():
                return make("DataHasValue", entity("DataProperty", p.iri), self.literal())
            return make("ObjectHasValue", p, self.individual())
        if word in ("some", "only"):
            name = "SomeValuesFrom" if word == "some" else "AllValuesFrom"
            if data or self.looks_like_range():
                return make("Data" + name, [entity("DataProperty", p.iri)], self.range_primary())
            return make("Object" + name, p, self.class_primary())
        n = cardinality(self.take())
        name = {"min": "MinCardinality", "max": "MaxCardinality", "exactly": "ExactCardinality"}[word]
        if self.ends():
            return make("Data" + name, n, p, entity("Datatype", RDFS_LITERAL)) if data else make("Object" + name, n, p, entity("Class", THING))
        if data or self.looks_like_range():
            return make("Data" + name, n, entity("DataProperty", p.iri), self.range_primary())
        return make("Object" + name, n, p, self.class_primary())

    def looks_like_range(self) -> bool:
        t = self.peek()
        if t == "{":
            return bool(re.match(r'"|[+-]?\.?[0-9]|(?:true|false)$', self.peek(1)))
        if t in ("(", "not"):
            return False
        try:
            at = self.at
            return self.is_range(self.full())
        except OWLSyntaxError:
            return False
        finally:
            self.at = at

    def ends(self) -> bool:
        t = self.peek()
        return not t or t in (",", ")", "and", "or", "}", "]") or t in SECTIONS or t in FRAMES or t in MISC

    def range_primary(self) -> Obj:
        if self.accept("not"):
            return make("DataComplementOf", self.range_primary())
        if self.accept("("):
            out = self.range()
            self.take(")")
            return out
        if self.accept("{"):
            out = [self.literal()]
            while self.accept(","):
                out.append(self.literal())
            self.take("}")
            return make("DataOneOf", out)
        d = entity("Datatype", self.full())
        if self.accept("["):
            facets = []
            while True:
                f = self.take()
                if f not in FACETS:
                    self.fail(f"no facet: {f}")
                facets.append(make("OWLFacetRestriction", iri(XSD + FACETS[f] if FACETS[f] else RDF + f), self.literal()))
                if not self.accept(","):
                    break
            self.take("]")
            return make("DatatypeRestriction", d, facets)
        return d

    # frames

    def annotations(self) -> list[Obj]:
        out = []
        if self.accept("Annotations:"):
            while True:
                more = self.annotations()
                out.append(make("OWLAnnotation", entity("AnnotationProperty", self.full()), self.value(), annotations=more))
                if not (self.peek() == "," and self.more_annotations()):
                    break
                self.take(",")
        return out

    def more_annotations(self) -> bool:
        """After a comma: another annotation, or the next item of a section."""
        t, nxt = self.peek(1), self.peek(2)
        if t == "Annotations:":
            return True
        return bool(t) and (t.startswith("<") or ":" in t) and bool(re.match(r'"|<|_:|[+-]?\.?[0-9]|(?:true|false)$|[^,(){}\[\]]*:[^\s]', nxt)) and not nxt.endswith(":") and self.annotation_like(t)

    def annotation_like(self, t: str) -> bool:
        try:
            n = self.full(t)
        except OWLSyntaxError:
            return False
        return n in self.known["AnnotationProperty"] or n.startswith((RDFS, OWL))

    def items(self, one: Callable[[list[Obj]], None]) -> None:
        while True:
            one(self.annotations())
            if not self.accept(","):
                break

    def many(self, one: Callable[[], Any]) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    def add(self, kind: str, *values: Any, notes: list[Obj]) -> None:
        self.out.axioms.append(make(kind, *values, annotations=notes))

    def document(self) -> Ontology:
        self.survey()
        while self.accept("Prefix:"):
            self.take(), self.take()
        self.take("Ontology:")
        if self.peek().startswith("<") or self.peek() and self.peek() not in SECTIONS | _HEAD and self.peek() not in FRAMES and self.peek() not in MISC:
            self.out.iri = self.full()
            if self.peek().startswith("<"):
                self.out.version = self.full()
        while self.peek() in ("Import:", "Annotations:"):
            if self.accept("Import:"):
                self.out.imports.append(self.full())
            else:
                self.out.annotations += self.annotations()
        while self.peek():
            t = self.take()
            if t in FRAMES:
                self.frame(FRAMES[t])
            elif t in MISC:
                self.misc(*MISC[t])
            else:
                self.at -= 1
                self.fail(f"no frame: {t}")
        return self.out.distinct()

    def misc(self, kind: str, what: str) -> None:
        notes = self.annotations()
        if what == "property":
            ps = self.many(self.property)
            word = "Data" if any(p.kind == "OWLDataProperty" for p in ps) else "Object"
            self.add(f"{kind}{word}Properties", ps, notes=notes)
        else:
            self.add(kind, self.many(self.cls if what == "class" else self.individual), notes=notes)

    def frame(self, keyword: str) -> None:
        subject = self.individual() if keyword == "NamedIndividual" else entity(keyword, self.full())
        if subject.iri is not None:
            self.out.axioms.append(make("Declaration", subject))
        while self.peek() in SECTIONS:
            section = self.take()
            getattr(self, "in_" + keyword.lower())(subject, section[:-1])

    def about(self, subject: Obj) -> None:
        """Annotations of the frame's subject; each may be annotated itself."""

        def one(notes: list[Obj]) -> None:
            target = iri(subject.iri) if subject.iri is not None else subject
            self.add("AnnotationAssertion", entity("AnnotationProperty", self.full()), target, self.value(), notes=notes)

        self.items(one)

    def unknown(self, section: str) -> None:
        self.at -= 1
        self.fail(f"no section of this frame: {section}")

    def in_class(self, c: Obj, section: str) -> None:
        if section == "Annotations":
            self.about(c)
        elif section == "DisjointUnionOf":
            notes = self.annotations()
            self.add("DisjointUnion", c, self.many(self.cls), notes=notes)
        elif section == "HasKey":
            notes, ps = self.annotations(), []
            while not self.ends():
                ps.append(self.property())
                self.accept(",")
            self.add("HasKey", c, [p for p in ps if p.kind != "OWLDataProperty"], [p for p in ps if p.kind == "OWLDataProperty"], notes=notes)
        elif section == "SubClassOf":
            self.items(lambda n: self.add("SubClassOf", c, self.cls(), notes=n))
        elif section == "SuperClassOf":
            self.items(lambda n: self.add("SubClassOf", self.cls(), c, notes=n))
        elif section in ("EquivalentTo", "DisjointWith"):
            self.items(lambda n: self.add("EquivalentClasses" if section == "EquivalentTo" else "DisjointClasses", [c, self.cls()], notes=n))
        else:
            self.unknown(section)

    def in_datatype(self, d: Obj, section: str) -> None:
        if section == "Annotations":
            self.about(d)
        elif section == "EquivalentTo":
            self.items(lambda n: self.add("DatatypeDefinition", d, self.range(), notes=n))
        else:
            self.unknown(section)

    def in_objectproperty(self, p: Obj, section: str) -> None:
        sets = {"EquivalentTo": "EquivalentObjectProperties", "DisjointWith": "DisjointObjectProperties", "InverseOf": "InverseObjectProperties"}
        if section == "Annotations":
            self.about(p)
        elif section in ("Domain", "Range"):
            self.items(lambda n: self.add("ObjectProperty" + section, p, self.cls(), notes=n))
        elif section == "Characteristics":
            self.items(lambda n: self.add(self.take() + "ObjectProperty", p, notes=n))
        elif section == "SubPropertyOf":
            self.items(lambda n: self.add("SubObjectPropertyOf", p, self.object_property(), notes=n))
        elif section in sets:
            self.items(lambda n: self.add(sets[section], [p, self.object_property()], notes=n))
        elif section == "SubPropertyChain":

            def chain(n: list[Obj]) -> None:
                parts = [self.object_property()]
                while self.accept("o"):
                    parts.append(self.object_property())
                self.add("SubPropertyChainOf", parts, p, notes=n)

            self.items(chain)
        else:
            self.unknown(section)

    def in_dataproperty(self, p: Obj, section: str) -> None:
        if section == "Annotations":
            self.about(p)
        elif section == "Domain":
            self.items(lambda n: self.add("DataPropertyDomain", p, self.cls(), notes=n))
        elif section == "Range":
            self.items(lambda n: self.add("DataPropertyRange", p, self.range(), notes=n))
        elif section == "Characteristics":
            self.items(lambda n: self.add(self.take() + "DataProperty", p, notes=n))
        elif section == "SubPropertyOf":
            self.items(lambda n: self.add("SubDataPropertyOf", p, entity("DataProperty", self.full()), notes=n))
        elif section in ("EquivalentTo", "DisjointWith"):
            self.items(lambda n: self.add("EquivalentDataProperties" if section == "EquivalentTo" else "DisjointDataProperties", [p, entity("DataProperty", self.full())], notes=n))
        else:
            self.unknown(section)

    def in_annotationproperty(self, p: Obj, section: str) -> None:
        if section == "Annotations":
            self.about(p)
        elif section in ("Domain", "Range"):
            self.items(lambda n: self.add("AnnotationProperty" + section, p, iri(self.full()), notes=n))
        elif section == "SubPropertyOf":
            self.items(lambda n: self.add("SubAnnotationPropertyOf", p, entity("AnnotationProperty", self.full()), notes=n))
        else:
            self.unknown(section)

    def in_namedindividual(self, i: Obj, section: str) -> None:
        if section == "Annotations":
            self.about(i)
        elif section == "Types":
            self.items(lambda n: self.add("ClassAssertion", self.cls(), i, notes=n))
        elif section in ("SameAs", "DifferentFrom"):
            self.items(lambda n: self.add("SameIndividual" if section == "SameAs" else "DifferentIndividuals", [i, self.individual()], notes=n))
        elif section == "Facts":

            def fact(n: list[Obj]) -> None:
                no = "Negative" if self.accept("not") else ""
                p = self.property()
                if self.starts_literal():
                    self.add(no + "DataPropertyAssertion", entity("DataProperty", p.iri), i, self.literal(), notes=n)
                else:
                    self.add(no + "ObjectPropertyAssertion", p, i, self.individual(), notes=n)

            self.items(fact)
        else:
            self.unknown(section)


def parse(text: str, scope: str = "") -> Ontology:
    return _Reader(text.removeprefix("﻿"), scope).document()


_SIGN = {XSD + v: k for k, v in FACETS.items() if v} | {RDF + "langRange": "langRange"}


def render_object(o: Obj, short: Callable[[Obj], str] | None = None, inner: bool = False) -> str:
    """One object as plain text, entities by a short-form provider. Datatype definitions render empty."""
    name = short or (lambda e: re.search(r"[\w.-]*$", e.iri)[0] or f"<{e.iri}>")
    r = lambda x, deep=True: render_object(x, short, deep)
    k, f = KIND[o.kind].keyword, o.fields
    if o.kind == "OWLLiteral":
        if f[2] in (XSD + "integer", XSD + "decimal", XSD + "boolean"):
            return f[0]
        return f'"{escape(f[0])}"' + (f"@{f[1]}" if f[1] else "" if f[2] == XSD + "string" else f"^^{name(entity('Datatype', f[2]))}")
    if o.kind == "OWLAnonymousIndividual":
        return f"_:{f[0]}"
    if o.kind == "IRI":
        return f"<{o.iri}>"
    if o.iri is not None:
        return name(o)
    wrap = lambda text: f"({text})" if inner else text
    if k in ("ObjectIntersectionOf", "DataIntersectionOf", "ObjectUnionOf", "DataUnionOf"):
        return wrap((" and " if "Inter" in k else " or ").join(map(r, f[0])))
    if k in ("ObjectComplementOf", "DataComplementOf"):
        return wrap("not " + r(f[0]))
    if k in ("ObjectOneOf", "DataOneOf"):
        return "{" + " , ".join(map(r, f[0])) + "}"
    if k == "ObjectInverseOf":
        return "inverse " + wrap(r(f[0]))
    if k == "ObjectHasSelf":
        return wrap(f"{r(f[0])} Self")
    if k == "DatatypeRestriction":
        return f"{r(f[0])}[{', '.join(f'{_SIGN[x.fields[0].iri]} {r(x.fields[1])}' for x in f[1])}]"
    words = {"SomeValuesFrom": "some", "AllValuesFrom": "only", "HasValue": "value"}
    for tail, word in words.items():
        if k.endswith(tail):
            p = " , ".join(map(r, f[0])) if isinstance(f[0], tuple) else r(f[0])
            return wrap(f"{p} {word} {r(f[1])}")
    for tail, word in {"MinCardinality": "min", "MaxCardinality": "max", "ExactCardinality": "exactly"}.items():
        if k.endswith(tail):
            return wrap(f"{r(f[1])} {word} {f[0]} {r(f[2])}")
    if k in ("Annotation", "AnnotationAssertion"):
        return " ".join(map(r, f if k == "Annotation" else (f[1], f[0], f[2])))
    top = lambda x: r(x, False)
    between = {"SubClassOf": "SubClassOf", "SubObjectPropertyOf": "SubPropertyOf", "SubDataPropertyOf": "SubPropertyOf", "SubAnnotationPropertyOf": "SubPropertyOf", "ObjectPropertyDomain": "Domain", "DataPropertyDomain": "Domain", "AnnotationPropertyDomain": "Domain", "ObjectPropertyRange": "Range", "DataPropertyRange": "Range", "AnnotationPropertyRange": "Range"}
    if k in between:
        return f"{top(f[0])} {between[k]} {top(f[1])}"
    if k == "SubPropertyChainOf":
        return f"{' o '.join(map(r, f[0]))} SubPropertyOf {r(f[1])}"
    nary = {"EquivalentClasses": "EquivalentTo", "DisjointClasses": "DisjointWith", "EquivalentObjectProperties": "EquivalentTo", "EquivalentDataProperties": "EquivalentTo", "DisjointObjectProperties": "DisjointWith", "DisjointDataProperties": "DisjointWith", "InverseObjectProperties": "InverseOf", "SameIndividual": "SameAs", "DifferentIndividuals": "DifferentFrom"}
    if k in nary:
        return f"{top(f[0][0])} {nary[k]} {top(f[0][1])}" if len(f[0]) == 2 else f"{nary[k]}: {' , '.join(map(top, f[0]))}"
    if k == "DisjointUnion":
        return f"{r(f[0])} DisjointUnionOf {' , '.join(map(top, f[1]))}"
    if k == "HasKey":
        return f"{r(f[0])} HasKey {' , '.join(map(r, (*f[1], *f[2])))}"
    if k == "ClassAssertion":
        return f"{r(f[1])} Type {top(f[0])}"
    if k.endswith("PropertyAssertion"):
        return ("not " if k.startswith("Negative") else "") + f"{r(f[1])} {r(f[0])} {r(f[2])}"
    if k == "Declaration":
        return f"{ {v: x for x, v in FRAMES.items()}[KIND[f[0].kind].keyword] } {r(f[0])}"
    if k == "DatatypeDefinition":
        return ""
    return f"{k.removesuffix('ObjectProperty').removesuffix('DataProperty')} {r(f[0])}"
