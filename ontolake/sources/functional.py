"""Functional-style syntax: reader and writer, both driven by the field table of the model."""

from __future__ import annotations

import re
import sys
from typing import Any

from ..errors import OWLOntologyStorageError, OWLSyntaxError
from ..functions.literals import LANGUAGE
from ..model import AT_LEAST_TWO, BY_KEYWORD, KIND, OWL, RDF, RDFS, RDFS_LITERAL, THING, XSD, Obj, Ontology, anonymous, cardinality, entity, escape, iri, literal, make

DEFAULT_PREFIXES = {"rdf:": RDF, "rdfs:": RDFS, "xsd:": XSD, "owl:": OWL}

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
      |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
      |(?P<string>"(?:[^"\\]|\\.)*")
      |(?P<lang>@[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*)
      |(?P<type>\^\^)
      |(?P<node>_:[^\s()<>"=@^]+)
      |(?P<punct>[()=])
      |(?P<name>[^\s()<>"=@^\#]*:[^\s()<>"=@^\#]*(?:\#[^\s()<>"=@^]*)?)
      |(?P<word>[^\s()<>"=@^:\#]+)""",
    re.X | re.S,
)

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


def role(keyword: str, field: str) -> str:
    """What a field of a kind holds: class, object, data, annotation (properties), individual, range, literal, datatype,
    value (of an annotation), subject, iri, entity, number."""
    if keyword == "Declaration":
        return "entity"
    if field in ("cardinality", "facet", "datatype"):
        return {"cardinality": "number", "facet": "iri", "datatype": "datatype"}[field]
    if keyword.startswith(("Annotation", "SubAnnotation")):
        return {"property": "annotation", "subProperty": "annotation", "superProperty": "annotation", "subject": "subject", "value": "value"}.get(field, "iri")
    if field in ("property", "subProperty", "superProperty", "properties", "chain", "inverse", "objectProperties", "dataProperties"):
        return "data" if field == "dataProperties" or "Data" in keyword and field != "objectProperties" else "object"
    if field in ("individual", "individuals", "subject"):
        return "individual"
    if field == "value":
        return "literal" if "Data" in keyword or keyword == "FacetRestriction" else "individual"
    if field in ("filler", "range", "operand", "operands", "values", "dataRange") and keyword.startswith("Data"):
        return "class" if keyword == "DataPropertyDomain" else "literal" if field == "values" else "range"
    return "class"


_ENTITY = {"class": "Class", "object": "ObjectProperty", "data": "DataProperty", "annotation": "AnnotationProperty", "individual": "NamedIndividual", "range": "Datatype", "datatype": "Datatype"}


class Reader:
    def __init__(self, text: str, scope: str = "") -> None:
        self.text, self.scope, self.prefixes = text, scope, dict(DEFAULT_PREFIXES)
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                self.fail(f"unexpected {text[at]!r}", at)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.at = 0

    def fail(self, message: str, place: int | None = None) -> None:
        place = self.tokens[min(self.at, len(self.tokens) - 1)][2] if place is None and self.tokens else place or 0
        raise OWLSyntaxError(message, self.text.count("\n", 0, place) + 1, place - self.text.rfind("\n", 0, place))

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead][:2] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "end" or text is not None and value != text:
            self.fail(f"expected {text or 'more'}, found {value or 'the end'}")
        self.at += 1
        return kind, value

    def full(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            return value[1:-1]
        if kind == "name":
            prefix, _, rest = value.partition(":")
            if prefix + ":" not in self.prefixes:
                self.at -= 1
                self.fail(f"unknown prefix {prefix}:")
            return self.prefixes[prefix + ":"] + rest
        self.at -= 1
        self.fail(f"expected an IRI, found {value}")
        raise AssertionError

    def literal(self) -> Obj:
        kind, value = self.take()
        if kind != "string":
            self.at -= 1
            self.fail(f"expected a literal, found {value}")
        lexical = re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.S)
        if self.peek()[0] == "lang":
            return literal(lexical, self.take()[1][1:])
        if self.peek()[0] == "type":
            self.take()
            return literal(lexical, "", self.full())
        return literal(lexical)

    def annotations(self) -> list[Obj]:
        out = []
        while self.peek()[1] == "Annotation" and self.peek(1)[1] == "(":
            self.take(), self.take()
            more = self.annotations()
            out.append(make("OWLAnnotation", self.value("annotation"), self.value("value"), annotations=more))
            self.take(")")
        return out

    def value(self, what: str) -> Any:
        kind, word = self.peek()
        if what == "number":
            return cardinality(self.take()[1])
        if what == "literal" or what == "value" and kind == "string":
            return self.literal()
        if kind == "node" and what in ("individual", "subject", "value"):
            return anonymous(self.take()[1][2:], self.scope)
        if what in ("iri", "subject", "value"):
            return iri(self.full())
        if what == "entity":
            keyword = self.take()[1]
            if keyword not in BY_KEYWORD or BY_KEYWORD[keyword].category != "entity":
                self.fail(f"no kind of entity: {keyword}")
            self.take("(")
            out = entity(keyword, self.full())
            self.take(")")
            return out
        if kind == "word" and self.peek(1)[1] == "(":
            return self.compound(what)
        return entity(_ENTITY[what], self.full())

    def compound(self, what: str) -> Obj:
        keyword = self.take()[1]
        k = BY_KEYWORD.get(keyword)
        allowed = {"class": "class", "range": "range", "object": "property"}.get(what)
        if k is None or k.category != allowed:
            self.at -= 1
            self.fail(f"{keyword} is no {what}")
        self.take("(")
        out = self.fields(k.keyword, k.fields, [])
        self.take(")")
        return out

    def fields(self, keyword: str, specs: tuple[str, ...], annotations: list[Obj]) -> Obj:
        values: list[Any] = []
        if keyword == "DatatypeRestriction":
            datatype, facets = self.value("datatype"), []
            while self.peek()[1] != ")":
                facets.append(make("OWLFacetRestriction", self.value("iri"), self.literal()))
            return make(keyword, datatype, facets)
        for i, spec in enumerate(specs):
            name = spec.strip("{}[]")
            what = role(keyword, name)
            if spec[0] in "{[":
                many = []
                nested = keyword == "HasKey"
                if nested:
                    self.take("(")
                # A list before a last single field leaves one value for it.
                while self.peek()[1] != ")" and not (i + 1 < len(specs) and not nested and self._last_one()):
                    many.append(self.value(what))
                if nested:
                    self.take(")")
                values.append(many)
            elif name == "filler" and self.peek()[1] == ")":
                values.append(entity("Datatype", RDFS_LITERAL) if keyword.startswith("Data") else entity("Class", THING))
            else:
                values.append(self.value(what))
        return make(keyword, *values, annotations=annotations)

    def _last_one(self) -> bool:
        """Is one value left before the closing parenthesis."""
        depth, at = 0, self.at
        while at < len(self.tokens):
            t = self.tokens[at][1]
            if t == "(":
                depth += 1
            elif t == ")":
                depth -= 1
                if depth < 0:
                    return False
            at += 1
            if depth == 0 and not (at < len(self.tokens) and self.tokens[at][1] == "(" and self.tokens[at - 1][0] == "word"):
                return at < len(self.tokens) and self.tokens[at][1] == ")"
        return False

    def axiom(self) -> Obj:
        keyword = self.take()[1]
        self.take("(")
        annotations = self.annotations()
        if keyword == "SubObjectPropertyOf" and self.peek()[1] == "ObjectPropertyChain":
            self.take(), self.take("(")
            chain = []
            while self.peek()[1] != ")":
                chain.append(self.value("object"))
            self.take(")")
            out = make("SubPropertyChainOf", chain, self.value("object"), annotations=annotations)
        else:
            k = BY_KEYWORD.get(keyword)
            if k is None or k.category != "axiom" or keyword == "SubPropertyChainOf":
                self.at -= 2
                self.fail(f"no axiom: {keyword}")
            out = self.fields(keyword, k.fields, annotations)
        self.take(")")
        return out

    def document(self) -> Ontology:
        while self.peek()[1] == "Prefix":
            self.take(), self.take("(")
            name = self.take()[1]
            self.take("=")
            self.prefixes[name] = self.full()
            self.take(")")
        self.take("Ontology")
        self.take("(")
        out = Ontology(prefixes=self.prefixes)
        if self.peek()[0] in ("iri", "name"):
            out.iri = self.full()
            if self.peek()[0] in ("iri", "name"):
                out.version = self.full()
        while self.peek()[1] == "Import":
            self.take(), self.take("(")
            out.imports.append(self.full())
            self.take(")")
        out.annotations = self.annotations()
        while self.peek()[1] != ")":
            out.axioms.append(self.axiom())
        self.take(")")
        if self.peek()[0] != "end":
            self.fail(f"after the ontology: {self.peek()[1]}")
        return out.distinct()


def parse(text: str, scope: str = "") -> Ontology:
    return Reader(text.removeprefix("﻿"), scope).document()


def render_object(o: Obj, labels: dict[tuple[str, str], str] | None = None, as_entity: bool = False) -> str:
    """One object in functional notation with full IRIs. labels: names of anonymous individuals, filled on first use."""
    labels = {} if labels is None else labels
    if o.kind == "OWLLiteral":
        lexical, language, datatype = o.fields
        if language and not re.match(LANGUAGE, language):
            raise OWLOntologyStorageError(f"{language} is no language tag")
        return f'"{escape(lexical)}"' + (f"@{language}" if language else f"^^<{datatype}>")
    if o.kind == "OWLAnonymousIndividual":
        return labels.setdefault(o.fields, f"_:genid{len(labels)}")
    if o.iri is not None:
        return f"{KIND[o.kind].keyword}(<{o.iri}>)" if as_entity else f"<{o.iri}>"
    one = lambda v: v if isinstance(v, str) else render_object(v, labels)
    k, parts = KIND[o.kind], [one(a) for a in o.annotations]
    if o.kind == "OWLDeclarationAxiom":
        return f"Declaration({' '.join([*parts, render_object(o.fields[0], labels, True)])})"
    if o.kind == "OWLFacetRestriction":
        return " ".join(map(one, o.fields))
    keyword = k.keyword
    for spec, v in zip(k.fields, o.fields):
        if isinstance(v, tuple):
            many = [one(x) for x in v]
            if len(many) == 1 and AT_LEAST_TWO.get(keyword) == spec.strip("{}[]"):
                many *= 2  # a lone member twice keeps to the grammar
            text = " ".join(many)
            if keyword == "HasKey":
                text = f"({text})"
            if keyword == "SubPropertyChainOf":
                text = f"ObjectPropertyChain({text})"
            parts.append(text)
        else:
            parts.append(one(v))
    return f"{'SubObjectPropertyOf' if keyword == 'SubPropertyChainOf' else keyword}({' '.join(p for p in parts if p)})"


def render(ontology: Ontology) -> str:
    """A whole document: imports, annotations and axioms, each in order of their keys, one to a line."""
    o, labels = ontology.distinct(), {}
    head = " ".join(f"<{x}>" for x in (o.iri, o.version) if x)
    lines = [f"Prefix({p}=<{x}>)" for p, x in sorted(o.prefixes.items())]
    lines += [f"Ontology({head}"] + [f"Import(<{x}>)" for x in o.imports]
    lines += [render_object(a, labels) for a in [*o.annotations, *o.axioms]]
    return "\n".join([*lines, ")"]) + "\n"
