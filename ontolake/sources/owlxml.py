"""OWL/XML: reader and writer, driven by the field table of the model."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from typing import Any
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from ..errors import OWLSyntaxError
from ..model import BY_KEYWORD, KIND, OWL, RDF, RDFS, RDFS_LITERAL, THING, XSD, Obj, Ontology, anonymous, cardinality, entity, iri, literal, make

from .rdfxml import XML, parse_xml

_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "xml": XML}


class _Reader:
    def __init__(self, root: ET.Element, scope: str, base: str) -> None:
        self.root, self.scope, self.prefixes = root, scope, dict(_PREFIXES)
        self.base = root.get(f"{{{XML}}}base", base)

    def name(self, e: ET.Element) -> str:
        if not e.tag.startswith("{" + OWL + "}"):
            raise OWLSyntaxError(f"unexpected element {e.tag}")
        return e.tag[len(OWL) + 2 :]

    def full(self, e: ET.Element) -> str:
        if (v := e.get("IRI")) is not None:
            return v if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) else urljoin(e.get(f"{{{XML}}}base", self.base), v)
        if (v := e.get("abbreviatedIRI")) is not None:
            p, _, rest = v.partition(":")
            if p not in self.prefixes:
                raise OWLSyntaxError(f"unknown prefix {p}:")
            return self.prefixes[p] + rest
        raise OWLSyntaxError(f"{self.name(e)} without an IRI")

    def text_iri(self, e: ET.Element) -> str:
        v = (e.text or "").strip()
        if self.name(e) == "AbbreviatedIRI":
            p, _, rest = v.partition(":")
            return self.prefixes[p] + rest
        return v if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) else urljoin(self.base, v)

    def notes(self, e: ET.Element) -> tuple[list[Obj], list[ET.Element]]:
        found, rest = [], []
        for c in e:
            (found if self.name(c) == "Annotation" else rest).append(c)
        return [self.annotation(c) for c in found], rest

    def annotation(self, e: ET.Element) -> Obj:
        more, (p, v) = self.notes(e)
        return make("OWLAnnotation", self.object(p), self.object(v), annotations=more)

    def object(self, e: ET.Element) -> Any:
        n = self.name(e)
        if n in ("IRI", "AbbreviatedIRI"):
            return iri(self.text_iri(e))
        if n == "AnonymousIndividual":
            return anonymous(e.get("nodeID").removeprefix("_:"), self.scope)
        if n == "Literal":
            return literal(e.text or "", e.get(f"{{{XML}}}lang", ""), "" if e.get("datatypeIRI") is None else e.get("datatypeIRI"))
        if n == "FacetRestriction":
            return make("OWLFacetRestriction", iri(e.get("facet")), self.object(e[0]))
        k = BY_KEYWORD.get(n)
        if k is None:
            raise OWLSyntaxError(f"unknown element {n}")
        if k.category == "entity":
            return entity(n, self.full(e))
        return self.compound(n, e, list(e), [])

    def compound(self, n: str, e: ET.Element, rest: list[ET.Element], notes: list[Obj]) -> Obj:
        if n == "ObjectPropertyChain":
            raise OWLSyntaxError("a chain stands only below a super-property")
        k, values, parts = BY_KEYWORD[n], [], [self.object(c) for c in rest]
        if n == "HasKey":
            data = [p for p in parts[1:] if p.kind == "OWLDataProperty"]
            return make(n, parts[0], [p for p in parts[1:] if p not in data], data, annotations=notes)
        for i, spec in enumerate(k.fields):
            name = spec.strip("{}[]")
            if name == "cardinality":
                values.append(cardinality(e.get("cardinality")))
            elif spec[0] in "{[":
                left = len(k.fields) - i - 1
                values.append(parts[: len(parts) - left])
                parts = parts[len(parts) - left :]
            elif name == "filler" and not parts:
                values.append(entity("Datatype", RDFS_LITERAL) if n.startswith("Data") else entity("Class", THING))
            else:
                values.append(parts.pop(0))
        return make(n, *values, annotations=notes)

    def axiom(self, e: ET.Element) -> Obj:
        n = self.name(e)
        notes, rest = self.notes(e)
        if n == "SubObjectPropertyOf" and self.name(rest[0]) == "ObjectPropertyChain":
            return make("SubPropertyChainOf", [self.object(c) for c in rest[0]], self.object(rest[1]), annotations=notes)
        if n not in BY_KEYWORD or BY_KEYWORD[n].category != "axiom":
            raise OWLSyntaxError(f"unknown axiom {n}")
        return self.compound(n, e, rest, notes)

    def document(self) -> Ontology:
        if self.name(self.root) != "Ontology":
            raise OWLSyntaxError("no Ontology element")
        out = Ontology(self.root.get("ontologyIRI"), self.root.get("versionIRI"))
        for e in self.root:
            if self.name(e) == "Prefix":
                self.prefixes[e.get("name", "")] = e.get("IRI")
        for e in self.root:
            n = self.name(e)
            if n == "Import":
                out.imports.append((e.text or "").strip())
            elif n == "Annotation":
                out.annotations.append(self.annotation(e))
            elif n != "Prefix":
                out.axioms.append(self.axiom(e))
        out.prefixes = {p + ":": v for p, v in self.prefixes.items()}
        return out.distinct()


def parse(text: str, scope: str = "", base: str = "") -> Ontology:
    return _Reader(parse_xml(text), scope, base).document()


def _element(o: Obj, deep: int, labels: dict) -> list[str]:
    pad, k, f = "    " * deep, KIND[o.kind].keyword, o.fields
    if o.kind == "IRI":
        return [f"{pad}<IRI>{escape(f[0])}</IRI>"]
    if o.kind == "OWLLiteral":
        tag = f" xml:lang={quoteattr(f[1])}" if f[1] else "" if f[2] == XSD + "string" else f" datatypeIRI={quoteattr(f[2])}"
        return [f"{pad}<Literal{tag}>{escape(f[0], {chr(13): '&#13;'})}</Literal>"]
    if o.kind == "OWLAnonymousIndividual":
        return [f'{pad}<AnonymousIndividual nodeID="{labels.setdefault(f, f"_:genid{len(labels)}")}"/>']
    if o.iri is not None:
        return [f"{pad}<{k} IRI={quoteattr(o.iri)}/>"]
    inner, attrs = [x for a in o.annotations for x in _element(a, deep + 1, labels)], ""
    for spec, v in zip(KIND[o.kind].fields, f):
        if isinstance(v, str):
            attrs = f' cardinality="{v}"'
        elif o.kind == "OWLFacetRestriction" and spec == "facet":
            attrs = f" facet={quoteattr(v.iri)}"
        elif k == "SubPropertyChainOf" and spec == "[chain]":
            inner += [f"{pad}    <ObjectPropertyChain>", *(x for c in v for x in _element(c, deep + 2, labels)), f"{pad}    </ObjectPropertyChain>"]
        elif isinstance(v, tuple):
            many = v * 2 if len(v) == 1 and k.startswith(("Equivalent", "Disjoint", "Same", "Different")) and k != "DisjointUnion" else v
            inner += [x for c in many for x in _element(c, deep + 1, labels)]
        else:
            inner += _element(v, deep + 1, labels)
    tag = "SubObjectPropertyOf" if k == "SubPropertyChainOf" else k
    return [f"{pad}<{tag}{attrs}>", *inner, f"{pad}</{tag}>"]


def render(o: Ontology) -> str:
    o, labels = o.distinct(), {}
    head = "".join(f" {n}={quoteattr(v)}" for n, v in (("ontologyIRI", o.iri), ("versionIRI", o.version)) if v)
    lines = ['<?xml version="1.0"?>', f'<Ontology xmlns="{OWL}"{head}>']
    lines += [f"    <Prefix name={quoteattr(p.rstrip(':'))} IRI={quoteattr(v)}/>" for p, v in sorted(o.prefixes.items())]
    lines += [f"    <Import>{escape(x)}</Import>" for x in o.imports]
    lines += [x for a in [*o.annotations, *o.axioms] for x in _element(a, 1, labels)]
    return "\n".join([*lines, "</Ontology>"]) + "\n"


