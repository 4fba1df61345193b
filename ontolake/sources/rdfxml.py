"""RDF/XML: reader to quads and writer from quads."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from urllib.parse import urldefrag, urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from ..errors import OWLSyntaxError, SecurityPolicyError, XmlParseError
from ..model import RDF, XSD
from .rdf_terms import Quad, Term, blank, iri_term, lit_term

XML = "http://www.w3.org/XML/1998/namespace"
_SYNTAX = {RDF + x for x in ("ID", "about", "resource", "nodeID", "parseType", "datatype", "aboutEach", "aboutEachPrefix", "bagID", "RDF")}
#: Most internal entities that a document may declare, and most characters and references of one.
ENTITIES, ENTITY_CHARS, ENTITY_REFERENCES = 1000, 10_000, 20


def parse_xml(text: str | bytes) -> ET.Element:
    """Root element. External and parameter entities are refused, internal ones bounded. The XML parser itself says what is
    declared, wherever in the document type that stands."""
    raw = text.encode("utf-8") if isinstance(text, str) and not re.match(r"\s*<\?xml[^>]*encoding", text) else text if isinstance(text, bytes) else re.sub(r"encoding=[\"'][^\"']*[\"']", "", text, count=1)
    if b"<!DOCTYPE" in raw or b"\x00" in raw[:4] or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        check_entities(raw)
    try:
        return ET.fromstring(raw)
    except ET.ParseError as e:
        raise XmlParseError(str(e)) from e


class _Root(Exception):
    """The document type is over."""


def check_entities(raw: bytes) -> None:
    """Entities as the XML parser reads their declarations, up to the root element."""
    sizes: dict[str, int] = {}

    def declared(name: str, parameter: int, value: str | None, _base, system: str | None, public: str | None, _notation) -> None:
        if parameter or value is None or system is not None or public is not None:
            raise SecurityPolicyError("external and parameter entities are not read")
        # What it becomes when all entities inside it, declared before, are put in.
        size = len(value) + sum(sizes.get(x, 0) for x in re.findall(r"&([^;#\s]+);", value))
        sizes.setdefault(name, size)
        if len(sizes) > ENTITIES or size > ENTITY_CHARS or value.count("&") > ENTITY_REFERENCES:
            raise SecurityPolicyError("too many or too large entities")

    def over(*_) -> None:
        raise _Root

    parser = expat.ParserCreate()
    parser.EntityDeclHandler, parser.StartElementHandler = declared, over
    try:
        parser.Parse(raw, True)
    except (_Root, expat.ExpatError):  # what is wrong with the text is said when it is read
        return


def name_of(tag: str) -> str:
    ns, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return ns + local


class _Reader:
    def __init__(self, base: str) -> None:
        self.base, self.quads, self.count, self.ids = base, [], 0, set()

    def fresh(self) -> Term:
        self.count += 1
        return blank(f"b{self.count}_gen")

    def add(self, s: Term, p: str, o: Term) -> None:
        self.quads.append(Quad(s, iri_term(p), o))

    def resolve(self, base: str, ref: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref):
            return ref
        return urldefrag(base)[0] if ref == "" else urljoin(urldefrag(base)[0], ref) if base else ref

    def scope(self, e: ET.Element, base: str, lang: str) -> tuple[str, str]:
        b = e.get(f"{{{XML}}}base")
        return self.resolve(base, b) if b is not None else base, e.get(f"{{{XML}}}lang", lang)

    def made(self, base: str, name: str) -> str:
        v = self.resolve(base, "#" + name)
        if v in self.ids:
            raise OWLSyntaxError(f"rdf:ID {name} twice")
        self.ids.add(v)
        return v

    def node(self, e: ET.Element, base: str, lang: str) -> Term:
        base, lang = self.scope(e, base, lang)
        r = f"{{{RDF}}}"
        if e.get(r + "ID") is not None:
            s = iri_term(self.made(base, e.get(r + "ID")))
        elif e.get(r + "about") is not None:
            s = iri_term(self.resolve(base, e.get(r + "about")))
        elif e.get(r + "nodeID") is not None:
            s = blank(e.get(r + "nodeID"))
        else:
            s = self.fresh()
        if name_of(e.tag) != RDF + "Description":
            self.add(s, RDF + "type", iri_term(name_of(e.tag)))
        self.attributes(e, s, base, lang)
        item = 0
        for c in e:
            if name_of(c.tag) == RDF + "li":
                item += 1
                self.property(c, s, f"{RDF}_{item}", base, lang)
            else:
                self.property(c, s, name_of(c.tag), base, lang)
        return s

    def attributes(self, e: ET.Element, s: Term, base: str, lang: str) -> None:
        for k, v in e.attrib.items():
            n = name_of(k)
            if n in _SYNTAX or n.startswith(XML) or not k.startswith("{"):
                continue
            self.add(s, n, iri_term(self.resolve(base, v)) if n == RDF + "type" else lit_term(v, lang))

    def property(self, e: ET.Element, s: Term, p: str, base: str, lang: str) -> None:
        base, lang = self.scope(e, base, lang)
        r = f"{{{RDF}}}"
        kind = e.get(r + "parseType")
        if kind == "Resource":
            o = self.fresh()
            for c in e:
                self.property(c, o, name_of(c.tag), base, lang)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            cells = [self.fresh() for _ in items]
            o = cells[0] if cells else iri_term(RDF + "nil")
            for i, item in enumerate(items):
                self.add(cells[i], RDF + "first", item)
                self.add(cells[i], RDF + "rest", cells[i + 1] if i + 1 < len(cells) else iri_term(RDF + "nil"))
        elif kind is not None:
            inner = (escape(e.text) if e.text else "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            o = lit_term(inner, "", RDF + "XMLLiteral")
        elif len(e):
            if len(e) > 1 or (e.text or "").strip() or (e[0].tail or "").strip():
                raise OWLSyntaxError(f"more than one value in {p}")
            o = self.node(e[0], base, lang)
        elif e.get(r + "resource") is not None:
            o = iri_term(self.resolve(base, e.get(r + "resource")))
            self.attributes(e, o, base, lang)
        elif e.get(r + "nodeID") is not None:
            o = blank(e.get(r + "nodeID"))
            self.attributes(e, o, base, lang)
        elif any(k.startswith("{") and name_of(k) not in _SYNTAX and not name_of(k).startswith(XML) for k in e.attrib):
            o = self.fresh()
            self.attributes(e, o, base, lang)
        else:
            dt = e.get(r + "datatype")
            o = lit_term(e.text or "", "" if dt else lang, self.resolve(base, dt) if dt else "")
        self.add(s, p, o)
        if e.get(r + "ID") is not None:
            n = iri_term(self.made(base, e.get(r + "ID")))
            for q, v in (("subject", s), ("predicate", iri_term(p)), ("object", o)):
                self.add(n, RDF + q, v)
            self.add(n, RDF + "type", iri_term(RDF + "Statement"))


def read_rdfxml(text: str, base: str = "") -> list[Quad]:
    root = parse_xml(text)
    r = _Reader(base)
    if name_of(root.tag) == RDF + "RDF":
        b, lang = r.scope(root, base, "")
        for e in root:
            r.node(e, b, lang)
    else:
        r.node(root, base, "")
    return r.quads


def write_rdfxml(quads: Iterable[Quad], prefixes: dict[str, str]) -> str:
    """A description for each subject; blank nodes by rdf:nodeID. Predicates need a name that XML can write."""
    spaces = {"rdf": RDF} | {p.rstrip(":"): ns for p, ns in prefixes.items() if p.rstrip(":")}
    by: dict[Term, list[Quad]] = {}
    for q in sorted({Quad(q.s, q.p, q.o) for q in quads}, key=lambda q: tuple(map(str, q[:3]))):
        by.setdefault(q.s, []).append(q)
    lines = []

    def element(iri: str) -> str:
        m = re.search(r"[A-Za-z_À-�][\w.\-·]*$", iri)
        if not m or m.start() == 0:
            raise OWLSyntaxError(f"no element name in {iri}")
        ns, local = iri[: m.start()], m[0]
        for p, v in spaces.items():
            if v == ns:
                return f"{p}:{local}"
        spaces[f"ns{len(spaces)}"] = ns
        return f"{list(spaces)[-1]}:{local}"

    for s, rows in by.items():
        about = f"rdf:about={quoteattr(s.value)}" if s.kind == "iri" else f"rdf:nodeID={quoteattr(s.value)}"
        lines.append(f"  <rdf:Description {about}>")
        for q in rows:
            n, o = element(q.p.value), q.o
            if o.kind == "iri":
                lines.append(f"    <{n} rdf:resource={quoteattr(o.value)}/>")
            elif o.kind == "blank":
                lines.append(f"    <{n} rdf:nodeID={quoteattr(o.value)}/>")
            else:
                tag = f" xml:lang={quoteattr(o.language)}" if o.language else "" if o.datatype == XSD + "string" else f" rdf:datatype={quoteattr(o.datatype)}"
                lines.append(f"    <{n}{tag}>{escape(o.value, {chr(13): '&#13;'})}</{n}>")
        lines.append("  </rdf:Description>")
    head = "".join(f"\n    xmlns:{p}={quoteattr(ns)}" for p, ns in spaces.items())
    return f'<?xml version="1.0"?>\n<rdf:RDF{head}>\n' + "\n".join(lines) + "\n</rdf:RDF>\n"
