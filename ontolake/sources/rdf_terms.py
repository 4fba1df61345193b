"""RDF terms and quads in Python, and the line, Turtle and TriG readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

from ..errors import OWLSyntaxError
from ..model import OWL, RDF, RDFS, XSD


class Term(NamedTuple):
    kind: str  # iri, blank, literal
    value: str
    language: str = ""
    datatype: str = ""

    def __str__(self) -> str:
        return nt(self)


class Quad(NamedTuple):
    s: Term
    p: Term
    o: Term
    g: Term | None = None


def iri_term(v: str) -> Term:
    return Term("iri", v)


def blank(v: str) -> Term:
    return Term("blank", v)


def lit_term(lexical: str, language: str = "", datatype: str = "") -> Term:
    return Term("literal", lexical, language, RDF + "langString" if language else datatype or XSD + "string")


_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise OWLSyntaxError(f"bad escape \\{m[2]}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


def nt(t: Term) -> str:
    """A term in N-Triples."""
    if t.kind == "iri":
        return f"<{t.value}>"
    if t.kind == "blank":
        return f"_:{t.value}"
    text = t.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{text}"' + (f"@{t.language}" if t.language else "" if t.datatype == XSD + "string" else f"^^<{t.datatype}>")


def write_lines(quads: Iterable[Quad]) -> str:
    return "".join(" ".join(nt(x) for x in q if x is not None) + " .\n" for q in quads)


_PN = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
_PNC = _PN + r"_0-9\u00B7\u0300-\u036F\u203F\u2040\-"
_TOKEN = re.compile(
    rf"""(?P<space>(?:[ \t\r\n]|\#[^\n\r]*)+)
      |(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
      |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
      |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      |(?P<at>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
      |(?P<type>\^\^)
      |(?P<blank>_:[{_PN}_0-9](?:[{_PNC}.]*[{_PNC}])?)
      |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
      |(?P<name>(?:[{_PN}](?:[{_PNC}.]*[{_PNC}])?)?:(?:(?:[{_PN}_:0-9]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[{_PNC}.:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[{_PNC}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
      |(?P<word>[A-Za-z]+)
      |(?P<punct>[.;,\[\](){{}}])""",
    re.X | re.S,
)


class TurtleReader:
    """Turtle, and TriG with graphs=True. Blank nodes of the text keep their labels; others get names of their own."""

    def __init__(self, text: str, base: str = "", graphs: bool = False) -> None:
        self.text, self.base, self.graphs, self.prefixes = text.removeprefix("\ufeff"), base, graphs, {}
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                self.fail(f"unexpected {self.text[at]!r}", at)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.at, self.count, self.graph = 0, 0, None
        self.quads: list[Quad] = []

    def fail(self, message: str, place: int | None = None) -> None:
        if place is None:
            place = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        raise OWLSyntaxError(message, self.text.count("\n", 0, place) + 1, place - self.text.rfind("\n", 0, place))

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if kind == "end" or value is not None and text != value:
            self.fail(f"expected {value or 'more'}, found {text or 'the end'}")
        self.at += 1
        return kind, text

    def fresh(self) -> Term:
        self.count += 1
        return blank(f"b{self.count}_gen")

    def resolve(self, text: str) -> str:
        v = unescape(text[1:-1])
        return v if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) or not self.base else urljoin(self.base, v)

    def named(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            return self.resolve(text)
        if kind == "name":
            prefix, _, rest = text.partition(":")
            if prefix not in self.prefixes:
                self.at -= 1
                self.fail(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)
        self.at -= 1
        self.fail(f"expected an IRI, found {text}")
        raise AssertionError

    def parse(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            low = text.lower()
            if text in ("@prefix", "@base") or kind == "word" and low in ("prefix", "base"):
                self.take()
                if low.endswith("prefix"):
                    name = self.take()[1]
                    if not name.endswith(":"):
                        self.fail(f"no prefix: {name}")
                    self.prefixes[name[:-1]] = self.resolve(self.take()[1])
                else:
                    self.base = self.resolve(self.take()[1])
                if text.startswith("@"):
                    self.take(".")
            elif self.graphs and (text == "{" or kind == "word" and low == "graph"):
                if text != "{":
                    self.take()
                    self.graph = self.label()
                self.block()
            else:
                self.statement()
        return self.quads

    def label(self) -> Term:
        kind, text = self.peek()
        if kind == "blank":
            self.take()
            return blank(text[2:])
        if text == "[":
            self.take(), self.take("]")
            return self.fresh()
        return iri_term(self.named())

    def block(self) -> None:
        self.take("{")
        while self.peek()[1] != "}":
            self.statement(inside=True)
        self.take("}")
        self.graph = None

    def statement(self, inside: bool = False) -> None:
        if self.peek()[1] == "[":
            self.take()
            s = self.fresh()
            empty = self.peek()[1] == "]"
            if not empty:
                self.properties(s)
            self.take("]")
            if self.graphs and not inside and empty and self.peek()[1] == "{":
                self.graph = s
                self.block()
                return
            if self.peek()[1] not in (".", "}"):
                self.properties(s)
        else:
            s = self.term()
            if s.kind == "literal":
                self.fail("a literal is no subject")
            if self.graphs and not inside and self.peek()[1] == "{":
                self.graph = s
                self.block()
                return
            self.properties(s)
        if not (inside and self.peek()[1] == "}"):
            self.take(".")

    def properties(self, s: Term) -> None:
        while True:
            kind, text = self.peek()
            if kind == "word" and text == "a":
                self.take()
                p = iri_term(RDF + "type")
            else:
                p = iri_term(self.named())
            while True:
                self.quads.append(Quad(s, p, self.term(), self.graph))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}"):
                return

    def term(self) -> Term:
        kind, text = self.peek()
        if kind in ("iri", "name"):
            return iri_term(self.named())
        self.take()
        if kind == "blank":
            return blank(text[2:])
        if kind in ("string", "long"):
            cut = 3 if kind == "long" else 1
            value = unescape(text[cut:-cut])
            nxt, tag = self.peek()
            if nxt == "at":
                self.take()
                return lit_term(value, tag[1:])
            if nxt == "type":
                self.take()
                return lit_term(value, "", self.named())
            return lit_term(value)
        if kind == "number":
            return lit_term(text, "", XSD + ("double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return lit_term(text, "", XSD + "boolean")
        if text == "[":
            s = self.fresh()
            if self.peek()[1] != "]":
                self.properties(s)
            self.take("]")
            return s
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = iri_term(RDF + "nil")
            cells = [self.fresh() for _ in items]
            for i, item in enumerate(items):
                self.quads.append(Quad(cells[i], iri_term(RDF + "first"), item, self.graph))
                self.quads.append(Quad(cells[i], iri_term(RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else head, self.graph))
            return cells[0] if cells else head
        self.at -= 1
        self.fail(f"unexpected {text}")
        raise AssertionError


def read_turtle(text: str, base: str = "") -> list[Quad]:
    return TurtleReader(text, base).parse()


def read_trig(text: str, base: str = "") -> list[Quad]:
    return TurtleReader(text, base, graphs=True).parse()


_LINE = re.compile(
    rf"""[ \t]*(?P<s><[^<>"{{}}|^`\x00-\x20]*>|_:[{_PN}_0-9](?:[{_PNC}.]*[{_PNC}])?)[ \t]*(?P<p><[^<>"{{}}|^`\x00-\x20]*>)[ \t]*
    (?P<o><[^<>"{{}}|^`\x00-\x20]*>|_:[{_PN}_0-9](?:[{_PNC}.]*[{_PNC}])?|"(?P<lex>(?:[^"\\\n\r]|\\.)*)"(?:@(?P<lang>[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^<(?P<dt>[^<>"{{}}|^`\x00-\x20]*)>)?)
    [ \t]*(?P<g><[^<>"{{}}|^`\x00-\x20]*>|_:[{_PN}_0-9](?:[{_PNC}.]*[{_PNC}])?)?[ \t]*\.[ \t]*(?:\#.*)?$""",
    re.X,
)


def read_lines(text: str, quads: bool = True) -> Iterator[Quad]:
    """N-Quads, or N-Triples without a graph term."""
    for n, line in enumerate(re.split(r"\r\n|\n|\r", text.removeprefix("\ufeff")), 1):
        if not line.strip(" \t") or line.lstrip(" \t").startswith("#"):
            continue
        m = _LINE.match(line)
        if not m or m["g"] and not quads:
            raise OWLSyntaxError("no statement", n, 1)
        of = lambda x: blank(x[2:]) if x.startswith("_:") else iri_term(unescape(x[1:-1]))
        o = lit_term(unescape(m["lex"]), m["lang"] or "", unescape(m["dt"] or "")) if m["lex"] is not None else of(m["o"])
        yield Quad(of(m["s"]), of(m["p"]), o, of(m["g"]) if m["g"] else None)


#: Sections of a document with banners, by the type of their subjects.
SECTIONS = (("Annotation properties", OWL + "AnnotationProperty"), ("Datatypes", RDFS + "Datatype"), ("Object Properties", OWL + "ObjectProperty"), ("Data properties", OWL + "DatatypeProperty"), ("Classes", OWL + "Class"), ("Individuals", OWL + "NamedIndividual"))


def write_turtle(quads: Iterable[Quad], prefixes: dict[str, str], banners: bool = False) -> str:
    """Turtle, a block for each subject; blank nodes used once stand inline, lists as parentheses where they are well
    formed. banners: subjects in sections by their types, a banner before each, the ontology's header first."""
    quads = sorted({Quad(q.s, q.p, q.o) for q in quads}, key=lambda q: tuple(map(nt, q[:3])))
    by: dict[Term, list[Quad]] = {}
    uses: dict[Term, int] = {}
    for q in quads:
        by.setdefault(q.s, []).append(q)
        uses[q.o] = uses.get(q.o, 0) + 1
    short = sorted(prefixes.items(), key=lambda x: -len(x[1]))
    local = re.compile(rf"(?:[{_PN}_0-9](?:[{_PNC}]*))?\Z")
    done: set[Term] = set()

    def show(t: Term) -> str:
        if t.kind == "iri":
            for p, ns in short:
                if ns and t.value.startswith(ns) and local.match(t.value[len(ns) :]):
                    return p + t.value[len(ns) :]
        if t.kind == "literal" and t.datatype not in (XSD + "string", RDF + "langString"):
            return nt(t._replace(datatype=XSD + "string")) + "^^" + show(iri_term(t.datatype))
        return nt(t)

    def members(t: Term) -> list[Term] | None:
        out, seen = [], set()
        while t.value != RDF + "nil":
            mine = by.get(t, [])
            first, rest = [q.o for q in mine if q.p.value == RDF + "first"], [q.o for q in mine if q.p.value == RDF + "rest"]
            if t.kind != "blank" or uses.get(t) != 1 or len(mine) != 2 or len(first) != 1 or len(rest) != 1 or t in seen:
                return None
            seen.add(t)
            out.append(first[0])
            t = rest[0]
        done.update(seen)
        return out

    def value(t: Term, deep: int) -> str:
        if t.kind == "blank" and uses.get(t) == 1 and t not in done and t in by and deep < 200:
            items = members(t)
            if items:
                return "( " + " ".join(value(i, deep + 1) for i in items) + " )"
            done.add(t)
            return "[ " + body(t, deep + 1, " ; ") + " ]"
        return show(t)

    def body(s: Term, deep: int, sep: str) -> str:
        lines: dict[str, list[str]] = {}
        for q in by[s]:
            lines.setdefault("a" if q.p.value == RDF + "type" else show(q.p), []).append(value(q.o, deep))
        return sep.join(f"{p} {' , '.join(v)}" for p, v in sorted(lines.items(), key=lambda x: (x[0] != "a", x[0])))

    out = [f"@prefix {p} <{ns}> ." for p, ns in sorted(prefixes.items())] + [""]
    subjects = [s for s in by if s.kind == "iri"] + [s for s in by if s.kind == "blank" and uses.get(s) != 1] + [s for s in by if s.kind == "blank" and uses.get(s) == 1]
    if banners:
        types = {s: {q.o.value for q in by[s] if q.p.value == RDF + "type"} for s in subjects}
        place = lambda s: -1 if OWL + "Ontology" in types[s] else next((i for i, (_, t) in enumerate(SECTIONS) if t in types[s]), len(SECTIONS)) if s.kind == "iri" else len(SECTIONS)
        subjects.sort(key=place)  # stable: the order inside a section stays
    last = -1
    for s in subjects:
        if s not in done:
            done.add(s)
            if banners and place(s) != last:
                last = place(s)
                out.append(f"#################################################################\n#    {(*(n for n, _ in SECTIONS), 'General axioms')[last]}\n#################################################################\n")
            out.append(f"{show(s)} {body(s, 0, ' ;' + chr(10) + '    ')} .\n")
    return "\n".join(out)
