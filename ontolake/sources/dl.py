"""Description-logic notation, a statement a line."""

from __future__ import annotations

import re

from ..errors import OWLSyntaxError
from ..model import NOTHING, THING, XSD, Obj, Ontology, cardinality, entity, literal, make

#: Operators and their spellings.
SPELLINGS = {
    "sub": ("⊑", "\\sqsubseteq", "sub", "->"), "equiv": ("≡", "\\equiv", "=="), "differ": ("≠", "\\not=", "!="), "and": ("⊓", "\\sqcap", "and"), "or": ("⊔", "\\sqcup", "or"), "not": ("¬", "\\lnot", "not"),
    "some": ("∃", "\\exists", "exists"), "all": ("∀", "\\forall", "forall"), "min": ("≥", "\\geq", ">"), "max": ("≤", "\\leq", "<"), "exact": ("equal", "="), "in": ("∈", "in"), "transitive": ("transitive", "trans", "R⁺"), "compose": ("∘", "o"), "inverse": ("⁻", "^-"), "dot": (".",),
}
_WORDS = {s: op for op, all_ in SPELLINGS.items() for s in all_ if s[0].isalpha()}
_SIGNS = sorted(((s, op) for op, all_ in SPELLINGS.items() for s in all_ if not s[0].isalpha()), key=lambda x: -len(x[0]))
_TOKEN = re.compile(r"\s+|<[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]*>|" + "|".join(re.escape(s) for s, _ in _SIGNS) + r"|[(){}\[\],:]|\"(?:[^\"\\]|\\.)*\"|-?[0-9]+(?:\.[0-9]+)?|[^\s(){}\[\],:.⊑≡≠⊓⊔¬∃∀≥≤∈∘⁻<>=!\"^]+")
_OF_SIGN = dict(_SIGNS)


class _Line:
    def __init__(self, line: str, number: int, prefix: str) -> None:
        self.tokens, self.number, self.prefix, at = [], number, prefix, 0
        while at < len(line):
            m = _TOKEN.match(line, at)
            if not m:
                self.fail(f"unexpected {line[at]!r}")
            t = m[0]
            if t.strip():
                self.tokens.append((_OF_SIGN.get(t) or _WORDS.get(t) or ("number" if re.fullmatch(r"-?[0-9]+(?:\.[0-9]+)?", t) else t if t in "(){}[],:" else "text" if t[0] == '"' else "name"), t))
            at = m.end()
        self.at = 0

    def fail(self, message: str) -> None:
        raise OWLSyntaxError(message, self.number, 1)

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else "end"

    def take(self, kind: str | None = None) -> str:
        if self.peek() == "end" or kind and self.peek() != kind:
            self.fail(f"expected {kind or 'more'}, found {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, kind: str) -> bool:
        if self.peek() == kind:
            self.at += 1
            return True
        return False

    def iri(self, name: str) -> str:
        return name[1:-1] if name.startswith("<") else self.prefix + name

    def property(self) -> Obj:
        inverse = False
        p = entity("ObjectProperty", self.iri(self.take("name")))
        while self.accept("inverse"):
            inverse = not inverse
        return make("ObjectInverseOf", p) if inverse else p

    def expression(self) -> Obj:
        parts = [self.conjunction()]
        while self.accept("or"):
            parts.append(self.conjunction())
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else make("ObjectUnionOf", parts)

    def conjunction(self) -> Obj:
        parts = [self.unary()]
        while self.accept("and"):
            parts.append(self.unary())
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else make("ObjectIntersectionOf", parts)

    def unary(self) -> Obj:
        op = self.peek()
        if op in ("some", "all"):
            self.take()
            p = self.property()
            self.accept("dot")
            if self.peek() == "{" and self.peek(1) in ("number", "text") and p.kind == "OWLObjectProperty":
                return make("DataSomeValuesFrom" if op == "some" else "DataAllValuesFrom", [entity("DataProperty", p.iri)], self.values())
            return make("ObjectSomeValuesFrom" if op == "some" else "ObjectAllValuesFrom", p, self.primary())
        if op in ("min", "max", "exact"):
            self.take()
            n, p = cardinality(self.take("number")), self.property()
            filler = self.primary() if self.accept("dot") else entity("Class", THING)
            return make({"min": "ObjectMinCardinality", "max": "ObjectMaxCardinality", "exact": "ObjectExactCardinality"}[op], n, p, filler)
        if self.accept("not"):
            return make("ObjectComplementOf", self.unary())
        return self.primary()

    def values(self) -> Obj:
        self.take("{")
        out = []
        while not self.accept("}"):
            kind, text = self.peek(), self.take()
            out.append(literal(text[1:-1]) if kind == "text" else literal(text, "", XSD + ("double" if "." in text else "integer")))
            self.accept(",")
        return make("DataOneOf", out)

    def primary(self) -> Obj:
        if self.accept("("):
            out = self.expression()
            self.take(")")
            return out
        if self.accept("{"):
            out = []
            while not self.accept("}"):
                out.append(entity("NamedIndividual", self.iri(self.take("name"))))
                self.accept(",")
            return make("ObjectOneOf", out)
        if self.peek() in ("some", "all", "min", "max", "exact", "not"):
            return self.unary()
        name = self.take("name")
        top = {"top": THING, "⊤": THING, "\\top": THING, "bottom": NOTHING, "⊥": NOTHING, "\\bottom": NOTHING, "\\bot": NOTHING}
        return entity("Class", top[name] if name in top else self.iri(name))

    def role_axiom(self) -> Obj:
        chain = [self.property()]
        while self.accept("compose"):
            chain.append(self.property())
        if self.accept("sub"):
            return make("SubPropertyChainOf", chain, self.property()) if len(chain) > 1 else make("SubObjectPropertyOf", chain[0], self.property())
        if self.accept("equiv"):
            return make("EquivalentObjectProperties", [chain[0], self.property()])
        if self.accept("differ"):
            return make("DisjointObjectProperties", [chain[0], self.property()])
        if self.accept("exact"):
            return make("InverseObjectProperties", [chain[0], self.property()])
        self.take("in")
        self.take("transitive")
        return make("TransitiveObjectProperty", chain[0])

    def axiom(self) -> Obj:
        if self.accept(":"):
            out = self.role_axiom()
        elif self.peek() == "name" and self.peek(1) in ("differ", "exact") and self.peek(2) == "name":
            a = entity("NamedIndividual", self.iri(self.take()))
            kind = "DifferentIndividuals" if self.take() in SPELLINGS["differ"] else "SameIndividual"
            out = make(kind, [a, entity("NamedIndividual", self.iri(self.take("name")))])
        elif self.peek() == "name" and self.peek(1) == "(" and self.peek(2) == "name" and self.peek(3) in (")", ","):
            name = self.iri(self.take())
            self.take("(")
            a = entity("NamedIndividual", self.iri(self.take("name")))
            if self.accept(","):
                kind = self.peek()
                if kind in ("text", "number"):
                    text = self.take()
                    v = literal(text[1:-1]) if kind == "text" else literal(text, "", XSD + ("double" if "." in text else "integer"))
                    out = make("DataPropertyAssertion", entity("DataProperty", name), a, v)
                else:
                    out = make("ObjectPropertyAssertion", entity("ObjectProperty", name), a, entity("NamedIndividual", self.iri(self.take("name"))))
            else:
                out = make("ClassAssertion", entity("Class", name), a)
            self.take(")")
        else:
            left = self.expression()
            if self.accept("equiv"):
                out = make("EquivalentClasses", [left, self.expression()])
            elif self.accept("differ"):
                out = make("DisjointClasses", [left, self.expression()])
            elif self.peek() == "(":
                self.take("(")
                out = make("ClassAssertion", left, entity("NamedIndividual", self.iri(self.take("name"))))
                self.take(")")
            else:
                self.take("sub")
                out = subsumption(left, self.expression())
        if self.peek() != "end":
            self.fail(f"after the statement: {self.tokens[self.at][1]}")
        return out


def subsumption(left: Obj, right: Obj) -> Obj:
    """A subsumption that says a range, a domain or that a property is functional becomes that axiom."""
    if left.iri == THING:
        if right.kind == "OWLObjectAllValuesFrom":
            return make("ObjectPropertyRange", *right.fields)
        if right.kind == "OWLObjectMaxCardinality" and right.fields[0] == "1" and right.fields[2].iri == THING:
            return make("FunctionalObjectProperty", right.fields[1])
    if left.kind == "OWLObjectSomeValuesFrom" and left.fields[1].iri == THING:
        return make("ObjectPropertyDomain", left.fields[0], right)
    return make("SubClassOf", left, right)


def parse(text: str, scope: str = "", prefix: str = "") -> Ontology:
    """prefix: what names without a scheme are put behind, such as the document's IRI and '#'."""
    out = Ontology()
    for n, line in enumerate(text.removeprefix("﻿").splitlines(), 1):
        if line.strip() and not line.lstrip().startswith(("//", "#")):
            out.axioms.append(_Line(line, n, prefix).axiom())
    return out.distinct()
