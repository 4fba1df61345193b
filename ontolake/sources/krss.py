"""KRSS, both dialects: S-expressions of concepts, roles and individuals."""

from __future__ import annotations

import re

from ..errors import OWLSyntaxError
from ..model import NOTHING, THING, Obj, Ontology, cardinality, entity, make

#: Top-level forms of both dialects, and those of the second alone.
SHARED = ("define-primitive-concept", "define-concept", "define-primitive-role", "transitive", "range", "instance", "related", "equal", "distinct")
SECOND = ("define-role", "disjoint", "equivalent", "implies", "disjoint-roles", "implies-role", "inverse", "roles-equivalent", "role-inclusion")

_TOKEN = re.compile(r"\s+|;[^\n]*|\(|\)|<[^<>\s]*>|\"(?:[^\"\\]|\\.)*\"|\|[^|]*\||[^\s()\"|;]+")


def read(text: str) -> list:
    """Nested lists of texts."""
    stack, at = [[]], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise OWLSyntaxError(f"unexpected {text[at]!r}", text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at))
        t, at = m[0], m.end()
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise OWLSyntaxError("a parenthesis too many")
            done = stack.pop()
            stack[-1].append(done)
        elif t.strip() and t[0] != ";":
            stack[-1].append(t)
    if len(stack) > 1:
        raise OWLSyntaxError("a parenthesis is not closed")
    return stack[0]


class _Reader:
    def __init__(self, dialect: int, prefix: str) -> None:
        self.dialect, self.prefix, self.out = dialect, prefix, []

    def iri(self, t: str) -> str:
        if not isinstance(t, str):
            raise OWLSyntaxError(f"expected a name, found {t}")
        t = t.strip("|")
        if t.startswith("<"):
            return t[1:-1]
        return t if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", t) else self.prefix + t

    def individual(self, t) -> Obj:
        return entity("NamedIndividual", self.iri(t))

    def role(self, t) -> Obj:
        if isinstance(t, list):
            if len(t) == 2 and t[0] in ("inv", "inverse"):
                p = self.role(t[1])
                return p.fields[0] if p.kind == "OWLObjectInverseOf" else make("ObjectInverseOf", p)
            raise OWLSyntaxError(f"no role: {t}")
        return entity("ObjectProperty", self.iri(t))

    def concept(self, t) -> Obj:
        if isinstance(t, str):
            return entity("Class", {"top": THING, "*top*": THING, "bottom": NOTHING, "*bottom*": NOTHING}.get(t.lower()) or self.iri(t))
        if not t:
            raise OWLSyntaxError("an empty concept")
        op, rest = t[0].lower(), t[1:]
        if op in ("and", "or") and rest:
            return make("ObjectIntersectionOf" if op == "and" else "ObjectUnionOf", map(self.concept, rest))
        if op == "not" and len(rest) == 1:
            return make("ObjectComplementOf", self.concept(rest[0]))
        if op in ("some", "all") and len(rest) == 2:
            return make("ObjectSomeValuesFrom" if op == "some" else "ObjectAllValuesFrom", self.role(rest[0]), self.concept(rest[1]))
        kinds = {"at-least": "ObjectMinCardinality", "at-most": "ObjectMaxCardinality", "exactly": "ObjectExactCardinality"}
        if op in kinds and len(rest) in (2, 3):
            return make(kinds[op], cardinality(rest[0]), self.role(rest[1]), self.concept(rest[2]) if len(rest) == 3 else entity("Class", THING))
        raise OWLSyntaxError(f"no concept: {op}")

    def form(self, f: list) -> None:
        if not isinstance(f, list) or not f or not isinstance(f[0], str):
            raise OWLSyntaxError(f"no form: {f}")
        op, a, add = f[0].lower(), f[1:], lambda *x: self.out.append(make(*x))
        if op not in SHARED and not (self.dialect == 2 and op in SECOND):
            raise OWLSyntaxError(f"no form of this dialect: {op}")
        two = {"implies": ("SubClassOf", self.concept), "implies-role": ("SubObjectPropertyOf", self.role)}
        sets = {"disjoint": ("DisjointClasses", self.concept), "equivalent": ("EquivalentClasses", self.concept), "disjoint-roles": ("DisjointObjectProperties", self.role), "roles-equivalent": ("EquivalentObjectProperties", self.role), "inverse": ("InverseObjectProperties", self.role), "equal": ("SameIndividual", self.individual), "distinct": ("DifferentIndividuals", self.individual)}
        if op == "define-primitive-role":
            self.define_role(a)
            return
        if op == "define-primitive-concept" and len(a) == 1:
            add("Declaration", self.concept(a[0]))
            return
        want = 3 if op == "related" else 1 if op == "transitive" else 2
        if len(a) != want:
            raise OWLSyntaxError(f"{op} takes {want} parts; found {a[want] if len(a) > want else 'fewer'}")
        if op in two:
            add(two[op][0], *map(two[op][1], a))
        elif op in sets:
            add(sets[op][0], list(map(sets[op][1], a)))
        elif op == "define-primitive-concept":
            add("SubClassOf", self.concept(a[0]), self.concept(a[1]))
        elif op == "define-concept":
            add("EquivalentClasses", [self.concept(a[0]), self.concept(a[1])])
        elif op == "define-role":
            add("EquivalentObjectProperties", [self.role(a[0]), self.role(a[1])])
        elif op == "transitive":
            add("TransitiveObjectProperty", self.role(a[0]))
        elif op == "range":
            add("ObjectPropertyRange", self.role(a[0]), self.concept(a[1]))
        elif op == "instance":
            add("ClassAssertion", self.concept(a[1]), self.individual(a[0]))
        elif op == "related":
            add("ObjectPropertyAssertion", self.role(a[1]), self.individual(a[0]), self.individual(a[2]))
        elif op == "role-inclusion":
            if isinstance(a[0], list) and a[0] and a[0][0] == "compose":
                add("SubPropertyChainOf", [self.role(x) for x in a[0][1:]], self.role(a[1]))
            else:
                add("SubObjectPropertyOf", self.role(a[0]), self.role(a[1]))

    def define_role(self, a: list) -> None:
        p, rest = self.role(a[0]), a[1:]
        add = lambda *x: self.out.append(make(*x))
        if self.dialect == 2:
            add("Declaration", p)
        if rest and not (isinstance(rest[0], str) and rest[0].startswith(":")):
            add("SubObjectPropertyOf", p, self.role(rest[0]))
            rest = rest[1:]
        if len(rest) % 2:
            raise OWLSyntaxError("an attribute without a value")
        for name, v in zip(rest[::2], rest[1::2]):
            name = name.lower()
            yes = not (isinstance(v, str) and v.lower() == "nil")
            flags = {":transitive": "TransitiveObjectProperty", ":symmetric": "SymmetricObjectProperty", ":reflexive": "ReflexiveObjectProperty"}
            if name == ":right-identity":
                raise OWLSyntaxError(":right-identity is not read")
            if self.dialect == 1:
                raise OWLSyntaxError(f"no attribute of this dialect: {name}")
            if name in flags:
                if yes:
                    add(flags[name], p)
            elif name in (":parent", ":parents"):
                for x in v if isinstance(v, list) else [v]:
                    add("SubObjectPropertyOf", p, self.role(x))
            elif name == ":domain":
                add("ObjectPropertyDomain", p, self.concept(v))
            elif name == ":range":
                add("ObjectPropertyRange", p, self.concept(v))
            elif name == ":inverse":
                add("InverseObjectProperties", [p, self.role(v)])
            else:
                raise OWLSyntaxError(f"unknown attribute {name}")


def parse(text: str, scope: str = "", prefix: str = "", dialect: int = 2) -> Ontology:
    r = _Reader(dialect, prefix)
    for f in read(text.removeprefix("﻿")):
        if f in ("end-tbox", "end-abox"):
            continue
        r.form(f)
    return Ontology(axioms=r.out).distinct()
