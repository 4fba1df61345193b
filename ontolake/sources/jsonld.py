"""JSON-LD to quads: contexts inside the document, without fetching remote ones."""

from __future__ import annotations

import json
import re
from typing import Any
from urllib.parse import urljoin

from ..errors import OWLSyntaxError, SecurityPolicyError
from ..model import RDF, XSD
from .rdf_terms import Quad, Term, blank, iri_term, lit_term

_KEYWORDS = {"@base", "@container", "@context", "@direction", "@graph", "@id", "@import", "@included", "@index", "@json", "@language", "@list", "@nest", "@none", "@prefix", "@propagate", "@protected", "@reverse", "@set", "@type", "@value", "@version", "@vocab"}
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


class Context:
    def __init__(self, base: str = "") -> None:
        self.base, self.vocab, self.language = base, None, None
        self.terms: dict[str, dict[str, Any] | None] = {}

    def copy(self) -> Context:
        c = Context(self.base)
        c.vocab, c.language, c.terms = self.vocab, self.language, dict(self.terms)
        return c

    def extended(self, local: Any) -> Context:
        c = self.copy()
        for one in local if isinstance(local, list) else [local]:
            if one is None:
                c = Context(self.base)
            elif isinstance(one, str):
                raise SecurityPolicyError(f"remote context {one} is not fetched")
            elif isinstance(one, dict):
                c._add(one)
            else:
                raise OWLSyntaxError("a context is an object")
        return c

    def _add(self, one: dict) -> None:
        if "@base" in one:
            self.base = urljoin(self.base, one["@base"]) if one["@base"] is not None else ""
        if "@vocab" in one:
            self.vocab = self.expand(one["@vocab"], True) if one["@vocab"] else one["@vocab"]
        if "@language" in one:
            self.language = one["@language"]
        todo = {k: v for k, v in one.items() if not k.startswith("@")}
        for term in todo:
            self._define(term, todo, set())

    def _define(self, term: str, todo: dict, active: set[str]) -> None:
        if term in active:
            raise OWLSyntaxError(f"the term {term} is defined by itself")
        v = todo[term]
        if v is None or isinstance(v, dict) and "@id" in v and v["@id"] is None:
            self.terms[term] = None
            return
        v = {"@id": v} if isinstance(v, str) else dict(v)
        active = active | {term}
        ident = v.get("@reverse", v.get("@id", term))
        prefix = ident.partition(":")[0] if isinstance(ident, str) else ""
        for other in (ident, prefix):
            if other in todo and other != term and other not in self.terms:
                self._define(other, todo, active)
        if ident == term and ":" not in term:
            full = (self.vocab or "") + term if self.vocab is not None else None
        elif ident == term:
            p, _, rest = term.partition(":")
            full = (self.terms[p]["@id"] + rest) if self.terms.get(p) else term
        else:
            full = self.expand(ident, True)
        if full is None:
            raise OWLSyntaxError(f"the term {term} has no IRI")
        out = {"@id": full, "reverse": "@reverse" in v, "container": v.get("@container") if isinstance(v.get("@container"), list) else [v["@container"]] if v.get("@container") else []}
        if "@type" in v:
            t = v["@type"]
            if isinstance(t, str) and t in todo and t not in self.terms:
                self._define(t, todo, active)
            out["type"] = t if t in ("@id", "@vocab", "@json", "@none") else self.expand(t, True)
        if "@language" in v:
            out["language"] = v["@language"]
        if "@context" in v:
            out["context"] = v["@context"]
        self.terms[term] = out

    def expand(self, name: str, vocab: bool = False) -> str | None:
        if name in _KEYWORDS:
            return name
        if vocab and name in self.terms:
            return self.terms[name]["@id"] if self.terms[name] else None
        if ":" in name:
            p, _, rest = name.partition(":")
            if p == "_" or rest.startswith("//"):
                return name
            if self.terms.get(p):
                return self.terms[p]["@id"] + rest
            if _ABSOLUTE.match(name):
                return name
        if vocab:
            return self.vocab + name if self.vocab is not None else None
        return urljoin(self.base, name) if self.base else name


class _Reader:
    def __init__(self) -> None:
        self.quads: list[Quad] = []
        self.count = 0

    def fresh(self) -> Term:
        self.count += 1
        return blank(f"b{self.count}_gen")

    def named(self, v: str) -> Term:
        return blank(v[2:]) if v.startswith("_:") else iri_term(v)

    def add(self, s: Term, p: str, o: Term, g: Term | None) -> None:
        ok = all(t.kind != "iri" or _ABSOLUTE.match(t.value) for t in (s, o)) and _ABSOLUTE.match(p) and not p.startswith("_:")
        if ok:  # statements that are not well formed are left out
            self.quads.append(Quad(s, iri_term(p), o, g))

    def node(self, v: dict, c: Context, g: Term | None) -> Term | None:
        if "@context" in v:
            c = c.extended(v["@context"])
        keys = {k: (c.expand(k, True)) for k in v if k != "@context"}
        ids = [k for k, e in keys.items() if e == "@id"]
        s = self.named(c.expand(v[ids[0]]) or v[ids[0]]) if ids and v[ids[0]] is not None else self.fresh()
        for k, e in keys.items():
            if e == "@type":
                for t in v[k] if isinstance(v[k], list) else [v[k]]:
                    full = c.expand(t, True) or c.expand(t)
                    if full:
                        self.add(s, RDF + "type", self.named(full), g)
        for k, e in keys.items():
            x = v[k]
            if e == "@graph":
                inner = g if len(keys) == 1 and not ids else s
                for one in x if isinstance(x, list) else [x]:
                    self.node(one, c, inner)
            elif e == "@included":
                for one in x if isinstance(x, list) else [x]:
                    self.node(one, c, g)
            elif e == "@reverse":
                for p, ys in x.items():
                    for y in ys if isinstance(ys, list) else [ys]:
                        full = c.expand(p, True)
                        o = self.value(y, c, c.terms.get(p) or {}, g)
                        if full and o:
                            self.add(o, full, s, g)
            elif e is None or e.startswith("@"):
                continue
            else:
                term = c.terms.get(k) or {}
                inner = c.extended(term["context"]) if "context" in term else c
                for o in self.values(x, inner, term, g):
                    self.add(*((o, e, s) if term.get("reverse") else (s, e, o)), g)
        return s

    def values(self, x: Any, c: Context, term: dict, g: Term | None) -> list[Term]:
        if x is None:
            return []
        kinds = term.get("container", [])
        if "@list" in kinds and not (isinstance(x, dict) and "@list" in x):
            return [self.list(x if isinstance(x, list) else [x], c, term, g)]
        if "@language" in kinds and isinstance(x, dict):
            return [lit_term(t, "" if lang == "@none" else lang) for lang, ts in sorted(x.items()) for t in (ts if isinstance(ts, list) else [ts]) if t is not None]
        if ("@index" in kinds or "@id" in kinds) and isinstance(x, dict) and not ({"@id", "@value", "@type"} & set(x)):
            x = [{**y, "@id": k} if "@id" in kinds and isinstance(y, dict) else y for k, ys in sorted(x.items()) for y in (ys if isinstance(ys, list) else [ys])]
        out = []
        for y in x if isinstance(x, list) else [x]:
            if isinstance(y, dict) and "@set" in y:
                out += self.values(y["@set"], c, term, g)
            elif isinstance(y, list):
                out += self.values(y, c, term, g)
            else:
                o = self.value(y, c, term, g)
                out += [o] if o is not None else []
        return out

    def list(self, items: list, c: Context, term: dict, g: Term | None) -> Term:
        plain = {k: v for k, v in term.items() if k != "container"}
        parts = self.values(items, c, plain, g)
        head = iri_term(RDF + "nil")
        for o in reversed(parts):
            cell = self.fresh()
            self.add(cell, RDF + "first", o, g)
            self.add(cell, RDF + "rest", head, g)
            head = cell
        return head

    def value(self, y: Any, c: Context, term: dict, g: Term | None) -> Term | None:
        kind = term.get("type")
        if isinstance(y, dict):
            expanded = {c.expand(k, True): v for k, v in y.items()}
            if "@value" in expanded:
                v, t, lang = expanded["@value"], expanded.get("@type"), expanded.get("@language")
                if v is None:
                    return None
                if t == "@json":
                    return lit_term(json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False), "", RDF + "JSON")
                return self.scalar(v, c.expand(t, True) if t else None, lang)
            if "@list" in expanded:
                x = expanded["@list"]
                return self.list(x if isinstance(x, list) else [x], c, term, g)
            return self.node(y, c, g)
        if y is None:
            return None
        if kind == "@json":
            return lit_term(json.dumps(y, separators=(",", ":"), sort_keys=True, ensure_ascii=False), "", RDF + "JSON")
        if kind in ("@id", "@vocab") and isinstance(y, str):
            full = c.expand(y, kind == "@vocab") or c.expand(y)
            return self.named(full) if full else None
        if kind and kind not in ("@id", "@vocab", "@none"):
            return self.scalar(y, kind, None)
        return self.scalar(y, None, (term["language"] if "language" in term else c.language) if isinstance(y, str) else None)

    def scalar(self, v: Any, datatype: str | None, language: str | None) -> Term:
        if isinstance(v, bool):
            return lit_term("true" if v else "false", "", datatype or XSD + "boolean")
        if isinstance(v, (int, float)):
            if isinstance(v, float) and (v != int(v) or abs(v) >= 1e21) or datatype == XSD + "double":
                mantissa, _, exponent = f"{v:.15E}".partition("E")
                mantissa = mantissa.rstrip("0")
                return lit_term(f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(exponent)}", "", datatype or XSD + "double")
            return lit_term(str(int(v)), "", datatype or XSD + "integer")
        return lit_term(str(v), language or "", datatype or "") if not language else lit_term(str(v), language)


def read_jsonld(text: str, base: str = "") -> list[Quad]:
    try:
        data = json.loads(text.removeprefix("﻿"))
    except ValueError as e:
        raise OWLSyntaxError(f"no JSON: {e}") from e
    r = _Reader()
    for one in data if isinstance(data, list) else [data]:
        if not isinstance(one, dict):
            raise OWLSyntaxError("a JSON-LD document is an object or an array of objects")
        r.node(one, Context(base), None)
    return [q for q in r.quads if all(_well_formed(t) for t in (q.s, q.p, q.o, q.g) if t is not None)]


def _well_formed(t: Term) -> bool:
    """IRIs are absolute, without blanks and brackets and with one fragment at most; language tags have a tag's form. Statements
    with other terms are left out, as the format asks."""
    iri = lambda x: re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) and not re.search(r'[\s<>"{}|\\^`]', x) and x.count("#") <= 1
    if t.kind == "iri":
        return bool(iri(t.value))
    if t.kind == "literal":
        return bool(iri(t.datatype)) and (not t.language or re.fullmatch(r"[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*|[ixIX](?:-[A-Za-z0-9]{1,8})+", t.language) is not None)
    return True
