"""Transformations of structural objects and whole ontologies in Python, for documents: renaming, duplication, merging,
removal, parser metadata and resource limits. Tables of axioms use operators.changes instead."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from ..errors import ResourceLimitError
from ..model import ENTITY_KINDS, KIND, Obj, Ontology, make, walk
from ..sources.rdf_terms import Quad, nt
from .comparison import same


def transform(o: Obj, leaf: Callable[[Obj], Obj], memo: dict[str, Obj] | None = None) -> Obj:
    """o with every leaf (entity, IRI, literal, anonymous individual) replaced, sets put in order again. Iterative and
    shared: an object that occurs twice is rebuilt once."""
    memo = {} if memo is None else memo
    name = lambda x: x.kind + x.key
    todo = [(o, False)]
    while todo:
        x, ready = todo.pop()
        if name(x) in memo:
            continue
        if x.kind in ("OWLLiteral", "OWLAnonymousIndividual", "IRI") or KIND[x.kind].category == "entity":
            memo[name(x)] = leaf(x)
            continue
        parts = [v for f in x.fields for v in (f if isinstance(f, tuple) else (f,)) if isinstance(v, Obj)] + list(x.annotations)
        if not ready:
            todo.append((x, True))
            todo += [(p, False) for p in parts]
            continue
        new = lambda v: memo[name(v)] if isinstance(v, Obj) else v
        memo[name(x)] = make(x.kind, *([new(v) for v in f] if isinstance(f, tuple) else new(f) for f in x.fields), annotations=[new(a) for a in x.annotations])
    return memo[name(o)]


def rename(axioms: Iterable[Obj], iris: dict[str, str], kind: str | None = None) -> list[tuple[str, Obj]]:
    """('remove', old) and ('add', new) of the axioms that a renaming changes. kind: rename that kind of entity alone; else
    entities of every kind, and IRIs as annotation subjects and values."""
    memo: dict[str, Obj] = {}

    def leaf(x: Obj) -> Obj:
        if x.iri in iris and (x.kind == kind or kind is None):
            return Obj(x.kind, (iris[x.iri],))
        if x.kind == "OWLLiteral" and x.fields[2] in iris and kind in (None, "OWLDatatype"):
            return Obj(x.kind, (x.fields[0], x.fields[1], iris[x.fields[2]]))
        return x

    out = []
    for a in axioms:
        b = transform(a, leaf, memo)
        if b != a:
            out += [("remove", a), ("add", b)]
    return out


def duplicate(o: Obj, entities: dict[str, str] | None = None, iris: dict[str, str] | None = None, literals: dict[str, Obj] | None = None, scope: str | None = None) -> Obj:
    """A copy with entities, other IRIs and literals (by key) exchanged, and anonymous individuals in a new scope."""

    def leaf(x: Obj) -> Obj:
        if x.kind == "OWLAnonymousIndividual":
            return Obj(x.kind, (x.fields[0], x.fields[1] if scope is None else scope))
        if x.kind == "OWLLiteral":
            return (literals or {}).get(x.key, x)
        names = (iris if x.kind == "IRI" else entities) or {}
        return Obj(x.kind, (names[x.iri],)) if x.iri in names else x

    return transform(o, leaf)


def remove(axioms: Iterable[Obj], entity: Obj) -> list[Obj]:
    """Axioms that refer to an entity, and annotations of its IRI, one after the other; one that is both comes twice."""
    axioms = list(axioms)
    refer = [a for a in axioms if any(x.key == entity.key and x.kind == entity.kind for x, _ in walk(a))]
    return refer + [a for a in axioms if a.kind == "OWLAnnotationAssertionAxiom" and a.fields[1].kind == "IRI" and a.fields[1].iri == entity.iri]


def merge(ontologies: Iterable[Ontology], iri: str | None = None, logical_only: bool = False) -> Ontology:
    """The union of direct axioms. Annotations, imports and source ids are left behind; anonymous individuals keep their
    documents' scopes, so equal labels stay apart."""
    axioms = {a.key: a for o in ontologies for a in o.axioms if not logical_only or KIND[a.kind].logical}
    return Ontology(iri, axioms=[axioms[k] for k in sorted(axioms)])


@dataclass(frozen=True)
class ParserMetadata:
    """What reading an RDF document found: distinct triples, statements before repeats were dropped, header status,
    statements that no rule took, and entities that are used without a declaration."""

    triples: int
    statements: int
    header: str  # parsed or missing
    unparsed: tuple[str, ...]
    guessed: tuple[tuple[str, str], ...]


def parser_metadata(quads: Iterable[Quad], o: Ontology) -> ParserMetadata:
    quads = list(quads)
    declared = {a.fields[0].key for a in o.axioms if a.kind == "OWLDeclarationAxiom"}
    used = {(x.iri, x.kind) for a in o.axioms for x, _ in walk(a) if x.kind in ENTITY_KINDS and x.key not in declared and x.kind != "OWLNamedIndividual"}
    left = tuple(sorted(" ".join(map(nt, q[:3])) for q in getattr(o, "unconsumed", [])))
    return ParserMetadata(len({q[:3] for q in quads}), len(quads), "parsed" if o.iri else "missing", left, tuple(sorted(used)))


def same_graph(left: Iterable[Quad], right: Iterable[Quad]) -> bool:
    """Are two RDF datasets equal up to the names of blank nodes."""
    text = lambda qs: {"(" + " ".join(nt(t) if t is not None else "-" for t in q).replace("(", "\\u0028").replace(")", "\\u0029") + " )" for q in qs}
    return same(text(left), text(right)) is not None


@dataclass(frozen=True)
class Limits:
    """Ceilings; going over one is an error, never a cut."""

    chars: int | None = None
    axioms: int | None = None
    quads: int | None = None
    depth: int | None = None

    def with_(self, **changes) -> Limits:
        return replace(self, **changes)

    def check(self, what: str, n: int) -> None:
        most = getattr(self, what)
        if most is not None and n > most:
            raise ResourceLimitError(f"{n} {what}; the limit is {most}")

    def check_ontology(self, o: Ontology) -> None:
        from ..model import height

        self.check("axioms", len(o.axioms))
        if self.depth is not None:
            for a in o.axioms:
                self.check("depth", height(a))
