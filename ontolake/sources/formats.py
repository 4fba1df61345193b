"""Document formats with their prefixes and parameters, and writer settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..errors import UnsupportedConstructError
from ..model import OWL, RDF, RDFS, XSD, Ontology
from .registry import FORMAT, store

DEFAULTS = {"owl:": OWL, "rdf:": RDF, "rdfs:": RDFS, "xsd:": XSD}
FORCE_STRING = "force xsd:string on literals"


@dataclass
class DocumentFormat:
    """A format by key, with the prefixes that its documents use. Prefix names end with a colon."""

    key: str
    prefixes: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS))
    parameters: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.key not in FORMAT:
            raise ValueError(f"no format {self.key}")

    @staticmethod
    def _name(prefix: str) -> str:
        return prefix if prefix.endswith(":") else prefix + ":"

    def set_prefix(self, prefix: str, namespace: str) -> None:
        self.prefixes[self._name(prefix)] = namespace

    def get_prefix(self, prefix: str) -> str | None:
        return self.prefixes.get(self._name(prefix))

    def contains_prefix(self, prefix: str) -> bool:
        return self._name(prefix) in self.prefixes

    def set_default_prefix(self, namespace: str) -> None:
        self.prefixes[":"] = namespace

    def get_iri(self, short: str) -> str:
        p, colon, rest = short.partition(":")
        if not colon or p + ":" not in self.prefixes:
            raise ValueError(f"unknown prefix in {short}")
        return self.prefixes[p + ":"] + rest

    def get_prefix_iri(self, iri: str) -> str | None:
        """The shortest form of an IRI by its longest namespace."""
        fit = max(((ns, p) for p, ns in self.prefixes.items() if ns and iri.startswith(ns)), key=lambda x: len(x[0]), default=None)
        return fit[1] + iri[len(fit[0]) :] if fit else None

    def copy_prefixes_from(self, other: DocumentFormat) -> None:
        self.prefixes.update(other.prefixes)

    def unregister_namespace(self, namespace: str) -> None:
        self.prefixes = {p: ns for p, ns in self.prefixes.items() if ns != namespace}

    def clear(self) -> None:
        self.prefixes = dict(DEFAULTS)

    def set_parameter(self, name: str, value: object) -> None:
        if name != FORCE_STRING:
            raise UnsupportedConstructError(f"no parameter {name}")
        self.parameters[name] = value


@dataclass(frozen=True)
class WriterConfiguration:
    indent: int = 4
    use_banners: bool = True
    labels_as_banner: bool = False
    save_anonymous_ids: bool = False

    def with_(self, **changes) -> WriterConfiguration:
        return replace(self, **changes)


class StringTarget:
    """Where a document's text goes. Only complete texts are published."""

    def __init__(self) -> None:
        self.text = ""

    def write(self, text: str, append: bool = False) -> None:
        self.text = self.text + text if append else text


def save(o: Ontology, fmt: DocumentFormat, target: StringTarget, append: bool = False) -> None:
    text = store(replace(o, prefixes=fmt.prefixes), fmt.key)
    if fmt.parameters.get(FORCE_STRING) is False and fmt.key == "functional":
        text = text.replace(f'"^^<{XSD}string>', '"')
    target.write(text, append)
