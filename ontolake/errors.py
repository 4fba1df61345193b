"""Errors with stable codes."""

from __future__ import annotations


class OntologyError(Exception):
    code = "ONTOLOGY_ERROR"


class OWLSyntaxError(OntologyError):
    code = "OWL_SYNTAX_ERROR"

    def __init__(self, message: str, line: int | None = None, column: int | None = None) -> None:
        super().__init__(message if line is None else f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class ParserMismatchError(OntologyError):
    code = "PARSER_MISMATCH"


class XmlParseError(OntologyError):
    code = "XML_PARSE_ERROR"


class UnsupportedConstructError(OntologyError):
    code = "UNSUPPORTED_CONSTRUCT"


class ResourceLimitError(OntologyError):
    code = "RESOURCE_LIMIT_EXCEEDED"


class SecurityPolicyError(OntologyError):
    code = "SECURITY_POLICY_VIOLATION"


class DocumentLoadError(OntologyError):
    code = "DOCUMENT_LOAD_FAILED"


class MissingImportError(DocumentLoadError):
    code = "MISSING_IMPORT"


class UnloadableImportError(DocumentLoadError):
    code = "UNLOADABLE_IMPORT"


class OWLOntologyCreationError(OntologyError):
    code = "ONTOLOGY_CREATION_FAILED"


class AmbiguousRdfDatasetError(OWLOntologyCreationError):
    code = "AMBIGUOUS_RDF_DATASET"


class GraphSelectionError(OWLOntologyCreationError):
    code = "RDF_GRAPH_SELECTION_FAILED"


class OWLOntologyStateError(OntologyError):
    code = "ONTOLOGY_STATE_INVALID"


class OWLOntologyStorageError(OntologyError):
    code = "ONTOLOGY_STORAGE_FAILED"


class OWLStorerNotFoundError(OWLOntologyStorageError):
    code = "STORER_NOT_FOUND"


class UnparsableOntologyException(OntologyError):
    code = "UNPARSABLE_ONTOLOGY"

    def __init__(self, failures: dict[str, Exception]) -> None:
        super().__init__("; ".join(f"{k}: {v}" for k, v in failures.items()))
        self.failures = failures
