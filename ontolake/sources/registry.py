"""Formats: detection, parsing and storing by format, and loading of documents with Spark."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AmbiguousRdfDatasetError, OntologyError, OWLOntologyStorageError, OWLStorerNotFoundError, ParserMismatchError, ResourceLimitError, UnparsableOntologyException
from ..model import ANNOTATION_AXIOMS, KIND, Obj, Ontology, height, walk
from ..operators import comparison
from . import dl, functional, krss, manchester, mapping, owlxml
from .jsonld import read_jsonld
from .rdf_terms import Quad, nt, read_lines, read_trig, read_turtle, write_turtle
from .rdfxml import read_rdfxml, write_rdfxml

PREFIX_BYTES = 8192
MATCH, MAYBE, NO = 0, 1, 2

_TRIVIA = r"(?:\s|#[^\n]*(?:\n|$))*"
_XML_HEAD = r"\s*(?:<\?xml[^>]*\?>)?(?:\s|<!--.*?-->|<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>|<\?.*?\?>)*"


class Format(NamedTuple):
    key: str
    priority: int
    media: tuple[str, ...]
    extensions: tuple[str, ...]
    match: str  # expression over the first bytes: certainly this format
    maybe: str  # possibly this format


#: Formats with their priority, media types, extensions.
FORMATS: tuple[Format, ...] = (
    Format("owlxml", 5, ("application/owl+xml",), (".owx", ".owl", ".xml"), rf"(?s)^{_XML_HEAD}<(?:[\w.-]+:)?Ontology\b", ""),
    Format("jsonld", 8, ("application/ld+json",), (".jsonld", ".json"), r"(?s)^\s*[\[{].*\"@(?:context|id|graph|type)\"", r"^\s*[\[{]"),
    Format("functional", 10, ("text/owl-functional",), (".ofn", ".owl"), rf"^{_TRIVIA}(?:Prefix|Ontology)\s*\(", ""),
    Format("dl", 15, ("text/dl",), (".dl",), r"[⊑≡⊓⊔¬∃∀≥≤∘]|\\sqsubseteq|\\equiv", r"^\s*:?\s*\w+\s*(?:->|==|!=|\()"),
    Format("krss1", 15, ("text/krss",), (".krss",), r"(?i)^(?:\s|;[^\n]*\n)*\((?:" + "|".join(krss.SHARED) + r")\s", ""),
    Format("krss2", 16, ("text/krss2",), (".krss2", ".krss"), r"(?i)(?:^|\n)\s*\((?:" + "|".join(krss.SECOND) + r")\s", r"(?i)^(?:\s|;[^\n]*\n)*\((?:" + "|".join(krss.SHARED) + r")\s"),
    Format("manchester", 20, ("text/owl-manchester",), (".omn", ".owl"), rf"^{_TRIVIA}(?:Prefix|Ontology):", ""),
    Format("trig", 22, ("application/trig",), (".trig",), r"(?s)^(?:\s|#[^\n]*\n|@?(?i:prefix|base)\b[^\n]*\n)*(?:(?i:graph)\s+)?(?:<[^<>\s]*>|[\w.-]*:[\w.-]*|_:\w+|\[\s*\])?\s*\{", ""),
    Format("nquads", 23, ("application/n-quads",), (".nq",), r"(?m)\A(?:\s|#[^\n]*\n)*(?:<[^<>\s]+>|_:\S+)\s*<[^<>\s]+>\s*(?:<[^<>\s]+>|_:\S+|\"(?:[^\"\\\n]|\\.)*\"(?:@[\w-]+|\^\^<[^<>\s]+>)?)\s*(?:<[^<>\s]+>|_:\S+)\s*\.", ""),
    Format("ntriples", 24, ("application/n-triples", "text/plain"), (".nt",), r"(?m)\A(?:\s|#[^\n]*\n)*(?:<[^<>\s]+>|_:\S+)\s*<[A-Za-z][\w+.-]*:[^<>\s]*>\s*(?:<[^<>\s]+>|_:\S+|\"(?:[^\"\\\n]|\\.)*\"(?:@[\w-]+|\^\^<[^<>\s]+>)?)\s*\.[ \t]*(?:#[^\n]*)?$", ""),
    Format("turtle", 25, ("text/turtle",), (".ttl", ".owl"), rf"^{_TRIVIA}(?:@prefix|@base|(?i:prefix|base)\s+[\w.-]*:?\s*<)", r"^\s*(?:<[^<>\s]*>|[\w.-]*:[\w.-]*|_:\w+|\[)\s"),
    Format("rdfxml", 30, ("application/rdf+xml", "application/xml", "text/xml"), (".rdf", ".owl", ".xml"), rf"(?s)^{_XML_HEAD}<(?:[\w.-]+:)?RDF\b", rf"(?s)^{_XML_HEAD}<\w"),
)
FORMAT = {f.key: f for f in FORMATS}
#: The order in which formats are tried where content is not looked at.
FIXED_ORDER = ("rdfxml", "owlxml", "functional", "turtle", "manchester", "nquads", "trig", "ntriples", "jsonld", "dl", "krss2")
RDF_FORMATS = {"rdfxml", "turtle", "ntriples", "nquads", "trig", "jsonld"}


def utf8_prefix(text: str, size: int = PREFIX_BYTES) -> str:
    """The start of a text of at most so many bytes, cut between characters."""
    return text[:size].encode("utf-8", "surrogatepass")[:size].decode("utf-8", "ignore")


def candidates(text: str, content_type: str = "", file_name: str = "", explicit: str | None = None, fixed_order: bool = False) -> list[str]:
    """Formats to try, in order: by evidence, media type, static priority, extension, name. fixed_order: the fixed list
    instead, or those of it that have the media type."""
    if fixed_order and not explicit:
        media = content_type.split(";")[0].strip().lower()
        return [k for k in FIXED_ORDER if media in FORMAT[k].media] or list(FIXED_ORDER)
    if explicit:
        if explicit not in FORMAT:
            raise ParserMismatchError(f"no format {explicit}")
        return [explicit]
    head = utf8_prefix(text.removeprefix("﻿"))
    media = content_type.split(";")[0].strip().lower()
    extension = (re.search(r"\.[^./\\]+$", file_name) or [""])[0].lower()
    second = re.search(FORMAT["krss2"].match, head)
    rows = []
    for f in FORMATS:
        rank = MATCH if re.search(f.match, head) else MAYBE if f.maybe and re.search(f.maybe, head) else NO
        if f.key == "krss1" and second:
            rank = NO
        if f.key == "krss2" and rank == MAYBE and extension == ".krss2":
            rank = MATCH
        if f.key == "dl" and rank == MATCH and re.match(r"\s*(?:<\?xml|<|@prefix|Prefix|Ontology|\(|\{)", head):
            rank = NO
        by_media = media in f.media
        if rank == MATCH or rank == MAYBE and (by_media or extension in f.extensions):
            rows.append((rank, not by_media, f.priority, extension not in f.extensions, f.key))
    return [r[-1] for r in sorted(rows)]


def quads_of(text: str, key: str, base: str = "") -> list[Quad]:
    readers: dict[str, Callable[[], list[Quad]]] = {
        "turtle": lambda: read_turtle(text, base), "trig": lambda: read_trig(text, base), "ntriples": lambda: list(read_lines(text, False)),
        "nquads": lambda: list(read_lines(text)), "rdfxml": lambda: read_rdfxml(text, base), "jsonld": lambda: read_jsonld(text, base),
    }
    return readers[key]()


def parse(text: str, key: str | None = None, document_iri: str = "", content_type: str = "", file_name: str = "", strict: bool = False, annotations: bool = True, max_axioms: int | None = None, declared: dict[str, set[str]] | None = None) -> tuple[Ontology, str]:
    """An ontology from a text, and the format that read it. annotations: keep annotation axioms."""
    failures: dict[str, Exception] = {}
    prefix = document_iri + "#" if document_iri and not document_iri.endswith(("#", "/")) else document_iri
    for name in candidates(text, content_type, file_name, key):
        try:
            if name in RDF_FORMATS:
                quads = quads_of(text, name, document_iri)
                if len({q.g for q in quads}) > 1:
                    raise AmbiguousRdfDatasetError("more than one graph; select one")
                out: Ontology = mapping.from_rdf(quads, document_iri, strict, document_iri or None, declared)
            else:
                out = {
                    "functional": lambda: functional.parse(text, document_iri), "manchester": lambda: manchester.parse(text, document_iri), "owlxml": lambda: owlxml.parse(text, document_iri, document_iri),
                    "dl": lambda: dl.parse(text, document_iri, prefix), "krss1": lambda: krss.parse(text, document_iri, prefix, 1), "krss2": lambda: krss.parse(text, document_iri, prefix, 2),
                }[name]()
        except OntologyError as e:
            failures[name] = e
            continue
        if not annotations:
            out.axioms = [a for a in out.axioms if a.kind not in ANNOTATION_AXIOMS]
        if max_axioms is not None and len(out.axioms) > max_axioms:
            raise ResourceLimitError(f"{len(out.axioms)} axioms; the limit is {max_axioms}")
        return out, name
    if key and failures:
        raise next(iter(failures.values()))
    raise UnparsableOntologyException(failures) if failures else ParserMismatchError("no format matches")


def store(o: Ontology, key: str, proof: bool = True) -> str:
    """An ontology's text in a format: functional, owlxml, turtle or rdfxml. proof: what went through RDF is read back and
    compared; a difference is an error and no text is given."""
    return _stored(o, key, proof)[0]


def _stored(o: Ontology, key: str, proof: bool = True) -> tuple[str, Ontology | None]:
    """The text, and what its proof read if any reading of the text gives that: no IRI depends on the document's, and nothing
    anonymous has a scope."""
    if key == "functional":
        return functional.render(o), None
    if key == "owlxml":
        return owlxml.render(o), None
    if key not in ("turtle", "rdfxml"):
        raise OWLStorerNotFoundError(key)
    quads = mapping.to_rdf(o)
    text = write_turtle(quads, o.prefixes) if key == "turtle" else write_rdfxml(quads, o.prefixes)
    if not proof:
        return text, None
    read = quads_of(text, key)
    back = mapping.from_rdf(read)
    header = lambda x: (x.iri, x.version, sorted(x.imports), sorted(comparison.stable(x.annotations)))
    if back.unconsumed or header(back) != header(o) or not comparison.compare(back.distinct().axioms, o.distinct().axioms):
        raise OWLOntologyStorageError("the text does not say what the ontology says")
    iris = {x for q in read for t in q[:3] for x in ((t.value,) if t.kind == "iri" else (t.datatype,) if t.kind == "literal" else ())}
    anywhere = not back.diagnostics and all(map(_ABSOLUTE, iris)) and not any("_:" in a.key for a in (*back.annotations, *back.axioms))
    return text, back if anywhere else None


_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:").match


#: Most bytes that a packed document may unpack to.
UNPACKED = 1 << 30


def _unpacked(data: bytes, wbits: int, most: int) -> bytes:
    """All members of a stream, one after another, as far as the bound."""
    out = b""
    while data:
        one = zlib.decompressobj(wbits)
        out += one.decompress(data, most + 1 - len(out))
        if len(out) > most or one.unconsumed_tail:
            raise ResourceLimitError(f"a document of more than {most} bytes when unpacked")
        if not one.eof:
            raise ParserMismatchError("a packed document that breaks off")
        data = one.unused_data
    return out


def decoded(data: bytes, most: int = UNPACKED) -> str:
    """Text of a file: plain, gzip, deflate, or the one entry of a zip archive; UTF-32 and UTF-16 by their marks, the encoding
    that an XML document declares, else UTF-8. What unpacks to more than `most` bytes is refused before it is held."""
    if data[:2] == b"\x1f\x8b":
        data = _unpacked(data, 31, most)
    elif data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            if len(names) != 1:
                raise ParserMismatchError("an archive of more than one file")
            with z.open(names[0]) as f:
                data = f.read(most + 1)
                if len(data) > most:
                    raise ResourceLimitError(f"a document of more than {most} bytes when unpacked")
                f.read(1)  # at the end the CRC is checked
    elif data[:1] == b"\x78" and data[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
        data = _unpacked(data, 15, most)
    if data[:4] in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"):
        return data.decode("utf-32")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    declared = re.match(rb"\s*<\?xml[^>]*?encoding=[\"']([A-Za-z][A-Za-z0-9._-]*)[\"']", data)
    if declared:
        try:
            return data.decode(declared[1].decode())
        except LookupError as e:
            raise ParserMismatchError(f"an unknown encoding: {declared[1].decode()}") from e
    return data.decode("utf-8-sig")


AXIOM = "doc string, ontology_iri string, format string, axiom_key string, key_noann string, kind string, is_logical boolean, height int, error string"
REACH = "doc string, root_key string, root_kind string, node_key string, node_kind string, in_annotation boolean"
EDGE = "doc string, parent_key string, parent_kind string, field string, ord int, child_key string, child_kind string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(batches, rows: Callable[[str, Ontology, str], Iterator[tuple]], columns: list[str], failed: Callable[[str, Exception], tuple] | None):
    import pandas as pd

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                o, key = parse(decoded(content), document_iri=path, file_name=path)
                out = list(rows(path, o, key))
            except (OntologyError, ValueError) as e:
                out = [failed(path, e)] if failed else []
            for i in range(0, len(out), 20_000):
                yield pd.DataFrame(out[i : i + 20_000], columns=columns)


def _names(shape: str) -> list[str]:
    return [c.split()[0] for c in shape.split(", ")]


def load_axioms(spark: SparkSession, path: str) -> DataFrame:
    """Axioms of all documents under a path, a document a row of the scan; those that fail give one row with their error."""

    def rows(doc: str, o: Ontology, key: str) -> Iterator[tuple]:
        for a in o.axioms:
            yield doc, o.iri, key, a.key, a.key_noann, a.kind, KIND[a.kind].logical, height(a), None

    fail = lambda doc, e: (doc, None, None, None, None, None, None, None, f"{getattr(e, 'code', 'ERROR')}: {e}")
    return _documents(spark, path).mapInPandas(lambda it: _parsed(it, rows, _names(AXIOM), fail), AXIOM)


def load_reach(spark: SparkSession, path: str) -> DataFrame:
    """Every object inside each axiom of all documents."""

    def rows(doc: str, o: Ontology, key: str) -> Iterator[tuple]:
        for a in o.axioms:
            for x, ann in walk(a):
                if x is not a:
                    yield doc, a.key, a.kind, x.key, x.kind, ann

    return _documents(spark, path).mapInPandas(lambda it: _parsed(it, rows, _names(REACH), None), REACH)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Direct fields of axioms and of the expressions inside."""

    def rows(doc: str, o: Ontology, key: str) -> Iterator[tuple]:
        seen: set[tuple] = set()
        for a in o.axioms:
            for x, _ in walk(a):
                for name, i, c in x.children():
                    row = (doc, x.key, x.kind, name, i, c.key, c.kind)
                    if row not in seen:
                        seen.add(row)
                        yield row

    return _documents(spark, path).mapInPandas(lambda it: _parsed(it, rows, _names(EDGE), None), EDGE)


def load_ontologies(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document: id, format, authored imports, number of axioms and annotations, statements no rule took."""

    def rows(doc: str, o: Ontology, key: str) -> Iterator[tuple]:
        yield doc, o.iri, o.version, key, o.imports, len(o.axioms), len(o.annotations), len(getattr(o, "unconsumed", [])), None

    shape = "doc string, ontology_iri string, version_iri string, format string, imports array<string>, n_axioms int, n_annotations int, n_unconsumed int, error string"
    fail = lambda doc, e: (doc, None, None, None, [], 0, 0, 0, f"{getattr(e, 'code', 'ERROR')}: {e}")
    return _documents(spark, path).mapInPandas(lambda it: _parsed(it, rows, _names(shape), fail), shape)


def detected(df: DataFrame, text: str) -> DataFrame:
    """df with `formats`: certain formats of a text column by its first characters, most important first; by expressions
    alone, for whole tables of documents. Rules between dialects and media types are left to candidates()."""
    head = F.substring(F.col(text), 1, PREFIX_BYTES)
    found = [F.when(head.rlike(f.match), F.lit(f.key)) for f in sorted(FORMATS, key=lambda f: (f.priority, f.key))]
    return df.withColumn("formats", F.array_join(F.array_compact(F.array(*found)), ","))


def load_quads(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Quads of RDF documents, terms in N-Triples. N-Quads and N-Triples alone are better read by operators.rdf.scan_lines,
    which splits files."""
    shape = "doc string, subject string, predicate string, object string, graph string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for doc, content in zip(pdf["path"], pdf["content"]):
                text = decoded(content)
                names = [n for n in candidates(text, file_name=doc, explicit=key) if n in RDF_FORMATS]
                if names:
                    out = [(doc, nt(q.s), nt(q.p), nt(q.o), nt(q.g) if q.g else "") for q in quads_of(text, names[0], doc)]
                    yield pd.DataFrame(out, columns=_names(shape))

    return _documents(spark, path).mapInPandas(run, shape)


def functional_text(axiom_keys: DataFrame, column: str = "axiom_key") -> DataFrame:
    """Axiom keys in functional notation, by expressions alone: keys are that notation but for the kind that they put
    around entities, which a declaration keeps, around facets, and around chains. A literal whose own text looks like such
    a wrapper would lose it; functional.render has no such limit."""
    bare = F.regexp_replace(column, r"(?<!Declaration\()\b(?:Class|Datatype|ObjectProperty|DataProperty|AnnotationProperty|NamedIndividual)\((<[^<>]*>)\)", "$1")
    facet = F.regexp_replace(bare, r"\bFacetRestriction\((<[^<>]*> \x22(?:[^\x22\\]|\\.)*\x22(?:@[\w-]+|\^\^<[^<>]*>))\)", "$1")
    chain = F.regexp_replace(facet, r"\bSubPropertyChainOf\(\(([^()]*)\)", "SubObjectPropertyOf(ObjectPropertyChain($1)")
    return axiom_keys.withColumn("text", chain)


TEXT = "doc string, format string, axiom_key string, kind string, error string"


def parse_texts(df: DataFrame, doc: Column, text: Column, key: str | None = None, through: tuple[str, ...] = ()) -> DataFrame:
    """(doc, format, axiom_key, kind, error): the axioms of many documents in a table, each parsed once; doc is its IRI. A
    document that fails gives one row with its error. through: formats that each ontology is then written in and read again
    from, one after another, before its axioms are given. Documents are dealt over tasks, since the rows that they are made of
    may be few bytes: a file of a million customers is two splits."""
    names = _names(TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for iri, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    o, used = parse(text or "", key, iri or "")
                    for name in through:
                        written, read = _stored(o, name)
                        o, used = (read, name) if read is not None else parse(written, name, iri or "")
                    rows += [(iri, used, a.key, a.kind, None) for a in o.distinct().axioms]
                except (OntologyError, ValueError) as e:
                    rows.append((iri, key, None, None, f"{getattr(e, 'code', 'ERROR')}: {e}"))
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[i : i + 20_000])], names=names)

    return dealt(df).select(doc.cast("string").alias("doc"), text.cast("string").alias("text")).mapInArrow(run, TEXT)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions, or three for each core if that is more."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 3 * spark.sparkContext.defaultParallelism))


def node_count(o: Obj) -> int:
    return sum(1 for _ in walk(o))


def save_axioms(axioms: DataFrame, path: str, column: str = "axiom_key") -> None:
    """Axioms as text files in functional notation, a statement a line, in order of their keys inside each file."""
    lines = functional_text(axioms.select(F.col(column).alias("axiom_key")).distinct())
    lines.repartitionByRange("axiom_key").sortWithinPartitions("axiom_key").select("text").write.text(path)
