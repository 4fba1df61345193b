"""Token ids as ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of their id, sorted inside each range, encoded and written in that order, so that a range
is one file of about FILE_BYTES of the table, its stripes are read in parallel, and a lookup by id skips stripes by their
statistics and Bloom filters. Each row also holds where its ids start inside its range, and how many they are, so that
no ids are read to add them up; the sums of the ranges before it (a table of a row for each file, FILES_AT_MOST rows at
most, which is why it may be broadcast) turn that into the place among all ids.

The tokenizers library encodes. Words repeat, so a text is handed to it in pieces, and what a short piece became is
remembered, up to a fixed number of pieces. Texts are cut only before a single blank or around a single line break between
two characters that are no white space, and between letters and the marks at a piece's end: there the splitter of byte-level vocabularies ends
a word whatever stands around it, so the pieces' ids are the text's. A piece that is one word by itself goes to the
library's model, any other through its whole pipeline. Vocabularies with another splitter, or with added tokens that hold
white space, get whole texts.

Defined results for odd input: a null text counts as empty and still gets the end id; rows with a null id come first, as
Spark sorts them; rows with the same id are ordered by a hash of their text and then by the text, so that many rows of
one id (or none) spread over ranges; repeated rows stand after one another; an empty table gives no rows; other columns
are ignored; texts of any length are encoded whole, long runs of blanks included.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, vocabulary
from .common import partitions, per_worker, shared_path

ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "orc.create.index": "true"}
#: Bytes of the table to a file, until there are FILES_AT_MOST; then files grow.
FILE_BYTES, FILES_AT_MOST = 256 << 20, 1_000_000
#: Pieces that a worker remembers between texts, about, and the longest that it remembers.
KEPT_PIECES, KEPT_CHARS = 1_000_000, 64
#: White space but the blank and the line break, and the mark that `pieces` uses.
_SELDOM = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "\0"
_MARKS = string.punctuation
#: A blank or none, then letters of blocks that no version of Unicode changed.
_WORD = r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """The text cut before every single blank, and around every single line break, between two characters that are no white
    space."""
    if not any(c in text for c in _SELDOM):
        out = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if "" not in out and " " not in out:  # no two white spaces in a row, none at an end
            return out
    out, first, end = [], 0, -1
    for w in text.split(" "):
        start, end = end, end + 1 + len(w)  # the blank before w, and the one after it
        if start > first and w and not text[start - 1].isspace() and not w[0].isspace():
            out.append(text[first:start])
            first = start
    out.append(text[first:])
    return out


class Encoder(dict):
    """Texts -> ids as little-endian 32-bit integers, by the tokenizers library, without special tokens added. As a dict: what
    pieces became."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.engine = Tokenizer.from_str(spec)
        self.engine.no_truncation()
        self.engine.no_padding()
        j = json.loads(spec)
        split = j["pre_tokenizer"] or {}
        added = [x["content"] for x in j["added_tokens"]]
        self.cuts = j["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not any(c.isspace() for x in added for c in x)
        # Letters alone are one word of the splitter, and the marks after them another; not so if an added token is found there.
        self.words = self.cuts and all(any(c.isalpha() for c in x) and any(c in _MARKS for c in x) for x in added)
        self.symbols = dict(enumerate(byte_symbols()))
        self.tokenize, self.is_word = self.engine.model.tokenize, re.compile(_WORD).fullmatch
        self.packs = [struct.Struct(f"<{n}i").pack for n in range(24)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}i", *e.ids) for e in self.engine.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, piece: str) -> bytes:
        if not self.words:
            out = self._ids([piece])[0]
        elif self.is_word(piece):
            # The stand-ins of a blank and of plain letters are fixed; other letters go by their bytes.
            symbols = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            tokens = self.tokenize(symbols)
            n = len(tokens)
            out = self.packs[n](*[t.id for t in tokens]) if n < len(self.packs) else struct.pack(f"<{n}i", *[t.id for t in tokens])
        elif (word := piece.rstrip(_MARKS)) and len(word) < len(piece) and self.is_word(word):
            out = self.get(word)
            if out is None:  # seen once: the word is worth keeping, not yet the word with its marks
                return self[word] + self[piece[len(word) :]]
            out += self[piece[len(word) :]]
        else:
            out = self._ids([piece])[0]
        if len(piece) <= KEPT_CHARS:
            self[piece] = out
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._ids(texts)
        out = [b"".join(map(self.__getitem__, pieces(t))) for t in texts]
        if len(self) > KEPT_PIECES:
            self.clear()
        return out


def n_files(rows: DataFrame) -> int:
    """Ranges for rows (doc_id, text): by the table's bytes as the planner knows them, or else by bytes of text; no fewer than
    the session's shuffle partitions."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # unknown
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, min(FILES_AT_MOST, max(partitions(rows.sparkSession), -(-size // FILE_BYTES))))


def write_token_files(df: DataFrame, path: str, end_id: int = 2, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Writes (doc_id, part, local_start, n_tokens, ids) in ascending id order as ORC. files: ranges to deal the ids into."""
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(vocab_path or default_path()))
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    files = files or n_files(rows)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        encode = per_worker("token-files", spec.value, Encoder)
        part, at, end = TaskContext.get().partitionId(), 0, np.int32(end_id).tobytes()
        for batch in batches:
            n, done = batch.num_rows, 0
            while done < n:  # some rows at a time: ids take several times the room of texts
                texts, size, first = [], 0, done
                while done < n and size < 2_000_000:
                    texts.append(batch.column(1)[done].as_py())
                    size += len(texts[-1])
                    done += 1
                ids = [x + end for x in encode(texts)]
                sizes = np.array([len(x) // 4 for x in ids], "<i8")
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                starts, at = at + offsets[:-1], at + int(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, done - first), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype("<i4")), pa.array(np.frombuffer(b"".join(ids), "<i4")))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, part int, local_start long, n_tokens long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, and start: the number of ids of all documents before it."""
    rows = spark.read.orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))  # a row for each file
    before = ends.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_files(documents: DataFrame) -> DataFrame:
    """Writes the whole table and reads it back."""
    spark, path = documents.sparkSession, shared_path(documents.sparkSession, "token-files")
    write_token_files(documents, path)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return read_token_files(spark, path).mapInArrow(_checks, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
