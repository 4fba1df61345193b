"""Byte-pair encoding over a contiguous rank array, and decoding, for vocabulary files of the tokenizers library.

A word is held as two short arrays: its parts, and the rank of every pair of neighbours. The least rank is looked for
again and again; its right part is deleted, and the ranks left and right of the merged part are read anew. Words of more
than LONG parts use a heap with links instead, which gives the same merges without a quadratic scan.

Words repeat, so each Python worker keeps what a word became, up to a fixed number of words.

Defined results for odd input: a null text counts as empty and gives no ids; a row without an id keeps its null id;
repeated rows are encoded each by itself; whole texts are encoded, of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest word, in parts, that the rank array serves.
LONG = 256
#: Words that a worker remembers at most, and the longest that it remembers.
KEPT_WORDS, KEPT_CHARS = 300_000, 64

#: White space as Unicode has it; Python's own class also holds four control characters.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split pattern of the vocabulary file.
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible, else the next code point from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class WordBPE:
    """Encodes and decodes as the file's tokenizer: composed, lower-cased words, each with an end mark."""

    def __init__(self, spec: str) -> None:
        import regex

        j = json.loads(spec)
        model = j["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        ids = self.ids
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.added = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for t, i in [*ids.items(), *self.added.items()]:
            self.tokens[i] = t
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(_WORDS).findall
        self.symbols = byte_symbols()
        self.none = len(self.pairs)
        outer = self

        class Kept(dict):
            def __missing__(self, word: str) -> bytes:
                out = np.asarray(outer.word(word), "<u4").tobytes()
                if len(word) <= KEPT_CHARS:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = out
                return out

        self.kept = Kept()

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        ids, symbols = self.ids, [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        parts = [ids[s] for s in symbols if s in ids]
        return self.merge_short(parts) if len(parts) <= LONG else self.merge_long(parts)

    def merge_short(self, parts: list[int]) -> list[int]:
        pairs, none = self.pairs.get, (self.none, 0)
        found = [pairs(p, none) for p in zip(parts, parts[1:])]
        ranks = [f[0] for f in found]
        while ranks:
            least = min(ranks)
            if least == self.none:
                break
            i = ranks.index(least)
            parts[i] = pairs((parts[i], parts[i + 1]))[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = pairs((parts[i - 1], parts[i]), none)[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        left, right, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], right[i] = pairs[a, b][1], True, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (p := (parts[x], parts[y])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], x, *p))
        return [p for p, g in zip(parts, gone) if not g]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without the rule for word ends
        return b"".join(map(self.kept.__getitem__, self.words(text.lower())))

    def encode(self, text: str) -> np.ndarray:
        if self.split_added and "<" in text:
            out = b"".join(np.uint32(self.added[x]).tobytes() if x in self.added else self._plain(x) for x in self.split_added.split(text))
        else:
            out = self._plain(text)
        return np.frombuffer(out, "<u4")

    def decode(self, ids) -> str:
        """The file names no decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def vocabulary(path: str) -> str:
    """The file's text, read on the driver; of fixed size, so that it can travel with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: id, `ids` and `decoded` (with keep), `n_tokens`, and the hashes of ids and decoded text. A map over rows."""
    spark: SparkSession = df.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(vocab_path or default_path()))
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(spec.value)
        for batch in batches:
            out: dict[str, list] = {"n": [], "h": [], "d": [], "ids": [], "decoded": []}
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                decoded = bpe.decode(ids)
                out["n"].append(len(ids))
                out["h"].append(hashlib.sha256(ids).hexdigest())
                out["d"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if keep:
                    out["ids"].append(ids.astype("<i4"))
                    out["decoded"].append(decoded)
            more = [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["h"], pa.string()), pa.array(out["d"], pa.string()), *more], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep else ())])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if keep else ""))


def op6_bpe_round_trip(documents: DataFrame) -> DataFrame:
    return encode_decode(documents, keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
