"""License scans by ordered signature rules.

Several hundred expressions stand in license_rules. An Aho-Corasick pass over the lower-case words, whatever parts them, finds which
keywords occur; only the rules whose keyword occurs are run. Detections are then resolved in order of priority, then length, then
place: one that lies inside a kept detection is suppressed.

Besides, a small set of base phrases is counted over words, a contract of its own: all places count, and their labels
are never suppressed.

Defined results for odd input: a null text counts as empty: no words, no places (null first and last word), score 0;
a row without an id keeps its null id; repeated rows are scanned each by itself; other columns are ignored; whole texts
of any length are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points
from .license_rules import Rule, build

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORD = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_PHRASES = tuple((b" " + p.encode() + b" ", label) for p, label in BASE.items())


def _line(low: bytes) -> bytes:
    """The words of lower-case text, a blank around each."""
    return b" " + b" ".join(low.translate(_WORD).split()) + b" "


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] | None = None) -> None:
        import ahocorasick

        self.rules = build() if rules is None else rules
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):  # keywords are looked for in the words alone, however these are parted
            self.by_word.setdefault(_line(r.keyword.encode()).decode().strip(), []).append(i)

        self.automaton = ahocorasick.Automaton()
        for word in self.by_word:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def base(self, low: bytes) -> tuple[int, list[int], set[str]]:
        """Number of words; where each base phrase starts, in words; labels."""
        line = _line(low)
        starts, labels = [], set()
        if b"license" in low or b"cc" in low:
            for phrase, label in _PHRASES:
                at, seen, before = line.find(phrase), 0, 0
                while at >= 0:
                    before += line.count(b" ", seen, at)  # words before the place, counted on from the one before it
                    seen = at
                    starts.append(before)
                    labels.add(label)
                    at = line.find(phrase, at + 1)
        return line.count(b" ") - 1 if len(line) > 2 else 0, sorted(starts), labels

    def detections(self, low: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) that remain, in bytes, by place."""
        words = {w for _, w in self.automaton.iter(_line(low).decode("latin-1"))}
        found = []
        for i in sorted(i for w in words for i in self.by_word[w]):
            r = self.rules[i]
            found += [(-r.priority, m.start() - m.end(), m.start(), m.end(), i) for m in r.pattern.finditer(low) if m.end() > m.start()]
        return resolve(found, self.rules)


def resolve(found: list[tuple[int, int, int, int, int]], rules) -> list[tuple[int, int, Rule]]:
    """Containment suppression over (-priority, -length, start, end, rule number): an interval is inside a kept one if the
    farthest end of the kept ones that start at its own start or before reaches its end. These ends stand in a binary tree
    of maxima over the ranks of all starts."""
    found.sort()
    rank = {a: i + 1 for i, a in enumerate(sorted({f[2] for f in found}))}
    ends = [-1] * (len(rank) + 1)
    kept = []
    for _, _, a, b, i in found:
        at, far = rank[a], -1
        while at:
            far = max(far, ends[at])
            at &= at - 1
        if far >= b:
            continue
        kept.append((a, b, rules[i]))
        at = rank[a]
        while at < len(ends):
            ends[at] = max(ends[at], b)
            at += at & -at
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, base places (`places`, sorted) and labels, and `found`: structs of label, rule, start, end
    (code points) and confidence. A map over rows."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for batch in batches:
            counts, places, labels, found = [], [], [], []
            for text in batch.column(1):
                low = text.as_py().encode("utf-8", "surrogatepass").lower()
                n, at, names = scan.base(low)
                hits = scan.detections(low)
                place = code_points(low, (x for a, b, _ in hits for x in (a, b)))
                counts.append(n)
                places.append(at)
                labels.append(sorted(names))
                found.append([{"label": r.label, "rule": r.name, "start": place[a], "end": place[b], "confidence": r.confidence} for a, b, r in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())), pa.array(found, found_type)],
                names=[id_col, "n_words", "places", "base_labels", "found"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, places array<long>, base_labels array<string>, found array<struct<label:string,rule:string,start:int,end:int,confidence:double>>")


def op3_license_scan(documents: DataFrame) -> DataFrame:
    """score: the strongest confidence among the detections, a base phrase counting as a bare name."""
    labels = F.array_sort(F.array_union("base_labels", F.transform("found", lambda x: x["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.7).otherwise(0.0))
    return scan_licenses(documents).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.cast("double").alias("score"),
    )
