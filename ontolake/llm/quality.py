"""Quality classifier: random Fourier features of document statistics, ridge regression by normal equations, isotonic
calibration.

Statistics of whole texts (lengths, repetition, character classes, compressibility) are standardised by the labelled
rows. Random cosine features approximate a Gaussian kernel over them. Each partition sums its part of the normal
equations, and the parts are added by row of the matrix, in two steps so that no task adds up all of them; the driver solves
systems of fixed size. Rows are dealt into FOLDS by a hash of their statistics; a row's raw score for the calibration comes
from weights that were fitted without its fold, so that it is not that of rows known by heart. These scores, counted in BINS
bins, give rising levels by pooling adjacent violators; between the pools' middles levels are interpolated.

All labelled rows are used. Only the text enters a score.

Defined results for odd input: a null or empty text has all-zero statistics and is scored like any other; a document
without a label is only scored; several labels of one id count by their mean; null labels are left out; a row with a null
id is scored and counts as not held out; repeated rows are scanned each by itself; without any labelled row every score
is 0.5; other columns are carried by `keep_good` and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, staged

STATS = (
    "log_chars", "log_words", "word_len", "word_len_sd", "distinct_words", "top_word", "same_as_before", "distinct_lines", "line_words", "symbols",
    "digits", "upper", "pipes", "marks_a_word", "stops_a_word", "letters", "entropy", "squeezed", "distinct_pairs", "symbol_ended",
)
FEATURES, WIDTH, RIDGE, BINS, FOLDS, SEED = 256, 4.0, 1e-3, 2048, 4, 7

_SYMBOLS = b"#$%&*+<=>@^_`|~\\{}[]/!"
_CLASS = bytearray(256)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.isascii() and _c.isdigit() else 2 if "A" <= _c <= "Z" else 3 if "a" <= _c <= "z" or _i >= 128 else 4 if _i in _SYMBOLS else 5 if _c.isspace() else 6


def statistics(text: str) -> list[float]:
    """The numbers of one whole text, in the order of STATS."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(np.frombuffer(bytes(_CLASS), np.uint8), weights=byte, minlength=7)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = text.split("\n")
    p = byte[byte > 0] / n
    # Compressed by chunks of fixed size, so that a text of any length takes bounded memory.
    squeezed = sum(len(zlib.compress(raw[i : i + 32768], 1)) for i in range(0, n, 32768))
    ended = sum(w[-1] in "#$%&*|!~" for w in words)
    return [
        math.log1p(n), math.log1p(len(words)), float(lens.mean()), float(lens.std()), len(counts) / m, (max(counts.values()) if counts else 0) / m, same / m,
        len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), kind[4] / n, kind[1] / n, kind[2] / n, byte[124] / n, (byte[44] + byte[59] + byte[58]) / m,
        (byte[46] + byte[33] + byte[63]) / m, (kind[2] + kind[3]) / n, float(-(p * np.log2(p)).sum()), squeezed / n, pairs / m, ended / m,
    ]


def with_statistics(df: DataFrame, text_col: str = "text", name: str = "_stats") -> DataFrame:
    """df without the text, and its statistics as array<double>. A map over rows."""
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = df.select(*(F.col(f"`{c}`") for c in rest)).schema.add(name, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


class Model:
    """Standardisation, random features, weights and calibration; of fixed size, whatever the data."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(x @ self.directions + self.phases) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def _matrix(batch: pa.RecordBatch, name: str = "_stats") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def isotonic(raw: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by raw score: one knot in the middle of each pool's bins, and its level.
    A pool's level leans on one row of each label, so that none is certain."""
    pools: list[list[float]] = []  # weight, sum of good, sum of raw x weight
    for r, g, w in zip(raw, good, n):
        pools.append([w, g, r * w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, g2, r2 = pools.pop()
            pools[-1] = [pools[-1][0] + w2, pools[-1][1] + g2, pools[-1][2] + r2]
    share = sum(p[1] for p in pools) / sum(p[0] for p in pools)
    return np.array([p[2] / p[0] for p in pools]), np.array([(p[1] + share) / (p[0] + 1) for p in pools])


def fit(labelled: DataFrame) -> Model:
    """labelled: _stats and _good (0 to 1), read three times; best a stored table."""
    sums = [f for i in range(len(STATS)) for f in (F.avg(F.col("_stats")[i]).alias(f"m{i}"), F.stddev_pop(F.col("_stats")[i]).alias(f"s{i}"))]
    row = labelled.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if not row["n"]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    scale = np.array([row[f"s{i}"] for i in range(len(STATS))])
    model = Model(np.array([row[f"m{i}"] for i in range(len(STATS))]), np.where(scale > 1e-9, scale, 1.0))
    shape = model
    size = FEATURES + 1

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gram = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            stats = _matrix(batch)
            z, fold = shape.features(stats), folds_of(stats)
            y = batch.column(batch.schema.get_field_index("_good")).to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                gram[f] += z[fold == f].T @ np.hstack([z[fold == f], y[fold == f, None]])
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([place] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([np.ascontiguousarray(gram[:, r]).tobytes() for r in range(size)], pa.binary())], names=["place", "row", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for place, row, part in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(part)
                total[place, row] = total[place, row] + v if (place, row) in total else v
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["place", "row", "part"])

    shape_of = "place int, row int, part binary"
    wide = max(1, math.isqrt(partitions(labelled.sparkSession)))
    half = labelled.mapInArrow(sums_of, shape_of).withColumn("place", F.pmod("place", F.lit(wide)).cast("int")).repartition(8 * wide, "place", "row").mapInArrow(added, shape_of)
    rows = half.withColumn("place", F.lit(0)).repartition(8, "row").mapInArrow(added, shape_of).collect()  # a row for each of the matrix
    gram = np.zeros((FOLDS, size, size + 1))
    for r in rows:
        gram[:, r["row"]] += np.frombuffer(r["part"]).reshape(FOLDS, size + 1)
    model.weights = solved(gram.sum(0))
    without = np.stack([solved(gram.sum(0) - gram[f]) for f in range(FOLDS)])
    fitted = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(out_of_fold(fitted, _matrix(batch), without)), batch.column(batch.schema.get_field_index("_good"))], names=["raw", "good"])

    bins = labelled.mapInArrow(scored, "raw double, good double").groupBy(F.floor((F.col("raw") + 1) / 3 * BINS).alias("bin")).agg(F.avg("raw").alias("raw"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    found = sorted((r["raw"], r["good"], r["n"]) for r in bins.collect())  # BINS rows at most
    model.knots, model.levels = isotonic(*(np.array(x, float) for x in zip(*found)))
    return model


def folds_of(stats: np.ndarray) -> np.ndarray:
    """A fold for each row, by its statistics alone."""
    return np.array([zlib.crc32(row.tobytes()) % FOLDS for row in np.ascontiguousarray(stats)], int)


def solved(gram: np.ndarray) -> np.ndarray:
    """Ridge weights of summed normal equations; the last feature is constant, so that its square counts the rows."""
    size = len(gram)
    n = max(gram[-1, size - 1], 1.0)
    ridge = RIDGE * n / size * np.eye(size)
    ridge[-1, -1] = 1e-9 * n
    return np.linalg.solve(gram[:, :size] + ridge, gram[:, size])


def out_of_fold(model: Model, stats: np.ndarray, without: np.ndarray) -> np.ndarray:
    """Raw scores by the weights that were fitted without a row's fold."""
    return np.clip((model.features(stats) * without[folds_of(stats)]).sum(1), -1, 2)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _labels(labels: DataFrame, by: str) -> DataFrame:
    return labels.where(F.col("quality").isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("_label_id")).agg(F.avg(F.col("quality").cast("double")).alias("_good"))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """stats: id and _stats of documents. Labels of held-out ids are not looked at."""
    known = _labels(labels.where(~held_out(id_col)), id_col)
    return fit(staged(stats.join(known, F.col(id_col) == F.col("_label_id")).select("_stats", "_good"), "quality-labelled"))


def with_scores(stats: DataFrame, model: Model) -> DataFrame:
    """stats with `score` instead of _stats."""
    shape = model
    rest = [c for c in stats.columns if c != "_stats"]
    schema = stats.select(*(F.col(f"`{c}`") for c in rest)).schema.add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(np.clip(shape.score(_matrix(batch)), 0, 1))], names=[*rest, "score"])

    return stats.mapInArrow(run, schema)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose score is at least `least`, with all its columns. The scores are computed where the texts are
    read, so that filtering needs no join; the classifier is fitted first, on the labelled documents alone."""
    known = _labels(labels.where(~held_out(id_col)), id_col)
    own = df.select(F.col(id_col), F.col(text_col).alias("text")).join(known, F.col(id_col) == F.col("_label_id")).select("_good", "text")
    model = fit(staged(with_statistics(own), "quality-labelled"))
    shape, schema, place = model, df.schema, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = np.array([statistics(t.as_py() or "") for t in batch.column(place)])
                yield batch.filter(pa.array(shape.score(stats) >= least))

    return df.mapInArrow(run, schema)


def op8_quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    stats = staged(with_statistics(documents.select("doc_id", "text")), "quality-statistics")
    scored = with_scores(stats, train(stats, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
