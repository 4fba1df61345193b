"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects the same number of copies, its source's target over its source's size. In the order
of sizes, the prefix sum of expected copies, plus one random offset a source, crosses some integers; a document is
emitted once for each integer crossed inside its own step. With sizes in order, the words taken stay within the size of
one document of the target.

A prefix sum over a source that holds a third of all rows would be one task's work as a window. As all steps of a source
are equal, the prefix sum is a rank times the step, and the rank is put together from counts: of smaller sizes in the
source, of earlier cells (hash buckets) of the same size, and of rows before it in its cell. Only counts meet in one
place; the windows over rows are of cells. A row for each source goes through one task: sources are collections, not hosts.

Defined results for odd input: a null text has size 0; a null source is a source of its own, last in order; a source
of size 0 has target 0 and takes nothing; equal rows are ranked one after another, which of them gets a copy does not
show; an empty table gives no rows; other columns are carried by `mix` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2.0, 20240501
CELLS = 256
_KEYS = ["_sk", "_sn", "_size", "_cell"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: _sk, _sn (is the source null), n, source_size. Adds target, and the expected copies of a document.

    Targets are min(most x size, level x weight) for the level at which they sum to share x all sizes. With sources in
    order of most x size / weight, the level is the largest of what is left, after capping all sources before, over the
    weights that are left; so no loop is needed. A row for each source goes through the windows."""
    order = F.row_number().over(Window.orderBy("_sn", "_sk")) - 1
    one = sizes.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (order % len(weights) + 1).cast("int")))
    one = one.withColumn("_cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_sn", "_sk")
    capped = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(1))
    level = F.max(F.col("_level")).over(every)
    one = one.withColumn("_level", (F.sum("source_size").over(every) * F.lit(share) - capped) / left).withColumn("_level", level)
    one = one.withColumn("target", F.least("_cap", F.col("_level") * F.col("_w")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = (F.pmod(F.xxhash64("_sk", "_sn", F.lit(SEED)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    return one.select("_sk", "_sn", "source_size", "target", F.least(step, F.lit(most)).alias("_step"), offset.alias("_offset"))


def _keys(id_col: Column, source: Column, size: Column) -> dict[str, Column]:
    source = source.cast("string")
    return {"_sk": F.coalesce(source, F.lit("")), "_sn": source.isNull(), "_size": size, "_cell": F.pmod(F.xxhash64(id_col), F.lit(CELLS))}


def _copies(keyed: DataFrame, counted: DataFrame, tie: list[Column], **targets) -> DataFrame:
    """keyed: rows with the keys; counted: the same rows, perhaps with fewer columns. Rows of keyed with source_size,
    target and _copies."""
    cells = counted.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    steps = cells.groupBy("_sk", "_sn", "_size").agg(F.sum("_n").alias("_n"))
    sources = source_targets(steps.groupBy("_sk", "_sn").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size")), **targets)
    before = lambda *by: F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("_n")
    steps = steps.select("_sk", "_sn", "_size", before("_sk", "_sn", "_size").alias("_less")).join(sources, ["_sk", "_sn"])
    cells = cells.withColumn("_in", before(*_KEYS)).drop("_n").join(steps, ["_sk", "_sn", "_size"])
    own = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(*tie)) - 1
    ranked = keyed.withColumn("_own", own).join(cells, _KEYS).withColumn("_rank", F.col("_less") + F.col("_in") + F.col("_own"))
    crossed = F.floor(F.col("_offset") + (F.col("_rank") + 1) * F.col("_step")) - F.floor(F.col("_offset") + F.col("_rank") * F.col("_step"))
    return ranked.withColumn("_copies", F.least(crossed, F.ceil("_step")).cast("int")).drop("_own", "_in", "_less", "_rank", "_step", "_offset", "_sk", "_sn", "_cell")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The mixture itself: every row of df as often as it is taken, with the columns of df, whatever their names: a row travels
    as one column. The rows pass one exchange, by keys that no hot source can fill."""
    keys = [c.alias(k) for k, c in _keys(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), n_words(F.col(f"`{text_col}`"))).items()]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    copies = _copies(df.select(row, *keys), df.select(*keys), [F.col("_row")[id_col], F.xxhash64(F.col("_row")[text_col])], **targets)
    return copies.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")


def op5_source_mix(documents: DataFrame) -> DataFrame:
    """What the mix takes of each document. The texts are read once; their sizes go through a table in the shared folder."""
    slim = staged(documents.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "mix-sizes")
    keyed = slim.withColumns(_keys(F.col("doc_id"), F.col("source"), F.col("size")))
    mixed = _copies(keyed, keyed.select(*_KEYS), [F.col("doc_id")])
    return mixed.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("_copies") * F.col("size")).cast("long").alias("taken"))
