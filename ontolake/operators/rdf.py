"""RDF operators over quads and lists as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousRdfDatasetError, GraphSelectionError, ResourceLimitError
from ..staging import stored

#: A statement of N-Triples or N-Quads on a line: subject, predicate, object, graph.
_TERM = r"<[^<>\x22{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|[^<>\x22{}|^`\\\x00-\x20])*>"
_BLANK = r"_:[A-Za-z0-9_·-�][A-Za-z0-9_.·-�-]*"
_LITERAL = rf"\x22(?:[^\x22\\\n\r]|\\[tbnrf\x22'\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*\x22(?:@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*|\^\^{_TERM})?"
STATEMENT = rf"^[ \t]*({_TERM}|{_BLANK})[ \t]*({_TERM})[ \t]*({_TERM}|{_BLANK}|{_LITERAL})[ \t]*({_TERM}|{_BLANK})?[ \t]*\.[ \t]*(?:#.*)?$"


def scan_lines(spark, path: str, quads: bool = True) -> DataFrame:
    """N-Quads or N-Triples files as quads, by Spark's splittable text reader and one expression a line: doc, line text,
    subject, predicate, object, graph, ok. Lines without a statement are left out; bad ones have ok = false."""
    lines = spark.read.text(path).select(F.input_file_name().alias("doc"), F.col("value").alias("line"))
    lines = lines.where(~F.col("line").rlike(r"^[ \t]*(#.*)?$"))
    part = lambda i: F.regexp_extract("line", STATEMENT, i)
    out = lines.select("doc", "line", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), part(4).alias("graph"))
    ok = (F.col("subject") != "") & (F.lit(quads) | (F.col("graph") == ""))
    return out.withColumn("ok", ok)


def select_graph(quads: DataFrame, policy: str = "requireSingleGraph", graph: str | None = None) -> DataFrame:
    """Triples by a policy: requireSingleGraph, defaultGraphOnly, selectGraph or merge. graph '' is the default graph."""
    if policy == "merge":
        return quads.select("subject", "predicate", "object").distinct()
    if policy == "defaultGraphOnly":
        return quads.where("graph = ''").select("subject", "predicate", "object").distinct()
    if policy == "selectGraph":
        if graph is None or quads.where(F.col("graph") == graph).isEmpty():
            raise GraphSelectionError(f"no graph {graph}")
        return quads.where(F.col("graph") == graph).select("subject", "predicate", "object").distinct()
    if policy != "requireSingleGraph":
        raise ValueError(policy)
    if len(quads.select("graph").distinct().limit(2).collect()) > 1:
        raise AmbiguousRdfDatasetError("more than one graph")
    return quads.select("subject", "predicate", "object").distinct()


def list_members(cells: DataFrame, heads: DataFrame, rounds: int = 40) -> DataFrame:
    """head, place, item of RDF lists. cells: cell, first, rest (null at the end); heads: cell. By pointer doubling: each
    cell learns how far it is from its list's end. A cycle never ends, and raises."""
    far = stored(cells.select("cell", F.col("rest").alias("to"), F.when(F.col("rest").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("cell").alias("last")), "lists")
    far = stored(far.withColumn("last", F.coalesce("to", "cell")), "lists")
    for _ in range(rounds):
        if far.where("to IS NOT NULL").isEmpty():
            break
        ahead = far.select(F.col("cell").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"), F.col("last").alias("last2"))
        far = stored(far.join(ahead, "to", "left").select("cell", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("last2", "last").alias("last")), "lists")
    else:
        raise ResourceLimitError("a list with a cycle, or of more than 2^40 cells")
    start = far.join(heads, "cell", "left_semi").select(F.col("cell").alias("head"), F.col("steps").alias("whole"), "last")
    items = far.join(cells.select("cell", "first"), "cell")
    return items.join(start, "last").where("steps <= whole").select("head", (F.col("whole") - F.col("steps")).alias("place"), F.col("first").alias("item"))


def unconsumed(quads: DataFrame, consumed: DataFrame) -> DataFrame:
    """Statements that no rule of a mapping took."""
    return quads.join(consumed, ["subject", "predicate", "object"], "left_anti")
