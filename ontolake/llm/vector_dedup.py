"""Near-duplicate vectors of one label: small-world graphs per shard, every shard asked, links verified, components
united.

Equal vectors of a label are one class, which counts with its size. Classes are dealt into shards of about SHARD by a
hash; each shard's graph is built once and stored, one row a shard. All shards of a label then ask each other, in tiles:
shards are dealt into about sqrt(n) sets of TILE at most, and a task holds two sets and compares their pairs of shards. So
each shard's row goes to as many tiles as there are sets, and a label of any size is many tasks of bounded size. Within a
pair, links are kept as a Boolean matrix and leave it as sums per vector and as edges between the components that each shard
has by itself; so a crowd of near copies never becomes a list of pairs.

Every link found is verified in double precision on the original vectors. Beams widen until an audit passes, which compares
nodes of both sides with all of the other, nodes that have links and nodes near the threshold among them; the widest looks at
every node of the shard. `link_vectors_audited` gives the audits too.

Defined results for odd input: vectors that are null, zero, or hold null or non-finite components, those without a label or
without an id link with nothing and are components of their own; vectors link within their dimension only; rows that repeat
an id are vectors of their own, and linked where equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components
from .hnsw import Graph, levels_of, links
from .vectors import cosines, matrix, products, takes_part, usable

LEAST, SHARD, SALTS, TILE = 0.98, 2048, 8, 16
#: What single precision may take from a cosine.
SLACK = 1e-5
_AUDIT = ("beam", "true", "hit", "asked", "met", "every")


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def verified(found: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, chunk: int = 50_000) -> np.ndarray:
    """found, without pairs whose cosine in double precision is less than `least`."""
    aa = products(a, a)
    bb = aa if b is a else products(b, b)
    for i in range(0, len(a), 256):
        r, c = np.nonzero(found[i : i + 256])
        for j in range(0, len(r), chunk):  # vectors are copied for some pairs at a time
            x, y = r[j : j + chunk] + i, c[j : j + chunk]
            bad = cosines(a[x], b[y], aa[x], bb[y]) < least
            found[x[bad], y[bad]] = False
    return found


def local_components(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable of each row of a symmetric Boolean matrix."""
    left, out = np.ones(len(ids), bool), ids.copy()
    for i in np.argsort(ids, kind="stable"):
        if left[i]:
            left[i] = False
            edge = np.array([i])
            while len(edge):
                near = found[edge].any(0) & left
                edge = np.flatnonzero(near)
                left[edge] = False
                out[edge] = ids[i]
    return out


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table["rep"].to_numpy().astype("<i8")
    order = np.argsort(ids, kind="stable")
    x = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)[order]
    ids, weight = ids[order], table["n"].to_numpy().astype("<i8")[order]
    graph = Graph(_unit(x), levels_of(ids))
    found, audit = links(graph, None, LEAST - SLACK)
    found = verified(found, x, x, LEAST)
    out = {"d": key[1], "shard": key[2], "count": len(ids), "ids": ids.tobytes(), "weights": weight.tobytes(), "vecs": x.tobytes(), "graph": graph.pack(), "comps": local_components(found, ids).astype("<i8").tobytes(), "links": (found @ weight + weight - 1).astype("<i8").tobytes(), "audit": np.array([audit[x] for x in _AUDIT], "<i8").tobytes()}
    return pa.table({"label": pa.array([key[0].as_py()], key[0].type), **{k: [v] if not isinstance(v, pa.Scalar) else [v.as_py()] for k, v in out.items()}}).cast(pa.schema([("label", key[0].type), ("d", pa.int32()), ("shard", pa.int32()), ("count", pa.int32()), *((c, pa.binary()) for c in ("ids", "weights", "vecs", "graph", "comps", "links", "audit"))]))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[r].as_py(), "<i8")) for c in range(3)], names=["rep", "comp", "links"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(x.as_py(), "<i8") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(len(_AUDIT)))], names=["nodes", *_AUDIT])


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("audit", pa.binary())])


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Two sets of shards: (rep, null, links) for sums, (component, component, null) for edges, and an audit of each pair."""
    one, two, sets = key[2].as_py(), key[3].as_py(), table["sets"][0].as_py()
    sides = []
    for r in range(table.num_rows):
        row = {c: table[c][r].as_py() for c in ("shard", "ids", "weights", "vecs", "graph", "comps")}
        ids, weight, comps = (np.frombuffer(row[c], "<i8") for c in ("ids", "weights", "comps"))
        x = matrix(row["vecs"], len(row["vecs"]) // 8 // len(ids))
        sides.append((row["shard"], ids, weight, comps, x, Graph.unpack(row["graph"], _unit(x))))
    sums: dict[int, int] = {}
    edges: set[tuple[int, int]] = set()
    audits = []
    for shard_a, ids_a, weight_a, comps_a, x_a, g_a in sides:
        for shard_b, ids_b, weight_b, comps_b, x_b, g_b in sides:
            if shard_a % sets != one or shard_b % sets != two or one == two and shard_a >= shard_b:
                continue
            found, audit = links(g_a, g_b, LEAST - SLACK)
            found = verified(found, x_a, x_b, LEAST)
            audits.append(np.array([audit[c] for c in _AUDIT], "<i8").tobytes())
            for ids, n in ((ids_a, found @ weight_b), (ids_b, weight_a @ found)):
                for i in np.flatnonzero(n):
                    sums[int(ids[i])] = sums.get(int(ids[i]), 0) + int(n[i])
            for i in np.flatnonzero(found.any(1)):
                edges.update((int(comps_a[i]), int(c)) for c in np.unique(comps_b[found[i]]))
    rows = [(k, None, n, None) for k, n in sums.items()] + [(*e, None, None) for e in edges] + [(None, None, None, x) for x in audits]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _MET)], schema=_MET) if rows else _MET.empty_table()


def link_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    return link_vectors_audited(embeddings, id_col, vector_col, label_col)[0]


def link_vectors_audited(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """link_vectors, and its audits: a row for each shard and pair of shards with the beam that it ended with, the pairs that
    the audit knows (true), those of them that were found (hit), the nodes audited (asked), those of them that found their nearest
    neighbour (met), and whether every node was looked at (every)."""
    rows = usable(embeddings, id_col, vector_col, F.col(label_col).alias("label"))
    digest = F.md5(F.col("vec").cast("string"))
    classes = rows.where(F.col("label").isNotNull()).withColumn("key", digest).groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"), F.first("d").alias("d"))
    classes = staged(classes, "vector-classes")
    counts = classes.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = classes.join(counts, ["label", "d"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    label_type = classes.schema["label"].dataType.simpleString()
    dealt = dealt.select("label", "d", "shard", "rep", "n", "vec").repartition("label", "d", "shard")  # not by label, as the join leaves them
    shards = staged(dealt.groupBy("label", "d", "shard").applyInArrow(_build, f"label {label_type}, d int, shard int, count int, ids binary, weights binary, vecs binary, graph binary, comps binary, links binary, audit binary"), "vector-shards")
    own = shards.select("ids", "comps", "links").mapInArrow(_nodes, "rep long, comp long, links long")
    # Tiles: every two sets of shards of a label, and each set with itself.
    sets = counts.where("shards > 1").select("label", "d", F.ceil(F.col("shards") / F.least(F.lit(TILE), F.ceil(F.sqrt("shards")))).cast("int").alias("sets"))
    rows = shards.select("label", "d", "shard", "ids", "weights", "vecs", "graph", "comps").join(sets, ["label", "d"])
    mine = F.pmod(F.col("shard"), F.col("sets"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).withColumn("one", F.least(mine, F.col("other"))).withColumn("two", F.greatest(mine, F.col("other")))
    rows = rows.drop("other").repartition("label", "d", "one", "two")
    met = rows.select("label", "d", "one", "two", "sets", "shard", "ids", "weights", "vecs", "graph", "comps").groupBy("label", "d", "one", "two").applyInArrow(_tile, "a long, b long, links long, audit binary")
    found = staged(met, "vector-pairs")
    audits = shards.select("count", "audit").union(found.where("audit is not null").select(F.lit(None).cast("int"), "audit")).mapInArrow(_audits, "nodes int, " + ", ".join(f"{c} long" for c in _AUDIT))
    found = found.where("audit is null")
    parts = connected_components(found.where("links is null").select("a", "b"))
    sums = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    nodes = own.join(sums, "rep", "left").join(parts, F.col("comp") == F.col("node"), "left")
    nodes = nodes.select("rep", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "comp").alias("component_id"))
    known = classes.select("label", "key", "rep").join(nodes, "rep").select(F.col("label").alias("_label"), F.col("key").alias("_key"), "n_links", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    vector = F.col(vector_col)
    in_class = takes_part(vector) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    every = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(in_class, F.md5(vector.cast("array<double>").cast("string"))).alias("key"))
    every = every.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    out = every.join(known, (F.col("label") == F.col("_label")) & (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), audits


def op10_vector_dedup(embeddings: DataFrame) -> DataFrame:
    return link_vectors(embeddings)
