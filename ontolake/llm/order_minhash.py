"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text becomes its words in lower case, punctuation aside, and its runs of K words, each labelled with how often it
occurred before. A sketch takes the TAKEN runs with the smallest values of one hash and keeps them in text order; it thus
depends on what the text holds and in which order, as edit distance does. Texts that share one of SKETCHES sketches are
candidates, and a banded bit-parallel alignment of their words decides: they link if at most a ninth of the longer's words
is edited, or at most a fifth and their runs have a Jaccard similarity of LEAST or more.

Texts with the same words are one class. Inside a bucket (the classes that share a sketch) two steps look for links: all
are compared with the bucket's first; then, components found so far given, only pairs of different components are. A crowd
of near copies thus costs a comparison for each member and not for each pair, and no link that would join two components
is left out.

A bucket of more than CROWD classes that still holds several components is a crowd around a common passage. Its members are
looked up twice, once for each half of the rule: by labelled runs of K words, of which LEAST must be common, and by labelled
words, of which CLOSE must be. Under any order of a text's runs, two that link share `shared_least` of those that come before
the last `least_common` less as many. The order is the bucket's own, rare runs first; what the passage holds comes last. The
order decides how many meet, never which links exist. Members of different components that share enough, in their prefixes
first and then in all, are compared there.

A bucket of SHARD words at most is one task. Of a larger one, about REFERENCES members drawn by hash tell which runs are held
by several, and its members are dealt by run into shards of about SHARD runs, a row for each shard that a member has runs in:
a task is of bounded size whatever the size of the bucket. Links share enough in one shard at least. Holders of a run that
more than HOT members hold in their prefixes are compared with their first and dealt, DEALS times, into cells of CELL by hash,
whose members are compared with each other; what then is still apart is compared in pairs of different components, so that
nothing is left out.

Chance that two texts share no sketch, for the share s of common runs (of the runs of both): (1 - s^TAKEN)^SKETCHES, that is
8e-8 at 0.8. Where edits are spread so that a ninth of the words takes out five ninths of the runs, at the rule's edge, it is
0.08 (tests measure it); 0.01 where 8 % of the words are edited. A block that moved by more than a tenth of the text is two
edits of its length, so such texts are no links, however many runs they share.

Defined results for odd input: a null text counts as empty; texts without any word are alike only if they are the same
text; texts of fewer than K words are one run; rows with a null id take part, and never stay if another row of their group
has an id; a group whose ids are all null has a null component; repeated rows are in one group; texts of any length are
read whole; other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spare_driver
from .common import staged as stored
from .components import connected_components

K, TAKEN, SKETCHES, LEAST, CROWD = 5, 2, 16, 0.8, 64
#: For texts of equal length, runs with a similarity of 0.8 mean that at most a ninth of the words is edited.
CLOSE = 8 / 9
#: Members of a cell, and how often members are dealt into cells; their first ties the cells together.
CELL, DEALS = 24, 2
#: Members of a crowd, about, whose runs tell which are common in it; runs to a shard of its prefixes; holders of a run whose
#: pairs are counted in a shard.
REFERENCES, SHARD, HOT = 64, 4_000_000, 4000
#: Share of its limit beyond which the driver's heap is collected after a stored table.
HEAP = 0.45
_WORD = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def staged(df: DataFrame, name: str) -> DataFrame:
    """A stored table, after which the driver's heap is small again: all plans together would bring it to its limit."""
    out = stored(df, name)
    spare_driver(df.sparkSession, HEAP)
    return out


def words_of(text: str) -> np.ndarray:
    """A 32-bit number for each word."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split()
    return np.fromiter(map(zlib.crc32, words), "<u4", len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def labelled_runs(words: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit number for each run of k words and how often it occurred before."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = _mix(h + words[i : i + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if not first.all():
        start = np.flatnonzero(first)
        label = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
        again = np.empty(n, np.uint64)
        again[order] = label
        h = h + again * np.uint64(0xD6E8FEB86659FD93)
    return h


_SEEDS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(runs: np.ndarray, count: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """For each of `count` hashes: one number for the runs with its smallest values, in text order."""
    n, out = len(runs), np.zeros(count, np.uint64)
    if not n:
        return out[:0]
    take = min(taken, n)
    step = max(1, 2_000_000 // n)
    for i in range(0, count, step):
        seeds = _SEEDS[i : min(count, i + step)]
        v = _mix(runs[None, :] ^ seeds[:, None])
        at = np.sort(np.argpartition(v, take - 1, axis=1)[:, :take], axis=1)
        h = seeds.copy()
        for j in range(take):
            h = _mix(h + np.take_along_axis(v, at[:, j : j + 1], 1)[:, 0])
        out[i : i + step] = h
    return out


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is `most` or less, else most + 1. Bit-parallel over a band of `most`
    diagonals on either side, in Python's long integers; equal ends are cut off first."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    n = len(a)
    same = a == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = len(a)
    if n:
        same = a[::-1] == b[::-1][:n]
        tail = n if same.all() else int(np.argmin(same))
        a, b = a[: n - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n:
        return m if m <= most else most + 1
    band = 8
    while True:  # a narrow band first: if the distance fits, it is exact
        band = min(band, most)
        d = _banded(a.tolist(), b.tolist(), band) if m - n <= band else band + 1
        if d <= band:
            return d
        if band >= most:
            return most + 1
        band *= 4


def _banded(a: list[int], b: list[int], band: int) -> int:
    """Distance of a (the shorter) to b within `band` diagonals: bit i of the vectors at column j stands for row
    j - band + i. Vertical differences outside the matrix are set so that they never help."""
    n, m = len(a), len(b)
    width = 2 * band + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    shifted = {w: p << band for w, p in places.items()}  # bit i + band for row i
    get = shifted.get
    # Column 0: D[i][0] = i for rows 1..band; rows of number 0 or less have no difference.
    up = full & ~((1 << band) - 1)  # +1 steps from the row above, for rows 1 and on
    down = 0
    score = band  # D at the lowest row of the band, row band
    limit = 2 * band + m - n
    for j in range(m):
        # The band moves a row down: bit i is now row j + 1 - band + i (rows from 1).
        eq = (get(b[j], 0) >> j) & full
        # Row differences of the column before, moved to this band; a new lowest row counts +1.
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        hp = down | (full & ~(d0 | up))
        hn = d0 & up
        # Along the lowest diagonal: a step costs nothing where d0 is set.
        if not d0 >> (width - 1) & 1:
            score += 1
            if score > limit:  # walking up to row n takes off one a row at most
                return band + 1
        d0 >>= 1
        up = (hn | (full & ~(d0 | hp))) & full
        down = d0 & hp
    # score is D[m + band][m] if the matrix went on below row n; walk up to row n.
    rows_below = m + band - n
    for i in range(rows_below):
        bit = width - 1 - i
        # difference D[row] - D[row - 1] in the last column; after the shift, bit b is row m - band + b + 1
        score -= (up >> (bit - 1) & 1) - (down >> (bit - 1) & 1) if bit else 0
    return score


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST, close: float = CLOSE) -> bool:
    """Are texts of one word or more near-duplicates: at most 1 - close of the longer's words edited; or at most
    1 - least of them, and the labelled runs of K words have a Jaccard similarity of `least` or more."""
    longer = max(len(a), len(b))
    x, y = labelled_runs(a), labelled_runs(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    alike = common >= least * (len(x) + len(y) - common)
    most = int((1 - (least if alike else close)) * longer + 1e-9)
    # An edit takes K runs at most, so too few common runs need no alignment.
    return common >= max(len(x), len(y)) - K * most and edits(a, b, most) <= most


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            out: list[list] = [[], [], [], []]
            for text in part.column(2):
                text = text.as_py()
                words = words_of(text)
                raw = words.tobytes()
                out[0].append(hashlib.md5(raw if len(words) else b"-" + text.encode("utf-8", "surrogatepass")).digest())
                out[1].append(len(words))
                out[2].append(sketches(labelled_runs(words)).view(np.int64))
                out[3].append(raw)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], names=["id", "digest", "node", "n", "sketches", "words"])


def least_common(n: int, k: int) -> int:
    """How many labelled runs of k words (K or 1) a text of n words has at least in common with any text it links to by that
    half of the rule: K by the similarity of runs, 1 by edits, each of which takes one word."""
    return max(1, math.ceil((max(1, n - K + 1) * LEAST if k == K else n * CLOSE) - 1e-6))


def shared_least(n: int, k: int) -> int:
    """How many runs of their prefixes two texts share that link; for each of the two, and the smaller number holds."""
    return max(1, least_common(n, k) // 4)


def ordered(words: np.ndarray, k: int, runs: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, int]:
    """The labelled runs of k words of a text, those that are held after those that are not, by how often; and the number of
    those that come before the last `least_common` - `shared_least`."""
    own, n = labelled_runs(words, k), len(words)
    often = np.zeros(len(own), "<u2")
    if len(runs):
        at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
        often = np.where(runs[at] == own, held[at], 0)
    return own[np.lexsort((own, often))], max(1, len(own) - least_common(n, k) + shared_least(n, k))


def _common_runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(bucket, refs) to the runs that two references or more hold, sorted, and by how many."""
    for batch in batches:
        runs, held = [], []
        for refs in batch.column(1):
            found, count = np.unique(np.concatenate([labelled_runs(np.frombuffer(w, "<u4"), k) for w in refs.as_py()]), return_counts=True)
            runs.append(found[count > 1].tobytes())
            held.append(count[count > 1].astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary()), pa.array(held, pa.binary())], names=["bucket", "runs", "held"])


_SHARDED = "bucket long, shard int, shards int, node binary, n int, comp binary, words binary, first int, grams binary"


def _sharded(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard in which a member has runs: these, in order, and how many are of its prefix."""
    names = [x.split()[0] for x in _SHARDED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for bucket, node, n, comp, total, words, runs, held in zip(*(c.to_pylist() for c in batch.columns)):
            grams, first = ordered(np.frombuffer(words, "<u4"), k, np.frombuffer(runs or b"", "<u8"), np.frombuffer(held or b"", "<u2"))
            shards = total // SHARD + 1
            shard = (_mix(grams) % np.uint64(shards)).astype(int)
            rows += [(bucket, int(x), shards, node, n, comp, words, int((shard[:first] == x).sum()), grams[shard == x].tobytes()) for x in np.unique(shard)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


_MET = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("name", pa.int64()), ("n", pa.int32()), ("comp", pa.binary())])


def _compared(bucket: int, nodes: list, comps: list, comp: np.ndarray, n: np.ndarray, words: list, grams: list[np.ndarray], first: np.ndarray, shards: int, k: int) -> list[tuple]:
    """Links (a, b) that join components. Members are compared that share in their prefixes (the `first` of their runs), and
    then in all, as many runs as the rule asks for, on average of the bucket's shards (one of them has that many at least).
    comp follows the links. Besides, the holders (a, name of the run, n, comp) of runs that more than HOT hold in their
    prefixes."""
    found, gram = np.unique(np.concatenate(grams), return_inverse=True)
    own = np.split(gram, np.cumsum([len(g) for g in grams])[:-1])
    lead = np.concatenate([g[:m] for g, m in zip(own, first)])
    holders = np.bincount(lead, minlength=len(found))
    posts = np.split(np.repeat(np.arange(len(grams)), first)[np.argsort(lead, kind="stable")], np.cumsum(holders)[:-1])
    least = np.array([shared_least(int(x), k) for x in n])
    runs = np.maximum(1, n - k + 1)
    mark = np.zeros(len(found), bool)
    rows: list[tuple] = []
    # The largest component's members are met by all others, so only these look around.
    largest = comp == np.bincount(comp).argmax()
    done = largest.copy()
    for i in np.flatnonzero(~largest):
        near = [posts[g] for g in own[i][: first[i]] if 1 < holders[g] <= HOT]
        done[i] = True
        if not near:
            continue
        count = np.bincount(np.concatenate(near), minlength=len(nodes))
        other = np.flatnonzero((count * shards >= np.minimum(least, least[i])) & (count > 0) & (comp != comp[i]) & (~done | largest))
        if not len(other):
            continue
        mark[own[i]] = True
        common = np.add.reduceat(mark[np.concatenate([own[j] for j in other])], np.r_[0, np.cumsum([len(own[j]) for j in other])[:-1]], dtype=int)
        mark[own[i]] = False
        wanted = (runs[other] + runs[i]) * LEAST / (1 + LEAST) if k == K else np.maximum(n[other], n[i]) * CLOSE
        text = np.frombuffer(words[i], "<u4")
        for j in other[common * shards >= wanted - 1e-6]:
            if comp[i] != comp[j] and similar(text, np.frombuffer(words[j], "<u4")):
                comp[comp == comp[j]] = comp[i]
                rows.append((*sorted((nodes[i], nodes[j])), None, None, None))
    for g in np.flatnonzero(holders > HOT):
        name = int(_mix(found[g : g + 1] ^ np.uint64(bucket & (1 << 64) - 1)).view(np.int64)[0])
        rows += [(nodes[i], None, name, int(n[i]), comps[i]) for i in posts[g]]
    return rows


def _met_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _MET)], schema=_MET) if rows else _MET.empty_table()


def _members(table: pa.Table) -> tuple[list, list, np.ndarray, np.ndarray, list]:
    comps = table["comp"].to_pylist()
    _, comp = np.unique(np.array(comps, object), return_inverse=True)
    return table["node"].to_pylist(), comps, comp, table["n"].to_numpy(), table["words"].to_pylist()


def _met(key: tuple[pa.Scalar, ...], table: pa.Table, k: int) -> pa.Table:
    """What `_compared` finds in one shard of a bucket."""
    nodes, comps, comp, n, words = _members(table)
    if (comp == comp[0]).all():
        return _MET.empty_table()
    grams = [np.frombuffer(g, "<u8") for g in table["grams"].to_pylist()]
    return _met_table(_compared(key[0].as_py(), nodes, comps, comp, n, words, grams, table["first"].to_numpy(), table["shards"][0].as_py(), k))


def _met_of(k: int):
    return lambda key, table: _met(key, table, k)


def _met_whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What `_compared` finds in a whole bucket, whose holders of each run are known."""
    nodes, comps, comp, n, words = _members(table)
    rows: list[tuple] = []
    for k in (K, 1):
        if (comp == comp[0]).all():
            break
        grams = [labelled_runs(np.frombuffer(w, "<u4"), k) for w in words]
        _, at, held = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        often = np.split(held[at], np.cumsum([len(g) for g in grams])[:-1])
        grams = [g[np.lexsort((g, h))] for g, h in zip(grams, often)]
        first = np.array([max(1, len(g) - least_common(int(m), k) + shared_least(int(m), k)) for g, m in zip(grams, n)])
        rows += _compared(key[0].as_py(), nodes, comps, comp, n, words, grams, first, 1, k)
    return _met_table(rows)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            a, b, x, y = (part.column(part.schema.get_field_index(c)) for c in ("a", "b", "a_words", "b_words"))
            linked = [similar(np.frombuffer(p.as_py(), "<u4"), np.frombuffer(q.as_py(), "<u4")) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _verified(pairs: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """pairs (a, b) with `linked`; a stored table. The side that repeats most, a, is joined last, where skewed partitions
    can be split."""
    of = lambda s: words.select(F.col("node").alias(s), F.col("words").alias(f"{s}_words"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a")
    return staged(rows.select("a", "b", "a_words", "b_words").mapInArrow(_aligned, "a binary, b binary, linked boolean"), name)


def _near(n: str, m: str):
    """Can texts of so many words be similar enough."""
    return F.least(n, m) >= F.greatest(n, m) * LEAST - F.lit(1e-9)


def _cross(rows: DataFrame) -> DataFrame:
    """(a, b) of rows (bucket, node, n, comp) in one bucket, of near lengths and different components."""
    x, y = (rows.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "comp"))) for s in "xy")
    pairs = x.join(y, "bucket").where((F.col("comp_x") < F.col("comp_y")) & _near("n_x", "n_y"))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _buckets(entries: DataFrame, name: str) -> DataFrame:
    """entries (bucket, node, n) of buckets with two nodes or more, with the bucket's first (node, n) and size."""
    firsts = entries.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return staged(entries.join(firsts, "bucket"), name)


_MET_SCHEMA = "a binary, b binary, name long, n int, comp binary"


def _meetings(crowd: DataFrame, words: DataFrame) -> DataFrame:
    """crowd: (bucket, node, n, comp, size). What `_compared` finds in its buckets; a stored table. A bucket of SHARD words at
    most is one group; a larger one is dealt by run."""
    words = words.select("node", "words")
    totals = crowd.groupBy("bucket").agg(F.sum("n").alias("total"))
    crowd = staged(crowd.select("bucket", "node", "n", "comp", "size").join(totals, "bucket"), "crowds")
    whole = crowd.where(F.col("total") <= SHARD).select("bucket", "node", "n", "comp").join(words, "node")
    met = whole.groupBy("bucket").applyInArrow(_met_whole, _MET_SCHEMA)
    large = crowd.where(F.col("total") > SHARD)
    if not large.isEmpty():
        drawn = large.where(F.pmod(F.xxhash64("node", "bucket"), "size") < REFERENCES).select("bucket", "node")
        refs = staged(drawn.join(words, "node").groupBy("bucket").agg(F.collect_list("words").alias("refs")), "crowd-references")
        for k in (K, 1):
            common = refs.mapInArrow(lambda batches, k=k: _common_runs(batches, k), "bucket long, runs binary, held binary")
            rows = large.select("bucket", "node", "n", "comp", "total").join(words, "node").join(common, "bucket", "left")
            rows = rows.select("bucket", "node", "n", "comp", "total", "words", "runs", "held").mapInArrow(lambda batches, k=k: _sharded(batches, k), _SHARDED)
            met = met.union(rows.groupBy("bucket", "shard").applyInArrow(_met_of(k), _MET_SCHEMA))
    return staged(met, "crowd-links")


def _cells(big: DataFrame) -> DataFrame:
    """Large buckets dealt into cells by hash, more than once, so that the cells of all deals hang together."""
    deal = lambda i: F.xxhash64("bucket", F.lit(i), F.pmod(F.xxhash64("node", F.lit(i)), F.ceil(F.col("size") / CELL)))
    return big.select(F.explode(F.array(*(deal(i) for i in range(DEALS)))).alias("bucket"), "node", "n", "comp")


def _comps(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    several = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    return rows.join(several, "bucket", "left_semi")


def classes_and_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, components): id, digest of the text, node of its class; and (node, component) of linked classes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    docs = staged(rows.mapInArrow(_sketched, f"id {kind}, digest string, node binary, n int, sketches array<long>, words binary"), "sketches")
    # Buckets: a row for each class and sketch, of buckets with two classes or more.
    nodes = docs.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    entries = nodes.select("node", "n", F.posexplode("sketches").alias("i", "s")).select(F.xxhash64("i", "s").alias("bucket"), "node", "n")
    buckets = _buckets(staged(entries, "buckets"), "shared-buckets")
    words = docs.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    words = staged(words, "candidate-words")
    # All with the first of their bucket.
    stars = buckets.where((F.col("node") != F.col("first.node")) & _near("n", "first.n"))
    stars = stars.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    found = _verified(stars, words, "star-links")
    # Pairs of different components in a bucket, or of a crowd that share a run of their prefixes.
    comps = connected_components(found.where("linked").select("a", "b"), store=staged)
    left = staged(_open(_comps(buckets.select("bucket", "node", "n", "size"), comps)), "open-buckets")
    pairs = _cross(left.where(F.col("size") <= CROWD))
    crowd = left.where(F.col("size") > CROWD)
    big = None
    if not crowd.isEmpty():
        met = _meetings(crowd, words)
        again = met.where("b is null").select(F.col("name").alias("bucket"), F.col("a").alias("node"), "n", "comp").distinct()
        sizes = again.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("first"))
        big = staged(again.join(sizes, "bucket"), "prefix-buckets")
        star = big.where((F.col("node") != F.col("first.node")) & _near("n", "first.n")).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
        pairs = pairs.union(star).union(_cross(_cells(big)))
        crowd_links = met.where("b is not null").select("a", "b")
    tested = found.select("a", "b")
    links = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = links.union(crowd_links) if big is not None else links
    for last in (False, True):
        now = _verified(pairs.distinct().join(tested, ["a", "b"], "left_anti"), words, "cross-links")
        comps = connected_components(links.union(now.where("linked").select("a", "b")), store=staged)
        if last or big is None:
            break
        links, tested = comps.select(F.col("node").alias("a"), F.col("component").alias("b")), tested.union(now.select("a", "b"))
        pairs = _cross(_open(_comps(big.select("bucket", "node", "n"), comps)))
    return docs.select("id", "digest", "node"), comps


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: its id, digest (md5 of the text), component_id (the smallest id of its group), kept."""
    docs, parts = classes_and_links(df, id_col, text_col)
    groups = docs.groupBy("node").agg(F.min("id").alias("first")).join(parts, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    groups = staged(groups.select("node", "first", "comp"), "groups")
    ids = groups.groupBy("comp").agg(F.min("first").alias("component_id"))
    names = groups.join(ids, "comp").select("node", "component_id")
    out = docs.join(names, "node")
    return out.select(F.col("id").alias(id_col), "digest", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group: that with the smallest id; of rows that repeat id and text, one. Rows with a null id
    go if their group has any id; else they stay. df's columns may have any names: a row travels as one column."""
    found = near_duplicates(df, id_col, text_col)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    rows = df.select(row, F.col(f"`{id_col}`").alias("_own_id"), F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_own"))
    rows = rows.join(gone, F.col("_own").eqNullSafe(F.col("_digest")) & F.col("_own_id").eqNullSafe(F.col("_id")), "left_anti")
    nth = F.row_number().over(Window.partitionBy("_own_id", "_own").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).where((F.col("_nth") == 1) | F.col("_own_id").isNull()).select("_row.*")


def op2_near_duplicates(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", "component_id", "kept")
