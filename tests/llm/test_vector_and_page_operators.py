"""Vectors, pages, components and the pipeline, against brute force."""

import hashlib
import os

import numpy as np
import pytest

from ontolake.llm import ann, common, hnsw, vector_dedup, warc
from ontolake.llm.components import connected_components
from ontolake.llm.queries import ORACLES, QUERIES

VEC = "vec_id long, embedding array<float>, label int, vec string, key string"


def frame(spark, x, labels, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], None if k is None else int(k), "x", "y") for i, v, k in zip(ids, x, labels)], VEC)


def clusters(n, d, seed, spread=0.01):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, d))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d)) * rng.choice([0, 1, 1, 8], (n, 1))).astype(np.float32)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(900, 17)), np.repeat(rng.normal(size=(1, 17)), 100, 0)]).astype(np.float32)
    odd = [None, [0.0] * 17, [float("nan")] * 17, [None] * 17, [1.0]]
    d = frame(spark, [*x, *odd], [0] * 1005)
    got = ann.op1_nearest_neighbours(d).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 1000, 50):
        s = unit @ unit[q]
        s[q] = -9
        s = np.round(s, 12)
        want = np.lexsort((np.arange(1000), -s))[:5].tolist()
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        hit += len(set(want) & set(mine.vec_id))
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-9)
        if q >= 900:
            assert mine.vec_id.tolist() == want  # ties go to the smaller id
    assert hit >= 0.99 * 100
    assert ann.op1_nearest_neighbours(d.where("FALSE")).count() == 0
    few = ann.op1_nearest_neighbours(frame(spark, x[:3], [0] * 3)).toPandas()
    assert sorted(few.vec_id) == [1, 2]


def test_driver_gets_codebooks_and_no_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 8))
    d = frame(spark, x, [0] * 3000)
    vectors = ann.usable(d, "vec_id", "embedding").repartition(7)
    monkeypatch.setattr(type(d), "toArrow", lambda self: pytest.fail("vectors on the driver"))
    q = ann.fit_quantiser(vectors, 8, 3000, sample=500)
    ids = [r["vec_id"] for r in vectors.orderBy(ann.F.xxhash64("vec_id"), "vec_id").limit(500).select("vec_id").collect()]
    own = ann.Quantiser(8).fit(x[ids])  # the same sample in the same order
    assert np.allclose(q.words, own.words) and np.allclose(q.finer, own.finer)
    assert (q.margin, q.finer_margin) == ann.calibrated(own, x[ids])
    assert 500 <= ann.sampled(vectors, 3000, 500).count() <= 1500  # what one task sorts
    same = ann.usable(d, "vec_id", "embedding").withColumn("vec_id", ann.F.lit(7).cast("long"))
    assert len(ann.fit_quantiser(same, 8, 3000, sample=500).words) == q.m


def test_search_spares_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)], "vec_id long, embedding array<double>")
    shares, tasks = [], []
    monkeypatch.setattr(ann, "spare_driver", lambda session, share: shares.append(share))
    monkeypatch.setattr(ann, "BLOCK", 1)
    monkeypatch.setattr(ann, "QUERIES", 1)
    monkeypatch.setattr(ann, "TASKS", 3)
    kept = ann.staged
    monkeypatch.setattr(ann, "staged", lambda rows, name: tasks.append(rows.rdd.getNumPartitions()) or kept(rows, name) if name == "ann-candidates" else kept(rows, name))
    assert ann.op1_nearest_neighbours(df, every=6).count() == 50
    assert shares == [ann.HEAP] * 4  # vectors, codebooks, index, candidates
    assert tasks == [3]


def test_quantiser_prefers_small_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    q = ann.Quantiser(64).fit(x)
    plain = ann.Quantiser(64)
    plain.eta = 1.0
    plain.fit(x)

    def along(z):
        p = z.parts(x)
        codes, _ = z._codes(p)
        return (((p - z.words[np.arange(z.m), codes]) * p).sum((1, 2)) ** 2).mean()

    assert along(q) < along(plain)


def brute_links(x, labels, least=0.98):
    n = len(x)
    ok = [v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    parent, deg = list(range(n)), [0] * n

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] is not None and labels[i] == labels[j]:
                a, b = np.asarray(x[i], float), np.asarray(x[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    deg[i] += 1
                    deg[j] += 1
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
    return deg, [root(i) for i in range(n)]


@pytest.mark.parametrize("shard", [40, vector_dedup.SHARD])
def test_vector_links(spark, monkeypatch, shard):
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    x = clusters(300, 8, 3, 0.05)
    x[50] = x[51] = x[52]
    rows = [*map(list, x), None, [0.0] * 8, [float("inf")] * 8, [None] * 8, [1.0], list(x[0])]
    labels = [*np.random.default_rng(4).integers(0, 2, 300).tolist(), 0, 0, 0, 0, 0, None]
    got = vector_dedup.op10_vector_dedup(frame(spark, rows, labels)).toPandas().sort_values("vec_id")
    deg, comp = brute_links(rows, labels)
    assert got.n_links.tolist() == deg
    assert got.component_id.tolist() == comp
    assert got.kept.tolist() == [i == c for i, c in enumerate(comp)]
    assert vector_dedup.op10_vector_dedup(frame(spark, rows, labels).where("FALSE")).count() == 0


def test_audits_see_links_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 150)
    x = clusters(900, 16, 8, 0.04)
    rows, audits = vector_dedup.link_vectors_audited(frame(spark, x, [0] * 900))
    found = audits.toPandas()
    n = found.nodes.notna().sum()  # a shard each, and a pair of shards each
    assert n > 4 and len(found) == n + n * (n - 1) / 2
    assert found.true.sum() > 500 and (found.hit >= 0.999 * found.true).all() and (found.met >= 0.9 * found.asked).all()
    assert (found.every == 0).any()  # the graph answers, not a look at every node
    deg, comp = brute_links16(x)
    got = rows.toPandas().sort_values("vec_id")
    assert abs(got.n_links.sum() - sum(deg)) <= 0.001 * sum(deg) and got.component_id.tolist() == comp


def brute_links16(x):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    return near.sum(1).tolist(), vector_dedup.local_components(near, np.arange(len(x))).tolist()


def test_vectors_link_within_their_dimension(spark):
    x = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.001, 0.0], [0.0, 1.0]]
    got = vector_dedup.op10_vector_dedup(frame(spark, x, [0] * 5)).toPandas().sort_values("vec_id")
    assert got.component_id.tolist() == [0, 0, 2, 2, 4] and got.n_links.tolist() == [1, 1, 1, 1, 0]
    found = ann.nearest(frame(spark, x, [0] * 5), ann.F.lit(True)).toPandas()
    assert {(r.query_id, r.vec_id) for r in found.itertuples()} == {(a, b) for s in ((0, 1, 4), (2, 3)) for a in s for b in s if a != b}


def test_graph_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(x, hnsw.levels_of(np.arange(3000)))
    ids, _ = g.layers[-1].search(x, x[:200], g.entries(x[:200]), 96)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9
    again = hnsw.Graph.unpack(g.pack(), x)
    assert (again.layers[-1].near == g.layers[-1].near).all()


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: root(n) for n in parent if n not in loops}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_need_no_round(spark):
    for edges, most in (([(9, 1), (8, 1), (1, 7), (5, 2), (2, 5), (3, 3)], 1), ([(i, i + 1) for i in range(4)], 4)):
        before = len(common._STAGED)
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert len(common._STAGED) - before <= most  # the edges are one table, and each round is
        want = {9: 1, 8: 1, 7: 1, 1: 1, 5: 2, 2: 2} if most == 1 else dict.fromkeys(range(5), 0)
        assert got == want


def test_pages(spark):
    long = "<p>" + "é" * 100
    rows = [(3, "http://a/3", long), (1, "http://a\r\n/1", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\nContent-Length: 9\r\n\r\n" + "x" * 200), (1, "other", long), (None, "n", long), (None, "m", "z" * 100)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    got = warc.op7_warc_round_trip(d).toPandas()
    assert len(got) == len(rows)
    digest = hashlib.sha256(long.encode()).hexdigest()
    same = got[got.payload_digest == digest]
    assert sorted(same.record_type) == ["response"] + ["revisit"] * 3
    assert same[same.record_type == "response"].page_id.tolist() == [1]
    assert set(same[same.record_type == "revisit"].refers_to) == {1}
    assert set(same.payload_bytes) == {len(long.encode())}
    rest = got[got.payload_digest != digest]
    assert set(rest.record_type) == {"response"} and rest.refers_to.isna().all()
    assert sorted(rest.payload_bytes) == sorted(len((h or "").encode()) for _, _, h in rows if h != long)
    assert warc.op7_warc_round_trip(d.where("FALSE")).count() == 0


def test_captures_are_nested(spark):
    from ontolake.llm.common import shared_path

    path = shared_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string"), path)
    row = warc.assemble(warc.read_warc(spark, path)).first()
    assert row["response"]["payload"] == "hello" and row["request"]["record_type"] == "request"
    assert row["metadata"]["concurrent_to"] == row["response"]["record_id"]


def test_archives_hold_a_member_for_each_record(spark):
    import gzip
    import zlib

    path = warc.shared_path(spark, "test-warc")
    big = "".join(chr(32 + i % 90) for i in range(20_000_000))  # more than one member holds
    html = [None, "", "x" * 99, "é" * 50, "\r\n\r\nWARC/1.1\r\n" * 20, big, "\0" * 300, "y" * 200, "y" * 200]
    warc.write_warc(spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1), path)
    data = b"".join(r["content"] for r in spark.read.format("binaryFile").load(path).collect())
    assert gzip.decompress(data).count(b"WARC-Record-ID: ") == 3 * len(html)  # what any gzip reader sees
    members, whole, rest = 0, 0, data
    while rest:
        one = zlib.decompressobj(31)
        head = one.decompress(rest)
        members, rest, whole = members + 1, one.unused_data, whole + (head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n"))
    assert members == 3 * len(html) + 2 and whole == 3 * len(html) - 1
    rows = warc.assemble(warc.read_warc(spark, path)).collect()
    got = {int(r["metadata"]["page_id"]): r["response"]["payload"] for r in rows}
    assert got == {i: (None if i == 8 else h or "") for i, h in enumerate(html)}


def test_pages_that_repeat_without_end_are_spread(spark):
    rows = [(7, "u", "z" * 150)] * 300 + [(None, None, "z" * 150)] * 50 + [(9, "v", "w" * 150)] * 40 + [(9, None, "w" * 150)]
    got = warc.op7_warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert len(got) == len(rows) and (got.record_type == "response").sum() == 2
    assert sorted(got[got.record_type == "response"].page_id) == [7, 9] and set(got[got.record_type == "revisit"].refers_to) == {7, 9}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    out = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, before, sf)
        assert out.columns == documents.columns, name
        assert 0 < out.count() <= 2 * before.count()
    final = corpus_pipeline.run(spark, sf)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and final.count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, by plain loops."""
    import re
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from ontolake.llm import mixing, order_minhash, quality, secrets

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    # Some documents get a secret besides.
    given, tables = spark.read.parquet(f"{sf}/documents.parquet"), f"file://{tmp_path}"
    secret = ann.F.when(ann.F.col("doc_id") % 7 == 0, ann.F.concat("text", ann.F.lit(" password: hunter2hunter2. "))).otherwise(ann.F.col("text"))
    given.withColumn("text", secret).withColumn("n_chars", ann.F.char_length("text").cast(given.schema["n_chars"].dataType)).write.parquet(f"{tables}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tables}/labels.parquet")
    sf = tables
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    every = {r["doc_id"]: r.asDict() for r in docs.collect()}
    # Quality: a fit in one piece over the labelled rows that are not held out.
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None and zlib_crc(r["doc_id"]) % 3 != 1}
    frame = spark.createDataFrame([([float(v) for v in quality.statistics(every[i]["text"] or "")], y) for i, y in known.items() if i in every], "_stats array<double>, _good double")
    model = quality.fit(frame)
    score = {i: float(model.score(np.array([quality.statistics(r["text"] or "")]))[0]) for i, r in every.items()}
    assert all(abs(s - 0.5) > 1e-6 for s in score.values())
    good = stages[0](spark, docs, sf)
    kept = {i for i, s in score.items() if s >= 0.5}
    assert {r["doc_id"] for r in good.collect()} == kept and 0 < len(kept) < len(every)
    # Near-duplicates: all pairs.
    ids, words = sorted(kept), {i: order_minhash.words_of(every[i]["text"] or "") for i in kept}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (every[i]["text"] or "") == (every[j]["text"] or "") or len(words[i]) and len(words[j]) and order_minhash.similar(words[i], words[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    single = stages[1](spark, good, sf)
    firsts = {i for i in ids if root(i) == i}
    assert {r["doc_id"] for r in single.collect()} == firsts and len(firsts) < len(ids)
    # Secrets: spans cut out of each text, one after another.
    scan = secrets.Scanner()
    clean = {}
    for i in firsts:
        text, out, at = every[i]["text"], "", 0
        for _, a, b in sorted(scan(text), key=lambda s: s[1:]) if text else ():
            if a >= at:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        clean[i] = out + text[at:] if text else text
    assert any("[REDACTED]" in (x or "") for x in clean.values())
    safe = stages[2](spark, single, sf)
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect() if r["text"] is not None)
    # Mixture: each source near its target, no document more than twice.
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in clean.items()}
    total = Counter()
    for i in size:
        total[every[i]["source"]] += size[i]
    mixed = stages[3](spark, safe, sf)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= firsts and max(times.values()) <= 2
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight, left, free, target = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}, 1.5 * sum(total.values()), set(names), {}
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]
        target |= {s: 2 * total[s] for s in over} or {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        left, free = left - sum(target[s] for s in over), free - set(over) if over else set()
    for s in names:
        taken = sum(size[i] * n for i, n in times.items() if every[i]["source"] == s)
        assert abs(taken - target[s]) <= 2 * max(size.values())
    # Encoding: the library.
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, n in times.items():
        e = theirs.encode(clean[i] or "", add_special_tokens=False).ids
        want += [(i, len(e), hashlib.sha256(np.asarray(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(e, skip_special_tokens=False).encode()).hexdigest())] * n
    assert rows(stages[4](spark, mixed, sf)) == sorted(want, key=str)
    assert rows(corpus_pipeline.run(spark, sf)) == sorted(want, key=str)
    assert mixing.WEIGHTS == (5, 2, 1)


def zlib_crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("embeddings", "pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = sorted((tuple(r[[d[0] for d in want.description].index(c)] for c in columns) for r in want.fetchall()), key=str)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == rows


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLES) <= set(QUERIES)
