"""Periodic runs, fingerprints and dimension-sharded clustering: against brute force and by their contracts, odd rows included."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gable.llm import fingerprints as P
from gable.llm import queries as Q
from gable.llm.centroids import assigned, blocks, clustered, first_centroids, moved
from gable.llm.common import shingle_sets
from gable.llm.periodic_runs import Grammar, numbered, periodic_runs, runs_of

TEXTS = [None, "", " \n\t ", "a", "a a a a a a", "a b " * 3, "x " + "a b c " * 9 + "y", "é é é é é é é é é é é é", "w " * 30_000, " ".join(map(str, range(30_000))), "a b " * 3, "p q r s " * 4000 + "z " * 11]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs string, _t string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(50_000 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None, "a b c " * 5, None, None, None), (None, None, None, None, None), (50_003, "twice the id", None, None, None), (50_003, "a", None, None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    return real.unionByName(odd).withColumns({"runs": F.lit("clash"), "_t": F.lit("clash"), "sketch": F.lit("clash")}).repartition(7).cache()


def brute_runs(ws):
    """(start, length, period) by trying all periods."""
    n, out = len(ws), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(ws[t] == ws[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 5, 6, 7, 24, 60, 150]), rng.choice([1, 2, 3, 40])
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w * rng.choice([1, 1, 2]))
        ids, symbols, ends = numbered((w, None) for w in texts)
        start, end, period = runs_of(ids, symbols, ends)
        for w, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
            mine = (start >= a) & (start < b)
            assert list(zip((start[mine] - a).tolist(), (end - start)[mine].tolist(), period[mine].tolist())) == brute_runs(w)


def test_grammar_derives_the_text_and_repeats_no_pair():
    rng = random.Random(4)
    w = [b"%d" % rng.randrange(4) for _ in range(500)]
    ids, symbols, _ = numbered([(w, None)])
    g = Grammar(ids, symbols)

    def derived(s):
        return [s] if g.left[s] < 0 else derived(g.left[s]) + derived(g.right[s])

    assert [x for s in g.sequence for x in derived(s)] == ids.tolist() and len(g.sequence) < 250
    pairs = list(zip(g.sequence[:-1].tolist(), g.sequence[1:].tolist()))
    assert all(pairs[j] != p for i, p in enumerate(pairs) for j in range(i + 2, len(pairs)))
    for s in range(symbols, len(g.left)):
        assert derived(s) == ids[g.first[s] : g.first[s] + g.length[s]].tolist()


def test_periodic_query_on_whole_and_odd_texts(docs):
    got = {}
    for r in periodic_digest_rows(docs):
        got.setdefault(r["doc_id"], []).append(r)
    seen = 0
    for d in docs.select("doc_id", "text").collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        if len(ws) > 3000:
            continue
        n, h = len(ws), 1 if d["doc_id"] is None else zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(ws)
        drop = {i for s, le, q in runs for i in range(s + q, s + le)}
        best = min(((-le, s, q) for s, le, q in runs), default=None)
        want = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        want += (hashlib.sha256("".join(f"{s},{le},{q}\n" for s, le, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in drop).encode()).hexdigest())
        assert want in [tuple(r)[1:] for r in got[d["doc_id"]]]
        seen += bool(runs)
    assert seen > 10
    assert sum(map(len, got.values())) == docs.count()


def periodic_digest_rows(docs):
    from gable.llm.periodic_runs import digests

    return digests(periodic_runs(docs, order=Q.repeating)).collect()


def test_long_periodic_texts(spark):
    rows = {r["doc_id"]: r for r in periodic_runs(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")).collect()}
    assert [tuple(x) for x in rows[8]["runs"]] == [(0, 30_000, 1)] and rows[8]["collapsed"] == "w"
    assert rows[9]["runs"] == [] and rows[9]["n_words"] == 30_000 and rows[9]["collapsed"] == TEXTS[9]
    assert [tuple(x) for x in rows[11]["runs"]] == [(0, 16_000, 4), (16_000, 11, 1)] and rows[11]["collapsed"] == "p q r s z"
    assert rows[0]["runs"] == [] and rows[0]["collapsed"] == "" and [tuple(x) for x in rows[6]["runs"]] == [(1, 27, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert periodic_runs(none).count() == 0 and P.edited_fingerprints(none).count() == 0 and P.sketched(none).count() == 0
    assert P.merged(P.sketched(none), "doc_id").count() == 0
    assert clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_the_order_and_estimate_well(docs):
    rows = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    order = sorted(texts, reverse=True)
    table = docs.sparkSession.createDataFrame(rows).repartition(5)
    got = {r["doc_id"]: r for r in P.edited_fingerprints(table).collect()}
    assert set(got) == set(texts)
    sets = lambda t: set(shingle_sets([t])[0].tolist())
    off, by_text = [], {}
    for d, nxt in zip(order, [*order[1:], order[0]]):
        t, half, r = texts[d], len(texts[d]) // 2, got[d]
        edited = t[: len(t) - half] + texts[nxt][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = sets(t), sets(edited), sets(texts[nxt])
        off.append((r["near_edited"] - jaccard(a, e), r["near_next"] - jaccard(a, b), r["n_shingles"] / len(a) - 1 if a else r["n_shingles"], r["kept_share"] - (len(a & e) / len(a) if a else 1)))
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(base64.b64decode(r["fingerprint"])) == 5 * min(P.SIZE, len(a))
        if len(a | e) < P.SIZE:
            assert math.isclose(r["near_edited"], jaccard(a, e))
    # errors of 128 values: 0.044 at most for a resemblance, 0.09 for a number of shingles, as standard deviations
    assert (np.abs(off).max(axis=0) < [0.2, 0.2, 0.4, 0.3]).all() and (np.std(off, axis=0) < [0.044, 0.044, 0.09, 0.07]).all()


def test_fingerprints_of_odd_rows(spark, docs):
    assert P.edited_fingerprints(docs).count() == docs.count()
    one = P.edited_fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d").hexdigest() and one["near_next"] == 1.0
    rows = [(None, None, "x"), (None, "", "x"), (3, "q w e r t y", "x"), (3, "q w e r t y", "x")]
    got = sorted((r["doc_id"] or 0, r["n_chars"], r["near_next"]) for r in P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, sketch string")).collect())
    assert got == [(0, 0, 0.0), (0, 0, 1.0), (3, 11, 0.0), (3, 11, 1.0)]


def test_sketches_merge_over_parts(spark):
    rng = random.Random(1)
    words = [str(i) for i in range(3000)]
    parts = [(i % 3 if i % 7 else None, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(parts, "key int, text string").repartition(6)
    got = {r["key"]: P.unpacked_sketch(r["sketch"]) for r in P.merged(P.sketched(df, "key"), "key").collect()}
    for k in (0, 1, 2, None):
        union = set().union(*[shingle_sets([t])[0].tolist() for key, t in parts if key == k])
        assert got[k].tolist() == sorted({h >> 24 for h in union})[: P.SIZE]
        assert abs(P.distinct(got[k]) / len(union) - 1) < 0.3
    pair = spark.createDataFrame([(1, P.packed_sketch(got[0]), P.packed_sketch(P.merge(got[0], got[1]))), (2, None, None)], "id int, x binary, y binary")
    a, b = (r.asDict() for r in P.compared(pair, "x", "y").orderBy("id").collect())
    assert a["a_in_b"] > 0.9 and 0.3 < a["b_in_a"] < 0.7 and 0.3 < a["resemblance"] < 0.7
    assert b["resemblance"] == 1.0 and b["a_shingles"] == 0.0


def lloyd(rows, k=16, rounds=3):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashes = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v.tolist()) for i, v in kept)
    c = np.array([v for _, v in hashes[:k]])
    x = np.array([v for _, v in kept])
    for r in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        if r < rounds:
            c = np.array([(x[label == j].sum(axis=0) // (label == j).sum()) if (label == j).any() else c[j] for j in range(len(c))])
    low = d.min(axis=1)
    return [(i, int(a), int(b), int(low[label == a].sum()), int(low.sum()), c[a].tolist()) for (i, _), a, b in zip(kept, label, low)]


def odd_vectors():
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 4)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [float("nan")] * 64), (105, [1.0] * 63 + [float("inf")]), (106, [None] + [1.0] * 63), (107, [0.0] * 64)]
    return rows + [(None, [2.0] * 64), (None, [-1e5] * 64), (5, rows[5][1]), (5, rows[6][1]), (5, [0.015625, -0.015625] * 32)]


@pytest.mark.parametrize("n", [None, 5])
def test_clusters_equal_brute_force(spark, n):
    rows = odd_vectors()[:n]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, clustered(df).collect()), key=key) == sorted(lloyd(rows), key=key)


def test_shards_add_up_whatever_their_width(spark):
    rows = odd_vectors()[:90]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(4)
    c = first_centroids(df, "vec_id", "embedding", 64, 64.0, 7, 1)
    seen = set()
    for width, most in ((64, 2048), (32, 10), (7, 3)):
        table = blocks(df, "vec_id", "embedding", 64, 64.0, width, most)
        assert table.select("shard").distinct().count() == -(-64 // width)
        seen.add(moved(table, assigned(table, c, width), c, width).tobytes())
    assert len(seen) == 1
    with pytest.raises(Exception, match="64 bits"):
        clustered(spark.createDataFrame([(1, [3e30] * 64)], "vec_id long, embedding array<float>")).count()
