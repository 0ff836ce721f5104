import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectorium.llm import cross_polytope as CP
from lectorium.llm import score_fusion as SF

RESULTS = "result_id long, query_id long, score_list string, chunk_id long, score double, item_json string"


def brute_fusion(rows, better):
    from statistics import median

    lists = {}
    for _, q, name, chunk, score, item in rows:
        if score is None or math.isnan(score):
            import json

            score = json.loads(item)["score"] if item else None
        if score is None or q is None or chunk is None or name not in better:
            continue
        score = score if better[name] == "high" else -score
        own = lists.setdefault((q, name), {})
        own[chunk] = max(own.get(chunk, -math.inf), score)
    gains, names = {}, {}
    for (q, name), own in lists.items():
        names.setdefault(q, set()).add(name)
        mid = median(own.values())
        mad = median(abs(s - mid) for s in own.values())
        mean = sum(abs(s - mid) for s in own.values()) / len(own)
        unit = mad * 1.4826 or mean * 1.2533 or 1
        for chunk, s in own.items():
            bounded = SF.FLOOR + (1 - SF.FLOOR) / (1 + math.exp(-(s - mid) / unit))
            gains[q, chunk] = gains.get((q, chunk), 0) + math.log(bounded) - math.log(SF.FLOOR)
    return {k: math.exp(math.log(SF.FLOOR) + g / len(names[k[0]])) for k, g in gains.items()}


def test_fusion_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), rng.choice("abc"), rng.randrange(12), rng.choice([rng.gauss(0, 10.0 ** rng.randrange(4)), float("nan"), None]), rng.choice([None, '{"score": 2.5}'])) for i in range(300)]
    rows += [(900, 7, "a", 1, 1.0, None), (901, 7, "a", 2, 1.0, None), (902, 8, "zzz", 1, 1.0, None), (903, None, "a", 1, 1.0, None), rows[0]]
    lists = spark.createDataFrame([("a", "low"), ("b", "high"), ("c", "low")], "score_list string, better string").withColumn("score", F.lit(3))
    df = spark.createDataFrame(rows, RESULTS).withColumn("better", F.lit("x"))
    got = {(r["query_id"], r["chunk_id"]): r["fused_score"] for r in SF.fused_ranking(df.drop("better"), lists).collect()}
    expected = brute_fusion(rows, {"a": "low", "b": "high", "c": "low"})
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert [r["chunk_id"] for r in SF.fused_ranking(df, lists).where("query_id = 7").orderBy("fused_rank").collect()] == [1, 2]  # tie
    assert SF.best(df.limit(0), lists).count() == 0


def test_no_list_dominates_by_its_range(spark):
    rows = [(i, 1, "wide", i, 1000.0 * i, None) for i in range(5)] + [(10 + i, 1, "narrow", i, (4 - i) / 1e6, None) for i in range(5)]
    lists = spark.createDataFrame([("wide", "high"), ("narrow", "high")], "score_list string, better string")
    got = {r["chunk_id"]: r["fused_score"] for r in SF.fused_ranking(spark.createDataFrame(rows, RESULTS), lists).collect()}
    assert all(abs(got[i] - got[4 - i]) < 1e-9 for i in range(5))


def planted(n=1500, d=32, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    for i in range(0, 200, 2):
        m[i + 1] = m[i] + rng.normal(size=d) * 0.2
    m[300:304] = m[300] * np.array([[1.0], [2.0], [1.0], [1.0]])
    return m


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_similar_pairs_against_brute_force(spark):
    m = planted()
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [1.0] * 7), (9005, [float("nan")] * 32), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("key", F.lit(1))
    u = unit(m.astype(np.float32).astype(float))
    sims = np.triu(u @ u.T, 1)
    expected = {(int(a), int(b)) for a, b in np.argwhere(sims >= 0.9)}
    pairs = [tuple(r) for r in CP.similar_pairs(df, "id", "embedding", 0.9).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= expected and len(pairs) >= 0.98 * len(expected)
    assert {(300, 302), (302, 303), (300, 303)} <= set(pairs)  # exact copies
    assert CP.similar_pairs(df.limit(0), "id", "embedding", 0.9).count() == 0
    assert CP.similar_pairs(df.where("id = 9002"), "id", "embedding", 0.9).count() == 0


def at_cosine(cosine, n, d, seed):
    rng = np.random.default_rng(seed)
    x, y = unit(rng.normal(size=(n, d))), rng.normal(size=(n, d))
    y = unit(y - x * (x * y).sum(axis=1, keepdims=True))
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


def test_recall_at_the_threshold_whatever_the_axes(spark, monkeypatch):
    x, y = at_cosine(0.901, 400, 64, 4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate((x, y)))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    for axes in (3, 4):
        monkeypatch.setattr(CP, "_axes_for", lambda rows, padded: axes)
        assert CP.hashing_for(800, 64, 0.9, 8, 3).axes == axes
        pairs = {tuple(r) for r in CP.similar_pairs(df, "id", "embedding", 0.9).collect()}
        assert sum((i, i + 400) in pairs for i in range(400)) >= 0.985 * 400
    monkeypatch.undo()
    assert [CP.hashing_for(n, 64, 0.9, 8, 3).axes for n in (5_000, 655_000, 1_000_000, 100_000_000)] == [1, 2, 3, 4]
    assert CP.hashing_for(81_000, 64, 0.9, 8, 3).tables == 8


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(CP, "BLOCK", 50)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    m = np.array([centre + rng.normal(size=16) * 0.02 for _ in range(160)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    assert CP.similar_pairs(df, "id", "embedding", 0.9, tables=4, probes=2).count() == 160 * 159 // 2


def test_nearest_recall(spark):
    m = planted()
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(9001, None), (9003, [0.0] * 32)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("rank", F.lit(1))
    asked = df.where("id % 100 = 0").select("id")
    got = {}
    for r in CP.nearest(df, "id", "embedding", asked, 10, dimension=32).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbour_id"])
    u = unit(m)
    hits = 0
    for q in range(0, 1500, 100):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:10]) & set(got[q]))
        assert q not in got[q] and len(got[q]) == 10
    assert hits >= 0.9 * 150
    assert CP.nearest(df.limit(0), "id", "embedding", asked, 3).count() == 0


def test_rotations_keep_lengths():
    h = CP.Hashing(20, 2, 2, 3)
    x = unit(np.random.default_rng(0).normal(size=(50, 20))).astype(np.float32)
    assert np.allclose(np.linalg.norm(h.rotated(x, 1, 1), axis=1), 1, atol=1e-5)
    assert np.allclose(h.rotated(x, 0, 0) @ h.rotated(x, 0, 0).T, x @ x.T, atol=1e-5)
    assert h.buckets(x, 0).shape == (50, 3)
