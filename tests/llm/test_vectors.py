import math

import numpy as np

from tests.llm.brute import Groups


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def brute(rows):
    ok = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, g = {r[0]: 0 for r in rows}, Groups({r[0] for r in rows if r[0] is not None})
    for k, (a, v, l) in enumerate(ok):
        for b, w, m in ok[:k]:
            if l == m and len(v) == len(w) and cosine(v, w) >= 0.93:
                links[a] += 1
                links[b] += 1
                g.join(a, b)
    return sorted(((r[0], links[r[0]], None if r[0] is None else g.find(r[0])) for r in rows), key=str)


def test_vector_dedup(spark):
    from anchorloom.llm import vector_dedup

    rng, rows = np.random.default_rng(4), []
    for i in range(240):
        v = rng.normal(size=16)
        if i >= 120:
            v = np.array(rows[i - 120][1]) + rng.normal(size=16) * 0.25
        rows.append((i, v.tolist(), i % 120 % 3))
    rows += [(300 + i, rows[0][1], 0) for i in range(5)]
    rows += [(310, None, 0), (311, [0.0] * 16, 0), (312, [math.nan] * 16, 0), (313, rows[0][1], None), (314, [None, 1.0], 0), (315, [1.0, 2.0], 0), (316, [2.0, 4.0], 0), (317, [], 0), (318, [math.inf] * 16, 0), (319, [1e200, 2e200], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, rep int")
    made = vector_dedup.dedup(df)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in made.collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    missed = sum(w[1] - g[1] for g, w in zip(got, want, strict=True))
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and missed <= 0.05 * sum(w[1] for w in want)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in made.collect())
    assert vector_dedup.dedup(df.limit(0)).count() == 0


def test_prune_drops_what_a_neighbour_covers():
    from anchorloom.llm.vector_dedup import prune

    angle = np.array([0.0, 0.1, 0.12, -0.5])
    near = prune(np.stack([np.cos(angle), np.sin(angle)], 1))
    assert near[0][0] == 1 and 2 not in near[0] and 3 in near[0]


def test_components(spark):
    from anchorloom.llm.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == 100 and {got[x] for x in range(500, 560)} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_failed_audit_ends_in_exact_comparison(spark, monkeypatch):
    from pyspark.sql import functions as F

    from anchorloom.llm import vector_dedup

    graph = vector_dedup._graph
    monkeypatch.setattr(vector_dedup, "_graph", lambda *a: graph(*a).withColumn("near", F.lit(b"")))  # without edges nothing is found
    rng, rows = np.random.default_rng(8), []
    for i in range(200):
        v = rng.normal(size=12) if i < 100 else np.array(rows[i - 100][1]) + rng.normal(size=12) * 0.2
        rows.append((i, v.tolist(), i % 100 % 3))
    want = brute(rows)
    assert sum(w[1] for w in want) > 50
    got = vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want


def test_audit_weighs_queries_alike(spark):
    from anchorloom.llm import vector_dedup

    rng = np.random.default_rng(9)
    hot = rng.normal(size=16)
    vectors = [hot + rng.normal(size=16) * 0.01 for _ in range(60)]
    for _ in range(30):
        v = rng.normal(size=16)
        vectors += [v, v + rng.normal(size=16) * 0.01]
    reps = spark.createDataFrame([(i, "s", bytearray(np.asarray(v, "<f8").tobytes())) for i, v in enumerate(vectors)], "rep long, space string, v binary")
    found = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    assert abs(vector_dedup.audit(reps, found, 120, 16, 0.93) - 0.5) < 0.01
