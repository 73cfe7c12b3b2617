import math

import numpy as np
import pytest

from rowloom.llm import ann
from tests.conftest import SF


def plain(rows, every=50, k=5):
    """(query_id, rank, vec_id, score) by comparing each query with every row."""
    lengths = {len(v) for _, v in rows}
    if len(lengths) > 1:  # each length among itself
        return sorted(x for n in lengths for x in plain([r for r in rows if len(r[1]) == n], every, k))
    rows = sorted({(i, tuple(v)) for i, v in rows})
    m = np.array([v for _, v in rows], float)
    ids = [i for i, _ in rows]
    norms = np.linalg.norm(m, axis=1)
    out = []
    for q, i in enumerate(ids):
        if i % every == 0:
            near = m @ m[q] / (norms * norms[q])
            best = {}
            for j, v in enumerate(ids):
                if v != i:
                    best[v] = max(near[j], best.get(v, -2))
            out += [(i, r, v, s) for r, (v, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k], 1)]
    return out


def got(df, **more):
    return sorted(tuple(r) for r in ann.search(df, **more).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, part int, v int")


def test_recall_on_real_vectors(spark):
    for base in (SF, SF.replace("0.001", "0.1")):
        df = spark.read.parquet(f"{base}/embeddings.parquet")
        want = plain([(r.vec_id, r.embedding) for r in df.collect()])
        rows = got(df)
        assert [r[:2] for r in rows] == [w[:2] for w in sorted(want)]
        found, wanted = {(q, v) for q, _, v, _ in rows}, {(q, v) for q, _, v, _ in want}
        assert len(found & wanted) / len(wanted) >= 0.9
        scores = {(q, v): s for q, _, v, s in want}
        assert all(math.isclose(s, scores[q, v], rel_tol=1e-9) for q, _, v, s in rows if (q, v) in scores)


def test_clustered_vectors_ask_few_parts():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((64, 32)) * 4
    vectors = ann._unit(np.repeat(centres, 100, axis=0) + rng.standard_normal((6400, 32)))
    router = ann.fit(vectors, 6400)
    parts = router.parts
    assert parts == 16 and router.asked <= 4
    sizes = np.bincount(ann.bisect(ann.neighbours(vectors, 10), parts))
    assert sizes.max() - sizes.min() <= 1


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(8).astype(np.float32).tolist(), 0, 0, 0) for k in range(-100, 120)]
    assert [(q, r, v) for q, r, v, _ in got(frame(spark, rows))] == [(q, r, v) for q, r, v, _ in sorted(plain([x[:2] for x in rows]))]


def test_equal_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)  # parts in many cells
    rng = np.random.default_rng(2)
    one, other = [1.0, 2.0, 0.5, -1.0], [3.0, 0.0, 1.0, 1.0]
    rows = [(k, one if k % 3 == 0 else other if k % 3 == 1 else rng.standard_normal(4).astype(np.float32).tolist(), 0, 0, 0) for k in range(301)]
    rows += [rows[0], rows[50]]
    assert [(q, r, v) for q, r, v, _ in got(frame(spark, rows))] == [(q, r, v) for q, r, v, _ in sorted(plain([x[:2] for x in rows]))]


def test_vectors_that_take_no_part(spark):
    good = [(k, [float(k + 1), 1.0], 0, 0, 0) for k in range(4)]
    bad = [(50, None, 0, 0, 0), (100, [], 0, 0, 0), (150, [0.0, 0.0], 0, 0, 0), (200, [None, 1.0], 0, 0, 0), (250, [float("nan"), 1.0], 0, 0, 0), (300, [float("inf"), 1.0], 0, 0, 0), (None, [1.0, 1.0], 0, 0, 0)]
    rows = got(frame(spark, good + bad))
    assert [(q, r, v) for q, r, v, _ in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert got(frame(spark, bad[:6])) == [] and got(frame(spark, good[:1])) == [] and got(frame(spark, good).limit(0)) == []
    assert got(frame(spark, [(0, [1.0, 0.0], 0, 0, 0), (1, [1e30, 1e30], 0, 0, 0), (2, [-1e-30, 0.0], 0, 0, 0)])) == [(0, 1, 1, pytest.approx(math.sqrt(0.5))), (0, 2, 2, pytest.approx(-1.0))]


def clustered(rng, clusters, each, width=16):
    centres = rng.standard_normal((clusters, width)) * 4
    return np.repeat(centres, each, axis=0) + rng.standard_normal((clusters * each, width))


def test_vectors_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROUTED", 300)
    rng = np.random.default_rng(4)
    rows = []
    for n, count in ((8, 900), (5, 400), (3, 60), (2, 1)):
        rows += [(len(rows) + k, rng.standard_normal(n).astype(np.float32).tolist(), 0, 0, 0) for k in range(count)]
    want, found = plain([r[:2] for r in rows]), got(frame(spark, rows))
    assert {(q, r) for q, r, _, _ in found} == {(q, r) for q, r, _, _ in want}
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_parts_within_parts(spark, monkeypatch):
    """Beyond a level's parts each is cut again, by a sample of its own."""
    monkeypatch.setattr(ann, "LEVEL_PARTS", 4)
    monkeypatch.setattr(ann, "PARTS_SHARE", 4)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 700)
    rng = np.random.default_rng(5)
    rows = [(k, v, 0, 0, 0) for k, v in enumerate(clustered(rng, 40, 100).astype(np.float32).tolist())]
    df = frame(spark, rows)
    merged = ann.valid(df).selectExpr("v", "array(vec_id) AS ids")
    (router,) = ann.fit_routers(merged).values()
    assert router.parts == 4 and len(router.children) == 4 and all(c.parts >= 4 for c in router.children.values()) and router.share() < 0.5
    want, found = plain([r[:2] for r in rows]), got(df, routers={16: router})
    assert [r[:2] for r in found] == [w[:2] for w in want]
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_queries_that_find_too_few_ask_on(spark):
    """A part may hold fewer than k others; then all parts are asked."""
    rng = np.random.default_rng(6)
    far = clustered(rng, 8, 60)
    rows = [(k + 1, v, 0, 0, 0) for k, v in enumerate(far.tolist())] + [(1000, (far[0] * -3).tolist(), 0, 0, 0)]
    router = ann.fit(ann._unit(far), 1e6)
    router.asked = 1
    found = got(frame(spark, rows), routers={16: router})
    assert all(sum(q == i for q, *_ in found) == 5 for i in (50, 100, 1000))
    router.weights[3][:] = -100.0
    router.weights[2][:] = 0.0
    router.weights[3][0], router.weights[3][1] = 0.0, -1.0  # all vectors in part 0
    few = rows[:4] + rows[-1:]
    assert [r[:3] for r in got(frame(spark, few), routers={16: router})] == [w[:3] for w in plain([r[:2] for r in few])]
