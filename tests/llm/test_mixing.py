import re
from collections import defaultdict

import pytest

from rowloom.llm import mixing
from tests.conftest import SF


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing the excess out again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not stopped:
            return full | {s: rate * weight[s] for s in open_}
        for s in stopped:
            full[s] = most * sizes[s]
            left -= full[s]
        open_ -= stopped
    return full


def sums(rows, of):
    out = defaultdict(float)
    for r in rows:
        out[r.source] += r[of]
    return dict(out)


def check(docs):
    rows = mixing.mix(docs).collect()
    given = [(r.doc_id, r.source, len(re.findall(mixing.WORD, r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=str) == sorted(given, key=str)
    sizes = defaultdict(int)
    for _, source, n in given:
        sizes[source] += n
    targets = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source] if sum(sizes.values()) else 0)
        assert r.taken == r.copies * r.size <= 2 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or rate - 1 < r.copies < rate + 1
    largest = defaultdict(int)
    for _, source, n in given:
        largest[source] = max(largest[source], n)
    for source, words in sums(rows, "taken").items():
        assert abs(words - targets[source]) <= largest[source]
    return rows


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(docs)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)


def test_hot_source_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 37)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    rows = check(docs)
    gap = {s: abs(sums(rows, "taken")[s] - next(r.target for r in rows if r.source == s)) for s in sums(rows, "taken")}
    assert max(gap.values()) <= 19
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # the same by shuffled joins
    assert sorted(mixing.mix(docs).collect()) == sorted(rows)


def test_copies_are_unbiased(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 9)) AS text", "IF(id < 2000, 'a', 'b') AS source")
    rows = [r for r in mixing.mix(docs).collect() if r.source == "b"]
    rate = rows[0].target / rows[0].source_size
    for k in range(9):
        own = [r.copies for r in rows if r.size == k + 1]
        assert sum(own) / len(own) == pytest.approx(rate, abs=0.12)


def test_awkward_rows(awkward, no_rows):
    check(awkward)
    assert mixing.mix(no_rows).collect() == []


def test_repeated_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "d " * 100, "t")], "doc_id long, text string, source string")
    rows = [r for r in check(docs) if r.source == "s"]
    assert len(rows) == 5 and max(r.copies for r in rows) - min(r.copies for r in rows) <= 1


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(1, "", "s"), (2, None, "t")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_applied_keeps_rows_and_columns(spark, awkward, no_rows):
    docs = awkward.union(awkward).repartition(5)
    key = lambda r: (str(r.doc_id), str(r.source), r.size)
    rows = mixing.applied(docs).collect()
    assert rows and [r.asDict()["size"] for r in rows] == [len(re.findall(mixing.WORD, r.text or "")) for r in rows]
    figures = lambda rows: sorted((*key(r), r.source_size, r.target, r.copies, r.taken) for r in rows)
    assert figures(rows) == figures(mixing.mix(docs).collect())
    assert set(mixing.applied(docs).columns) == {*docs.columns, *mixing.FIGURES}
    kept = [c for c in docs.columns if c not in mixing.FIGURES]
    assert sorted(map(str, docs.select(kept).collect())) == sorted(map(str, mixing.applied(docs).select(kept).collect()))
    assert mixing.applied(no_rows).collect() == []
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert figures(mixing.applied(real).collect()) == figures(mixing.mix(real).collect())
