import random

import numpy as np
import pytest
import xxhash

from rowloom.llm import simhash
from rowloom.llm.components import connected_components
from tests.conftest import SF


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    marks = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((d, f"{marks[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in simhash.classes(df).collect()), key=str)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(docs) == plain_classes([tuple(r) for r in docs.collect()])


def test_near_copies_and_short_texts(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(300)]
        for j in range(5):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(300)] = "other"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + k, t) for k, t in enumerate(["", None, "a", "a b", "A  b", "a b c", "b a"])]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain_classes(rows)


def test_awkward_rows(awkward, no_rows):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert got(awkward) == plain_classes(rows)
    assert got(no_rows) == []


def test_heavy_nodes_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_LIMIT", 4)
    rng = np.random.default_rng(0)
    centre = int(rng.integers(1 << 62))
    marks = sorted({centre ^ sum(1 << int(b) for b in rng.choice(62, 2, replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(1 << 62, size=200)})
    df = spark.createDataFrame([(m, m) for m in marks], "fp long, rep long")
    for bound in (100_000, 0):  # broadcast, and joined by shuffle
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
        labels = {r.node: r.label for r in connected_components(simhash.near_links(df)).collect()}
        groups = {}
        for m in marks:
            groups.setdefault(labels.get(m, m), set()).add(m)
        for m in marks:
            mine = next(g for g in groups.values() if m in g)
            assert all(((m ^ o) % (1 << 64)).bit_count() > 3 for g in groups.values() if g is not mine for o in g)
        assert len(groups) > 100 and max(map(len, groups.values())) > 250


@pytest.mark.parametrize("n", [2, 37, 500])
def test_walk_finds_all_pairs_once(n):
    rng = np.random.default_rng(n)
    marks = np.unique(np.concatenate([rng.integers(1 << 63, size=n).astype(np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(64, size=n).astype(np.uint64))]))
    zero = np.array([0])
    a, b = simhash.walk(marks, zero, zero, np.array([len(marks)]))
    pairs = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for j in range(len(marks)) for i in range(j) if int(marks[i] ^ marks[j]).bit_count() <= 3}
    assert pairs == want
    half = len(marks) // 2
    a, b = simhash.walk(marks, zero, np.array([half]), np.array([len(marks)]))
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in want if i < half <= j}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(300, 301), (301, 301)], "src long, dst long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 300: 300, 301: 300}
    assert connected_components(links.limit(0)).collect() == []


def test_keep_one(awkward, no_rows):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)
    assert simhash.keep_one(no_rows).collect() == []


def test_keep_one_tells_unlike_texts_of_one_id_apart(spark):
    rng = random.Random(2)
    one, other = (" ".join(f"w{rng.randrange(500)}" for _ in range(200)) for _ in range(2))
    docs = spark.createDataFrame([(1, one), (1, other), (1, one), (2, other + " end"), (None, "alone here now"), (None, "alone here now"), (None, one)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(1, one), (1, other), (0, "alone here now")])


def test_fingerprints_of_crowded_nodes_are_dealt_below(spark, monkeypatch):
    """Unrelated fingerprints meet in few nodes however many share a block; only a crowd of near copies is dealt in chunks."""
    monkeypatch.setattr(simhash, "NODE_LIMIT", 16)
    rng = np.random.default_rng(3)
    marks = np.unique((rng.integers(1 << 47, size=2000) << 16) | 77).tolist()  # all of one value in a block
    df = spark.createDataFrame([(m, m) for m in marks], "fp long, rep long")
    assert simhash.dealt(df).count() <= 7 * len(marks)  # three light blocks, and four nodes below the heavy one
    near = marks[:40] + [marks[k] ^ (1 << 20) ^ (1 << 40) ^ (1 << 60) for k in range(40)]
    links = connected_components(simhash.near_links(spark.createDataFrame([(m, m) for m in sorted({*marks, *near})], "fp long, rep long"))).collect()
    labels = {r.node: r.label for r in links}
    assert all(labels[near[k]] == labels[near[k + 40]] for k in range(40))
