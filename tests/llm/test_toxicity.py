import re
import zlib

import numpy as np

from rowloom.llm import toxicity
from tests.conftest import SF


def test_features_are_words_pairs_and_skips():
    text = "Stupid, the É cat\tsat 42!".encode()
    words = toxicity.word_hashes(text)
    assert len(words) == 6 and len(set(words.tolist())) == 6
    same = toxicity.word_hashes("x stupid y CAT".encode())
    assert same[1] == words[0] and same[3] == words[3]
    assert len(toxicity.features(text)) == 6 + 5 + 4
    assert len(toxicity.features(b"")) == len(toxicity.features(b" .. ")) == 0 and len(toxicity.features(b"a")) == 1


def test_pieces_hold_all_words(monkeypatch):
    text = b"ab cd efg " * 500
    whole = toxicity.word_hashes(text)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert np.array_equal(np.concatenate([toxicity.word_hashes(p) for p in toxicity._pieces(text)]), whole)


def test_updates_are_ftrl_proximal():
    """The vectorized training against the algorithm written out, a weight at a time."""
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 30, 6)), int(rng.random() < 0.5)) for _ in range(50)]
    places, weights, intercept = toxicity.train(rows)
    z, n = {}, {}
    a, b, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L2

    def weight(i):
        l1 = 0.0 if i == "b" else toxicity.L1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((b + np.sqrt(n.get(i, 0.0))) / a + l2)

    order = np.random.default_rng(toxicity.SEED)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            f, y = rows[k]
            own = [*f.tolist(), "b"]
            w = [weight(i) for i in own]
            g = (1 / (1 + np.exp(-sum(w))) - y) * (toxicity.TOXIC_WEIGHT if y else 1)
            for i, wi in zip(own, w, strict=True):
                z[i] = z.get(i, 0.0) + g - (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / a * wi
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "b" and weight(i)}
    assert dict(zip(places.tolist(), weights.tolist(), strict=True)).keys() == want.keys()
    assert np.allclose(weights, [want[i] for i in places.tolist()]) and np.isclose(intercept, weight("b"))


def test_held_out_documents(spark):
    base = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.places) < 20_000
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    wrong_alarms = sum(p and not t for p, t in held) / sum(not t for _, t in held)
    found = sum(p and t for p, t in held) / sum(t for _, t in held)
    assert wrong_alarms < 0.01 and found > 0.75
    insult = re.compile(r"(?i)\b(idiot|loser|moron|scum|pathetic)\b")
    texts = {r.doc_id: r.text for r in docs.collect()}
    insulting = [r for r in rows if len(insult.findall(texts[r.doc_id])) >= 3]
    assert sum(r.predicted for r in insulting) / len(insulting) > 0.9


def test_awkward_rows(spark, awkward, no_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, None), (6, 0), (7, 0), (8, 0), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count()
    blank = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1
    assert toxicity.score(no_rows, model).collect() == []
    for nothing in (toxicity.fit(no_rows, labels), toxicity.fit(awkward, labels.limit(0))):
        assert {(r.score, r.predicted) for r in toxicity.score(awkward, nothing).collect()} == {(0.0, 0)}
