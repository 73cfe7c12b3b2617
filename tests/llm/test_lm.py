import math
import random
from collections import Counter

import numpy as np

from rowloom.llm import lm
from tests.conftest import SF


def plain_counts(texts):
    out = Counter()
    for t in texts:
        out.update(map(lm.key_of, (t or "").lower().split()))
    return out


def plain_score(model, counts, text):
    """Each word's log-probability from its window, one at a time."""
    w = {k: v.astype(float) for k, v in lm.Network.read(model.flat).weights.items()}
    words = [lm.key_of(t) for t in (text or "").lower().split()]
    ids = lm.Encoder(model.keys).encode(text).tolist()
    padded = [lm.PAD, lm.PAD, *ids, lm.PAD, lm.PAD]
    totals = [1 + sum(n for k, n in counts.items() if k % lm.OTHERS == b and k not in model.keys) for b in range(lm.OTHERS)]
    total = 0.0
    for i, (token, word) in enumerate(zip(ids, words, strict=True)):
        hidden = w["bias"].copy()
        for k, offset in enumerate(lm.OFFSETS):
            hidden += w["embed"][k][padded[i + 2 + offset]]
        hidden = np.tanh(hidden)
        kind, member = divmod(token, lm.MEMBERS)
        for logits, own in ((hidden @ w["to_class"] + w["class_bias"], kind), (hidden @ w["to_member"][kind] + w["member_bias"][kind], member)):
            total += logits[own] - math.log(np.exp(logits - logits.max()).sum()) - logits.max()
        if token >= lm.TOKENS - lm.OTHERS:
            total += math.log(counts.get(word, 0) or lm.OTHERS / 2**64) - math.log(totals[word % lm.OTHERS])
    return len(ids), total


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5000)  # several chunks, and several parts of words
    monkeypatch.setattr(lm, "SLICED", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "the xqzv1 the"), (-2, None), (None, "xqzv2")], "doc_id long, text string"))
    model = lm.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = plain_counts(texts.values())
    top = sorted(counts, key=lambda k: (-counts[k], k))[: lm.TOKENS - lm.OTHERS]
    assert model.keys == top
    assert model.shared == [sum(n for k, n in counts.items() if k % lm.OTHERS == b and k not in set(top)) for b in range(lm.OTHERS)]
    others = spark.createDataFrame([(1, "the the"), (2, "neverseen1 neverseen2"), (3, "xqzv1 xqzv2"), (4, ""), (5, "the xqzv1 neverseen1 the")], "doc_id long, text string")
    found = {}
    for these in (docs.where("doc_id < 20 OR doc_id IS NULL"), others):
        rows = lm.score(these, model).collect()
        assert len(rows) == these.count()
        own = {r.doc_id: r.text for r in these.collect()}
        for r in rows:
            n, total = plain_score(model, counts, own[r.doc_id])
            assert r.n_tokens == n and math.isclose(r.score, total, rel_tol=1e-3, abs_tol=1e-2) and (n == 0 or math.isclose(r["mean"], total / n, rel_tol=1e-3))
            found[r.doc_id] = r.score
    assert found[2] < found[3] - 20  # words that were never counted are the least likely ones
    # The query's own path gives what scoring by the fitted model gives.
    direct = {r.doc_id: r.score for r in lm.fit_and_score(docs).collect()}
    assert len(direct) == len(texts) and all(math.isclose(direct[r.doc_id], r.score, rel_tol=1e-5, abs_tol=1e-4) for r in lm.score(docs, model).collect())


def test_a_model_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4000)  # many shards, averaged in three levels
    monkeypatch.setattr(lm, "FAN_IN", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in lm.fit_and_score(docs.repartition(n)).collect()} for n in (1, 64))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-5, abs_tol=1e-3) for k in one)


def test_held_out_likelihood_beats_unigrams_and_bigrams(spark):
    """Of the tokens, the rarer words' shares left aside."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    taught, held = docs.where("doc_id % 4 > 0"), docs.where("doc_id % 4 = 0")
    model = lm.fit(taught)
    encoder, network = lm.Encoder(model.keys), lm.Network.read(model.flat)
    known, new = ([encoder.encode(r.text) for r in d.collect()] for d in (taught, held))
    share = np.bincount(np.concatenate(known), minlength=lm.TOKENS) + 0.5
    share = share / share.sum()
    pairs, before = Counter(), Counter()
    for ids in known:
        pairs.update(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))
        before.update(ids[:-1].tolist())

    def bigram(weight):
        chance = lambda a, b: (pairs.get((a, b), 0) + weight * share[b]) / (before.get(a, 0) + weight)
        return np.mean([math.log(chance(a, b)) if a is not None else math.log(share[b]) for ids in new for a, b in zip([None, *ids[:-1].tolist()], ids.tolist(), strict=True)])

    parts = [network.run(x, np.flatnonzero(x != lm.PAD), False) for x, _ in lm.buffers(iter(new))]
    ours = np.concatenate(parts).mean()
    assert ours > max(bigram(w) for w in (10, 50, 200)) and ours > np.log(share[np.concatenate(new)]).mean() + 0.2


def test_order_matters(spark):
    rng = random.Random(0)
    words = [f"w{k}" for k in range(12)]
    line = lambda s: " ".join(words[(s + k) % 12] for k in range(200))
    docs = spark.createDataFrame([(k, line(k)) for k in range(600)], "doc_id long, text string")
    mixed = line(0).split()
    rng.shuffle(mixed)
    probe = spark.createDataFrame([(0, line(3)), (1, " ".join(mixed))], "doc_id long, text string")
    means = {r.doc_id: r.mean for r in lm.score(probe, lm.fit(docs)).collect()}
    assert means[0] > -0.5 and means[0] > means[1] + 1


def test_gradients():
    """Each step's direction against differences of the mean log-probability."""
    rng = np.random.default_rng(1)
    shares = np.full(lm.TOKENS, 1 / lm.TOKENS)
    x = np.concatenate([[lm.PAD] * 2, rng.integers(0, 60, 40), [lm.PAD] * 2]).astype(np.int16)
    at = np.arange(2, 42)
    network = lm.Network.start(shares)
    network.weights = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in network.weights.items()}
    found = {}
    network._step = lambda name, gradient, place=...: found.setdefault(name, []).append((place, gradient))
    network.run(x, at, True)
    loss = lambda: -network.run(x, at, False).mean()
    for name, parts in found.items():
        full = np.zeros(lm.SHAPES[name])
        for place, gradient in parts:
            full[place] += gradient
        for flat in np.argsort(-np.abs(full).ravel())[:3]:
            index = np.unravel_index(flat, full.shape)
            old, step = network.weights[name][index], 1e-5
            network.weights[name][index] = old + step
            high = loss()
            network.weights[name][index] = old - step
            low = loss()
            network.weights[name][index] = old
            assert math.isclose((high - low) / (2 * step), full[index], rel_tol=1e-3, abs_tol=1e-6), name


def test_awkward_rows(awkward, no_rows):
    model = lm.fit(awkward)
    rows = lm.score(awkward, model).collect()
    assert len(rows) == awkward.count() == lm.fit_and_score(awkward).count()
    blank = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {(r.n_tokens, r.score, r["mean"]) for r in blank} == {(0, 0.0, None)}
    assert next(r.n_tokens for r in rows if r.doc_id == 7) == 60_000
    copies = [r.score for r in rows if r.doc_id in (1, 2)]
    assert len(copies) == 3 and max(copies) - min(copies) < 1e-3
    assert lm.score(no_rows, model).collect() == [] and lm.fit_and_score(no_rows).collect() == []
    assert len(lm.score(awkward, lm.fit(no_rows)).collect()) == awkward.count()


def test_words_of_repeated_documents_are_likelier(spark):
    """Of two documents of words of their own, the one that occurs twice scores better."""
    rng = random.Random(5)
    fill = lambda: " ".join(rng.choice("abcdefgh") * 2 for _ in range(40))
    own = lambda k: " ".join(f"own{k}word{j}" for j in range(20))
    rows = [(k, fill() + " " + own(k)) for k in range(3000)]
    rows += [(3000 + k, rows[k][1]) for k in range(300)]
    means = {r.doc_id: r["mean"] for r in lm.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice, once = [means[k] for k in range(300)], [means[k] for k in range(300, 3000)]
    assert np.mean([t > np.quantile(once, 0.9) for t in twice]) > 0.9
