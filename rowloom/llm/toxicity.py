"""Toxicity by FTRL-proximal logistic regression.

Features are the hashed words, word pairs and skip-grams (pairs with one word
between) that a text holds, once each. Each weight has its own learning rate and
an L1 threshold that keeps it at zero until the evidence is large, so the model
is a few thousand numbers however large the hash space, and is small to send.

The fit takes an expected SAMPLE_ROWS labelled rows at most, chosen by hash of
doc_id, in one task that streams them in a fixed order; scoring reads every
whole text.

Defined results: a null text is an empty one, and scores by the intercept alone;
several labels of one doc_id count as the largest; null labels and null doc_ids
teach nothing; with nothing to learn from every score is 0; repeated rows each
get a row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 8000
SEED = 42
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
#: How often a toxic row counts; they are the fewer.
TOXIC_WEIGHT = 3.0
BITS = 26
FILTER_BITS = 22
#: Bytes of text whose words are hashed at once.
PIECE = 4_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.cumprod(np.full(1024, 0x100000001B3, np.uint64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; words are runs of letters and digits, A-Z as a-z."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = np.concatenate([[False], _WORD[raw], [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    lengths = np.flatnonzero(inside[:-1] & ~inside[1:]) - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    values = (raw[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
    hashes = np.add.reduceat(values, firsts)
    return (hashes ^ (hashes >> np.uint64(29))) * _MIX


def _pieces(text: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE and (cut := text.find(b" ", at + PIECE)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(text: bytes) -> np.ndarray:
    """The hashed features of a text, with repeats."""
    words = np.concatenate([word_hashes(piece) for piece in _pieces(text)])
    out = [words]
    for gap, salt in ((1, _SALTS[0]), (2, _SALTS[1])):
        out.append((words[:-gap] * salt) ^ (words[gap:] * _SALTS[2]))
    joined = np.concatenate(out) * _MIX
    return (joined >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    """Sparse weights by hashed feature."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, intercept: float | None):
        self.places, self.weights, self.intercept = places, weights, intercept
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[places & ((1 << FILTER_BITS) - 1)] = True

    def score(self, text: bytes) -> float:
        if self.intercept is None:
            return 0.0
        f = features(text)
        f = np.unique(f[self.maybe[f & ((1 << FILTER_BITS) - 1)]])
        total = self.intercept
        if len(f) and len(self.places):
            at = np.minimum(np.searchsorted(self.places, f), len(self.places) - 1)
            total += float(self.weights[at[self.places[at] == f]].sum())
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, total)))))


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Places, weights and intercept from (unique features, label) rows."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), None
    places = np.unique(np.concatenate([f for f, _ in rows]))
    compact = [(np.append(np.searchsorted(places, f), len(places)), y) for f, y in rows]
    z, n = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    l1 = np.full(len(places) + 1, L1)
    l1[-1] = 0.0  # the intercept

    def weights(at) -> np.ndarray:
        short = np.abs(z[at]) <= l1[at]
        return np.where(short, 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in order.permutation(len(compact)):
            at, label = compact[k]
            w = weights(at)
            error = (1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - label) * (TOXIC_WEIGHT if label else 1.0)
            rate = (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / ALPHA
            z[at] += error - rate * w
            n[at] += error * error
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w[:-1])
    return places[kept], w[kept], float(w[-1])


def held_out(divisor: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(features(t.as_py() or b"")).astype(np.int32).tobytes() for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(found, pa.binary()), batch.column("toxic")], names=["place", "features", "toxic"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += [(np.frombuffer(f, np.int32).astype(np.int64), label) for f, label in zip(batch.column("features").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
    if rows:
        places, weights, intercept = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array([places.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([intercept], pa.float64())], names=["places", "weights", "intercept"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of labels.toxic, from rows that aren't held out."""
    taught = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = taught.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = taught.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample has some sample_rows rows of a few bytes each; its features go to the one task that fits.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.select(F.xxhash64(F.lit(SEED), "doc_id").alias("place"), "text", "toxic").mapInArrow(_extracted, "place long, features binary, toxic int")
    sample = found.repartition(1).sortWithinPartitions("place", "features").select("features", "toxic")
    found = sample.mapInArrow(_fitted, "places binary, weights binary, intercept double").collect()
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    return Model(np.frombuffer(found[0]["places"], np.int64), np.frombuffer(found[0]["weights"]), found[0]["intercept"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    sent = (model.places, model.weights, model.intercept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent)
        for batch in batches:
            scores = np.array([own.score(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
