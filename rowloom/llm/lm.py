"""Language-model scores by masked pseudo-likelihood.

A small network looks at two tokens on either side of each token and predicts
it: an embedding for each place in the window, one hidden layer, and a softmax
in two steps (a class of tokens, then the token in it). A document's score is
the sum of the log-probabilities of all its tokens, each given its window.

Tokens are lower-cased words between white space: the most frequent of the
whole corpus have ids of their own, all others share OTHERS ids by hash. A word
of a shared id has that id's probability times its own counted share of the id,
so every word has a probability of its own, and the vocabulary grows with the
corpus. Each shared id keeps a count of one for words that are not counted (only
other documents than the counted ones have any), dealt evenly to its keys.

Words are counted by chunks of documents. A chunk's distinct words are dealt in
slices by ranges of their hashes; the slices of a range meet in one task, which
answers each with its words' counts over the corpus, and the answers meet their
chunk's texts again. No word is held by more than one row of a chunk, so a very
frequent one is no load.

The network is trained on every window of every document. Documents are dealt
by hash to shards of some SHARD_TOKENS tokens, whose number thus follows from
the corpus alone; in each of ROUNDS rounds every shard trains on a part of its
documents, in order of their hashes, from the same weights, and the shards'
weights are averaged by their numbers of tokens in a tree of FAN_IN to one. So
a model does not depend on how the rows are laid out in files or partitions.

Defined results: a null or blank text has no tokens, score 0 and a null mean;
rows are independent, so repeated rows and null ids keep a row each; an empty
table gives an empty result; other columns are ignored. Of rows that agree in
doc_id and text each has its share in training, in whatever shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import stored, tasks

CLASSES, MEMBERS = 32, 64
TOKENS = CLASSES * MEMBERS
OTHERS = 64
PAD = TOKENS
OFFSETS = (-2, -1, 1, 2)
WIDTH = 16
SEED = 42
RATE = 0.1
START_SQUARE = 1e-6
#: Windows of a training step: this many at first, twice as many after each GROW steps, BATCH at most.
FIRST_BATCH, GROW, BATCH = 256, 16, 16384
#: Tokens of documents that are brought together to be trained on or scored.
BUFFER = 1 << 17
#: Words that an encoder remembers at a time.
MEMO = 500_000
#: Words from which a chunk of documents ends.
CHUNK = 1 << 21
#: Words of chunks that meet in one task to be counted.
SLICED = 1 << 18
#: Tokens of a shard, rounds of training, and weights that are averaged at once.
SHARD_TOKENS, ROUNDS, FAN_IN = 1 << 21, 4, 16
SHAPES = {"embed": (len(OFFSETS), TOKENS + 1, WIDTH), "bias": (WIDTH,), "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,), "to_member": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


def key_of(word: str) -> int:
    """The signed 64-bit hash by which words are counted and known."""
    return (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)


class Encoder(dict):
    """Token ids by word: frequent words, most frequent first, then the shared ids."""

    def __init__(self, keys: list[int]):
        super().__init__()
        self.keys_ = {w: k for k, w in enumerate(keys[: TOKENS - OTHERS])}

    def __missing__(self, word: str) -> int:
        key = key_of(word)
        found = self.keys_.get(key)
        if found is None:
            found = TOKENS - OTHERS + key % OTHERS
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int16, len(words))


#: Logits above this count as this, so that no exponential overflows.
HIGHEST = 60.0


def softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    np.minimum(x, HIGHEST, out=x)
    np.exp(x, out=x)
    # A product with ones is faster than a sum over short rows.
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype) + x.dtype.type(1e-30)))[:, None]
    return x


class Network:
    """Weights, and the sums of squared gradients by which their steps are scaled."""

    def __init__(self, weights: dict[str, np.ndarray], squares: dict[str, np.ndarray] | None = None, steps: int = 0):
        self.weights, self.steps = weights, steps
        self.squares = {k: np.full_like(v, START_SQUARE) for k, v in weights.items()} if squares is None else squares

    @classmethod
    def start(cls, shares: np.ndarray) -> Network:
        """A network that predicts each token by its share of the corpus."""
        random = np.random.default_rng(SEED)
        w = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        for k in ("embed", "to_class", "to_member"):
            w[k] = (random.standard_normal(SHAPES[k]) * 0.1).astype(np.float32)
        by_class = shares.reshape(CLASSES, MEMBERS)
        w["class_bias"] = np.log(by_class.sum(axis=1)).astype(np.float32)
        w["member_bias"] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(w)

    @classmethod
    def read(cls, flat: bytes) -> Network:
        values, at = np.frombuffer(flat, np.float32), 0
        both: list[dict[str, np.ndarray]] = [{}, {}]
        for part in both:
            for k, shape in SHAPES.items():
                n = int(np.prod(shape))
                part[k] = values[at : at + n].reshape(shape).copy()
                at += n
        return cls(*both, int(values[at]))

    def flat(self) -> np.ndarray:
        return np.concatenate([*(part[k].ravel() for part in (self.weights, self.squares) for k in SHAPES), np.array([self.steps], np.float32)]).astype(np.float32)

    def _step(self, name: str, gradient: np.ndarray, at=...) -> None:
        squares = self.squares[name]
        squares[at] += gradient * gradient
        self.weights[name][at] -= RATE * gradient / np.sqrt(squares[at])

    def train(self, x: np.ndarray) -> int:
        """Train on all windows of a buffer; their number."""
        places = np.flatnonzero(x != PAD)
        at = 0
        while at < len(places):
            size = min(BATCH, FIRST_BATCH << min(20, self.steps // GROW))
            self.run(x, places[at : at + size], True)
            at += size
            self.steps += 1
        return len(places)

    def run(self, x: np.ndarray, at: np.ndarray, train: bool) -> np.ndarray:
        """Log-probabilities of the tokens x[at] in their windows; x is padded by PAD on both sides of each text."""
        w, n = self.weights, len(at)
        around = [x[at + o] for o in OFFSETS]
        hidden = w["embed"][0][around[0]]
        for k in range(1, len(OFFSETS)):
            hidden += w["embed"][k][around[k]]
        hidden += w["bias"]
        np.tanh(hidden, out=hidden)
        kinds, member = np.divmod(x[at], np.int16(MEMBERS))
        order = np.argsort(kinds, kind="stable")
        bounds = np.searchsorted(kinds[order], np.arange(CLASSES + 1))
        row = np.arange(n)
        p = softmax(hidden @ w["to_class"] + w["class_bias"])
        out = np.log(p[row, kinds] + 1e-30)
        back = None
        if train:
            p[row, kinds] -= 1
            back = p @ w["to_class"].T
            steps = [("to_class", hidden.T @ p / n, ...), ("class_bias", p.sum(axis=0) / n, ...)]
        for c in range(CLASSES):
            rows = order[bounds[c] : bounds[c + 1]]
            if not len(rows):
                continue
            h, m = hidden[rows], member[rows]
            q = softmax(h @ w["to_member"][c] + w["member_bias"][c])
            own = np.arange(len(rows))
            out[rows] += np.log(q[own, m] + 1e-30)
            if train:
                q[own, m] -= 1
                back[rows] += q @ w["to_member"][c].T
                steps += [("to_member", h.T @ q / n, c), ("member_bias", q.sum(axis=0) / n, c)]
        if train:
            back *= 1 - hidden * hidden
            back /= n
            for name, gradient, place in steps:
                self._step(name, gradient, place)
            self._step("bias", back.sum(axis=0))
            for k, ids in enumerate(around):
                by_id = np.argsort(ids, kind="stable")
                seen, first = np.unique(ids[by_id], return_index=True)
                self._step("embed", np.add.reduceat(back[by_id], first, axis=0), (k, seen))
        return out


def buffers(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Padded tokens of many encoded texts, and the texts' lengths; a very long text is a buffer of its own."""
    pad = np.full(2, PAD, np.int16)
    held, lengths, total = [pad], [], 0
    for ids in texts:
        held += [ids, pad]
        lengths.append(len(ids))
        total += len(ids) + 2
        if total >= BUFFER:
            yield np.concatenate(held), lengths
            held, lengths, total = [pad], [], 0
    if lengths:
        yield np.concatenate(held), lengths


class Places(dict):
    """Numbers of words, in the order in which they first occur."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def chunked(docs: DataFrame) -> DataFrame:
    """A row for each text (chunk, doc_id, mark, n, places), and one for each chunk (chunk, keys, counts) of its distinct words.

    The texts' words are places in the chunk's keys, compressed. mark is a hash
    of the row, by which it is dealt to shards.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("*", F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), "text").alias("mark"))
    names = ["chunk", "doc_id", "mark", "n", "places", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, chunk, places, counts, seen = pa.Codec("zstd"), TaskContext.get().partitionId() << 32, Places(), np.zeros(0, np.int64), {}

        def listed(id_type: pa.DataType) -> pa.RecordBatch:
            keys = np.array([key_of(w) for w in places], np.int64)
            nulls = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.int32(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *nulls, pa.array([keys.tobytes()], pa.binary()), pa.array([codec.compress(counts.tobytes(), asbytes=True)], pa.binary())], names=names)

        id_type = None
        for batch in batches:
            ids, marks, held, start = batch.column("doc_id"), batch.column("mark").to_pylist(), [], 0
            id_type = ids.type
            for k, text in enumerate(batch.column("text"), 1):
                words = (text.as_py() or "").lower().split()
                held.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                full = counts.sum() + sum(map(len, held)) >= CHUNK if len(held) % 64 == 0 or len(words) >= CHUNK else False
                if full or k == batch.num_rows:
                    n = len(held)
                    packed = pa.array([codec.compress(x.tobytes(), asbytes=True) for x in held], pa.binary())
                    own = []
                    for mark in marks[start : start + n]:  # equal rows go to shards of their own
                        own.append(mark if mark not in seen else key_of(f"{mark} {seen[mark]}"))
                        seen[mark] = seen.get(mark, 0) + 1
                    columns = [pa.array(np.full(n, chunk)), ids.slice(start, n), pa.array(own, pa.int64()), pa.array([len(x) for x in held], pa.int32()), packed]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
                    found = np.bincount(np.concatenate(held), minlength=len(places))
                    found[: len(counts)] += counts
                    counts, held, start = found, [], start + n
                if full or (k == batch.num_rows and counts.sum() >= CHUNK):
                    yield listed(id_type)
                    chunk, places, counts, seen = chunk + 1, Places(), np.zeros(0, np.int64), {}
        if seen:
            yield listed(id_type)

    return rows.mapInArrow(run, f"chunk long, doc_id {kind}, mark long, n int, places binary, keys binary, counts binary")


def _unsigned(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) ^ np.uint64(1 << 63)


def _sliced(bits: int):
    """The words of chunks in slices by the first bits of their keys, in order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for chunk, keys, counts, adds, asks in zip(*(batch.column(n).to_pylist() for n in ("chunk", "keys", "counts", "adds", "asks")), strict=True):
                own = np.frombuffer(keys, np.int64)
                order = np.argsort(own)
                own, n = own[order], len(order)
                found = np.frombuffer(codec.decompress(counts, n * 8), np.int64)[order] if n else np.zeros(0, np.int64)
                parts = (_unsigned(own) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
                starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if n else []
                ends = [*starts[1:], n]
                columns = [pa.array(parts[starts] if n else [], pa.int64()), pa.array([chunk] * len(starts), pa.int64()), pa.array([own[a:b].tobytes() for a, b in zip(starts, ends, strict=False)], pa.binary())]
                columns += [pa.array([codec.compress(found[a:b].tobytes(), asbytes=True) for a, b in zip(starts, ends, strict=False)], pa.binary()), pa.array([adds] * len(starts)), pa.array([asks] * len(starts))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "keys", "counts", "adds", "asks"])

    return run


COUNTED = "chunk long, part long, size int, totals binary, keys array<long>, counts array<long>, shared array<long>"


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each slice's words over those slices that add to them, and each part's frequent words; rows come by part."""
    codec, part = pa.Codec("zstd"), None
    held: list[tuple] = []
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]

    def answered() -> Iterator[pa.RecordBatch]:
        keys = [np.frombuffer(k, np.int64) for _, k, _, _, _ in held]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        added = np.concatenate([np.frombuffer(codec.decompress(c, len(k) * 8), np.int64) * adds for k, (_, _, c, adds, _) in zip(keys, held, strict=True)])
        totals = np.bincount(at, added, len(every)).astype(np.int64)
        known = np.flatnonzero(totals)
        top = known[np.lexsort((every[known], -totals[known]))[: TOKENS - OTHERS]]
        shared = np.bincount(every % OTHERS, totals, OTHERS).astype(np.int64)
        rows = [(None, part, None, None, every[top], totals[top], shared)]
        ends = np.cumsum([len(k) for k in keys])
        rows += [(chunk, part, len(k), codec.compress(totals[at[end - len(k) : end]].tobytes(), asbytes=True), None, None, None) for k, end, (chunk, _, _, _, asks) in zip(keys, ends, held, strict=True) if asks]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in COUNTED.split(", ")])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("part", "chunk", "keys", "counts", "adds", "asks")]
        for p, *row in zip(*columns, strict=True):
            if p != part:
                if held:
                    yield from answered()
                part, held = p, []
            held.append(tuple(row))
    if held:
        yield from answered()


def words_of(chunks: DataFrame) -> DataFrame:
    """(chunk, keys, counts): the counted words of stored chunks."""
    return chunks.where("keys IS NOT NULL").select("chunk", "keys", "counts")


def counted(asking: DataFrame | None, adding: DataFrame) -> DataFrame:
    """COUNTED, stored: for each slice of the asking words their counts in the adding words, and the adding words' most frequent by part.

    asking is None where the adding words ask themselves.
    """
    words = adding.select("*", F.lit(True).alias("adds"), F.lit(asking is None).alias("asks"))
    if asking is not None:
        words = words.union(asking.select("*", F.lit(False).alias("adds"), F.lit(True).alias("asks")))
    size = words.agg(F.sum(F.length("keys") / 8)).first()[0] or 0
    bits = max(0, ceil(log2(max(1, size / SLICED))))
    slices = words.mapInArrow(_sliced(bits), "part long, chunk long, keys binary, counts binary, adds boolean, asks boolean")
    return stored(slices.repartition(tasks(words), "part").sortWithinPartitions("part").mapInArrow(_totalled, COUNTED))


def vocabulary(counts: DataFrame) -> tuple[list[int], np.ndarray, list[int]]:
    """The keys of the frequent words, each token's share of the corpus, and the words of each shared id."""
    found = counts.where("shared IS NOT NULL")
    words = found.select(F.explode(F.arrays_zip("keys", "counts")).alias("w")).select("w.keys", "w.counts")
    top = words.orderBy(F.desc("counts"), "keys").limit(TOKENS - OTHERS).collect()
    shared = [0] * OTHERS
    for r in found.select(F.posexplode("shared").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect():
        shared[r["id"]] = r["n"]
    for r in top:
        shared[r["keys"] % OTHERS] -= r["counts"]
    shares = np.full(TOKENS, 0.5)
    shares[: len(top)] += np.array([r["counts"] for r in top], float)
    shares[TOKENS - OTHERS :] += sum(shared) / OTHERS
    return [r["keys"] for r in top], shares / shares.sum(), shared


ENCODED = "mark long, ids binary, shares double"


def encoded(chunks: DataFrame, counts: DataFrame, keys: list[int], shared: list[int]) -> DataFrame:
    """(doc_id, mark, ids, shares) of chunked texts: their tokens, and the sum of the logarithms of their words' shares of shared ids."""
    known = np.array(keys, np.int64)
    by_key = np.argsort(known)
    totals = np.array(shared, float) + 1
    names = ["doc_id", "mark", "ids", "shares"]

    def run(texts: pa.Table, slices: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        listed = [k for k in texts.column("keys").to_pylist() if k is not None]
        own = np.frombuffer(listed[0], np.int64) if listed else np.zeros(0, np.int64)
        order = np.argsort(own)
        found = np.zeros(len(own), np.int64)
        parts = sorted(zip(*(slices.column(c).to_pylist() for c in ("part", "size", "totals")), strict=True))
        at = 0
        for _, size, packed in parts:
            found[order[at : at + size]] = np.frombuffer(codec.decompress(packed, size * 8), np.int64)
            at += size
        tokens = (TOKENS - OTHERS + own % OTHERS).astype(np.int16)
        if len(known):
            place = np.minimum(np.searchsorted(known[by_key], own), len(known) - 1)
            is_known = known[by_key][place] == own
            tokens[is_known] = by_key[place[is_known]]
        logs = np.zeros(len(own))
        rare = tokens >= TOKENS - OTHERS
        logs[rare] = np.log(np.where(found[rare] > 0, found[rare], OTHERS / 2.0**64) / totals[tokens[rare] - (TOKENS - OTHERS)])
        rows = texts.filter(texts.column("keys").is_null())
        made, sums = [], []
        for packed, n in zip(rows.column("places"), rows.column("n").to_pylist(), strict=True):
            at = np.frombuffer(codec.decompress(packed.as_buffer(), n * 4), np.int32) if n else np.zeros(0, np.int32)
            made.append(tokens[at].tobytes())
            sums.append(float(logs[at].sum()))
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("mark"), pa.array(made, pa.binary()), pa.array(sums, pa.float64())], names=names)

    answers = counts.where("chunk IS NOT NULL").select(F.col("chunk").alias("of"), "part", "size", "totals")
    schema = f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, {ENCODED}"
    return chunks.drop("counts").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, schema)


def sharded(texts: DataFrame, tokens: int) -> DataFrame:
    """Encoded texts with shard and round, stored; the rows of a shard in order."""
    shards = max(1, ceil(tokens / SHARD_TOKENS))
    placed = texts.withColumn("shard", F.pmod("mark", F.lit(shards))).withColumn("round", F.pmod(F.xxhash64("mark"), F.lit(ROUNDS)).cast("int"))
    return stored(placed.repartition(tasks(texts), "shard").sortWithinPartitions("round", "shard", "mark"))


def _arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(ids.as_py(), np.int16) for ids in batch.column("ids"))


MODEL = "id long, flat binary, tokens long"


def _model(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["id", "flat", "tokens"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The means of models whose ids share a quotient by FAN_IN; rows come by id."""
    of, total, weight = None, np.zeros(0), 0
    for batch in batches:
        for id_, flat, tokens in zip(batch.column("id").to_pylist(), batch.column("flat"), batch.column("tokens").to_pylist(), strict=True):
            if of is not None and id_ // FAN_IN != of:
                yield _model([(of, (total / weight).astype(np.float32).tobytes(), weight)])
                of = None
            values = np.frombuffer(flat.as_py(), np.float32).astype(np.float64) * tokens
            of, total, weight = (id_ // FAN_IN, values, tokens) if of is None else (of, total + values, weight + tokens)
    if of is not None:
        yield _model([(of, (total / weight).astype(np.float32).tobytes(), weight)])


def train(texts: DataFrame, shares: np.ndarray, tokens: int) -> bytes:
    """The weights trained on all stored, sharded texts."""
    flat = Network.start(shares).flat().tobytes()
    for k in range(ROUNDS):
        begun = flat

        def run(batches: Iterator[pa.RecordBatch], begun: bytes = begun) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
                for batch in batches:
                    ids = batch.column("shard").to_numpy()
                    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
                    yield from ((int(ids[a]), batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)

            feed = pieces()
            ahead = next(feed, None)
            while ahead is not None:
                shard, network, trained = ahead[0], Network.read(begun), 0

                def own(shard: int = shard) -> Iterator[np.ndarray]:
                    nonlocal ahead
                    while ahead is not None and ahead[0] == shard:
                        yield from _arrays(ahead[1])
                        ahead = next(feed, None)

                for x, _ in buffers(own()):
                    trained += network.train(x)
                if trained:
                    yield _model([(shard, network.flat().tobytes(), trained)])

        models = texts.where(F.col("round") == k).select("shard", "ids").mapInArrow(run, MODEL)
        left = max(1, ceil(tokens / SHARD_TOKENS))
        while True:
            left = ceil(left / FAN_IN)
            groups = F.floor(F.col("id") / FAN_IN)
            models = models.repartition(min(tasks(texts), left), groups).sortWithinPartitions("id").mapInArrow(_averaged, MODEL)
            if left == 1:
                break
        found = models.collect()  # one
        flat = bytes(found[0]["flat"]) if found else flat
    return flat


def score_encoded(texts: DataFrame, flat: bytes) -> DataFrame:
    """(doc_id, n_tokens, score, mean) for each encoded text, with its words' shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.read(flat)
        for batch in batches:
            lengths: list[int] = []
            sums: list[float] = []
            for x, sizes in buffers(_arrays(batch)):
                places = np.flatnonzero(x != PAD)
                parts = [network.run(x, places[at : at + BATCH], False) for at in range(0, len(places), BATCH)]
                running = np.concatenate([[0.0], np.cumsum(np.concatenate([np.zeros(0), *parts]), dtype=np.float64)])
                ends = np.cumsum(sizes)
                sums += (running[ends] - running[ends - sizes]).tolist()
                lengths += sizes
            sums = [a + b for a, b in zip(sums, batch.column("shares").to_pylist(), strict=True)]
            means = [s / n if n else None for s, n in zip(sums, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_tokens", "score", "mean"])

    rows = texts.select("doc_id", "ids", "shares")
    return rows.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double, mean double")


@dataclass(frozen=True)
class Model:
    """The keys of the frequent words, the numbers of words of shared ids, the weights, and the counted words of the corpus by chunk."""

    keys: list[int]
    shared: list[int]
    flat: bytes
    words: DataFrame


def _fitted(docs: DataFrame) -> tuple[Model, DataFrame]:
    chunks = stored(chunked(docs))
    counts = counted(None, words_of(chunks))
    keys, shares, shared = vocabulary(counts)
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    texts = sharded(encoded(chunks, counts, keys, shared), tokens)
    return Model(keys, shared, train(texts, shares, tokens), words_of(chunks)), texts


def fit(docs: DataFrame) -> Model:
    """A model of all documents, each text read once."""
    return _fitted(docs)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, score, mean) for each row by a fitted model."""
    chunks = stored(chunked(docs))
    counts = counted(words_of(chunks), model.words)
    return score_encoded(encoded(chunks, counts, model.keys, model.shared), model.flat)


def fit_and_score(docs: DataFrame) -> DataFrame:
    """The scores of documents by a model trained on them, each text read once."""
    model, texts = _fitted(docs)
    return score_encoded(texts, model.flat)
