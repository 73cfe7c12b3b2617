"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a sample of the vectors is cut into balanced parts, so that
neighbours mostly fall into one part; a small classifier then learns to tell a
vector's part. Large tables have parts within parts: each is cut again by a
sample and a classifier of its own, so the number of parts goes on growing as
about the square root of the table. Every vector is indexed under its most
probable part, a query is sent to its most probable parts, and what is found
there is ranked by the exact cosine. The number of parts asked is the least with
which the sample's own neighbours are found again; a query that finds fewer than
k so is sent to all parts.

Each fit sees at most an expected SAMPLE_ROWS vectors (chosen by hash); the
index holds all. Equal vectors are merged before: of each, the smallest ids are
kept that a result could name. Parts are dealt in cells of bounded size,
candidates by queries, so a part with a third of all vectors is ranked by many
tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; those of each length are searched among themselves, as
others have no cosine to them; ties go to the smaller vec_id; rows with one
vec_id are the query's own, so none is its candidate; null vec_ids take no part;
fewer candidates than k give fewer rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.common import stored, tasks

SAMPLE_ROWS = 8192
SEED = 42
NEIGHBOURS = 10
HIDDEN = 64
EPOCHS = 40
#: Share of the sample's neighbours that the asked parts must hold.
FOUND = 0.95
#: Candidates, and queries, of a cell.
CELL = 2048
#: Parts of one level at most, and vectors of a sample for each of them at least.
LEVEL_PARTS, SAMPLE_SHARE = 256, 32
#: There are about the square root of the number of vectors, by this, parts.
PARTS_SHARE = 8
#: Vectors of one length that are worth a router of their own.
ROUTED = 4096
#: A part's id is that of its length, of its part and of its part within that.
LENGTH, LEVEL = 1 << 32, 1 << 12


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each unit vector."""
    out = np.zeros((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 1024):
        near = vectors[at : at + 1024] @ vectors.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node of a neighbour graph: halves of halves, refined by swaps; parts is a power of two."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    random = np.random.default_rng(SEED)
    width = 1
    while width < parts:
        inside = part[a] == part[b]
        ea, eb = a[inside], b[inside]
        degree = np.maximum(1, np.bincount(ea, minlength=n))
        x = random.standard_normal(n)
        size = np.bincount(part, minlength=width)
        for _ in range(60):  # towards the smoothest function on each part that isn't constant
            x = 0.5 * x + 0.5 * np.bincount(ea, weights=x[eb], minlength=n) / degree
            x -= (np.bincount(part, weights=x * degree, minlength=width) / np.maximum(1, np.bincount(part, weights=degree, minlength=width)))[part]
            x /= np.sqrt(np.bincount(part, weights=x * x, minlength=width) / np.maximum(1, size) + 1e-30)[part]
        order = np.lexsort((x, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        side = rank * 2 >= size[part]
        for _ in range(8):  # swap the nodes that gain most, as many from either half
            across = np.bincount(ea, weights=(side[ea] != side[eb]), minlength=n)
            gain = 2 * across - np.bincount(ea, minlength=n)
            moved = 0
            for p in range(width):
                own = np.flatnonzero((part == p) & (gain > 0))
                low, high = own[~side[own]], own[side[own]]
                m = min(len(low), len(high)) // 2
                if m:
                    for half in (low, high):
                        best = half[np.argsort(-gain[half], kind="stable")[:m]]
                        side[best] = ~side[best]
                    moved += m
            if not moved:
                break
        part = part * 2 + side
        width *= 2
    return part


class Router:
    """A network of one hidden layer that gives the log-probabilities of parts, but for a constant; and routers within the parts."""

    def __init__(self, weights: list[np.ndarray], asked: int, children: dict[int, Router] | None = None):
        self.weights, self.asked, self.children = weights, asked, children or {}

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def ranked(self, unit: np.ndarray, asked: int) -> np.ndarray:
        """The most probable parts of each unit vector."""
        w1, b1, w2, b2 = self.weights
        out = np.maximum(0, unit @ w1 + b1) @ w2 + b2
        return np.argsort(-out, axis=1, kind="stable")[:, : min(asked, self.parts)]

    def leaves(self, unit: np.ndarray, own: bool) -> list[list[int]]:
        """The parts to ask for each unit vector, or only its own, as numbers of LEVEL times the part and the part within."""
        ranked = self.ranked(unit, 1 if own else self.asked)
        out: list[list[int]] = [[] for _ in range(len(unit))]
        for column in ranked.T:
            for part in np.unique(column).tolist():
                rows = np.flatnonzero(column == part)
                child = self.children.get(part)
                within = [[0]] * len(rows) if child is None else [[x // LEVEL for x in found] for found in child.leaves(unit[rows], own)]
                for row, found in zip(rows.tolist(), within, strict=True):
                    out[row] += [part * LEVEL + x for x in found]
        return out

    def share(self) -> float:
        """The share of parts that a query asks."""
        within = [c.asked / c.parts for c in self.children.values()]
        return self.asked / self.parts * (sum(within) / len(within) if within else 1.0)


def train_router(unit: np.ndarray, part: np.ndarray, parts: int) -> Router:
    random = np.random.default_rng(SEED)
    weights = [random.standard_normal((unit.shape[1], HIDDEN)) * np.sqrt(2 / unit.shape[1]) * 4, np.zeros(HIDDEN), random.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(unit))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            x = unit[rows]
            hidden = np.maximum(0, x @ weights[0] + weights[1])
            out = hidden @ weights[2] + weights[3]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), part[rows]] -= 1
            p /= len(rows)
            back = (p @ weights[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(weights, 1)


def fit(sample: np.ndarray, total: float, share: float = FOUND) -> Router:
    """A router for about the square root of total parts, fitted on unit vectors, that asks for the share of their neighbours."""
    parts = 1
    while parts < min(LEVEL_PARTS, np.sqrt(total) / PARTS_SHARE) and parts * SAMPLE_SHARE < len(sample):
        parts *= 2
    if parts == 1:
        return Router([np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    near = neighbours(sample, min(NEIGHBOURS, len(sample) - 1))
    router = train_router(sample, bisect(near, parts), parts)
    ranked = router.ranked(sample, parts)
    place = np.empty_like(ranked)  # of each part in a vector's order
    np.put_along_axis(place, ranked, np.broadcast_to(np.arange(parts), ranked.shape), axis=1)
    needed = place[np.arange(len(sample))[:, None], ranked[near[:, :5], 0]]
    router.asked = int(np.quantile(needed, share, method="higher")) + 1
    router.weights = [w.astype(np.float32) for w in router.weights]
    return router


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array of double) of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _routed(routers: dict[int, Router], own: bool):
    """Vectors with the parts that they are in, or that they ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            listed: list[list[int]] = [[]] * len(lengths)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                router = routers.get(n)
                found = [[0]] * len(rows) if router is None else router.leaves(_unit(_matrix(batch.column("v").take(pa.array(rows)))), own)
                for row, parts in zip(rows.tolist(), found, strict=True):
                    listed[row] = [n * LENGTH + p for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, pa.list_(pa.int64()))], names=[*batch.schema.names, "parts"])

    return run


def _ranked(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        q, c = _matrix(queries.column("v")), _matrix(candidates.column("v"))
        ids = candidates.column("ids").to_pylist()
        unit = _unit(c)
        keep = min(k + 1, len(c))
        rows: list[tuple] = []
        for at in range(0, len(q), 512):
            near = _unit(q[at : at + 512]) @ unit.T
            least = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
            for i, own in enumerate(queries.column("vec_id").to_pylist()[at : at + 512]):
                close = np.flatnonzero(near[i] >= least[i] - 1e-12)
                exact = cosines(q[at + i], c[close])
                found = [(-s, v) for s, j in zip(exact, close, strict=True) for v in ids[j] if v != own]
                rows += [(own, v, -s) for s, v in sorted(found)[:k]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def cosines(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (others * query).sum(axis=1) / (np.sqrt((others * others).sum(axis=1)) * np.sqrt((query * query).sum()))


def _sampled(vectors: DataFrame, key: str, counts: dict) -> DataFrame:
    """An expected SAMPLE_ROWS of the vectors (id, v) of each key that is counted, chosen by hash of id."""
    shares = vectors.sparkSession.createDataFrame([(k, min(1.0, SAMPLE_ROWS / n)) for k, n in counts.items()], f"__k {vectors.schema[key].dataType.simpleString()}, __share double")
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < F.col("__share") * float(1 << 30)
    return vectors.join(F.broadcast(shares), F.col(key) == F.col("__k")).where(chosen).drop("__k", "__share")


def fit_routers(merged: DataFrame) -> dict[int, Router]:
    """A router for each length that many of the stored (v, ids) have."""
    vectors = merged.select(F.size("v").alias("n"), F.col("ids")[0].alias("id"), "v")
    counts = {r["n"]: r["count"] for r in vectors.groupBy("n").count().collect()}  # a row for each length
    routers = {}
    for n, total in sorted(counts.items()):
        if total < ROUTED and len(counts) > 1 and total < max(counts.values()):
            continue
        sample = _sampled(vectors.where(F.col("n") == n), "n", {n: total}).select("id", "v").toArrow().sort_by("id")
        deep = np.sqrt(total) / PARTS_SHARE > LEVEL_PARTS
        router = fit(_unit(_matrix(sample.column("v"))) if len(sample) else np.zeros((0, n)), total, np.sqrt(FOUND) if deep else FOUND)
        if deep and router.parts > 1:
            router.children = _fit_within(vectors.where(F.col("n") == n), n, router, total)
        routers[n] = router
    return routers


def _fit_within(vectors: DataFrame, n: int, router: Router, total: int) -> dict[int, Router]:
    """Routers within a router's parts, each fitted by a task on a sample of its part."""
    placed = vectors.select("id", "v").mapInArrow(_routed({n: Router(router.weights, 1)}, True), "id long, v array<double>, parts array<long>")
    placed = placed.select(F.shiftright(F.pmod(F.col("parts")[0], F.lit(LENGTH)), LEVEL.bit_length() - 1).alias("part"), "id", "v")
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # at most LEVEL_PARTS rows
    wanted = (np.sqrt(total) / router.parts) ** 2  # so that all parts are as many as the square root asks for

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        child = fit(_unit(np.stack(group["v"].to_numpy())), wanted, np.sqrt(FOUND))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "router": [pickle.dumps((child.weights, child.asked))]})

    found = _sampled(placed, "part", counts).groupBy("part").applyInPandas(one, "part long, router binary").collect()
    return {r["part"]: Router(*pickle.loads(bytes(r["router"]))) for r in found}


def _found(indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of the candidates (part, v, ids) for queries (part, vec_id, v)."""

    def cells(frame: DataFrame) -> DataFrame:
        return frame.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CELL)).cast("int").alias("n"))

    # A row for each part: at most LEVEL_PARTS squared, some 65,000, for each routed length.
    grid = F.broadcast(stored(cells(indexed).select("part", F.col("n").alias("nc")).join(cells(asked).select("part", F.col("n").alias("nq")), "part")))
    candidates = indexed.join(grid, "part").withColumn("c", F.pmod(F.xxhash64("v"), "nc").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    queries = asked.join(grid, "part").withColumn("q", F.pmod(F.xxhash64("vec_id"), "nq").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    found = queries.select("part", "c", "q", "vec_id", "v").groupBy("part", "c", "q").cogroup(candidates.select("part", "c", "q", "v", "ids").groupBy("part", "c", "q")).applyInArrow(_ranked(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return unique.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)


def search(embeddings: DataFrame, every: int = 50, k: int = 5, routers: dict[int, Router] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by every."""
    rows = valid(embeddings).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    merged = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    merged = stored(merged)
    routers = fit_routers(merged) if routers is None else routers
    indexed = stored(merged.mapInArrow(_routed(routers, True), "v array<double>, ids array<long>, parts array<long>").select(F.col("parts")[0].alias("part"), "v", "ids"))
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = queries.mapInArrow(_routed(routers, False), "vec_id long, v array<double>, parts array<long>")
    asked = stored(asked.select("vec_id", "v", F.explode("parts").alias("part")))
    found = stored(_found(indexed, asked, k))
    # Queries that found fewer than k where not all parts of their length were asked.
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.select("vec_id", "v").distinct().join(full, "vec_id", "left_anti")
    if any(r.share() < 1 for r in routers.values()) and short.limit(1).count():
        parts = indexed.select("part").distinct().select(F.floor(F.col("part") / LENGTH).cast("int").alias("n"), F.col("part").alias("whole"))
        again = short.withColumn("n", F.size("v")).join(F.broadcast(parts), "n").select("vec_id", "v", F.col("whole").alias("part"))
        more = _found(indexed, again, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*found.columns).union(more.select(*found.columns))
    return found.select("query_id", "rank", "vec_id", "score")
