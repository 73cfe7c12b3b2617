"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 majority bits over the XXH64 values of word shingles. Equal
fingerprints are merged first. Two fingerprints within three differing bits
agree in at least one of four 16-bit blocks, so the trie is entered four times,
at the depth-16 nodes of each block, and below them pairs of nodes are walked
together: a pair carries the bits that differ so far and is pruned as soon as
they exceed the budget. A node with very many fingerprints is entered again 12
bits below, at four nodes of its other 48 bits by the same argument, so that a
fingerprint is dealt at most 16 times while it has few near it; what is still
heavy there, a crowd of near copies, is dealt in chunks, each pair of chunks to
a task of its own. Tasks return a spanning forest of what they linked, never all
pairs, and the forests are merged by distributed connected components.

Defined results: a null text has no words and so fingerprint zero, like an
empty one; rows with a null doc_id take part, and a component's id is its
smallest non-null doc_id (null if it has none); repeated rows each get a row;
an empty table gives an empty result; columns other than doc_id and text are
ignored by ``classes`` and kept untouched by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import NULL_ID, stored, tasks
from rowloom.llm.components import connected_components, merge_links

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 4
#: Fingerprints of one trie node that a task takes; larger nodes are dealt in chunks.
NODE_LIMIT = 1024
#: Heavy nodes (16 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Node pairs of at most this many fingerprint pairs are compared at once.
SMALL = 16
#: Fingerprint pairs that a task walks at once.
WALK = 4_000_000


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
        total = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
        total = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        marks = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), marks], names=["doc_id", "twin", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, twin long, fp long) for each row; twin is a hash that tells apart texts of one doc_id."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    return rows.mapInArrow(_fingerprinted, "doc_id long, twin long, fp long")


def _expand(lo_a, hi_a, lo_b, hi_b):
    """All index pairs of many small range pairs."""
    width = hi_b - lo_b
    count = (hi_a - lo_a) * width
    owner = np.repeat(np.arange(len(count)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return lo_a[owner] + k // width[owner], lo_b[owner] + k % width[owner]


def walk(marks: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray, budget: int = MAX_BITS):
    """Index pairs of fingerprints within the budget, for each group [start, end).

    A group whose middle equals its start is joined with itself; otherwise
    [start, middle) is joined with [middle, end). Each side is in order.
    """
    own = middles == starts
    lo_a, hi_a = starts, np.where(own, ends, middles)
    lo_b, hi_b = np.where(own, starts, middles), ends
    errors = np.zeros(len(starts), np.int64)
    left, right = [], []
    for bit in range(63, -2, -1):
        small = (hi_a - lo_a) * (hi_b - lo_b) <= (SMALL if bit >= 0 else 1 << 62)
        if small.any():
            a, b = _expand(lo_a[small], hi_a[small], lo_b[small], hi_b[small])
            near = (np.bitwise_count(marks[a] ^ marks[b]) <= budget) & (a != b)
            left.append(a[near])
            right.append(b[near])
            lo_a, hi_a, lo_b, hi_b, errors = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, errors))
        if not len(lo_a) or bit < 0:
            break
        ones = np.concatenate([[0], np.cumsum((marks >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        mid_a, mid_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        same = (lo_a == lo_b) & (hi_a == hi_b)
        children = [
            (lo_a, mid_a, lo_b, mid_b, errors, np.ones(len(same), bool)),
            (mid_a, hi_a, mid_b, hi_b, errors, np.ones(len(same), bool)),
            (lo_a, mid_a, mid_b, hi_b, errors + 1, np.ones(len(same), bool)),
            (mid_a, hi_a, lo_b, mid_b, errors + 1, ~same),
        ]
        parts = []
        for *child, wanted in children:
            ok = wanted & (child[4] <= budget) & (child[0] < child[1]) & (child[2] < child[3])
            parts.append([x[ok] for x in child])
        lo_a, hi_a, lo_b, hi_b, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(cells: np.ndarray, sides: np.ndarray, marks: np.ndarray, ids: np.ndarray):
    """Links (id, root id) of whole cells; rows come in order of cell, side and mark."""
    starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
    ends = np.append(starts[1:], len(cells))
    second = np.concatenate([[0], np.cumsum(sides)])
    crossed = (cells[starts, 2] != cells[starts, 3]) if len(starts) else np.zeros(0, bool)
    middles = np.where(crossed, ends - (second[ends] - second[starts]), starts)
    work = np.cumsum((ends - starts) ** 2)
    at = 0
    while at < len(starts):
        done = work[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(work, done + WALK, side="right")))
        lo, hi = starts[at], ends[to - 1]
        a, b = walk(marks[lo:hi], starts[at:to] - lo, middles[at:to] - lo, ends[at:to] - lo)
        if len(a):
            yield merge_links(ids[lo:hi], a, b)
        at = to


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(last: bool):
        nonlocal held, rows
        batch = pa.Table.from_batches(held).combine_chunks()
        columns = {n: batch.column(n).to_numpy() for n in batch.column_names}
        cells = np.column_stack([columns[n] for n in ("block", "value", "i", "j")])
        cut = len(cells)
        if not last:  # the last cell may go on in the next batch
            cut = int(np.argmax((cells == cells[-1]).all(axis=1)))
        held, rows = ([batch.slice(cut).to_batches()[0]], len(cells) - cut) if cut < len(cells) else ([], 0)
        if cut:
            for src, dst in _forest(cells[:cut], columns["side"][:cut], columns["fp"][:cut].astype(np.uint64), columns["rep"][:cut]):
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 200_000:
            yield from flush(False)
    if held:
        yield from flush(True)


def _cells(reps: DataFrame) -> DataFrame:
    """(block, value, fp, rep): the depth-16 trie nodes of each fingerprint."""
    blocks = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF).alias("value")) for k in range(BLOCKS))))
    return reps.select("fp", "rep", blocks.alias("c")).select("c.block", "c.value", "fp", "rep")


def _deeper(cells: DataFrame) -> DataFrame:
    """The nodes 12 bits below depth-16 nodes: those within the budget agree in one of four blocks of the other 48 bits, too."""

    def below(k: int) -> Column:
        s = 16 * (k + 1) % 64  # turned so that the other bits come lowest
        turned = F.shiftrightunsigned("fp", s).bitwiseOR(F.shiftleft("fp", 64 - s)) if s else F.col("fp")
        parts = [F.struct(F.lit(BLOCKS * (j + 1) + k).alias("block"), (F.col("value") + F.shiftleft(F.shiftrightunsigned(turned, 12 * j).bitwiseAND(0xFFF), 16)).alias("value")) for j in range(BLOCKS)]
        return F.array(*parts)

    lists = reduce(lambda out, k: F.when(F.col("block") == k, below(k)).otherwise(out), range(1, BLOCKS), below(0))
    return cells.select(F.explode(lists).alias("c"), "fp", "rep").select("c.block", "c.value", "fp", "rep")


def _heavy(cells: DataFrame) -> tuple[DataFrame, int]:
    """(block, value, chunks) of nodes with more than NODE_LIMIT fingerprints, and their number."""
    heavy = stored(cells.groupBy("block", "value").count().where(F.col("count") > NODE_LIMIT).select("block", "value", F.ceil(F.col("count") / NODE_LIMIT).cast("int").alias("chunks")))
    n = heavy.count()
    return (F.broadcast(heavy) if n <= BROADCAST_ROWS else heavy), n


def dealt(reps: DataFrame) -> DataFrame:
    """(block, value, i, j, side, fp, rep): the fingerprints of each node, those of heavy nodes in nodes below or at last in pairs of chunks."""
    cells = _cells(reps)
    heavy, n = _heavy(cells)
    chunks = F.lit(1)
    if n:
        deep = stored(_deeper(cells.join(heavy, ["block", "value"], "left_semi")))
        cells = cells.join(heavy, ["block", "value"], "left_anti").union(deep)
        heavy, n = _heavy(deep)
        if n:
            cells, chunks = cells.join(heavy, ["block", "value"], "left"), F.coalesce("chunks", F.lit(1))
    return (
        cells.withColumn("chunks", chunks)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("block", "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp", "rep")
    )


def near_links(reps: DataFrame) -> DataFrame:
    """(src, dst) links between the reps of distinct fingerprints (fp, rep) that are near."""
    order = F.col("fp").bitwiseXOR(F.lit(-(2**63)))  # unsigned
    rows = dealt(reps).repartition(tasks(reps), "block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j", "side", order)
    return rows.mapInArrow(_links, "src long, dst long")


def _labelled(marks: DataFrame) -> DataFrame:
    """(fp, low, label) for each distinct fingerprint of stored marks; low is its smallest (doc_id, twin), null ids last."""
    low = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "twin"))
    reps = stored(marks.groupBy("fp").agg(low.alias("low")))
    # A rep must be unique; a null or shared doc_id isn't, so fingerprints stand for themselves.
    labels = connected_components(near_links(reps.select("fp", F.col("fp").alias("rep"))))
    return stored(reps.join(labels, reps.fp == labels.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label")))


def mark_classes(marks: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of stored marks."""
    grouped = _labelled(marks)
    # Stored, so that the join can split a class with very many fingerprints.
    lows = stored(grouped.groupBy("label").agg(F.min("low.doc_id").alias("component_id")))
    return grouped.join(lows, "label").select("fp", F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id) for each row."""
    marks = stored(fingerprints(docs))
    return marks.join(mark_classes(marks), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, with its columns, of each class: that of the smallest doc_id (null last), of these that of the smallest hash of the text.

    Of rows that agree in doc_id and text one stays.
    """
    marks = stored(fingerprints(docs))
    picks = _labelled(marks).groupBy("label").agg(F.min("low").alias("low")).select(F.nullif("low.doc_id", F.lit(NULL_ID)).alias("__d"), F.col("low.twin").alias("__t"))
    own, twin = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    rows = docs.withColumn("__id", own).withColumn("__twin", twin)
    return rows.join(picks, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__twin") == F.col("__t")), "left_semi").dropDuplicates(["__id", "__twin"]).drop("__id", "__twin")
