"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only.

A source's target divided by its size is the number of copies that each of its
documents should have; what is left over whole copies is a probability. Pairs
of documents move words of probability between them, at random and without
bias, until one of the two has none or all. Each block of a source is folded so
to a single residual document, and the residuals are folded again, block by
block, in a reduction tree with one residual a source at its root, which is
rounded to the nearest. The words of a source are thus kept exactly up to half
its last document. In LANDINGS steps, a rounded document of each source is
then turned over if its size comes nearer to what is missing or too much.

All randomness is a hash of the documents' ids, so reruns agree whatever the
partitions. A source is dealt to blocks by hash, so a source with a third of all
rows is folded by many tasks.

Defined results: a null text has size 0; documents of size 0 take nothing;
rows with a null source form a source, the last in order; rows that agree in
source, doc_id and size share their copies out as evenly as whole copies can;
sources of size 0 have target 0; an empty table gives an empty result; columns
other than doc_id, source and text are ignored by ``mix`` and kept by
``applied``, but for those that it names itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.common import stored, tasks

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 42
LANDINGS = 2
#: Documents that are folded in one block.
BLOCK = 512
#: Sources (some 60 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) for stored (source, size, count); sources by code point, null last."""
    order = F.asc_nulls_last("source")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    placed = stored(totals.repartitionByRange(tasks(sizes), order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, before))
        before += n
    offsets = sizes.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    sources = stored(placed.join(F.broadcast(offsets), "part").select("source", "source_size", weight.alias("weight")))

    all_words, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = share * all_words / all_weight if all_words else 0.0
    full = F.col("source_size") * most
    while True:  # each round stops some more sources and shares their excess out
        stopped = full < F.lit(level) * F.col("weight")
        words, weight_left = sources.agg(F.sum(F.when(stopped, full).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        above = (share * all_words - words) / weight_left if all_words and weight_left else level
        if above <= level:
            break
        level = above
    return sources.select("source", "source_size", "weight", F.least(full, F.lit(level) * F.col("weight")).alias("target"))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(2**53)) / F.lit(float(2**53))


def _pivot(a: Column, b: Column) -> Column:
    """What a pair becomes: one member is done (its p is 0 or 1), the other is carried on."""
    up_a = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that a can take from b
    up_b = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    to_a = _chance(a["doc_id"], a["size"], b["doc_id"], b["size"]) * (up_a + up_b) < up_b
    full_a = (1 - a["p"]) * a["size"] <= b["p"] * b["size"]
    full_b = (1 - b["p"]) * b["size"] <= a["p"] * a["size"]

    def at(unit: Column, p: Column) -> Column:
        return F.struct(unit["order"].alias("order"), unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["count"].alias("count"), unit["whole"].alias("whole"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def pair(done: Column, carry: Column) -> Column:
        return F.struct(done.alias("done"), carry.alias("carry"))

    a_takes = F.when(full_a, pair(at(a, F.lit(1.0)), at(b, b["p"] - up_a / b["size"]))).otherwise(pair(at(b, F.lit(0.0)), at(a, a["p"] + up_a / a["size"])))
    b_takes = F.when(full_b, pair(at(b, F.lit(1.0)), at(a, a["p"] - up_b / a["size"]))).otherwise(pair(at(a, F.lit(0.0)), at(b, b["p"] + up_b / b["size"])))
    whole = a["p"].isin(0.0, 1.0)
    return F.when(whole, pair(at(a, a["p"]), at(b, b["p"]))).when(to_a, a_takes).otherwise(b_takes)


UNIT = "struct<order:bigint,doc_id:{id},size:bigint,count:bigint,whole:bigint,p:double>"


def _fold(units: DataFrame, unit: str) -> DataFrame:
    """(source, carry, done array) for each block of (source, block, u)."""
    listed = units.groupBy("source", "block").agg(F.array_sort(F.collect_list("u")).alias("units"))

    def step(state: Column, b: Column) -> Column:
        pair = _pivot(state["carry"], b)
        return F.struct(pair["carry"].alias("carry"), F.concat(state["done"], F.array(pair["done"])).alias("done"))

    begun = F.struct(F.col("units")[0].cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("done"))
    folded = F.aggregate(F.slice("units", F.lit(2), F.size("units")), begun, step)
    return listed.select("source", folded.alias("f")).select("source", "f.carry", "f.done")


def _land(rounded: DataFrame, settled: DataFrame, aims: DataFrame, n: int) -> DataFrame:
    """The rounded units, of which one in each source may be turned over."""
    copies = (F.col("whole") + F.col("up")).alias("copies")
    taken = settled.select("source", "size", "copies").union(rounded.select("source", "size", copies)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    gaps = stored(taken.join(aims, F.col("source").eqNullSafe(F.col("s"))).select("s", (F.col("target") - F.col("words")).alias("gap")))
    wide = F.abs("gap")
    off = F.abs(wide - F.col("size"))
    wanted = F.when(F.col("gap") > 0, F.col("up") == 0).otherwise(F.col("up") == 1) & (off < wide)
    found = rounded.join(F.broadcast(gaps) if n <= BROADCAST_ROWS else gaps, F.col("source").eqNullSafe(F.col("s"))).where(wanted)
    picks = stored(found.groupBy("source").agg(F.min(F.struct(off.alias("off"), "order", "doc_id", "size")).alias("pick")).select(F.col("source").alias("ps"), F.col("pick.doc_id").alias("pd"), F.col("pick.size").alias("pn")))
    same = F.col("source").eqNullSafe(F.col("ps")) & F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("size") == F.col("pn"))
    turned = rounded.join(F.broadcast(picks) if n <= BROADCAST_ROWS else picks, same, "left")
    up = F.when(F.col("pn").isNotNull(), 1 - F.col("up")).otherwise(F.col("up"))
    return turned.select("source", "order", "doc_id", "size", "count", "whole", up.alias("up"))


def _decided(docs: DataFrame, weights: tuple, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(source, doc_id, size, count, copies) of the rows that agree in these, and (s, source_size, target)."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
    units = stored(rows.groupBy("source", "doc_id", "size").count())
    aims = stored(targets(units, weights, share, most))
    n = aims.count()
    aims = aims.select(F.col("source").alias("s"), "source_size", "target")
    if n <= BROADCAST_ROWS:
        aims = F.broadcast(aims)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("count")
    near = F.abs(rate - F.round(rate)) < 1e-9
    whole = F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("long")
    rated = units.join(aims, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "doc_id", "size", "count", whole.alias("whole"), F.when(near, 0.0).otherwise(rate - F.floor(rate)).alias("p"))
    rated = stored(rated)

    unit = UNIT.format(id=dict(rated.dtypes)["doc_id"])
    order = F.xxhash64(F.lit(SEED + 1), "doc_id", "size")
    open_ = rated.where("p > 0 AND size > 0").select("source", F.struct(order.alias("order"), "doc_id", "size", "count", "whole", "p").cast(unit).alias("u"))
    settled = rated.where("NOT (p > 0 AND size > 0)").select("source", "doc_id", "size", "count", F.col("whole").alias("copies"))
    rounded = []
    counts = open_.groupBy(F.col("source").alias("s")).count().select("s", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    while True:
        counts = stored(counts)
        most_blocks = counts.agg(F.max("blocks")).first()[0]
        if most_blocks is None:
            break
        lookup = F.broadcast(counts) if n <= BROADCAST_ROWS else counts
        level = F.lit(int(most_blocks))
        dealt = open_.join(lookup, F.col("source").eqNullSafe(F.col("s"))).select("source", F.pmod(F.xxhash64(level, "u.doc_id", "u.size"), "blocks").alias("block"), "u")
        folded = stored(_fold(dealt, unit))
        done = folded.select("source", F.explode("done").alias("u"))
        open_ = folded.select("source", F.col("carry").alias("u"))
        if most_blocks == 1:
            done = done.union(open_)
        rounded.append(done.select("source", "u.order", "u.doc_id", "u.size", "u.count", "u.whole", F.round("u.p").cast("long").alias("up")))
        if most_blocks == 1:
            break
        counts = counts.select("s", F.ceil(F.col("blocks") / BLOCK).cast("long").alias("blocks"))
    decided = settled
    if rounded:
        last = reduce(DataFrame.union, rounded)
        for _ in range(LANDINGS):
            last = _land(last, settled, aims, n)
        decided = settled.union(last.select("source", "doc_id", "size", "count", (F.col("whole") + F.col("up")).alias("copies")))
    return decided, aims


def _of_one(copies: Column, count: Column, k: Column) -> Column:
    """What the k-th (from 1) of count rows has of their copies."""
    return (F.floor(copies / count) + (k <= copies % count).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row."""
    decided, aims = _decided(docs, weights, share, most)
    each = decided.select("source", "doc_id", "size", "count", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("k"))
    each = each.select("source", "doc_id", "size", _of_one(F.col("copies"), F.col("count"), F.col("k")).alias("copies"))
    return each.join(aims, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


FIGURES = ("size", "source_size", "target", "copies", "taken")


def applied(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with its columns and those of FIGURES, which replace columns of their names."""
    decided, aims = _decided(docs, weights, share, most)
    kept = [c for c in docs.columns if c not in FIGURES]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("source").cast("string").alias("__s"), F.col("doc_id").alias("__d"), size_of(F.col("text").cast("string")).alias("__n"))
    plan = stored(decided).select(F.col("source").alias("__ps"), F.col("doc_id").alias("__pd"), F.col("size").alias("__pn"), F.col("count").alias("__count"), F.col("copies").alias("__copies"))
    met = rows.join(plan, F.col("__s").eqNullSafe(F.col("__ps")) & F.col("__d").eqNullSafe(F.col("__pd")) & (F.col("__n") == F.col("__pn"))).drop("__ps", "__pd", "__pn")
    out = met.where("__count = 1").withColumn("__own", F.col("__copies"))
    several = plan.where("__count > 1").limit(1).count()
    if several:
        # Rows that agree are numbered by where they are stored, each partition on from those before it, so no group is brought together.
        part = stored(met.where("__count > 1").withColumn("__part", F.spark_partition_id()))
        group = ["__s", "__d", "__n"]
        sizes = part.groupBy(*group, "__part").agg(F.count("*").alias("__rows"))
        before = sizes.withColumn("__before", F.sum("__rows").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__rows")).select(*(F.col(c).alias(f"{c}_") for c in (*group, "__part")), "__before")
        same = (F.col("__part") == F.col("__part_")) & (F.col("__n") == F.col("__n_")) & F.col("__s").eqNullSafe(F.col("__s_")) & F.col("__d").eqNullSafe(F.col("__d_"))
        nth = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(F.xxhash64("text")))
        numbered = part.withColumn("__k", nth).join(before, same).withColumn("__own", _of_one(F.col("__copies"), F.col("__count"), F.col("__before") + F.col("__k")))
        out = out.unionByName(numbered.select(*out.columns))
    out = out.join(aims, F.col("__s").eqNullSafe(F.col("s")), "left")
    figures = {"size": F.col("__n"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("__own"), "taken": F.col("__own") * F.col("__n")}
    return out.select(*(F.col(f"`{c}`") for c in kept), *(v.alias(k) for k, v in figures.items()))
