"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

1. The benchmark's windows (ten consecutive words of an item; a shorter item
   whole) and their terms are numbered, and the corpus frequencies of the terms
   counted. They rank the terms of each window, the rarest first.
2. The index stores a posting for each occurrence of a term in the corpus: term,
   document and position. It is built as far as lists are read: first those of
   each window's two rarest terms, over all documents; then those of all terms,
   in the documents that the intersection of the first has reached.
3. The lists of a window's terms are intersected from the rarest: its postings,
   adjusted by the term's offset, are the places where the window may begin, and
   the list of the next term keeps those at which it stands in its place, too.
   The NEAR_TERMS rarest terms within SLOP words of their places make a
   proximity match, all terms in place a phrase match.
4. Windows that match name the items that hold them.

The number of passes over the documents is the same for a benchmark of any size.
Lists are joined on document, term and position, so no term, passage or window
that is very frequent makes a hot key; equal postings of repeated rows are merged
before they meet. Windows and terms are broadcast up to a checked number, and
joined by shuffle beyond it; items never are.

Defined results: null texts have no words; documents without words give a row
with zeros; items without words never occur; repeated items with one id count
once, a null item_id counts as the id ''; rows that agree in doc_id and text
share their figures and each get a row, others with one doc_id are told apart;
an empty benchmark leaves every document clean; equally frequent terms rank by
their places; other columns are ignored by ``contamination`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.common import ascii_lower, stored
from rowloom.sources import files
from rowloom.sources.scratch import scratch_folder

WINDOW = 10
#: A run of what isn't in \x00-\x2F, \x3A-\x60 and \x7B-\x7F, said by what is in: Java matches negated ranges several times slower.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The rarest terms of a window that a proximity match needs, and how many words off its place each may stand.
NEAR_TERMS, SLOP = 4, 2
#: Rows of windows and terms, and of places (some 60 bytes each), that are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_PLACES = 500_000, 50_000
PLACE = ["d", "twin", "wid", "start"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, w array of words) of (item_id, text), and (wid, item); both stored."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text").cast("string")).alias("all"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (width - 1))))
    cut = items.where(F.size("all") > 0).select("item", "all", starts.alias("at")).select("item", F.slice("all", F.col("at"), width).alias("w"))
    wins = stored(cut.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return wins, stored(cut.join(wins, "w").select("wid", "item").distinct())


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """A row's keys d and twin, neither ever null: its doc_id, and a hash of whether that is null and of the text."""
    own = F.col("doc_id")
    return F.coalesce(own, F.lit("0").cast(docs.schema["doc_id"].dataType)), F.xxhash64(own.isNull(), F.col("text").cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    """(d, twin, nil, text) of each row; nil tells that its doc_id is null."""
    d, twin = _keyed(docs)
    return docs.select(d.alias("d"), twin.alias("twin"), F.col("doc_id").isNull().alias("nil"), F.col("text").cast("string").alias("text"))


def indexed(rows: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(tid, d, twin, at, n, nil): a posting for each occurrence of the terms (term, tid) in keyed rows, at from 1; each row has one of tid -1 at 0.

    n is the number of the row's words.
    """
    read = rows.select("d", "twin", "nil", words(F.col("text")).alias("all"))
    # The outer form: else Catalyst tests the array for rows below, and splits each text twice.
    found = read.select("d", "twin", "nil", F.size("all").alias("n"), F.posexplode_outer(F.concat(F.array(F.lit("")), F.col("all"))).alias("at", "term"))
    none = rows.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid"))
    return found.join(_small(terms.select("term", "tid").union(none), n_terms), "term").select("tid", "d", "twin", "at", "n", "nil")


def ranked(wins: DataFrame, terms: DataFrame, n_terms: int, counts: DataFrame) -> DataFrame:
    """(wid, rank, tid, off, size): the terms of each window that the corpus can hold, the rarest first, by (tid, count) of the corpus."""
    placed = wins.select("wid", F.size("w").alias("size"), F.posexplode("w").alias("off", "term")).join(_small(terms, n_terms), "term")
    rated = placed.join(_small(counts, n_terms), "tid", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    own = Window.partitionBy("wid")
    rated = rated.withColumn("rank", F.row_number().over(own.orderBy("count", "off")) - 1).withColumn("least", F.min("count").over(own))
    return rated.where("least > 0").select("wid", "rank", "tid", "off", "size")


class Lists:
    """An index, and the stored ranks of the terms of n windows' places by which its lists are intersected."""

    def __init__(self, index: DataFrame, ranks: DataFrame, n: int):
        self.index, self.ranks, self.n = index.where("at > 0"), ranks, n

    def places(self) -> DataFrame:
        """PLACE of all windows by their rarest terms; start counts from 1, and may lie before the document."""
        first = _small(self.ranks.where("rank = 0").select("wid", "tid", "off"), self.n)
        return stored(self.index.join(first, "tid").select("d", "twin", "wid", (F.col("at") - F.col("off")).alias("start")).distinct())

    def meet(self, places: DataFrame, low: int, high: int, slop: int = 0) -> DataFrame:
        """The places at which the terms of ranks low to high (exclusive) stand within slop words of theirs."""
        wanted = self.ranks.where(F.col("rank").between(low, high - 1))
        several = ["size", "rank"] if high - low > 1 else []
        need = places.join(_small(wanted, self.n), "wid").select(*PLACE, *several, "tid", (F.col("start") + F.col("off")).alias("wish"))
        lists = self.index.join(_small(wanted.select("tid").distinct(), self.n), "tid", "left_semi").select("d", "twin", "tid", "at")
        keys = ["d", "twin", "tid", "near"]
        if slop:  # what is within slop words falls into one of two runs of words
            run = lambda at: F.floor(at / (2 * slop + 1))
            need = need.withColumn("near", F.explode(F.array_distinct(F.array(run(F.col("wish") - slop), run(F.col("wish") + slop)))))
            lists = lists.withColumn("near", run(F.col("at")))
        else:
            need, lists = need.withColumnRenamed("wish", "near"), lists.withColumnRenamed("at", "near")
        rows = places.count() * (high - low) * (2 if slop else 1)  # at most
        met = lists.join(F.broadcast(need), keys) if rows <= BROADCAST_PLACES else need.join(lists.distinct(), keys)
        if slop:
            met = met.where(F.abs(F.col("at") - F.col("wish")) <= slop)
        if several:  # a window of fewer terms needs those that it has
            met = met.groupBy(*PLACE, "size").agg(F.size(F.collect_set("rank")).alias("met")).where(F.col("met") == F.least(F.lit(high), "size") - low)
        short = self.ranks.where((F.col("rank") == 0) & (F.col("size") <= low)).select("wid")
        passed = places.join(_small(short, self.n), "wid", "left_semi")
        return stored(met.select(*PLACE).distinct().union(passed.select(*PLACE)))


def _named(places: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """(d, twin, name array of the ids, in order, of items with windows at places)."""
    return places.select("d", "twin", "wid").distinct().join(items, "wid").groupBy("d", "twin").agg(F.array_sort(F.collect_set("item")).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, near: bool = False) -> DataFrame:
    """(doc_id, twin, n_words long, n_hit long, items array of ids in order) for each row, stored.

    near: also near_items, the ids of items of which a window stands whole or by proximity.
    """
    rows = keyed(docs.select("doc_id", "text"))
    wins, items = windows(benchmark, width)
    terms = stored(wins.select(F.explode("w").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()))
    n_terms = terms.count()
    ranks = stored(ranked(wins, terms, n_terms, stored(indexed(rows, terms, n_terms).groupBy("tid").count())))
    n = ranks.count()
    folder = scratch_folder(docs.sparkSession, "postings")

    def written(name: str, postings: DataFrame) -> DataFrame:
        postings.write.parquet(f"{folder}/{name}")
        return docs.sparkSession.read.parquet(f"{folder}/{name}")

    rare = terms.join(_small(ranks.where("rank < 2").select("tid").distinct(), n_terms), "tid", "left_semi")
    index = written("rare", indexed(rows, rare, n_terms))
    lists = Lists(index, ranks, n)
    places = lists.meet(lists.places(), 1, 2, SLOP if near else 0)
    reached = stored(places.select("d", "twin").distinct())
    lists = Lists(written("reached", indexed(rows.join(_small(reached, reached.count()), ["d", "twin"], "left_semi"), terms, n_terms)), ranks, n)
    if near:
        for k in range(2, NEAR_TERMS):
            places = lists.meet(places, k, k + 1, SLOP)
        close = places
    # Few places are left that aren't matches: the lists of the other terms are met together.
    spans = lists.meet(places, 1 if near else 2, width)
    width_of = ranks.where("rank = 0").select("wid", F.col("size").alias("width"))
    hits = spans.join(_small(width_of, n), "wid").groupBy("d", "twin").agg(F.collect_set(F.struct("start", "width")).alias("spans"))
    # Covered words: in order of start, each span adds what lies beyond the words covered so far.
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("words")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["width"] - 1).alias("upto"), (a["words"] + F.greatest(F.lit(0), s["start"] + s["width"] - 1 - F.greatest(a["upto"], s["start"] - 1))).cast("long").alias("words")),
    )["words"]
    none = F.array().cast("array<string>")
    lengths = index.where("at = 0").select("d", "twin", "nil", F.col("n").cast("long").alias("n_words"))
    out = lengths.join(hits.select("d", "twin", covered.alias("n_hit")), ["d", "twin"], "left").join(_named(spans, items, "items"), ["d", "twin"], "left")
    kept = [F.when(~F.col("nil"), F.col("d")).alias("doc_id"), "twin", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")]
    if near:
        out = out.join(_named(close, items, "near_items"), ["d", "twin"], "left")
        kept.append(F.coalesce("near_items", none).alias("near_items"))
    done = stored(out.select(*kept))
    files.remove(docs.sparkSession, folder)
    return done


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, in which no window of the benchmark occurs."""
    hit = contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("twin").alias("__t")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__d")) & (_keyed(docs)[1] == F.col("__t")), "left_anti")
