import random
import re
from collections import Counter

from rowloom.llm import decontam
from tests.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    found |= wins[k]
                    hit[s : s + n] = [True] * n
        out.append((doc, len(w), sum(hit), sorted(found)))
    return sorted(out, key=str)


def plain_near(docs, items, width=10, terms=4, slop=2):
    """(doc, ids of items of which a window's rarest terms stand near their places, the rarest in its own)."""
    split = [(doc, WORD.findall((text or "").translate(LOWER))) for doc, text in docs]
    counts = Counter(x for _, w in split for x in w)
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, w in split:
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        found = set()
        for win, names in wins.items():
            rank = sorted((counts[x], k, x) for k, x in enumerate(win))[:terms]
            for p in at.get(rank[0][2], ()):
                s = p - rank[0][1]
                if all(any(abs(q - s - k) <= slop for q in at.get(x, ())) for _, k, x in rank[1:]):
                    found |= names
        out.append((doc, sorted(found)))
    return sorted(out, key=str)


def got(docs, items, near=False):
    rows = decontam.contamination(docs, items, near=near).collect()
    if near:
        assert all(set(r["items"]) <= set(r["near_items"]) for r in rows)
        return sorted(((r.doc_id, r["near_items"]) for r in rows), key=str), sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_real_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, wanted = [(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()]
    assert got(docs, items, True) == (plain_near(rows, wanted), plain(rows, wanted))


def test_random_texts_of_few_words(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "É", "ab1", "-"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(80)]
    items = [(k, text(rng.choice([1, 2, 3, 6, 9, 11, 14]))) for k in range(12)] + [(3, "zz zz zz")]
    docs += [(200, items[5][1] + " . " + items[5][1]), (201, items[6][1].upper())]
    want = plain(docs, items)
    assert sum(r[2] > 0 for r in want) > 10
    near = plain_near(docs, items)
    assert any(len(n) > len(w[3]) for (_, n), w in zip(near, want, strict=True))
    assert got(*frames(spark, docs, items), True) == (near, want)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 5)  # all joins by shuffle
    monkeypatch.setattr(decontam, "BROADCAST_PLACES", 0)
    assert got(*frames(spark, docs, items)) == want
    assert got(*frames(spark, docs, items), True) == (near, want)


def test_awkward_rows(spark, awkward, no_rows):
    items = [(1, "cat sat on the"), (1, "cat sat on the"), (2, None), (3, ""), (None, "wort wort wort"), (4, "le chat est sur la table et le chien dans la"), (5, "été")]
    _, benchmark = frames(spark, [(0, "")], items)
    want = plain([(r.doc_id, r.text) for r in awkward.collect()], items)
    assert got(awkward, benchmark) == want
    assert got(no_rows, benchmark) == []
    assert got(awkward, benchmark.limit(0)) == plain([(r.doc_id, r.text) for r in awkward.collect()], [])
    assert got(awkward, benchmark.where("item_id = 2")) == plain([(r.doc_id, r.text) for r in awkward.collect()], [])
    kept = decontam.drop_contaminated(awkward, benchmark)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 5, 8, 9, None], key=str)


def test_one_id_with_two_texts(spark):
    docs, items = frames(spark, [(1, "a b c"), (1, "x y z"), (None, "a b c"), (None, "q")], [(7, "b c")])
    assert got(docs, items) == plain([(1, "a b c"), (1, "x y z"), (None, "a b c"), (None, "q")], [(7, "b c")])
    assert sorted(r.text for r in decontam.drop_contaminated(docs, items).collect()) == ["q", "x y z"]


def test_proximity(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text.replace("four", "uno four")), (3, text.replace("two", "x").replace("four", "y")), (4, "two four two four"), (5, "ten nine eight seven six five four three two one"), (6, text + " one one two two three three four four")]
    items = [(1, text)]
    near, whole = got(*frames(spark, rows, items), True)
    assert near == plain_near(rows, items) and whole == plain(rows, items)
    assert {d for d, found in near if found} == {1, 2, 3, 6} and {r[0] for r in whole if r[2]} == {1, 6}


def test_a_window_of_very_many_items_and_repeated_rows(spark):
    """Items and copies of rows are merged before they meet."""
    shared = "this very line of ten plain words stands in all"
    docs = spark.range(300).selectExpr("IF(id < 200, 7L, id) AS doc_id", f"IF(id % 100 < 50 OR id < 200, 'start {shared} end', 'nothing here') AS text")
    items = spark.range(100_000).selectExpr("id AS item_id", f"'{shared}' AS text")
    rows = decontam.contamination(docs, items).collect()
    assert len(rows) == 300 and all(r.n_hit in (0, 10) and len(r["items"]) == (100_000 if r.n_hit else 0) for r in rows)
    assert sum(r.n_hit > 0 for r in rows) == 250


def test_postings(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    wins, _ = decontam.windows(items)
    terms = wins.selectExpr("explode(w) AS term").distinct().selectExpr("term", "monotonically_increasing_id() AS tid")
    index = decontam.indexed(decontam.keyed(docs), terms, terms.count()).where("at > 0").collect()
    known = {r.term: r.tid for r in terms.collect()}
    want = sorted((known[x], r.doc_id, k) for r in docs.collect() for k, x in enumerate(WORD.findall((r.text or "").translate(LOWER)), 1) if x in known)
    assert sorted((r.tid, r.d, r["at"]) for r in index) == want
