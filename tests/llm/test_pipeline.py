import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from rowloom.llm import langid
from rowloom.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.llm.test_decontam import plain as plain_hits
from tests.llm.test_mixing import plain_targets
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_simhash import plain_classes
from tests.test_catalog import TABLES


def redacted(text):
    if text is None:
        return None
    upto, out = 0, []
    for a, b, kind in sorted((a, b, k) for k, a, b in plain_spans(text)):
        if a >= upto:
            out.append(text[upto:a] + f"[{kind.upper()}]")
        upto = max(upto, b)
    return "".join(out) + text[upto:]


def brute_force(spark, sf_dir):
    """The documents that are left before mixing, in plain Python (predictions by the fitted profiles)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [r.asDict() for r in df.collect()]
    profiles = langid.fit(df)
    names, scores = profiles.predict([d["text"] for d in docs])
    docs = [d for d, lang, s in zip(docs, names, scores, strict=True) if lang != "und" and s >= langid.MIN_SCORE]
    low = {doc: component for doc, _, component in plain_classes([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d for d in docs if low[d["doc_id"]] == d["doc_id"]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {doc: n for doc, _, n, _ in plain_hits([(d["doc_id"], d["text"]) for d in docs], items)}
    docs = [d for d in docs if not hits[d["doc_id"]]]
    for d in docs:
        d["text"] = redacted(d["text"])
    return docs


def test_run_against_brute_force(spark):
    docs = brute_force(spark, SF)
    rows = corpus_pipeline.run(spark, SF).collect()
    words = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    sources = {d["doc_id"]: d["source"] for d in docs}
    sizes = defaultdict(int)
    for doc, n in words.items():
        sizes[sources[doc]] += n
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert (r.size, r.source, r.source_size) == (words[r.doc_id], sources[r.doc_id], sizes[r.source])
        assert r.target == pytest.approx(targets[r.source]) and 0 < r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len({r.doc_id for r in rows}) == len(rows)
    given = {d["doc_id"]: d for d in docs}
    for r in rows:
        d = given[r.doc_id]
        assert (r.text, r.lang, r.source) == (d["text"], d["lang"], d["source"]) and r.n_chars in (d["n_chars"], len(d["text"]))
    sure = {d for d in words if words[d] and targets[sources[d]] >= sizes[sources[d]]}
    assert sure <= {r.doc_id for r in rows}
    for source, n in taken.items():
        assert abs(n - targets[source]) <= max(words[d] for d in words if sources[d] == source)


def test_stages_keep_the_columns_of_documents(spark, awkward, no_rows):
    for docs in (awkward, no_rows):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        assert set(docs.columns) <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)


def test_unlike_texts_of_one_id_and_a_folder_of_ones_own(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    rows = [(1, d.text + f" unlike {k}", d.lang, d.source, d.n_chars) for k, d in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path), str(tmp_path / "out"))
    left = {re.sub(r"\[[A-Z_]+\]", "", r.text)[:40] for r in out.collect()}
    assert out.count() >= 10 and len(left) >= 10 and [p.name for p in (tmp_path / "out").iterdir()] == ["4-source_mixing"]


def test_clean_documents_stay(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.language_id(spark, clean, SF)
    assert clean.count() - kept.count() <= 1


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
