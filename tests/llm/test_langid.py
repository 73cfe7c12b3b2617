import tracemalloc
import zlib

import numpy as np

from rowloom.llm import langid
from tests.conftest import SF


def plain_bundle(text):
    """The sum of permuted products, one n-gram at a time."""
    letters = langid.letter_vectors().astype(int)
    text = (text or "").lower()
    classes = [0]
    for c in text:
        k = 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (langid.CLASSES - 27)
        if k or classes[-1]:
            classes.append(k)
    if classes[-1]:
        classes.append(0)
    out = np.zeros(langid.DIMENSIONS, int)
    for i in range(len(classes) - 2):
        a, b, c = classes[i : i + 3]
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_bundles():
    texts = ["Hello, world!", "été ñ  ß 𝒳y", "", None, "...", "a", "日本語 text", "x1y2 z"]
    got = langid.Profiles([], np.zeros((0, langid.DIMENSIONS))).bundle(texts)
    for vector, text in zip(got, texts, strict=True):
        assert np.array_equal(vector.astype(int), plain_bundle(text)), text


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predict(docs, langid.fit(docs)).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98


def test_predictions_are_the_nearest_prototypes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    profiles = langid.fit(docs)
    sums = {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] = sums.get(r.lang, 0) + plain_bundle(r.text)
    assert sorted(sums) == profiles.languages
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs, profiles).collect():
        near = {lang: cosine(plain_bundle(texts[r.doc_id]), s) for lang, s in sums.items()}
        assert near[r.lang_pred] >= max(near.values()) - 1e-5 and abs(r.score - max(0, near[r.lang_pred])) < 1e-4


def test_awkward_rows(awkward, no_rows):
    profiles = langid.fit(awkward)
    rows = langid.predict(awkward, profiles).collect()
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert langid.predict(no_rows, profiles).collect() == []
    nothing = langid.fit(no_rows)
    assert {(r.lang_pred, r.score) for r in langid.predict(awkward, nothing).collect()} == {("und", 0.0)}
    kept = langid.keep_known(awkward, profiles)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    sure = sorted((r.doc_id for r in rows if r.lang_pred != "und" and r.score >= langid.MIN_SCORE), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sure and {1, 2, 6} <= set(sure)


def test_lang_source_and_id_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.fit(docs)
    blind = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source")
    assert sorted(langid.predict(blind, profiles).collect()) == sorted(langid.predict(docs, profiles).collect())


def test_very_many_languages(spark, monkeypatch):
    """There may be any number, compared block by block; a tie goes to the first."""
    rows = [(k, f"word{k % 1500} {chr(97 + k % 26) * 3}{chr(97 + k // 26 % 26) * 3}{chr(97 + k // 676 % 26) * 3} tail", f"l{k % 1500:04d}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(docs)
    assert 1000 < len(profiles.languages) <= 1500 and profiles.languages == sorted(profiles.languages)
    whole = sorted(langid.predict(docs, profiles).collect())
    monkeypatch.setattr(langid, "BLOCK", 400)
    assert len(profiles.blocks()) > 2
    assert sorted(langid.predict(docs, langid.fit(docs)).collect()) == whole
    twins = langid.Profiles(["a", "b"], np.stack([profiles.prototypes[0]] * 2))
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert {r.lang_pred for r in langid.predict(docs.limit(5), twins).collect()} == {"a"}


def test_memory_of_texts_with_very_many_ngrams():
    """A group of texts whose n-grams are nearly all different takes memory in proportion to the texts."""
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 7800))) for _ in range(256)]
    profiles = langid.Profiles([], np.zeros((0, langid.DIMENSIONS)))
    tracemalloc.start()
    profiles.bundle(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
