"""Language identification by hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector is the product
of its letters' vectors, each permuted by its place; a text's vector is the sum
over its n-grams, and a language's prototype the sum over its sample texts. A
text gets the language whose prototype has the largest cosine to its vector.

Whole texts count, both in prototypes and in predictions. Prototypes are fitted
on at most ROWS_PER_LANGUAGE labelled rows a language (chosen by hash of doc_id,
so their number is an expected one); only their sums, 8 KB a language, reach the
driver. Texts are compared with BLOCK languages at a time, so there may be any
number of languages.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there is nothing to learn from; ties go to the language
first in code point order; rows with null doc_id are held in; rows with null
lang or text teach nothing; repeated rows each get a row; empty tables give
empty results; other columns are ignored, and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
DIMENSIONS = 1024
GRAM = 3
SEED = 42
ROWS_PER_LANGUAGE = 2000
#: Languages (4 KB each) that texts are compared with at once, and whose sums a task holds.
BLOCK = 4096
FIT_TASKS = 8
#: Documents a stage keeps have at least this score: the spread of cosines of unrelated vectors.
MIN_SCORE = DIMENSIONS**-0.5
#: Letters a-z have classes 1 to 26; other letters share the rest. 0 is a boundary.
CLASSES = 128
#: Texts, and about as many code points, whose vectors are made at once.
GROUP_TEXTS, GROUP_CHARS = 256, 2_000_000
#: N-grams whose vectors are made at once.
GRAMS = 4096


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))


def _class_table() -> np.ndarray:
    """Class by code point, below the astral planes."""
    table = np.zeros(0x10000, np.uint8)
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
            table[point] = point - 96 if 97 <= point <= 122 else 27 + point % (CLASSES - 27)
    return table


class Profiles:
    """N-gram vectors and the prototypes of languages."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages = languages
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        self.prototypes = (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)
        letters = letter_vectors()
        self.rolled = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.table = _class_table()

    def grams(self, text: str) -> np.ndarray:
        """The n-gram ids of a text, with one boundary for each run of other characters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32)
        classes = self.table[np.minimum(points, 0xFFFF)]
        for at in np.flatnonzero(points > 0xFFFF):
            classes[at] = 27 + points[at] % (CLASSES - 27) if chr(points[at]).isalpha() else 0
        if not classes.any():
            return np.zeros(0, np.int32)
        padded = np.concatenate([np.zeros(1, np.uint8), classes, np.zeros(1, np.uint8)])
        kept = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])].astype(np.int32)
        ids = np.zeros(len(kept) - GRAM + 1, np.int32)
        for k in range(GRAM):
            ids = ids * CLASSES + kept[k : len(kept) - GRAM + 1 + k]
        return ids

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A vector for each text; zero if it has no letter."""
        lists = [np.sort(self.grams(t)) if t else np.zeros(0, np.int32) for t in texts]
        seen = np.zeros(CLASSES**GRAM, bool)
        for ids in lists:
            seen[ids] = True
        known = np.flatnonzero(seen)
        place = np.zeros(CLASSES**GRAM, np.int32)
        place[known] = np.arange(len(known))
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        cuts = [np.searchsorted(ids, known[::GRAMS]) for ids in lists]
        counts = np.zeros((len(texts), GRAMS), np.float32)
        for k, at in enumerate(range(0, len(known), GRAMS)):
            part = known[at : at + GRAMS]
            for row, (ids, cut) in enumerate(zip(lists, cuts, strict=True)):
                own = ids[cut[k] : cut[k + 1] if k + 1 < len(cut) else None]
                counts[row, : len(part)] = np.bincount(place[own] - at, minlength=len(part))
            vectors = np.ones((len(part), DIMENSIONS), np.int8)
            for g in range(GRAM):
                vectors *= self.rolled[g][part // CLASSES ** (GRAM - 1 - g) % CLASSES]
            out += counts[:, : len(part)] @ vectors.astype(np.float32)
        return out

    def blocks(self) -> list[tuple[list[str], np.ndarray]]:
        """Languages and prototypes by BLOCK, none if there are none."""
        return [(self.languages[k : k + BLOCK], self.prototypes[k : k + BLOCK]) for k in range(0, len(self.languages), BLOCK)]

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text and its cosine, -2 and UND for a text without letters."""
        vectors = self.bundle(texts)
        norms = np.linalg.norm(vectors, axis=1)
        if not self.languages:
            return [UND] * len(texts), np.full(len(texts), -2.0)
        cosines = (vectors @ self.prototypes.T) / np.where(norms > 0, norms, 1)[:, None]
        best = cosines.argmax(axis=1)
        return [self.languages[b] if n > 0 else UND for b, n in zip(best, norms, strict=True)], np.where(norms > 0, cosines[np.arange(len(texts)), best], -2.0).astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, cosines = self.nearest(texts)
        return names, [min(1.0, max(0.0, float(c))) for c in cosines]


def groups(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text or "")
        if len(held) >= GROUP_TEXTS or chars >= GROUP_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def held_out(divisor: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Profiles:
    """Profiles of the languages in lang, from rows that aren't held out."""
    taught = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull())
    counts = sorted(tuple(r) for r in taught.groupBy("lang").count().collect())  # a row for each language
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    shares = docs.sparkSession.createDataFrame([(name, k, min(1.0, rows_per_language / n)) for k, (name, n) in enumerate(counts)], "lang string, no int, share double")
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < F.col("share") * float(1 << 30)
    sample = taught.where(F.col("text").isNotNull()).join(F.broadcast(shares), "lang").where(chosen).select("no", "text").repartition(FIT_TASKS)

    def listed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["no", "sums"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles([], np.zeros((0, DIMENSIONS))), {}
        for batch in batches:
            langs, texts = batch.column("no").to_pylist(), batch.column("text").to_pylist()
            at = 0
            for part in groups(iter(texts)):
                vectors = profiles.bundle(part)
                for lang, vector in zip(langs[at : at + len(part)], vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
                at += len(part)
                if len(sums) >= BLOCK:
                    yield listed(sums)
                    sums.clear()
        if sums:
            yield listed(sums)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One sum a language; rows come by language. Sums are of whole numbers, so their order doesn't matter."""
        of, total = None, np.zeros(DIMENSIONS)
        for batch in batches:
            for no, sums in zip(batch.column("no").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if of is not None and no != of:
                    yield listed({of: total})
                    total = np.zeros(DIMENSIONS)
                of, total = no, total + np.frombuffer(sums)
        if of is not None:
            yield listed({of: total})

    kind = "no int, sums binary"
    found = sample.mapInArrow(bundle, kind).repartition(FIT_TASKS, "no").sortWithinPartitions("no").mapInArrow(together, kind)
    prototypes = np.zeros((len(counts), DIMENSIONS))
    for row in found.toLocalIterator():
        prototypes[row["no"]] = np.frombuffer(row["sums"])
    learned = np.flatnonzero(np.abs(prototypes).sum(axis=1))
    return Profiles([counts[k][0] for k in learned], prototypes[learned])


def _predicted(block: tuple[list[str], np.ndarray], names: tuple[str, str], first: bool):
    """Nearest languages of a block as two more columns, or in those that there are where they are nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*block)
        for batch in batches:
            langs: list[str] = []
            cosines: list[float] = []
            for part in groups(t.as_py() for t in batch.column("text")):
                found, sure = own.nearest(part)
                langs += found
                cosines += sure.tolist()
            kept = batch.columns if first else batch.columns[:-2]
            if not first:  # the language first in order stays by ties
                before = list(zip(batch.column(names[0]).to_pylist(), batch.column(names[1]).to_pylist(), strict=True))
                both = [b if b[1] >= c else (lang, c) for b, lang, c in zip(before, langs, cosines, strict=True)]
                langs, cosines = [b[0] for b in both], [b[1] for b in both]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(cosines, pa.float64())], names=[*batch.schema.names[: len(kept)], *names])

    return run


def _with_languages(rows: DataFrame, profiles: Profiles, names: tuple[str, str]) -> DataFrame:
    """rows with the nearest language of text, and its score."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), f"{names[0]} string, {names[1]} double"])
    for k, block in enumerate(profiles.blocks() or [([], np.zeros((0, DIMENSIONS)))]):
        rows = rows.mapInArrow(_predicted(block, names, k == 0), schema)
    return rows.withColumn(names[1], F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(names[1]))))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return _with_languages(rows, profiles, ("lang_pred", "score")).drop("text")


def keep_known(docs: DataFrame, profiles: Profiles, least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with its columns, whose language is known with at least that score."""
    plain = docs.toDF(*(f"c{k}" if c != "text" else c for k, c in enumerate(docs.columns)))
    found = _with_languages(plain, profiles, ("found", "sure"))
    return found.where((F.col("found") != UND) & (F.col("sure") >= least)).drop("found", "sure").toDF(*docs.columns)
