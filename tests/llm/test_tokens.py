import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from rowloom.llm import tokens
from rowloom.llm.queries import VOCABULARY
from tests.conftest import SF


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load(VOCABULARY)


def reference(vocabulary):
    """A unigram tokenizer of the same pieces, in another library."""
    low = min(s for _, s in vocabulary.pieces)
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    bytes_ = [(model.id_to_piece(i), low) for i in range(model.get_piece_size()) if model.is_byte(i)]
    out = Tokenizer(models.Unigram([("\0unknown", low), *bytes_, *vocabulary.pieces], unk_id=0, byte_fallback=True))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(out.encode(text, add_special_tokens=False).ids)


def test_whole_documents_against_a_tokenizer(spark, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = reference(vocabulary)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = tokens.token_counts(docs, vocabulary).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: count(t) for k, t in texts.items()}


def test_single_words_against_a_tokenizer(spark, vocabulary):
    count, counter = reference(vocabulary), tokens.Counter(vocabulary)
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in r.text.split()}
    words |= {"", "a", "é", "日本", "𝒳", "\n", "a  b", "antidisestablishmentarianism", "x" * 5000, "a " * 3000}
    assert {w: counter.count(w) for w in words} == {w: count(w) for w in words}


def plain(vocabulary, text):
    """Viterbi over all places and lengths, the earliest start winning ties."""
    pieces = dict(vocabulary.pieces)
    low = min(pieces.values()) - 10
    text = ("▁" if vocabulary.prefix else "") + text.replace(" ", "▁") if text else ""
    best = [(0.0, 0, False)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            score, count, _ = best[start]
            piece = text[start:end]
            if piece in pieces:
                option = (score + pieces[piece], count + 1, False)
            elif start == end - 1:
                option = (score + low, count + (len(piece.encode()) if vocabulary.bytes else 0 if best[start][2] else 1), True)
            else:
                continue
            if best[end] is None or option[0] > best[end][0]:
                best[end] = option
    return best[-1][1]


@pytest.mark.parametrize(("bytes_", "prefix"), [(True, True), (False, True), (False, False)])
def test_ties_and_unknowns_against_brute_force(bytes_, prefix):
    rng = random.Random(7)
    for _ in range(30):
        pieces = {"".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        v = tokens.Vocabulary(tuple((p, float(-rng.randint(1, 4))) for p in sorted(pieces)), bytes_, prefix)
        counter = tokens.Counter(v)
        for _ in range(20):
            text = "".join(rng.choice("ab é\nx𝒳") for _ in range(rng.randint(0, 14)))
            assert counter.count(text) == plain(v, text), (v, text)


def test_memo_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    counter, fresh = tokens.Counter(vocabulary), tokens.Counter(vocabulary)
    text = " ".join(f"word{k}" for k in range(100))
    assert counter.count(text) == sum(fresh.viterbi(f"▁word{k}") for k in range(100)) and len(counter) <= 5


def test_awkward_rows(awkward, no_rows, vocabulary):
    rows = tokens.token_counts(awkward, vocabulary).collect()
    texts = [r.text for r in awkward.collect()]
    assert [r.n_tokens for r in rows] == [tokens.Counter(vocabulary).count(t) for t in texts]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert tokens.token_counts(no_rows, vocabulary).collect() == []
