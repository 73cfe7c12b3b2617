import hashlib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowloom.llm import pii
from tests.conftest import SF

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.spans(df)).collect():
        want = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in BASE]
        assert r.spans == listed or r.spans.startswith(listed)


def test_real_documents(spark):
    check(spark, [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_texts_made_of_pieces(spark):
    rng = random.Random(5)
    pieces = ["a", "@", "b.c", ".", " ", "-", "+", "1", "23", "4111 1111 1111 1111", "4111111111111111", "255.1.2.3", "256.1.1.1", "00.1.2.3", "+1 (555) 123-4567", "é", "𝒳", "\n", "x@y.z", "_", "(", "%"]
    check(spark, ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1.@+- ()2é𝒳_%", max_size=40), min_size=40, max_size=40))
def test_any_texts(spark, texts):
    check(spark, texts)


def test_long_texts(spark):
    check(spark, ["1" * 50_000, "x@y.z " * 5_000, "a" * 100_000 + "@", "1.2.3.4 " * 3_000, "+1" + "-" * 50_000 + "2", "1 " * 20_000, None, ""])


def test_further_kinds_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "my ssn is 123-45-6789", "part 123-45-6789", "000-12-3456 ssn", "amex 378282246310005", "code 378282246310005"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.spans(df)).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:10:21", 3: "", 4: "", 5: "card_short:5:20", 6: ""}


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(0, "call +1 555 123 4567"), (1, "code +1 555 123 4567")], "doc_id long, text string")
    got = {r.doc_id: r.spans[0].score for r in pii.spans(df).collect()}
    assert got == {0: 0.9, 1: 0.6}


def test_redaction(spark):
    texts = ["mail a@b.c or a@b.c é, +1 (10.0.0.1) 555 00 x", None, "plain", "4111 1111 1111 1111"]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = pii.redact(df)
    assert got.columns == df.columns
    sized = spark.createDataFrame([(1, "to a@b.c", 8), (2, "none", None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, pii.redact(sized).collect())) == [(1, "to [EMAIL]", 10), (2, "none", None)]
    assert [r.text for r in sorted(got.collect())] == ["mail [EMAIL] or [EMAIL] é, [PHONE] x", None, "plain", "[CARD]"]


def test_awkward_rows(awkward, no_rows):
    got = pii.digest(pii.spans(awkward)).collect()
    assert len(got) == awkward.count() and sum(r.n_email for r in got) == 0
    assert pii.redact(awkward).columns == awkward.columns
    assert sorted(map(str, pii.redact(awkward).collect())) == sorted(map(str, awkward.collect()))
    assert pii.digest(pii.spans(no_rows)).collect() == []


def test_redaction_of_many_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 3)
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a@b.c ", "é ", "+1 (10.0.0.1) 555 00", " 1.2.3.4", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.redact(df).collect():
        upto, out = 0, []
        for a, b, kind in sorted((a, b, k) for k, a, b in plain(texts[r.doc_id])):
            if a >= upto:
                out.append(texts[r.doc_id][upto:a] + f"[{kind.upper()}]")
            upto = max(upto, b)
        assert r.text == "".join(out) + texts[r.doc_id][upto:]


def listed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.spans for r in sorted(pii.digest(pii.spans(df)).collect(), key=lambda r: r.doc_id)]


def test_ibans_before_words(spark, monkeypatch):
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    other = "ZZ" + f"{98 - int('12345678901234567' + '353500') % 97:02d}" + "12345678901234567"  # a country that isn't listed
    texts = [f"{de} Danke", f"{gb} Please", f"IBAN {de} BIC COBADEFFXXX", f"{de} {gb} {no}", f"{other} QRS", f"{de}X", f"{de}x", f"x{de}", f"AB12 CDEF GHIJ KLMN {de} OK", f"{de[:-1]}1 Danke", f"{other} X1 {no} Y"]
    want = ["iban:0:22", "iban:0:27", "iban:5:27", "iban:0:22,iban:23:50,iban:51:66", "iban:0:21", "", "", "", "iban:20:42", "", "iban:0:21,iban:25:40"]
    assert listed(spark, texts) == want
    monkeypatch.setattr(pii, "CHUNK", 2)
    assert listed(spark, texts) == want


def test_context_reaches_over_other_proposals(spark, monkeypatch):
    texts = ["ssn 123-45-6789, 234-56-7890", "amex exp 12/2027: 378282246310005", "123-45-6789 234-56-7890 are ssn", "ssn" + " " * 38 + "123-45-6789", "ssn" + " " * 37 + "123-45-6789", "é𝒳 " * 30 + "ssn 123-45-6789 234-56-7890 345-67-8901"]
    want = ["ssn:4:15,ssn:17:28", "card_short:18:33", "ssn:0:11,ssn:12:23", "", "ssn:40:51", "ssn:94:105,ssn:106:117,ssn:118:129"]
    assert listed(spark, texts) == want
    monkeypatch.setattr(pii, "CHUNK", 2)
    assert listed(spark, texts) == want
