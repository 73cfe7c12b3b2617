"""Personal data, in DataFrame operations only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for IBANs), and context words near a span raise its score. Base kinds
(email, ip, card, phone) are kept whatever their context says; the further kinds
(iban, ssn, and cards of 13 to 15 digits as ``card_short``) are kept from a
score of MIN_SCORE on.

Spans are places in code points, the end exclusive. A pattern's matches and the
pieces between them add up to the text, so places are running sums of lengths.
The patterns find what their plain forms in the comments find, but possessively
and from the start of a run only, so no text makes them slow or deep. The IBANs'
pattern takes up an IBAN's first four characters only, and looks at what may
follow: a country of the registry has its length, for others each length is
tried, the longest first. An IBAN must not go on with a letter or digit, and
does not begin within another one.

Context is the text's own on either side of a span, whatever else is found there.

Defined results: a null text is an empty one, with no spans; empty tables give
empty results; rows are independent, so repeated rows and null ids keep a row
each; other columns are kept by ``redact`` and ignored by ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "card_short")
KINDS = BASE + EXTRA
MIN_SCORE = 0.6
#: Code points on either side of a span in which context words count.
CONTEXT = 40

# The patterns by kind.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # [A-Z]{2}[0-9]{2}, and ahead of it the group (\x20?[A-Z0-9]){11,30}[A-Za-z0-9]?
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
    # [0-9]{3}-[0-9]{2}-[0-9]{4}
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# The lengths of IBANs in the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Characters that a match takes up, where it isn't all of it.
TAKES = {"iban": 4}
#: What a text must hold (nothing: any) for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": "", "ssn": "-"}
#: Context words by kind, in lower case.
CONTEXT_WORDS = {
    "email": "mail|contact|write to|courriel|correo",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|appelez",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "card_short": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
}
#: Scores of a confirmed span without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.8, 1.0), "ssn": (0.4, 0.8), "card_short": (0.5, 0.9)}

#: Matches that are walked at a time, so that appending stays in proportion.
CHUNK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""

    def step(total: Column, k: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces, A-Z and 0-9 only, leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _iban(ahead: Column) -> Column:
    """The IBAN that begins what the pattern saw ahead, or null."""
    lengths = F.create_map(*(F.lit(x) for n, countries in IBAN_LENGTHS.items() for c in countries.split() for x in (c, n)))
    own = F.try_element_at(lengths, F.left(ahead, F.lit(2)))
    tried = F.when(own.isNotNull(), F.array(own)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
    cut = lambda n: F.regexp_substr(ahead, F.concat(F.lit(r"\A(?:[A-Z0-9]\x20?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Za-z0-9])")))
    return F.get(F.filter(F.transform(tried, cut), lambda c: F.when(c.isNotNull(), mod97(F.replace(c, F.lit(" "), F.lit("")))).otherwise(False)), F.lit(0))


def _confirmed(kind: str, match: Column) -> Column:
    """The kind that a match of the pattern is, or null."""
    digits = _digits(match)
    n = F.length(digits)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    as_is = F.lit(kind)
    return {
        "email": as_is,
        "ip": F.when(match.rlike(rf"\A(?:{byte}\.){{3}}{byte}\z"), as_is),
        "card": F.when(n.between(13, 19), F.when(luhn(digits), F.when(n >= 16, as_is).otherwise("card_short"))),
        "phone": F.when(n.between(8, 15), as_is),
        "iban": F.when(match.isNotNull(), as_is),
        "ssn": F.when(~match.rlike("\\A(?:000|666|9)|-00-|-0000\\z"), as_is),
    }[kind]


def _score(kind: Column, around: Column) -> Column:
    out = F.lit(0.0)
    for k in KINDS:
        out = F.when(kind == k, F.when(around.rlike(rf"(?<![a-z])(?:{CONTEXT_WORDS[k]})"), SCORES[k][1]).otherwise(SCORES[k][0])).otherwise(out)
    return out


def _scored(text: Column, found: Column) -> Column:
    """found, an array of (kind, start, end) in order, with scores; each chunk's context is cut from its stretch of the text."""

    def score_chunk(chunk: Column) -> Column:
        base = F.greatest(F.lit(0), chunk[0]["start"] - CONTEXT)
        stretch = F.substr(text, base + 1, F.element_at(chunk, -1)["end"] + CONTEXT - base)

        def score(x: Column, s: Column) -> Column:
            first = F.greatest(F.lit(0), x["start"] - CONTEXT)
            before = F.substr(s["stretch"], first - s["base"] + 1, x["start"] - first)
            around = F.lower(F.concat(before, F.lit(" "), F.substr(s["stretch"], x["end"] - s["base"] + 1, F.lit(CONTEXT))))
            # A transform evaluates what it goes over once.
            return F.transform(F.array(around), lambda a: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _score(x["kind"], a).alias("score")))[0]

        return F.flatten(F.transform(F.array(F.struct(base.alias("base"), stretch.alias("stretch"))), lambda s: F.transform(chunk, lambda x: score(x, s))))

    last = F.ceil(F.size(found) / CHUNK).cast("int") - 1
    return F.when(F.size(found) > 0, F.flatten(F.transform(F.sequence(F.lit(0), last), lambda c: F.flatten(F.transform(F.array(F.slice(found, c * CHUNK + 1, CHUNK)), score_chunk)))))


def spans(docs: DataFrame, out: str = "spans") -> DataFrame:
    """docs with an array of (kind, start, end, score), by kind as in KINDS, then start."""
    names = {k: f"__pii_{k}" for k in PATTERNS}
    rows = docs.withColumn("__pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("__pii_text")
    # Each step is a projection of its own whose columns the next one uses more than once, so that no pattern runs twice.
    for k, pattern in PATTERNS.items():
        there = (F.contains(text, F.lit(NEEDS[k])) if NEEDS[k] else F.lit(True)) & text.rlike(pattern)
        rows = rows.withColumn(f"{names[k]}_found", F.when(there, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _iban) if k == "iban" else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        rows = rows.withColumn(f"{names[k]}_parts", F.when(F.col(f"{names[k]}_found").isNotNull(), F.split(text, pattern, -1)))
    for name in names.values():
        found, parts = F.col(f"{name}_found"), F.col(f"{name}_parts")
        rows = rows.withColumn(name, F.zip_with(found, F.slice(parts, F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("match"), F.length(gap).alias("gap"))))
    rows = rows.drop(*(f"{n}_{x}" for n in names.values() for x in ("found", "parts")))
    span = "struct<kind:string,start:int,end:int,score:double>"

    def chunks(name: str) -> Column:
        count = F.ceil(F.size(name) / CHUNK).cast("int")
        return F.when(F.size(name) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(name, c * CHUNK + 1, CHUNK)))

    def takes(kind: str, match: Column) -> Column:
        return F.lit(TAKES[kind]) if kind in TAKES else F.length(match)

    def begins(kind: str, name: str) -> Column:
        wide = F.transform(F.col(name), lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + p["gap"] + takes(kind, p["match"])))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(wide, start, lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]

    def walk(kind: str, chunk: Column, begin: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            end = start + F.length(p["match"])
            found = F.struct(_confirmed(kind, p["match"]).alias("kind"), start.alias("start"), end.alias("end"))
            return F.struct((start + takes(kind, p["match"])).alias("at"), F.concat(a["all"], F.filter(F.array(found), lambda x: x["kind"].isNotNull())).alias("all"))

        begun = F.struct(begin.alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("all"))
        return F.aggregate(chunk, begun, step)["all"]

    def walk_all(kind: str, name: str) -> Column:
        return F.flatten(F.zip_with(f"{name}_chunks", f"{name}_begins", lambda c, b: walk(kind, c, b)))

    def apart(found: Column) -> Column:
        """Without those that begin within one before."""
        begun = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("all"))
        step = lambda a, x: F.when(x["start"] >= a["upto"], F.struct(x["end"].alias("upto"), F.concat(a["all"], F.array(x)).alias("all"))).otherwise(a)
        return F.aggregate(found, begun, step)["all"]

    for kind, name in names.items():
        rows = rows.withColumn(f"{name}_chunks", chunks(name)).withColumn(f"{name}_begins", begins(kind, f"{name}_chunks"))
    none = F.array().cast(f"array<{span}>")
    for kind, name in names.items():
        walked = walk_all(kind, name)
        rows = rows.withColumn(f"{name}_walked", apart(walked) if kind in TAKES else walked)
    for name in names.values():
        rows = rows.withColumn(f"{name}_spans", F.coalesce(_scored(text, F.col(f"{name}_walked")), none))
    cards = F.col(f"{names['card']}_spans")
    base = [F.filter(cards, lambda x: x["kind"] == "card") if k == "card" else F.col(f"{names[k]}_spans") for k in BASE]
    extra = F.filter(F.concat(F.col(f"{names['iban']}_spans"), F.col(f"{names['ssn']}_spans"), F.filter(cards, lambda x: x["kind"] == "card_short")), lambda x: x["score"] >= MIN_SCORE)
    made = [f"{n}{x}" for n in names.values() for x in ("", "_chunks", "_begins", "_walked", "_spans")]
    return rows.withColumn(out, F.concat(*base, extra)).drop("__pii_text", *made)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of docs with spans; scores are those of spans."""
    listed = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.concat_ws(",", F.transform("spans", lambda x: x["score"].cast("string"))).alias("scores"))


def redact(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """docs with each found span, overlapping ones as one, replaced by its kind in brackets.

    The column named by length, if docs has it, is the text's length where the text has changed.
    """
    found = spans(docs, "__spans")
    ordered = F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = found.withColumn("__spans", ordered)
    last = F.ceil(F.size("__spans") / CHUNK).cast("int") - 1
    found = found.withColumn("__chunks", F.when(F.size("__spans") > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("__spans", c * CHUNK + 1, CHUNK))))

    def cut(a: Column, s: Column) -> Column:
        """One span: what stands before it, cut from the chunk's stretch of the text, and its kind."""
        piece = F.concat(F.substr(a["stretch"], a["upto"] - a["base"] + 1, F.greatest(F.lit(0), s["start"] - a["upto"])), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        pieces = F.when(s["start"] >= a["upto"], F.concat(a["pieces"], F.array(piece))).otherwise(a["pieces"])
        return F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), a["base"].alias("base"), a["stretch"].alias("stretch"), pieces.alias("pieces"))

    def cut_chunk(a: Column, chunk: Column) -> Column:
        end = F.aggregate(chunk, a["upto"], lambda e, s: F.greatest(e, s["end"]))
        stretch = F.substr("text", a["upto"] + 1, end - a["upto"])
        none = F.array().cast("array<string>")
        inner = F.aggregate(chunk, F.struct(a["upto"].alias("upto"), a["upto"].alias("base"), stretch.alias("stretch"), none.alias("pieces")), cut, lambda x: F.struct(x["upto"].alias("upto"), F.array(F.array_join(x["pieces"], "")).alias("out")))
        done = F.array(inner)  # evaluated once for both fields
        return F.aggregate(done, a, lambda b, x: F.struct(x["upto"].alias("upto"), F.concat(b["out"], x["out"]).alias("out")))

    begun = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("__chunks", begun, cut_chunk, lambda a: F.concat(F.array_join(a["out"], ""), F.substr("text", a["upto"] + 1)))
    found = found.withColumn("__redacted", F.when(F.size("__spans") > 0, whole))

    def column(name: str) -> Column:
        if name == "text":
            return F.coalesce("__redacted", "text").alias("text")
        if name == length:
            return F.coalesce(F.length("__redacted").cast(docs.schema[name].dataType), F.col(name)).alias(name)
        return F.col(f"`{name}`")

    return found.select(*(column(c) for c in docs.columns))
