"""Personal data by DataFrame functions alone: patterns propose spans, checksums confirm them, context scores them.

Positions: ``split`` gives the gaps between matches and ``regexp_extract_all`` the matches; running
sums of their lengths (code points) are the spans. Unbounded runs are possessive and start only where a run of
their class starts or where the last match ended, which changes no match and keeps long runs linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

_LOCAL, _PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Length of an IBAN: the countries that have it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Groups of four to the length of the country; a code without a known length may have any, the longest first."""
    groups = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = [rf"(?:{'|'.join(codes.split())})[0-9]{{2}}{groups(n - 4)}" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


#: kind: (pattern, a cheap test that any match passes, score without context, context words)
KINDS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_PART}++(?:\.{_PART}++)++", "@", 0.9, "email|e-mail|mail|contact|correo|courriel"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|address|host|server|login|client"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|mastercard|credit|payment|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "phone|tel|call|mobile|fax|telefon|llame|appel"),
    "iban": (_iban(), None, 0.8, "iban|bank|account|konto|cuenta|compte"),
}
BASE = ("email", "ip", "card", "phone")
#: Code points before a span in which context words count, and what one adds to the score.
CONTEXT, BONUS = 40, 0.1


def running(lengths: Column) -> Column:
    """Sums of all elements up to each, in blocks of the square root of their number."""
    n = F.size(lengths)
    block = F.ceil(F.sqrt(n)).cast("int")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    def within(size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda j: total(F.slice(lengths, j * size + 1, size)))
        before = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda j: total(F.slice(blocks, F.lit(1), j)))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(before, F.floor(i / size).cast("int")) + total(F.slice(lengths, (F.floor(i / size) * size).cast("int") + 1, i % size + 1)))

    return F.when(n > 0, within(block)).otherwise(F.array().cast("array<bigint>"))


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The mod-97 check of an IBAN without spaces: four first characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _lengths(matches: Column, gaps: Column) -> Column:
    return F.transform(matches, lambda x, i: (F.length(F.get(gaps, i)) + F.length(x)).cast("long"))


def _spans(kind: str, matches: Column, gaps: Column, ends: Column) -> Column:
    _, _, score, context = KINDS[kind]

    def span(x, i):
        end = F.get(ends, i)
        near = F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT))).rlike(rf"\b(?:{context})\b")
        bonus = F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), (F.lit(score) + bonus).alias("score"), confirmed(kind, x).alias("ok"))

    return F.transform(matches, span)


def pii_spans(docs: DataFrame) -> DataFrame:
    """The documents' columns doc_id and text with _rk_spans: kind, start, end, score of each confirmed span.

    start and end count code points, end exclusive; kinds as in KINDS, then by start. The score is that
    of the kind, raised where a context word stands before the span. Null and empty texts have no spans,
    equal texts have equal ones, repeated rows stay, an empty table gives no rows. Texts are searched whole, however long.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # in steps, so that no pattern runs twice over a text
    has_digits = F.col("text").rlike("[0-9]{2}|[0-9][ -][0-9]")
    for kind, (pattern, needs, _, _) in KINDS.items():
        maybe = F.col("text").contains(needs) if needs else has_digits
        if kind in ("ip", "phone"):
            maybe = F.col("text").rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"\+[0-9]")
        rows = rows.withColumn(f"_rk_m_{kind}", F.when(maybe, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, (pattern, *_) in KINDS.items():
        found = F.size(f"_rk_m_{kind}") > 0
        rows = rows.withColumn(f"_rk_g_{kind}", F.when(found, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    spans = []
    for kind in KINDS:
        matches, gaps = F.col(f"_rk_m_{kind}"), F.col(f"_rk_g_{kind}")
        rows = rows.withColumn(f"_rk_l_{kind}", _lengths(matches, gaps))
        rows = rows.withColumn(f"_rk_e_{kind}", running(F.col(f"_rk_l_{kind}")))

        spans.append(F.filter(_spans(kind, matches, gaps, F.col(f"_rk_e_{kind}")), lambda s: s["ok"]))
    return rows.select("doc_id", "text", F.concat(*spans).alias("_rk_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with each base span that overlaps no earlier one replaced by its kind in brackets.

    Spans are taken by start; of overlapping spans the first, then the longest, stays.
    """
    rows = pii_spans(docs).withColumn("_rk_s", F.array_sort("_rk_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    done = F.aggregate("_rk_s", start, piece)
    return rows.withColumn("_rk_d", done).select("doc_id", F.concat(F.col("_rk_d.out"), F.substring("text", (F.col("_rk_d.at") + 1).cast("int"), F.length("text"))).alias("text"))


def op6_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_spans(documents(spark, sf_dir))
    spans = F.col("_rk_spans")
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *[of(k) for k in BASE],
        F.sha2(told(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        told(spans).alias("spans"),
        F.aggregate(spans, F.lit(0.0), lambda m, s: F.greatest(m, s["score"])).alias("top_score"),
    )
