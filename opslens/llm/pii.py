"""Personal data in native expressions: patterns propose spans, checksums confirm them, words nearby adjust the score.

Places are found without a UDF: a text is split at a pattern's matches, and the lengths of the parts and of the matches
add up to the places. The patterns have no repeated groups, on which the regular-expression engine would recurse, and
start where a run of their characters starts, so that long runs are read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.quality import let

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Characters before a span that are searched for context words, what such a word adds, and the least score.
CONTEXT, CONTEXT_SCORE, LEAST_SCORE = 48, 0.4, 0.6

# The shapes of the kinds.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24,}(?![A-Za-z0-9_+/=-])"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def sum_of(n: Column) -> Column:
        def value(i: Column) -> Column:
            d = F.substr(n, F.length(n) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(n) - 1), F.lit(0), lambda s, i: s + value(i))

    return let(number, lambda n: (F.length(n) > 0) & (sum_of(n) % 10 == 0))


def mod97(code: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 by 97, its first four characters moved to the end."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def rest(t: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            c = F.ascii(F.substr(t, i, F.lit(1)))
            return F.when(c < 58, (s * 10 + c - 48) % 97).otherwise((s * 100 + c - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), step)

    return let(turned, lambda t: rest(t) == 1)


def octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda n: (F.length(n) <= 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255)))


def varied(text: Column) -> Column:
    """Letters and digits mixed, as in keys and not as in long words or numbers."""
    return text.rlike("[0-9]") & text.rlike("[A-Za-z]") & (F.length(F.regexp_replace(text, "[^0-9]", "")) * 8 >= F.length(text))


def between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Kind:
    """``gate`` is a cheap condition on texts that may hold the kind; ``valid`` the check of a match; ``score`` that of
    a valid match without context. Matches of a base kind count whatever their score."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


KINDS = (
    Kind("email", EMAIL, lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), octets, 0.6, "ip|host|address|server"),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda v: luhn(digits(v)), 0.7, "card|visa|credit|pay"),
    Kind("phone", PHONE, lambda t: F.contains(t, F.lit("+")), lambda v: between(F.length(digits(v)), 8, 15), 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, 0.8, "iban|account|bank", base=False),
    Kind("ssn", SSN, lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|social-security", base=False),
    Kind("secret", SECRET, lambda t: t.rlike("[A-Za-z0-9_+/=-]{24}"), varied, 0.3, "token|secret|passw|api[ _-]?key|key *[=:]|bearer|credential", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def matches(text: Column, pattern: str) -> Column:
    """All matches from the left that do not overlap, with their places in code points, end exclusive."""

    def places(found: Column) -> Column:
        def with_parts(parts: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                start = s["at"] + F.length(F.get(parts, i))
                end = start + F.length(F.get(found, i))
                return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("value")))).alias("out"))

            empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, step, lambda s: s["out"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_parts)).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind as ``kind, start, end, score``."""
    before = lambda s: F.lower(F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    found = F.filter(matches(text, kind.pattern), lambda s: kind.valid(s["value"]))

    def scored(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(before(s).rlike(rf"(?<![a-z])(?:{kind.words})"), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    all_ = F.transform(found, scored)
    kept = all_ if kind.base else F.filter(all_, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(kind.gate(text), kept).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``spans``: ``kind, start, end, score`` by kind as in ``KINDS``, then start.

    A null or empty text has no spans. Columns named ``spans`` are replaced; rows are neither joined nor counted, so
    repeated rows, null ids and empty tables need no care.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("spans", F.concat(*(spans_of(text, k) for k in KINDS)))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans are one, named by
    the first of them. Other columns stay as they are; a null text stays null."""
    text = F.col(text_col)
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        more = F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, more).otherwise(s["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate(order, empty, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    spans = F.concat(*(spans_of(F.coalesce(text, F.lit("")), k) for k in KINDS))
    found = docs.withColumn("_spans", spans)
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, new).otherwise(text)).select(*docs.columns)

