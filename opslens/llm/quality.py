"""Quality rules as a short-circuit cascade, in native expressions only.

Each rule has a condition that rejects a document. On a bounded sample the cost and the rejections of every rule are
measured; the cascade asks the rules in the order of rejections per cost, and a rejected document is not asked further.
The order decides the work only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import bounded_sample
from opslens.session import stored

#: Documents on which rules are measured at most.
SAMPLE = 2000
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


# -- measures --------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text; ``found`` are the words.

    Windows are told apart by 64-bit hashes. Only a text that has equal windows pays for sorting them and for adding
    up the words between them.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            n = F.size(p)
            same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(p, i)["i"]))

        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i + window - s["end"])).alias("n"), (i + window).alias("end"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(pairs, places), start, step, lambda s: s["n"])

    def count(own: Column) -> Column:
        windows = F.transform(
            F.slice(own, 1, F.greatest(F.size(own) - (window - 1), F.lit(0))),
            lambda h, i: F.xxhash64(*(F.get(own, i + k) for k in range(window))),
        )
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(F.transform(found, lambda w: F.xxhash64(w)), count)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("_counted", counted)
    return rows.select(
        "doc_id", "text", F.col("_counted")["n"].alias("n_words"), _without(text, WHITE).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"), F.col("_counted")["r"].alias("n_repeat_words"),
    )


# -- rules -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the columns of ``measured``."""

    name: str
    rejects: Column


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def standard_rules() -> list[Rule]:
    """Symbols in place of prose or tables, shouting, repeated lines, words too short or too long, few letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.col("n_words")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    exclaimed = F.length(text) - _without(text, "!")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2 * n)),
        Rule("dup_lines", 5 * F.col("n_dup_lines") > F.size(F.split(text, "\n")) * 2),
        Rule("upper_case", 10 * upper > 4 * letters),
        Rule("letters", 2 * letters < F.col("word_chars")),
        Rule("exclaimed", 4 * exclaimed > n),
    ]


def order_rules(measured: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejections per second on a bounded sample of measured documents."""
    rows = stored(measured)
    rows.agg(F.count("text")).first()
    worth = []
    for rule in rules:
        began = time.perf_counter()
        rejected = rows.agg(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long"))).first()[0] or 0
        worth.append((-rejected / max(time.perf_counter() - began, 1e-6), rule.name, rule))
    return [rule for _, _, rule in sorted(worth, key=lambda x: x[:2])]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``, the measures, ``base_failed``, ``failed_rule`` (null if none was asked or rejected) and ``kept``.

    Documents that fail the base check are not asked further. Which rule is named depends on the measured order; what
    is kept does not. Null and empty texts have no words and fail. Repeated rows and null ids are returned as given,
    further columns are ignored, an empty table gives an empty result.
    """
    rules = standard_rules() if rules is None else rules
    rules = order_rules(measures(bounded_sample(docs, id_col, sample), id_col, text_col), rules)
    measured = measures(docs, id_col, text_col).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    ruled = measured.withColumn("failed_rule", F.when(~F.col("base_failed"), cascade(rules)))
    return ruled.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
