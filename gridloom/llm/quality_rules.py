"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one long in which
bit ``b`` says that rule ``b`` failed. A policy is a versioned mask over those bits, so that a new
policy, or a policy without one of its rules (an ablation), reads the ledger and not the texts.

Only DataFrame functions run here and no row leaves its partition until an ablation counts bits.

Defined results: a null or empty text has no words and fails ``few_words``; other columns go along
(with the ledger's names replaced by its own); repeated rows are judged alike; an empty table gives
an empty ledger. Three-word windows are compared by a 64-bit hash of their words within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, read, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capital_words", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements; ``bit`` never changes once a ledger was written."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > n_words"),
    Rule(4, "duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(5, "letterless_words", "100 * n_letter_words < 75 * n_words"),
    Rule(6, "capitals", "100 * n_capital_words > 50 * n_words"),
    Rule(7, "shouts", "100 * n_shouts > 20 * n_words"),
)
#: Versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[x] for x in POLICIES[policy])


def _n(array: Column) -> Column:
    return F.size(array).cast("long")


def _measured(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    df = df.withColumn("_w", words(F.col("text"))).withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_h", F.filter(F.transform("_w", lambda w, i: F.when(i + 2 < F.size("_w"), F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))), lambda h: h.isNotNull()))
    # windows in order of their hashes; one equal to a neighbour in that order occurs twice or more
    df = df.withColumn("_d", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_s", F.when(F.col("_d"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda s, j: (s["h"] == F.get("_s", j + 1)["h"]) | ((j > 0) & (s["h"] == F.get("_s", F.greatest(j - 1, F.lit(0)))["h"]))
    df = df.withColumn("_p", F.sort_array(F.filter(F.transform("_s", lambda s, j: F.when(twin(s, j), s["i"])), lambda i: i.isNotNull())))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])
    capital = lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    return df.withColumns(
        {
            "n_words": _n(F.col("_w")),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": _n(F.col("_l")),
            "n_dup_lines": _n(F.col("_l")) - _n(F.array_distinct("_l")),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "n_letter_words": _n(F.filter("_w", lambda w: w.rlike(r"\p{L}"))),
            "n_capital_words": _n(F.filter("_w", capital)),
            "n_shouts": _n(F.filter("_w", lambda w: w.endswith("!!") | w.endswith("??"))),
        }
    ).drop("_w", "_l", "_h", "_d", "_s", "_p")


def ledger(df: DataFrame) -> DataFrame:
    """Adds the measurements and ``failed_bits`` to ``df`` (text, ...)."""
    bits = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END" for r in RULES)
    return _measured(df.drop(*MEASURES, "failed_bits", "_w", "_l", "_h", "_d", "_s", "_p")).withColumn("failed_bits", F.expr(bits))


def passes(policy: str) -> Column:
    """Whether a ledger's row breaks no rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept without it)."""
    rules = [r for r in RULES if mask(policy) >> r.bit & 1]
    under = rows.select(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])).alias("r")
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    return under.select("b", "n", one).groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("only_this"),
    )


def quality_rules(df: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``df`` that a policy keeps, with the columns of ``df``.

    The ledger is written first: policies read its bits. (A filter over the unwritten ledger would be
    pushed below it and evaluate every measurement once for each rule that names it.)
    """
    return materialize(ledger(df)).where(passes(policy)).select(*df.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *MEASURES, "failed_bits", F.lit("v2").alias("policy"), (~passes("base")).alias("base_failed"), passes("v2").alias("kept"))
