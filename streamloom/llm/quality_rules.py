"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one failure bit per rule.
A policy is a named, versioned set of rules, applied to the ledger as a mask, and an ablation (what each rule
alone rejects, what would come back without it) is a bitwise aggregation over the ledger, never over texts.

Defined results: a null text has no words and fails `few_words`; an empty table gives an empty ledger; repeated
rows are measured each; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import bind, words_of

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the ledger, and the condition over measurements under which a document fails it."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)

#: Policies by version; later versions never change earlier ones.
POLICIES = {
    "base.1": ("few_words", "repeated_windows"),
    "web.1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in names)


def _covered(windows: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more: sort (hash, position), keep those beside an equal
    hash, and add up the gaps between their positions, at most a window's length each."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = bind(
        ordered,
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )
    return bind(
        starts,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
        ),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        words_of(text).alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    n = F.size("codes")
    windowed = hashed.withColumn(
        "windows",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("codes"), i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("codes")
    repeated = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(_covered(F.col("windows")))
    measured = windowed.withColumn("n_repeat_words", repeated.cast("long")).drop("windows")
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def fails(policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger is rejected by a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy], rules))) != 0


def apply_policy(ledger_df: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the policy's version and its verdict."""
    return ledger_df.withColumns({"policy": F.lit(policy), "kept": ~fails(policy, rules)})


def ablations(ledger_df: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (they return without it), and the bits that
    every one and any one of its failures also has. One aggregation over the bits."""
    mask = mask_of(POLICIES[policy], rules)
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    chosen = [r for r in rules if r.name in POLICIES[policy]]
    failed = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]
    return (
        ledger_df.select(bits.alias("bits"))
        .groupBy("bits")
        .agg(F.count("*").alias("n"))
        .select("bits", "n", F.explode(F.array(*failed)).alias("r"))
        .where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum("n").alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(F.lit(0))).alias("n_only"),
            F.bit_and("bits").alias("always_with"),
            F.bit_or("bits").alias("ever_with"),
        )
    )
