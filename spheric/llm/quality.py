"""Quality rules as a bitmask ledger: every rule is evaluated once, its measurement and failure bit stored; policies and ablations are bit arithmetic over the ledger.

Built-in functions only: each text is measured within its row, so nothing is shuffled but the ablation's few sums.

A null text holds no words and counts as an empty one, which fails the rule of length. Rows that repeat, and null ids,
have a ledger row each; texts of any length are measured whole, and an empty table has an empty ledger. Further columns,
of any name, stay as they are; those of the ledger's names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spheric.llm.common import fresh, let

#: What parts words, and what counts as a symbol.
SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A text fails where the condition, SQL over the measurements, holds."""

    name: str
    fails: str


#: The bit of a rule is its place here: add at the end, never reorder, so that stored ledgers keep their meaning.
RULES = (
    Rule("short", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("long_words", "longest_word > 1000"),
    Rule("few_letters", "100 * n_letters < 60 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A version: a text goes if it fails any rule named."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(x) for x in dict.fromkeys(self.rules))


BASE = Policy("base", ("short", "repeated_words"))
STRICT = Policy("2", ("short", "repeated_words", "repeated_lines", "symbols", "word_length", "long_words", "few_letters"))


def repeat_words(words: Column, width: int = 3) -> Column:
    """The words that stand in a window of width words which the text has twice or more.

    Windows are hashed to 64 bits and sorted with their places, so equal ones stand together; a word is counted at the
    last repeated window that begins no later than it does.
    """

    def windows(w: Column) -> Column:
        places = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(width)]).alias("h"), i.alias("i"))))

    def repeated(held: Column) -> Column:
        near = lambda x, k: (F.get(held, k + 1)["h"] == x["h"]) | (F.get(held, k - 1)["h"] == x["h"])
        return F.sort_array(F.filter(F.transform(held, lambda x, k: F.when(near(x, k), x["i"])), lambda x: x.isNotNull()))

    def covered(starts: Column) -> Column:
        return F.transform(starts, lambda s, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - s, F.lit(width))))

    return let(words, lambda w: let(windows(w), lambda held: let(repeated(held), lambda starts: F.aggregate(covered(starts), F.lit(0), lambda a, x: a + x))))


def measurements(text: Column) -> dict[str, Column]:
    """The measurements by name; words and lines are split once each."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return {"words": words, "lines": lines}


def ledger(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its measurements and failures, a bit for each rule."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = fresh(docs, "parts")
    parts = docs.withColumn(held, F.struct(*[c.alias(name) for name, c in measurements(t).items()]))
    words, lines = F.col(f"{held}.words"), F.col(f"{held}.lines")
    joined = F.array_join(words, "")
    measured = parts.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_letters": F.length(F.regexp_replace(joined, r"[^\p{L}]+", "")).cast("long"),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOL, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }).drop(held)
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(rules)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures)


def verdict(failures: Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the policy keeps a row."""
    return failures.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(held: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (rule, failed, alone): how many the rule fails, and how many would stay without it. One pass, two sums for each rule."""
    mask = policy.mask(rules)
    own = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    names = [r.name for i, r in enumerate(rules) if mask >> i & 1]
    at = {r.name: i for i, r in enumerate(rules)}
    sums = []
    for name in names:
        bit = F.lit(1 << at[name]).cast("long")
        sums += [F.count(F.when(own.bitwiseAND(bit) != 0, 1)).alias(f"failed_{name}"), F.count(F.when(own == bit, 1)).alias(f"alone_{name}")]
    row = held.agg(*sums)
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("failed"), F.col(f"alone_{n}").alias("alone")) for n in names])))


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents, and the failure bits."""
    held = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(F.col("failures"), BASE)).alias("base_failed"), verdict(F.col("failures"), STRICT).alias("kept"), "failures",
    )
