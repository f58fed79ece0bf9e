"""Quality rules as a ledger of failure bits (operator 10, native).

Every rule is evaluated once a document; the ledger keeps the measurements and one
``failures`` bitmask. Policies are masks over that ledger, so a new policy version or an
ablation costs bit arithmetic on a narrow table and never reads the texts again.

Defined results: a null text is an empty one, so it has no words and fails
``too_few_words``. Repeated rows are judged one by one. Extra columns, of any name, are ignored by
``ledger`` and kept by ``keep``. An empty table gives an empty ledger. Texts of any length are
measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.store import let, whole_words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL predicate over MEASURES


#: A rule's bit is its place; new rules go to the end so that stored ledgers stay valid.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_ratio", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    Rule("shouting", "2 * n_marks > n_words AND n_words > 0"),
)

#: Versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_ratio", "repeated_lines", "word_length", "shouting"),
}


def bit(rule: str) -> int:
    return 1 << [r.name for r in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text, the first included.

    Hashes of all windows first: a text whose hashes all differ, as nearly every one does, is
    done then. Otherwise equal hashes are found by sorting, and the positions that they
    cover are folded from left to right.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def folded(pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(p["h"] == F.get(pairs, k)["h"], F.lit(False))
            twice = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
            start = F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(window), p - a["at"])).alias("n"))
            return F.aggregate(F.array_sort(F.transform(twice, lambda p: p["i"])), start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, folded))

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(
        let(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window))), covered)
    )


def measures(text: Column) -> Column:
    """A struct of MEASURES, all long; a null text measures as an empty one."""
    plain = F.coalesce(text, F.lit(""))
    lost = lambda chars: F.length(plain) - F.length(F.translate(plain, chars, ""))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            lost(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.length(plain) - F.length(F.replace(plain, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        )

    lines = F.filter(F.split(plain, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return let(whole_words(text), lambda w: let(lines, lambda at: of(w, at)))


def failures() -> Column:
    """The bitmask, from columns named as MEASURES."""
    out = F.lit(0).cast("long")
    for rule in RULES:
        out = out.bitwiseOR(F.when(F.expr(rule.fails), F.lit(bit(rule.name)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, MEASURES and ``failures``."""
    measured = docs.select(F.col(id_col), measures(F.col(text_col)).alias("m"))
    return measured.select(id_col, "m.*").withColumn("failures", failures())


def passes(policy: str = "v1") -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that ``policy`` keeps, with their own columns only."""
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], measures(F.col(text_col)).alias("m"))
    judged = inner.select(*[f"c{i}" for i in range(len(names))], "m.*").withColumn("failures", failures())
    return judged.where(passes(policy)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does: rows (rule, n_docs, n_failed, n_only, n_kept_without).

    ``n_only`` failed this rule of the policy and no other. One grouping by the bitmask, which
    has at most 2 to the number of rules distinct values; all else is bit arithmetic on those.
    """
    whole = mask(policy)
    counts = entries.groupBy(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counts.select("f", "n", F.explode(rules).alias("r"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").cast("long").alias("n_docs"),
        total(F.col("f").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("f") == F.col("r.bit")).alias("n_only"),
        total(F.col("f").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )
