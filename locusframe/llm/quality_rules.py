"""Quality rules as a ledger of measurements and failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule. Policies choose rules by a mask: a document passes if none of the chosen bits is
set, so a new policy or an ablation needs no second look at the texts.

A NULL or blank text has no words; it fails `too_few_words`. Rows are judged one by one, so
repeated rows and NULL in other columns change nothing.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import SPACE, line_array, word_array

REPEAT_WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
CAPITALS = r"\p{Lu}{2,}"

# Rules in the order of their bits. Ratios are whole percentages, so that they are exact.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("too_few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    ("capitals", lambda m: 100 * m["n_capitals"] > 30 * m["n_words"]),
    ("stutter", lambda m: 100 * m["n_stutter"] > 20 * m["n_words"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"])),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    """The bits of the named rules."""
    return sum(BIT[name] for name in names)


# Policies by version. Repeated lines are left to line dedup, which keeps the document.
POLICIES = {
    1: mask("too_few_words", "repeated_windows"),
    2: mask("too_few_words", "repeated_windows", "symbols", "capitals", "stutter", "word_length"),
    3: mask(*BIT),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, given the hash of every window."""

    def total(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, i: F.when(
                i + 1 < F.size(places),
                F.least(F.lit(REPEAT_WINDOW), F.try_element_at(places, i + 2) - p),
            ).otherwise(REPEAT_WINDOW),
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]))
            | ((i + 1 < F.size(pairs)) & (F.get(pairs, i + 1)["h"] == x["h"])),
        )
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), total)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
        _let(pairs, places)
    )


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first included.

    Windows are compared by a 64-bit hash. Only a text with a repeated window is sorted.
    """

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (REPEAT_WINDOW - 1))
        return _let(
            F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, REPEAT_WINDOW))), _covered
        )

    return F.when(F.size(words) <= REPEAT_WINDOW, 0).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    )


def _stutter(words: Column) -> Column:
    again = F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))
    return F.size(again)


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
        repeated_words(words).cast("bigint").alias("n_repeat_words"),
        _stutter(words).cast("bigint").alias("n_stutter"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
    )


def ledger(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with the structs `measures` and the integer `failed`, a bit per failed rule.

    A column of `docs` with one of these two names is replaced.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    full = F.filter(line_array(text), lambda line: line.rlike(f"[^{SPACE[1:-1]}]"))
    by_word, by_line = _let(word_array(text), _of_words), _let(full, _of_lines)
    rows = docs.drop("measures", "failed").withColumns(
        {"measures": F.struct(
            by_word.alias("of_words"),
            by_line.alias("of_lines"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            F.regexp_count(text, F.lit(CAPITALS)).cast("bigint").alias("n_capitals"),
        )}
    )
    m = F.col("measures")
    flat = F.struct(
        *(m["of_words"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stutter")),
        *(m["of_lines"][c].alias(c) for c in ("n_lines", "n_dup_lines")),
        *(m[c].alias(c) for c in ("n_symbols", "n_capitals")),
    )
    rows = rows.withColumn("measures", flat)
    bits = [F.when(rule(F.col("measures")), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return rows.withColumn("failed", total)


def passes(failed: Column, policy: int) -> Column:
    """Whether a document passes the policy of that version."""
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(judged: DataFrame, policy: int) -> DataFrame:
    """What every rule of a policy does: `(rule, failing, only_by_it, kept_without_it)`.

    The ledger is first counted by its bits, at most 2 to the number of rules.
    """
    chosen = POLICIES[policy]
    counts = judged.groupBy(F.col("failed").bitwiseAND(F.lit(chosen)).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rules = F.array(
        *(
            F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit"))
            for name in BIT
            if BIT[name] & chosen
        )
    )
    rows = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        total(hit).alias("failing"),
        total(hit & (rest == 0)).alias("only_by_it"),
        total(rest == 0).alias("kept_without_it"),
    )
