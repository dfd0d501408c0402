"""Text-building Column helpers."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.numbers import exponential, fixed, js_number_text, number_text
from locusframe.schema import DEFAULT_SPEC, RecordSpec

MISSING_NUMBER = "nan"


def rule_line(character: str = "-", width: int = 40) -> Column:
    return F.repeat(F.lit(character), width)


def join_text(parts: Column, separator: str) -> Column:
    """Join an array of texts; NULL elements are left out."""
    return F.array_join(parts, separator)


def flag_text(flag: Column) -> Column:
    return F.when(flag, "cis-acting").when(~flag, "trans-acting")


def display_name(name: Column, fallback: Column | str) -> Column:
    """`name`, or `fallback` when it is NULL or empty."""
    if isinstance(fallback, str):
        fallback = F.lit(fallback)
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def preview(text: Column, length: int, always: bool = False) -> Column:
    """The first `length` characters, with "..." when cut (or `always`)."""
    head = F.substring(text, 1, length)
    if always:
        return F.concat(head, F.lit("..."))
    return F.when(F.char_length(text) > length, F.concat(head, F.lit("..."))).otherwise(text)


def truncate_list(names: Column, limit: int, mark_cut: bool = False) -> Column:
    """The first `limit` names joined by ", ", with "..." appended when more exist."""
    text = F.array_join(F.slice(names, 1, limit), ", ")
    if not mark_cut:
        return text
    return F.concat(text, F.when(F.size(names) > limit, "...").otherwise(""))


def block_number(index: Column, size: Column | int) -> Column:
    """1-based number of the block of `size` rows that holds 0-based `index`."""
    size = F.lit(size) if isinstance(size, int) else size
    return ((index - index % size) / size).cast("bigint") + 1


def format_record(columns: Sequence[str], spec: RecordSpec = DEFAULT_SPEC) -> Column:
    """One record as " | "-separated text.

    `columns` are the columns the table has: a missing column prints "Unknown", a NULL
    cell prints "nan" in the required parts and drops the optional part.
    """

    def required(name: str, absent: str, text) -> Column:
        if name not in columns:
            return F.lit(absent)
        return F.coalesce(text(F.col(name)), F.lit(MISSING_NUMBER))

    def as_text(col: Column) -> Column:
        return col.cast("string")

    parts = [
        F.concat(F.lit("Gene: "), required(spec.entity, "Unknown gene", as_text)),
        F.concat(F.lit("LOD Score: "), required(spec.score, "Unknown", number_text)),
        F.concat(F.lit("P-value: "), required(spec.pvalue, "Unknown", number_text)),
        F.concat(
            F.lit("Location: Chromosome "),
            required(spec.group, "Unknown", as_text),
            F.lit(", Position "),
            required(spec.position, "Unknown", number_text),
            F.lit(" Mb"),
        ),
    ]
    # concat is NULL when any part is, and concat_ws leaves NULL parts out.
    if spec.ci_lo in columns and spec.ci_hi in columns:
        bounds = [fixed(F.col(c), 3) for c in (spec.ci_lo, spec.ci_hi)]
        parts.append(
            F.concat(F.lit("Confidence Interval: "), bounds[0], F.lit(" - "), bounds[1], F.lit(" Mb"))
        )
    if spec.flag in columns:
        parts.append(F.concat(F.lit("Type: "), flag_text(F.col(spec.flag))))
    if spec.category in columns:
        parts.append(F.concat(F.lit("Gene Type: "), F.nullif(F.col(spec.category), F.lit(""))))
    if spec.qvalue in columns:
        parts.append(F.concat(F.lit("Q-value (FDR): "), number_text(F.col(spec.qvalue))))
    return F.concat_ws(" | ", *parts)


def _or(text: Column, missing: str) -> Column:
    return F.coalesce(text, F.lit(missing))


def ranked_line(rank: Column, spec: RecordSpec = DEFAULT_SPEC) -> Column:
    """Numbered line of a top-score list."""
    return F.concat(
        rank.cast("string"),
        F.lit(". Gene: "),
        _or(display_name(F.col(spec.entity), F.col(spec.alt_entity)), "null"),
        F.lit(" - LOD Score: "),
        _or(fixed(F.col(spec.score), 2, "up"), "N/A"),
        F.lit(" (Chr "),
        _or(F.col(spec.group), "null"),
        F.lit(", Position: "),
        _or(js_number_text(F.col(spec.position)), "null"),
        F.lit(")"),
    )


def group_line(spec: RecordSpec = DEFAULT_SPEC) -> Column:
    """Bullet of a record listed under its group."""
    return F.concat(
        F.lit("• "),
        _or(display_name(F.col(spec.entity), F.col(spec.alt_entity)), "null"),
        F.lit(": LOD="),
        _or(fixed(F.col(spec.score), 2, "up"), "N/A"),
        F.lit(", Position="),
        _or(js_number_text(F.col(spec.position)), "null"),
        F.lit(", P-value="),
        _or(exponential(F.col(spec.pvalue)), "N/A"),
    )


def pvalue_line(spec: RecordSpec = DEFAULT_SPEC) -> Column:
    """Bullet of a record listed for its p-value."""
    return F.concat(
        F.lit("• "),
        _or(display_name(F.col(spec.entity), F.col(spec.alt_entity)), "null"),
        F.lit(": P-value="),
        _or(exponential(F.col(spec.pvalue)), "N/A"),
        F.lit(", LOD="),
        _or(fixed(F.col(spec.score), 2, "up"), "N/A"),
        F.lit(" (Chr "),
        _or(F.col(spec.group), "null"),
        F.lit(")"),
    )


def context_line(spec: RecordSpec = DEFAULT_SPEC) -> Column:
    """Line of the data context given to a language model."""
    return F.concat(
        F.lit("Gene: "),
        display_name(F.col(spec.entity), "N/A"),
        F.lit(" | LOD: "),
        _or(js_number_text(F.col(spec.score)), "null"),
        F.lit(" | P-val: "),
        _or(js_number_text(F.col(spec.pvalue)), "null"),
        F.lit(" | Chr: "),
        _or(F.col(spec.group), "null"),
        F.lit(" | Pos: "),
        _or(js_number_text(F.col(spec.position)), "null"),
        F.lit(" | Cis: "),
        _or(F.col(spec.flag).cast("string"), "null"),
        F.lit(" | Type: "),
        display_name(F.col(spec.category), "N/A"),
    )
