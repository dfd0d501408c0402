"""Data context per question: the records its wording asks for, and an overview."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.numbers import fixed
from locusframe.functions.parsing import group_token, route_context
from locusframe.functions.text import context_line
from locusframe.operators.ranking import (
    head_per_group,
    lowest_pvalues,
    top_n_by_score,
    top_plus_sample,
)
from locusframe.operators.stats import score_overview
from locusframe.schema import DEFAULT_SPEC, RecordSpec
from locusframe.storage import broadcast_small, stored

# Rows chosen per selection, and lines shown.
TOP_ROWS, GROUP_ROWS, PVALUE_ROWS, SAMPLE_ROWS, SHOWN_ROWS = 20, 50, 20, 10, 15

# Selections of 15 lines each that may be broadcast.
_BROADCAST_SELECTIONS = 10_000


def selections(records: DataFrame, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The shown lines of every possible selection: `selection, selected_group, lines`.

    Selections depend on the records alone, so each is made once for all questions.
    """

    def lines(rows: DataFrame, kind: str, group=None, source=None) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("selection"),
            (F.lit("") if group is None else group).alias("selected_group"),
            F.struct(F.lit(0) if source is None else source, F.col("rank")).alias("place"),
            context_line(spec).alias("line"),
        )

    grouped = records.filter(F.col(spec.group).isNotNull())
    per_group = head_per_group(grouped, GROUP_ROWS, [spec.group], [F.col(spec.row_id)])
    chosen = (
        lines(top_n_by_score(records, TOP_ROWS, drop_missing=True, spec=spec), "top")
        .union(lines(per_group, "group", F.col(spec.group)))
        .union(lines(lowest_pvalues(records, PVALUE_ROWS, spec), "pvalue"))
        .union(
            lines(
                top_plus_sample(records, SAMPLE_ROWS, spec), "mixed", source=F.col("source_order")
            )
        )
    )
    ordered = F.slice(F.sort_array(F.collect_list(F.struct("place", "line"))), 1, SHOWN_ROWS)
    numbered = F.transform(
        ordered, lambda row, i: F.concat((i + 1).cast("string"), F.lit(". "), row["line"])
    )
    return chosen.groupBy("selection", "selected_group").agg(numbered.alias("lines"))


def data_context(
    records: DataFrame, questions: DataFrame, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """Questions with their `selection`, `selected_group` and `context` text."""
    kind = route_context(F.col("question"))
    number = F.when(kind == "group", group_token(F.col("question")))
    asked = questions.withColumns(
        {"selection": kind, "selected_group": F.coalesce(number, F.lit(""))}
    )
    overview = score_overview(records, spec).select(F.struct("*").alias("overview")).scalar()
    stats = F.col("_overview")
    header = F.concat(
        F.lit("Dataset summary: "),
        stats["records"].cast("string"),
        F.lit(" total records\n\nStatistical overview:\n- Average LOD score: "),
        F.coalesce(fixed(stats["mean_score"], 2, "up"), F.lit("NaN")),
        F.lit("\n- Maximum LOD score: "),
        F.coalesce(fixed(stats["max_score"], 2, "up"), F.lit("-Infinity")),
        F.lit("\n- Total chromosomes: "),
        stats["groups"].cast("string"),
        F.lit("\n\nSample of relevant records:\n"),
    )
    body = F.array_join(F.transform("lines", lambda line: F.concat(line, F.lit("\n"))), "")
    chosen = broadcast_small(stored(selections(records, spec), "chosen"), _BROADCAST_SELECTIONS)
    return (
        asked.join(chosen, ["selection", "selected_group"], "left")
        .withColumn("_overview", overview)
        .withColumn("context", F.concat(header, F.coalesce(body, F.lit(""))))
        .select(*questions.columns, "selection", "selected_group", "context")
    )
