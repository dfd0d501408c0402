"""Rule-based answers: every question is routed to a ranking, filter or summary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.numbers import fixed, js_number_text
from locusframe.functions.parsing import (
    first_integer,
    pvalue_threshold,
    route_rules,
    score_threshold,
)
from locusframe.functions.text import group_line, pvalue_line, ranked_line
from locusframe.operators.filters import has_pvalue, has_score
from locusframe.operators.ranking import (
    TOP_ROWS_IN_MEMORY,
    head_per_group,
    position_in_order,
    top_n_by_score,
)
from locusframe.operators.stats import dataset_summary, group_counts, unique_entities
from locusframe.schema import DEFAULT_SPEC, RecordSpec
from locusframe.storage import stored

# Defaults of the rules and the text of the help answer.
DEFAULT_TOP, DEFAULT_PVALUE, LISTED = 5, 0.001, 10
HELP = (
    "I can help you analyze your genetic scan data! Try asking about:\n\n"
    "• Top QTLs with highest LOD scores\n"
    "• QTLs on specific chromosomes\n"
    "• Genes with significant p-values\n"
    "• Summary statistics of your data\n"
    "• Comparisons between chromosomes\n\n"
    "For example: 'What are the top 10 QTLs with highest LOD scores?' or "
    "'Show me significant genes with p-value < 0.001'"
)

# Wordings around numbers and names.
MORE = ("\n... and ", " more results.")
TOP_HEADER = ("Here are the top ", " QTLs with highest LOD scores:\n")
GROUP_HEADER = ("Found ", " QTLs on chromosome ", " with LOD > ", ":\n")
PVALUE_HEADER = ("Found ", " genes with p-values < ", ":\n")
ENTITIES_HEADER = ("Your dataset contains ", " unique genes. Here are some examples:\n")
COMPARE_HEADER = "QTL distribution across chromosomes:\n"
COMPARE_LINE = ("• Chromosome ", ": ", " QTLs")
SUMMARY_HEADER = "📊 Dataset Summary:\n"
SUMMARY_LABELS = (
    "• Total QTL records: ",
    "• Average LOD score: ",
    "• Maximum LOD score: ",
    "• Chromosomes covered: ",
    "• Unique genes: ",
)

# Thresholds that one sorted array may hold: 1 MB of numbers.
_PAGE = 1 << 17
# Thresholds whose arrays may be broadcast, and rows of lines that may be.
_BROADCAST_LIMITS, _BROADCAST_LINES = 500_000, 100_000


def routed_questions(questions: DataFrame, literal: bool = False) -> DataFrame:
    """Questions with `intent` and the numbers found in them; 0 counts as not found."""
    text = F.col("question")

    def number(value: Column) -> Column:
        return F.nullif(value, F.lit(0))

    return questions.withColumns(
        {
            "intent": route_rules(text, literal),
            "number": number(first_integer(text)),
            "score_limit": number(score_threshold(text)),
            "pvalue_limit": number(pvalue_threshold(text)),
        }
    )


def _line(number: Column | int, text: Column | str) -> list[Column]:
    number = F.lit(number) if isinstance(number, int) else number
    text = F.lit(text) if isinstance(text, str) else text
    return [number.cast("bigint").alias("line_no"), text.alias("line")]


def _more(total: Column) -> Column:
    rest = (total - LISTED).cast("string")
    return F.concat(F.lit(MORE[0]), rest, F.lit(MORE[1]))


def _listing(totals: DataFrame, first: DataFrame, header: Column) -> DataFrame:
    """Header, bullets and remainder line of questions with a `total` of matches."""
    head = totals.select("query_id", "intent", *_line(0, header))
    rows = first.select("query_id", "intent", *_line(F.col("rank"), F.col("line")))
    many = totals.filter(F.col("total") > LISTED)
    more = many.select("query_id", "intent", *_line(LISTED + 1, _more(F.col("total"))))
    return head.union(rows).union(more)


def _top(records: DataFrame, asked: DataFrame, spec: RecordSpec) -> DataFrame:
    """Questions for the top n; those with one n share its lines.

    The ranks below n are cut into blocks of powers of two, one for each bit of n, and a
    ranked line is in one block of every size: lines and questions meet without a rank that
    was not asked for.
    """
    wanted = asked.withColumn("wanted", F.coalesce("number", F.lit(DEFAULT_TOP)).cast("bigint"))
    most = wanted.agg(F.max("wanted")).first()[0] or 0
    scored = has_score(records, keep_zero=False, spec=spec)
    if most > TOP_ROWS_IN_MEMORY:
        most = min(most, scored.count())
    levels = F.sequence(F.lit(0), F.lit(int(most).bit_length()))
    ranked = top_n_by_score(scored, most, spec=spec).select(
        "rank", ranked_line(F.col("rank"), spec).alias("line"), F.explode(levels).alias("level")
    )
    ranked = ranked.withColumn("block", F.expr("shiftright(rank - 1, level)"))
    blocks = (
        wanted.select("wanted", F.least("wanted", F.lit(int(most))).alias("n"))
        .distinct()
        .withColumn("level", F.explode(levels))
        .filter(F.expr("shiftright(n, level) % 2 = 1"))
        .select("wanted", "level", F.expr("shiftright(n, level + 1) * 2").alias("block"))
    )
    lines = blocks.join(ranked, ["level", "block"]).select("wanted", "rank", "line")
    header = F.concat(F.lit(TOP_HEADER[0]), F.col("wanted").cast("string"), F.lit(TOP_HEADER[1]))
    rows = wanted.join(lines, "wanted")
    return wanted.select("query_id", "intent", *_line(0, header)).union(
        rows.select("query_id", "intent", *_line(F.col("rank"), F.col("line")))
    )


def count_below(values: Column, value: Column, most: int) -> Column:
    """How many of at most `most` ascending `values` are below `value`: a binary search.

    A place that is far enough on is taken if its value is still below; beyond the end there
    is none, and none is taken.
    """
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))))

    def further(count: Column, step: Column) -> Column:
        return F.when(F.get(values, count + step - 1) < value, count + step).otherwise(count)

    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), further))


def _arrays(limits: DataFrame, by: list[str], most: int, few, page: int) -> tuple[DataFrame, DataFrame | None]:
    """The sorted limits of each key, or of pages of them and the lowest limits of the pages."""
    limit = F.sort_array(F.collect_list("limit")).alias("limits")
    if most < page:
        return few(limits.groupBy(*by).agg(limit).withColumn("base", F.lit(0).cast("bigint"))), None
    paged = limits.withColumn("page", F.floor(F.col("n") / page).cast("bigint"))
    pages = paged.groupBy(*by, "page").agg(limit, F.min("n").alias("base"))
    lows = F.sort_array(F.collect_list(F.get("limits", F.lit(0)))).alias("lows")
    return few(pages), pages.groupBy(*by).agg(lows)


def _placed(records: DataFrame, limits: DataFrame, by: list[str], many: int, most: int, page: int) -> DataFrame:
    """Records with the number `n` of the highest limit below their value, if there is one.

    Without keys the limits are one row, a scalar subquery, and meet the records in no join.
    """
    few = (lambda df: F.broadcast(df)) if many <= _BROADCAST_LIMITS else (lambda df: df)
    arrays, lows = _arrays(limits, by, most, few, page)
    value = F.col("value")
    if lows is None:
        if by:
            found = records.join(arrays, by)
        else:
            one = arrays.select(F.struct("limits", "base").alias("one")).scalar()
            found = records.withColumn("one", one).select("*", "one.*").drop("one")
    else:
        if by:
            found = records.join(lows, by)
        else:
            found = records.withColumn("lows", lows.select("lows").scalar())
        at = count_below(F.col("lows"), value, most // page + 1) - 1
        found = found.withColumn("page", at.cast("bigint")).filter(F.col("page") >= 0).drop("lows")
        found = found.join(arrays, [*by, "page"])
    below = count_below(F.col("limits"), value, min(most, page) + 1)
    return found.withColumn("n", F.col("base") + below - 1).filter(F.col("n") >= 0)


def _above(records: DataFrame, limits: DataFrame, line: Column, spec: RecordSpec, by: list[str], page: int = _PAGE):
    """How many records are above each limit, and the first ones of them.

    `records` has `value` and the columns `by`, `limits` different limits of them. The sorted limits
    cut the values into intervals, and a record finds its one interval by binary search. Totals
    are running sums over the intervals. The first rows of intervals are merged into those of
    blocks of 2, 4, 8, ... intervals, and all intervals above a limit are a few such blocks.
    So nothing grows with records times limits, or with limits times limits.
    """
    numbered = stored(position_in_order(limits, [F.col("limit")], by, "n"), "limits")
    many, most = numbered.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = _placed(records, numbered, by, many, most, page)
    # Records above the limits 0 to n, and no other, are in interval n.
    # Texts are made for the listed records alone, at the end.
    record = F.struct(*(c for c in records.columns if c not in (*by, "value", spec.row_id)))
    matches = placed.select(*by, "n", spec.row_id, record.alias("record"))

    counts = matches.groupBy(*by, "n").agg(F.count("*").alias("rows"))
    down = Window.partitionBy(*by).orderBy(F.desc("n"))
    totals = numbered.join(counts, [*by, "n"], "left").withColumn(
        "total", F.coalesce(F.sum("rows").over(down), F.lit(0))
    )
    levels = F.sequence(F.lit(0), F.lit(int(most).bit_length()))
    first = head_per_group(matches, LISTED, [*by, "n"], [F.col(spec.row_id)]).drop("rank")
    blocks = first.withColumn("level", F.explode(levels)).withColumn(
        "block", F.expr("shiftright(n, level)")
    )
    heads = head_per_group(blocks, LISTED, [*by, "level", "block"], [F.col(spec.row_id)])
    # The intervals from n on: a block of each level at which n, rounded up, is odd.
    up = F.expr("shiftright(n + shiftleft(1, level) - 1, level)")
    parts = (
        numbered.withColumn("level", F.explode(levels))
        .withColumn("block", up.cast("bigint"))
        .filter((F.col("block") % 2 == 1) | ((F.col("n") == 0) & (F.col("level") == int(most).bit_length())))
    )
    met = parts.select(*by, "limit", "level", "block").join(
        heads.select(*by, "level", F.col("block").cast("bigint").alias("block"), spec.row_id, "record"),
        [*by, "level", "block"],
    )
    listed = head_per_group(met, LISTED, [*by, "limit"], [F.col(spec.row_id)])
    listed = listed.select(*by, "limit", "rank", "record.*").select(*by, "limit", "rank", line.alias("line"))
    # Questions may all ask for one limit, so they stay where they are while lines are few.
    few = F.broadcast if many * LISTED <= _BROADCAST_LINES else lambda df: df
    return few(totals.select(*by, "limit", "total")), few(listed)


def _group(records: DataFrame, asked: DataFrame, spec: RecordSpec) -> DataFrame:
    """Questions about a group; those that ask the same share its lines."""
    numbered = asked.filter(F.col("number").isNotNull()).withColumns(
        {
            "key": F.col("number").cast("string"),
            # Every record is above minus infinity, also one without a score.
            "limit": F.coalesce("score_limit", F.lit(float("-inf"))),
        }
    )
    keys = ["key", "limit"]
    lowest = F.lit(-1.7976931348623157e308)
    valued = records.withColumns(
        {"key": F.col(spec.group), "value": F.coalesce(spec.score, lowest)}
    )
    totals, first = _above(valued, numbered.select(*keys).distinct(), group_line(spec), spec, ["key"])
    found, on, above, end = map(F.lit, GROUP_HEADER)
    header = F.concat(
        found,
        F.col("total").cast("string"),
        on,
        F.col("key"),
        F.when(F.col("limit") >= 0, F.concat(above, js_number_text(F.col("limit")))).otherwise(""),
        end,
    )
    # A question that names no group has an empty answer.
    unknown = asked.filter(F.col("number").isNull()).select("query_id", "intent", *_line(0, ""))
    counted = numbered.join(totals, keys)
    return _listing(counted, numbered.join(first, keys), header).union(unknown)


def _pvalue(records: DataFrame, asked: DataFrame, spec: RecordSpec) -> DataFrame:
    """Questions about p-values below a threshold: their negatives are above its negative."""
    limited = asked.withColumn("limit", -F.coalesce("pvalue_limit", F.lit(DEFAULT_PVALUE)))
    valued = has_pvalue(records, keep_zero=False, spec=spec).withColumn("value", -F.col(spec.pvalue))
    totals, first = _above(valued, limited.select("limit").distinct(), pvalue_line(spec), spec, [])
    found, below, end = map(F.lit, PVALUE_HEADER)
    header = F.concat(found, F.col("total").cast("string"), below, js_number_text(-F.col("limit")), end)
    return _listing(limited.join(totals, "limit"), limited.join(first, "limit"), header)


def _shared(records: DataFrame, spec: RecordSpec) -> DataFrame:
    """Lines of the answers that depend on the records alone: `intent, line_no, line`."""
    entities = unique_entities(records, spec=spec)
    some = entities.select(
        F.lit("entities").alias("intent"),
        *_line(F.col("rank"), F.concat(F.lit("• "), F.col(spec.entity))),
    )
    total = F.coalesce(F.max("total"), F.lit(0)).cast("string")
    found = entities.agg(total.alias("total")).select(
        F.lit("entities").alias("intent"),
        *_line(
            0,
            F.concat(F.lit(ENTITIES_HEADER[0]), F.col("total"), F.lit(ENTITIES_HEADER[1])),
        ),
    )
    ranked_groups = F.sort_array(
        F.collect_list(
            F.struct(
                (-F.col("rows")).alias("o"),
                F.col(spec.group).try_cast("bigint").isNull().alias("text"),
                F.col(spec.group).try_cast("bigint").alias("n"),
                F.concat(
                    F.lit(COMPARE_LINE[0]),
                    F.col(spec.group),
                    F.lit(COMPARE_LINE[1]),
                    F.col("rows").cast("string"),
                    F.lit(COMPARE_LINE[2]),
                ).alias("line"),
            )
        )
    )
    compared = group_counts(records, LISTED, spec).agg(
        F.concat(
            F.array(F.lit(COMPARE_HEADER)),
            ranked_groups["line"],
        ).alias("lines")
    )
    figures = [
        F.col("records").cast("string"),
        fixed(F.col("mean_score"), 2, "up"),
        fixed(F.col("max_score"), 2, "up"),
        F.col("groups").cast("string"),
        F.col("entities").cast("string"),
    ]
    lines = [F.concat(F.lit(label), figure) for label, figure in zip(SUMMARY_LABELS, figures)]
    summary = dataset_summary(records, spec).select(F.array(F.lit(SUMMARY_HEADER), *lines).alias("lines"))

    def exploded(df: DataFrame, intent: str) -> DataFrame:
        lines = df.select(F.posexplode("lines").alias("n", "text"))
        return lines.select(F.lit(intent).alias("intent"), *_line(F.col("n"), F.col("text")))

    help_text = records.sparkSession.range(1).select(
        F.lit("help").alias("intent"), *_line(0, HELP)
    )
    return (
        some.union(found)
        .union(exploded(compared, "compare"))
        .union(exploded(summary, "summary"))
        .union(help_text)
    )


def answer_by_rules(
    records: DataFrame,
    questions: DataFrame,
    literal: bool = False,
    spec: RecordSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Lines of the answer to every question: `query_id, intent, line_no, line`.

    A question about a group that names no number has one empty line.
    """
    # The records are read once; every kind of answer reads the columns that answers show.
    shown = {spec.row_id, *(f for f in spec.types() if f not in (spec.flag, spec.category))}
    records = stored(records.select(*(c for c in records.columns if c in shown)), "records")
    routed = stored(routed_questions(questions, literal), "routed")

    def of(intent: str) -> DataFrame:
        return routed.filter(F.col("intent") == intent)

    # The shared answers have 34 lines at most.
    lines = F.broadcast(_shared(records, spec))
    shared = routed.select("query_id", "intent").join(lines, "intent")
    return (
        _top(records, of("top"), spec)
        .union(_group(records, of("group"), spec))
        .union(_pvalue(records, of("pvalue"), spec))
        .union(shared.select("query_id", "intent", "line_no", "line"))
    )


def answer_texts(lines: DataFrame, lines_per_part: int = 10_000) -> DataFrame:
    """Answers as text: `query_id, intent, part, answer`.

    Every question has a part, and an empty answer if it has no lines but an empty one. A list
    of more than `lines_per_part` lines continues in further parts.
    """
    part = F.floor(F.col("line_no") / lines_per_part) + 1
    texts = F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"]
    last = F.element_at(F.col("texts"), -1)
    empty = (F.size("texts") == 1) & (last == "")
    open_end = ~last.startswith("\n... and ") & (F.col("intent") != "help")
    return (
        lines.groupBy("query_id", "intent", part.alias("part"))
        .agg(texts.alias("texts"))
        .withColumn(
            "answer",
            F.concat(F.array_join("texts", "\n"), F.when(open_end & ~empty, "\n").otherwise("")),
        )
        .drop("texts")
    )
