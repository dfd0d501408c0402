"""Reading parameters and intent out of question text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define each parameter.
INTEGER = r"(\d+)"
SCORE_ABOVE = r"(?i)lod\s*>\s*(\d+(?:\.\d+)?)"
PVALUE_BELOW = r"(?i)(?:p-?value|pval)\s*<\s*([\d.e-]+)"
FLOAT_PREFIX = r"(?i)^(-?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)"
GROUP_NUMBER = r"(?i)chr(?:omosome)?\s*(\d+)"


def _first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def normalised(question: Column) -> Column:
    return F.lower(F.trim(question))


def first_integer(question: Column) -> Column:
    return _first_match(question, INTEGER).try_cast("bigint")


def score_threshold(question: Column) -> Column:
    return _first_match(question, SCORE_ABOVE).try_cast("double")


def pvalue_threshold(question: Column) -> Column:
    token = _first_match(question, PVALUE_BELOW)
    return _first_match(token, FLOAT_PREFIX).try_cast("double")


def group_token(question: Column) -> Column:
    return _first_match(question, GROUP_NUMBER)


def route_rules(question: Column, literal: bool = False) -> Column:
    """Intent of a question for rule-based answers.

    "compare" is tested ahead of "group", which would otherwise always win;
    `literal=True` keeps that original order.
    """
    text = F.lower(question)

    def has(word: str) -> Column:
        return F.contains(text, F.lit(word))

    group = (has("chromosome") | has("chr"), "group")
    compare = (has("compare") & has("chromosome"), "compare")
    pvalue = (has("p-value") | has("pval"), "pvalue")
    entities = (has("gene") & (has("what") | has("which")), "entities")
    order = [group, pvalue, entities, compare] if literal else [compare, group, pvalue, entities]
    intent = F.when(has("top") & has("lod"), "top")
    for condition, name in order:
        intent = intent.when(condition, name)
    return intent.when(has("summary") | has("overview"), "summary").otherwise("help")


def route_context(question: Column) -> Column:
    """Which selection of records serves as data context for a question."""
    text = F.lower(question)

    def any_of(*words: str) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(text, F.lit(word))
        return found

    return (
        F.when(any_of("top", "highest", "best"), "top")
        .when(any_of("chromosome", "chr"), "group")
        .when(any_of("p-value", "significant"), "pvalue")
        .otherwise("mixed")
    )
