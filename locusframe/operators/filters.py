"""Record predicates and the filters built from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.schema import DEFAULT_SPEC, RecordSpec


def score_tier(threshold: float, spec: RecordSpec = DEFAULT_SPEC) -> Column:
    """"high" at or above the threshold, "moderate" below, NULL without a score."""
    score = F.col(spec.score)
    return F.when(score >= threshold, "high").when(score < threshold, "moderate")


def in_group(df: DataFrame, group: str | int, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    return df.filter(F.col(spec.group) == str(group))


def score_above(df: DataFrame, threshold: float, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    return df.filter(F.col(spec.score) > threshold)


def pvalue_below(
    df: DataFrame, threshold: float, keep_zero: bool = False, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """Rows whose p-value is below the threshold; a p-value of exactly 0 counts as missing."""
    return has_pvalue(df, keep_zero, spec).filter(F.col(spec.pvalue) < threshold)


def has_score(df: DataFrame, keep_zero: bool = True, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    return _present(df, spec.score, keep_zero)


def has_pvalue(df: DataFrame, keep_zero: bool = True, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    return _present(df, spec.pvalue, keep_zero)


def _present(df: DataFrame, name: str, keep_zero: bool) -> DataFrame:
    kept = F.col(name).isNotNull()
    return df.filter(kept if keep_zero else kept & (F.col(name) != 0))


def has_entity(df: DataFrame, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    return df.filter(F.col(spec.entity).isNotNull() & (F.col(spec.entity) != ""))


def records_for_entity_set(
    df: DataFrame, members: DataFrame, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """Records whose entity occurs in `members`, one row each."""
    return df.join(members.select(spec.entity), spec.entity, "left_semi")
