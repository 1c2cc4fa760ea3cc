"""Survey cleaning: missing codes, mixed columns, long form, row filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.functions.numbers import code_text, share, to_number

NUMERIC_SHARE = 0.5  # a text column is numeric above this share (strict)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def question_columns(df: DataFrame, skip: Iterable[str]) -> list[str]:
    """Columns that can hold answers: number or text, not in ``skip``."""
    skip = set(skip)
    return [c for c in df.columns if c not in skip and (is_text(df, c) or is_number(df, c))]


def non_negative(v: Column) -> Column:
    """Negative codes and NaN mean "missing"."""
    return F.when((v >= 0) & ~F.isnan(v), v)


def clean_number(v: Column) -> Column:
    return non_negative(v.cast("double"))


def numeric_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: share of all rows (missing ones included) that read as numbers."""
    return df.agg(*[share(to_number(F.col(c)).isNotNull()).alias(c) for c in columns])


def numeric_text_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """Text columns to be read as numbers. One pass, one row back."""
    columns = [c for c in columns if is_text(df, c)]
    if not columns:
        return set()
    shares = numeric_shares(df, columns).first().asDict()
    return {c for c, s in shares.items() if s is not None and s > NUMERIC_SHARE}


def clean_survey(wide: DataFrame, skip: Iterable[str]) -> DataFrame:
    """Clean every question column of one survey.

    Number columns and text columns that mostly hold numbers become doubles
    with missing codes set to NULL; other text stays. The type is decided once
    per survey, so importance and evaluation see the same columns. Apart from
    the one-row decision this is a plain projection.
    """
    questions = question_columns(wide, skip)
    as_number = numeric_text_columns(wide, questions)
    out: list[Column] = []
    for c in wide.columns:
        if c not in questions:
            out.append(F.col(c))
        elif c in as_number:
            out.append(non_negative(to_number(F.col(c))).alias(c))
        elif is_text(wide, c):
            out.append(F.col(c))
        else:
            out.append(clean_number(F.col(c)).alias(c))
    return wide.select(*out)


def answer_text(df: DataFrame, name: str) -> Column:
    """An answer as text, whatever the column type."""
    return F.col(name) if is_text(df, name) else code_text(F.col(name).cast("double"))


def to_long(wide: DataFrame, ids: list[str], questions: list[str]) -> DataFrame:
    """Wide to ``(ids, var_code, val)``; missing answers give NULL ``val``."""
    texts = wide.select(*ids, *[answer_text(wide, q).alias(q) for q in questions])
    return texts.unpivot(ids, questions, "var_code", "val")


def country_rows(df: DataFrame, country_col: str, code: str) -> DataFrame:
    """Rows of one country; a plain column predicate, so it reaches the scan."""
    return df.where(F.col(country_col) == F.lit(code))


def require_rows(df: DataFrame, source: DataFrame, country_col: str, code: str) -> DataFrame:
    """Fail, naming some known countries, when ``df`` is empty."""
    if df.isEmpty():
        known = source.select(country_col).where(F.col(country_col).isNotNull()).distinct()
        first = [r[0] for r in known.orderBy(country_col).take(20)]
        raise ValueError(f"no rows for {country_col}={code!r}; {known.count()} values in data, such as {first}")
    return df


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that answered the target question."""
    return df.where(F.col(target).isNotNull())


def first_answers(long: DataFrame, ids: list[str], position: str) -> DataFrame:
    """One answer per respondent and variable: the one that came first."""
    return long.groupBy(*ids, "var_code").agg(F.min_by("val", position).alias("val"))


def feature_columns(df: DataFrame, admin: Iterable[str], target: str, country_col: str) -> list[str]:
    """Candidate predictors of ``target``."""
    return question_columns(df, {*admin, target, country_col})


def pool_from_long(long: DataFrame, admin: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Candidate predictors per ``keys`` with their number of answers.

    ``admin`` holds ``var_code``; features without any answer are dropped.
    Counted before the shuffle, so the exchange carries one row per variable.
    """
    return (
        long.where(F.col("var_code") != target)
        .groupBy(*keys, "var_code").agg(F.count("val").alias("n_answers"))
        .where(F.col("n_answers") > 0)
        .join(admin.select("var_code").distinct(), "var_code", "left_anti")
    )
