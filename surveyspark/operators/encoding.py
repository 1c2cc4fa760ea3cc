"""Answer classes: integer codes for targets and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import to_integer
from surveyspark.operators.cleaning import answer_text, is_text
from surveyspark.operators.ranking import ordered_row_number
from surveyspark.session import materialize

MIN_CLASS_ROWS = 5  # classes with fewer rows are dropped


def target_answers(df: DataFrame, targets: list[str], ids: list[str], country_col: str) -> DataFrame:
    """``(target, country, ids, answer, as_int)`` for every answered target.

    ``as_int`` is the integer reading of the answer: number columns are cut to
    their whole part, text must be a whole number.
    """
    entries = []
    for t in targets:
        as_int = to_integer(F.col(t)) if is_text(df, t) else F.col(t).cast("bigint")
        entries.append(F.struct(F.lit(t).alias("target"), answer_text(df, t).alias("answer"),
                                as_int.alias("as_int")))
    return (
        df.select(F.col(country_col).alias("country"), *ids, F.explode(F.array(*entries)).alias("a"))
        .select("a.target", "country", *ids, "a.answer", "a.as_int")
        .where(F.col("answer").isNotNull())
    )


def class_table(answers: DataFrame, cell: list[str]) -> DataFrame:
    """Classes per cell: ``(cell, answer, label, y, n)`` with rare ones removed.

    Labels are integers when every answer of the cell reads as one, otherwise
    text. Rare labels go, and the rest is numbered 0.. in label order; the
    integer rule is then checked again. Works on counted answers, whose number
    per cell is that of the answer options.
    """
    counts = materialize(answers.groupBy(*cell, "answer", "as_int").agg(F.count(F.lit(1)).alias("n"))).df
    of_cell = Window.partitionBy(*cell)

    def labeled(df: DataFrame, all_int) -> DataFrame:
        return df.withColumn("_all_int", all_int).withColumn(
            "label", F.when(F.col("_all_int"), F.col("as_int").cast("string")).otherwise(F.col("answer")))

    # answers may be many (free text) until the rare ones are gone, so the
    # first pass groups and joins; the windows below see frequent labels only
    whole = counts.groupBy(*cell).agg(F.bool_and(F.col("as_int").isNotNull()).alias("_whole"))
    first = labeled(counts.join(whole, cell), F.col("_whole"))
    kept = (first.groupBy(*cell, "label").agg(F.sum("n").alias("_rows"))
            .where(F.col("_rows") >= MIN_CLASS_ROWS).drop("_rows"))
    frequent = labeled(first.join(kept, [*cell, "label"], "left_semi").drop("label", "_all_int"),
                       F.min(F.col("as_int").isNotNull()).over(of_cell))
    order = of_cell.orderBy(F.when(F.col("_all_int"), F.col("as_int")), "label")
    return (
        frequent
        .withColumn("y", (F.dense_rank().over(order) - 1).cast("bigint"))
        .select(*cell, "answer", "label", "y", "n")
    )


def class_distribution(classes: DataFrame, cell: list[str]) -> DataFrame:
    return classes.groupBy(*cell, "y", "label").agg(F.sum("n").alias("n"))


def majority_baseline(classes: DataFrame, cell: list[str]) -> DataFrame:
    """``(cell, n_samples, n_classes, majority_baseline)``, unrounded."""
    per_class = classes.groupBy(*cell, "y").agg(F.sum("n").alias("n"))
    return per_class.groupBy(*cell).agg(
        F.sum("n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_classes"),
        (F.max("n") / F.sum("n")).alias("majority_baseline"),
    )


def label_codes(long: DataFrame, keys: list[str]) -> DataFrame:
    """Code book of text answers: ``(keys, var_code, val, code, n)``.

    Distinct answers first (map-side combine), then numbered in text order;
    missing answers have no code.
    """
    values = (long.where(F.col("val").isNotNull())
              .groupBy(*keys, "var_code", "val").agg(F.count(F.lit(1)).alias("n")))
    numbered = ordered_row_number(materialize(values), [*keys, "var_code"], "val")
    return numbered.withColumn("code", F.col("rn") - 1).drop("rn")
