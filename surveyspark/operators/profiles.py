"""Model input: one row per respondent and target, answers as an array."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators.cleaning import answer_text
from surveyspark.operators.encoding import class_table, target_answers
from surveyspark.operators.resampling import N_FOLDS, SEED, assign_folds
from surveyspark.session import Materialized, materialize

CELL = ["target", "country"]
MISSING = "∅"  # a missing answer is an answer of its own
ROWS_PER_TASK = 100_000  # profiles of one task


@dataclass(frozen=True)
class Profiles:
    """``df``: target, country, respondent, y, fold, pos, x.

    ``x`` holds the answers in the order of ``features``. Rows of rare classes
    keep ``y``, ``fold`` and ``pos`` NULL: they count for "has any answer" only.
    """

    df: DataFrame
    classes: Materialized
    features: list[str]
    id_col: str
    n_folds: int
    n_classes: int

    def by_respondent(self) -> DataFrame:
        """Rows that are scored, placed by respondent.

        The compact rows are shuffled here, so that everything expanded from
        them per feature, set or answer can be summed up without moving again.
        """
        return self.df.where(F.col("y").isNotNull()).repartition(*CELL, self.id_col)

    def feature_name(self, index: str) -> Column:
        return F.get(F.array(*[F.lit(f) for f in self.features]), F.col(index))

    def answers(self, rows: DataFrame | None = None) -> DataFrame:
        """Exploded to one row per feature, the target itself left out.

        ``i`` is the feature's place in ``features``.
        """
        rows = self.df if rows is None else rows
        kept = [c for c in rows.columns if c != "x"]
        return (
            rows.select(*kept, F.posexplode("x").alias("i", "val"))
            .withColumn("feature", self.feature_name("i"))
            .where(F.col("feature") != F.col("target"))
        )


def feature_array(clean: DataFrame, features: list[str]) -> Column:
    return F.array(*[F.coalesce(answer_text(clean, f), F.lit(MISSING)) for f in features])


def build_profiles(clean: DataFrame, id_col: str, country_col: str, targets: list[str],
                   features: list[str], n_folds: int = N_FOLDS, seed: int = SEED,
                   cells: DataFrame | None = None) -> Profiles:
    """Encode targets, deal folds and attach the answers.

    ``cells`` (target, country, place) sends the rows of a country to another cell, as
    ``screening.region_cells`` decides for small countries; each row is keyed once.

    Fold dealing moves narrow rows only (cell, respondent, class). The wide
    side is shuffled once, on the respondent, and the result is written, so the
    count and score passes start from it.
    """
    features = sorted(features)
    answers = target_answers(clean, targets, [id_col], country_col)
    if cells is not None:
        moved = materialize(cells.select(*CELL, "place"))
        answers = moved.join_into(answers, CELL, spread=id_col).drop("country").withColumnRenamed("place", "country")
    classes = materialize(class_table(answers, CELL))
    n_classes, largest = (classes.df.groupBy(*CELL).agg(F.max("y").alias("y"), F.sum("n").alias("n"))
                          .agg(F.max("y"), F.max("n")).first())
    labeled = classes.join_into(
        answers.select(*CELL, id_col, "answer"), [*CELL, "answer"], "left", spread=id_col,
    ).select(*CELL, id_col, "y")
    written = materialize(labeled)
    labeled = written.df
    dealt = assign_folds(labeled.where("y IS NOT NULL"), CELL, id_col, n_folds, seed, largest or 0)
    # Rare answers get no fold and need no order.
    rare = labeled.where("y IS NULL").withColumns({c: F.lit(None).cast(dealt.schema[c].dataType) for c in ("fold", "pos")})
    dealt = dealt.unionByName(rare, allowMissingColumns=True)
    wide = clean.select(id_col, feature_array(clean, features).alias("x"))
    # few bytes, much work: a number of tasks by rows, as small shuffles would be merged into one
    tasks = max(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), written.rows // ROWS_PER_TASK)
    rows = dealt.repartition(tasks, id_col).join(wide.repartition(tasks, id_col), id_col)
    rows = rows.select(*CELL, id_col, "y", "fold", "pos", "x")
    return Profiles(materialize(rows).df, classes, features, id_col, n_folds, (n_classes or 0) + 1)
