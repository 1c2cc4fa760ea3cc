"""Agreement of annotators: Cohen's kappa per pair, Fleiss' kappa over all, strict and lenient shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4

# Codes of an annotated request-variable pair.
CORRECT, PARTIAL, INCORRECT, INSIGHTFUL, VACUOUS = "correct", "partial", "incorrect", "unmappable-insightful", "unmappable-vacuous"
CODES = [CORRECT, PARTIAL, INCORRECT, INSIGHTFUL, VACUOUS]
ROWS_PER_TASK = 500_000  # ratings of one task


def codings(ratings: DataFrame) -> DataFrame:
    """One code per item and rater (the least of several); ratings without item, rater or code are left out."""
    return ratings.where("item IS NOT NULL AND rater IS NOT NULL AND code IS NOT NULL").groupBy("item", "rater").agg(F.min("code").alias("code"))


def _kappa(observed: Column, chance: Column) -> Column:
    """NULL where chance alone agrees always."""
    return F.when(chance < 1, r4((observed - chance) / (1 - chance)))


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """Agreement of every two raters on the items both coded: rater, other, n_items, agreement, kappa.

    An item's codes lie in one array of at most one entry per rater; pairs are formed in it and counted as a
    contingency table, so only (rater, rater, code, code) counts are shuffled further.
    """
    item = codings(ratings).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rater", "code"))).alias("said"))
    pairs = F.flatten(F.transform("said", lambda a, i: F.transform(
        F.filter("said", lambda b: b["rater"] > a["rater"]),
        lambda b: F.struct(a["rater"].alias("rater"), b["rater"].alias("other"), a["code"].alias("x"), b["code"].alias("y")))))
    table = item.select(F.explode(pairs).alias("p")).groupBy("p.rater", "p.other", "p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))
    who = ["rater", "other"]
    totals = table.groupBy(*who).agg(F.sum("n").alias("n_items"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    mine = table.groupBy(*who, F.col("x").alias("code")).agg(F.sum("n").alias("a"))
    theirs = table.groupBy(*who, F.col("y").alias("code")).agg(F.sum("n").alias("b"))
    chance = mine.join(theirs, [*who, "code"]).groupBy(*who).agg(F.sum(F.col("a") * F.col("b")).alias("products"))
    rows = totals.join(chance, who, "left")
    observed, by_chance = F.col("same") / F.col("n_items"), F.coalesce("products", F.lit(0)) / (F.col("n_items") * F.col("n_items"))
    return rows.select(*who, "n_items", r4(observed).alias("agreement"), _kappa(observed, by_chance).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Agreement over all raters, by ``keys`` (columns of an item): keys, n_items, n_ratings, agreement, kappa.

    Items may lack ratings: an item counts with the raters it has, if there are two or more, and code shares come from all ratings
    of such items. Its keys are the least ones of all its ratings; items with a NULL key are left out. Ratings are counted first, so that
    tasks hold equally many whatever their number, and move once, by item.
    """
    keys = keys or []
    tasks = max(int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")), ratings.count() // ROWS_PER_TASK)
    least = [F.min(k).alias(k) for k in keys]
    placed = ratings.where("item IS NOT NULL").select("item", "rater", "code", *keys).repartition(tasks, "item")
    said = placed.groupBy("item", "rater").agg(F.min(F.when(F.col("rater").isNotNull(), F.col("code"))).alias("code"), *least)
    counts = said.groupBy("item", "code").agg(F.count("code").alias("n"), *least)  # none where there is no code
    item = Window.partitionBy("item")
    # at most one row per rater in an item; its first one stands for the item
    counts = counts.select("code", "n", *(F.min(k).over(item).alias(k) for k in keys), F.sum("n").over(item).alias("m"),
                           F.sum(F.col("n") * F.col("n")).over(item).alias("squares"),
                           (F.row_number().over(item.orderBy(F.asc_nulls_last("code"))) == 1).alias("first")).where("m > 1 AND code IS NOT NULL")
    agreed = (F.col("squares") - F.col("m")) / (F.col("m") * (F.col("m") - 1))
    shares = counts.groupBy(*keys, "code").agg(F.sum("n").alias("n"), F.count_if("first").alias("n_items"), F.sum(F.when(F.col("first"), agreed)).alias("agreed"))
    rows = shares.groupBy(*keys).agg(F.sum("n_items").alias("n_items"), F.sum("n").alias("n_ratings"),
                                     (F.sum("agreed") / F.sum("n_items")).alias("observed"), F.sum(F.col("n") * F.col("n")).alias("products"))
    return rows.where(" AND ".join(["n_items > 0", *(f"`{k}` IS NOT NULL" for k in keys)])).select(
        *keys, "n_items", "n_ratings", r4(F.col("observed")).alias("agreement"),
        _kappa(F.col("observed"), F.col("products") / (F.col("n_ratings") * F.col("n_ratings"))).alias("kappa"))


def sensitivity(ratings: DataFrame) -> DataFrame:
    """Per rater: share of correct codes (strict), of correct or partial ones (lenient), and the insightful-to-vacuous ratio.

    The ratio is NULL without vacuous codes.
    """
    of = lambda *codes: F.count_if(F.col("code").isin(*codes))
    n = F.count(F.lit(1))
    return codings(ratings).groupBy("rater").agg(
        n.alias("n"), r4(of(CORRECT) / n).alias("strict"), r4(of(CORRECT, PARTIAL) / n).alias("lenient"),
        F.when(of(VACUOUS) > 0, r4(of(INSIGHTFUL) / of(VACUOUS))).alias("insightful_to_vacuous"))
