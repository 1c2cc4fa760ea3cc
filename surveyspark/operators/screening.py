"""Which cells and targets to study: regional fallback, target profiles and stratified choice, lists compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4, r6, seeded_key
from surveyspark.operators.mapping import selected_features
from surveyspark.operators.profiles import CELL
from surveyspark.operators.resampling import SEED
from surveyspark.operators.structure import as_features

MIN_ROWS = 600  # answered rows a cell needs to stand on its own
EVERYWHERE = "ALL"


def region_cells(answers: DataFrame, places: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Where the rows of every target and country go: target, country, level, place, n_rows.

    ``answers`` has target, country and one row per answer, ``places`` country and region. A country with at least ``min_rows`` answers
    to a target stays (level ``country``); the small ones of a region are joined (``region``), and regions that are still
    small are joined over all (``all``). Countries without region go to ``all`` at once. Rows are counted once; the rest works on
    one row per target and country.
    """
    counts = answers.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    regions = places.where("country IS NOT NULL").groupBy("country").agg(F.min("region").alias("region"))
    rows = counts.join(regions, "country", "left").withColumn("_alone", F.col("n") >= min_rows)
    small = Window.partitionBy("target", "region", "_alone")  # countries of one region
    rows = rows.withColumn("_pooled", F.sum("n").over(small))
    level = (F.when(F.col("_alone"), "country").when(F.col("region").isNotNull() & (F.col("_pooled") >= min_rows), "region").otherwise("all"))
    place = F.when(F.col("level") == "country", F.col("country")).when(F.col("level") == "region", F.col("region")).otherwise(EVERYWHERE)
    rows = rows.withColumn("level", level).withColumn("place", place)
    joined = Window.partitionBy("target", "level", "place")
    return rows.select(*CELL, "level", "place", F.sum("n").over(joined).alias("n_rows"))


# --- target screening --------------------------------------------------------

def target_profiles(importances: DataFrame, stability: DataFrame, demographic: DataFrame) -> DataFrame:
    """What a candidate target offers: target, n_countries, signal, diversity, variation.

    ``signal`` is the mean over countries of the positive importance of features that are not in ``demographic`` (feature),
    ``diversity`` the effective number of predictors (inverse Simpson index of their positive importances), ``variation`` one minus
    the mean agreement between countries of ``stability`` (target, mean_spearman). Sums are taken in whole millionths.
    """
    micro = F.greatest(F.lit(0), F.round(F.col("importance_mean") * 1000000).cast("bigint"))
    rows = as_features(importances).join(demographic.select("feature").distinct(), "feature", "left_anti").select(*CELL, "feature", micro.alias("m"))
    countries = as_features(importances).groupBy("target").agg(F.count_distinct("country").alias("n_countries"))
    sums = rows.groupBy("target", "feature").agg(F.sum("m").alias("m")).groupBy("target").agg(
        F.sum("m").alias("all"), F.sum(F.col("m").cast("double") * F.col("m")).alias("squares"))
    rows = countries.join(sums, "target", "left").join(stability.select("target", "mean_spearman"), "target", "left")
    return rows.select("target", "n_countries", r6(F.coalesce("all", F.lit(0)) / (F.col("n_countries") * 1000000.0)).alias("signal"),
                       F.when(F.col("squares") > 0, r4(F.col("all").cast("double") * F.col("all") / F.col("squares"))).alias("diversity"),
                       r4(1 - F.col("mean_spearman")).alias("variation"))


def quotas(candidates: DataFrame, total: int) -> DataFrame:
    """Places per section: section, n, quota; proportional, largest remainders first, ties to the earlier section.

    Quotas sum to ``total``, or to the number of candidates if that is smaller.
    """
    sizes = candidates.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per section
    sizes = sizes.withColumn("_all", F.sum("n").over(everything)).withColumn("_total", F.least(F.lit(total), F.col("_all")))
    sizes = sizes.withColumn("_whole", F.floor(F.col("n") * F.col("_total") / F.col("_all")).cast("bigint"))
    sizes = sizes.withColumn("_rest", F.col("n") * F.col("_total") - F.col("_whole") * F.col("_all"))
    left = F.col("_total") - F.sum("_whole").over(everything)
    nth = F.row_number().over(Window.orderBy(F.desc("_rest"), "section"))
    return sizes.select("section", "n", (F.col("_whole") + F.when(nth <= left, 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified_draw(candidates: DataFrame, total: int, score: str | None = None, seed: int = SEED) -> DataFrame:
    """``total`` candidates (section, target) over all sections, by quota: the highest scores first, or a seeded draw without ``score``.

    Equal scores, and NULL ones, which come last, are put in order by a seeded key, so reruns agree. Adds ``place`` (from 1, in its section).
    """
    key = seeded_key(seed, F.col("section"), F.col("target"))
    order = [F.col(score).desc_nulls_last()] if score else []
    nth = F.row_number().over(Window.partitionBy("section").orderBy(*order, key, "target"))
    return candidates.withColumn("place", nth.cast("bigint")).join(quotas(candidates, total).select("section", "quota"), "section").where(
        "place <= quota").drop("quota")


def screening_score(profiles: DataFrame) -> DataFrame:
    """Adds ``score``: mean of the places (0 to 1) of signal and variation among all candidates; ties share the lower place."""
    everything = Window.partitionBy()
    rows = profiles
    for c in ("signal", "variation"):
        rows = rows.withColumn(f"_{c}", F.rank().over(Window.orderBy(F.col(c).asc_nulls_first())))
    return rows.withColumn("score", r6((F.col("_signal") + F.col("_variation")) / (2.0 * F.count(F.lit(1)).over(everything)))).drop("_signal", "_variation")


# --- lists of two conditions -------------------------------------------------

# Words that show that a requested feature is about where people live.
PLACE_WORDS = ["country", "nation", "region", "urban", "rural", "province", "locality"]
BARE, GIVEN = "unprompted", "country_provided"


def _lists(requests: DataFrame, condition: str, out: str) -> DataFrame:
    chosen = selected_features(requests.where(F.col("condition") == condition), CELL)
    return chosen.groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_rank", "selected_code"))),
                                                 lambda s: s["selected_code"]).alias(out))


def list_class(a: Column, b: Column) -> Column:
    """What became of list ``a`` in ``b``: same, reordered, partly changed, disjoint, or which of them is empty."""
    shared = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), "both empty").when((F.size(a) == 0) | (F.size(b) == 0), "one empty")
            .when(a == b, "same").when((shared == F.size(a)) & (shared == F.size(b)), "reordered").when(shared == 0, "disjoint")
            .otherwise("partly changed"))


def list_taxonomy(requests: DataFrame) -> DataFrame:
    """Selected lists without and with the country, per cell: target, country, n_unprompted, n_provided, n_shared, jaccard, list_class.

    A list has each selected variable once, in the order of request. An unprompted list without country stands for all countries
    of its target. ``jaccard`` is NULL if both are empty.
    """
    bare = _lists(requests, BARE, "a")
    everywhere = bare.where("country IS NULL").select("target", F.col("a").alias("e"))
    given = _lists(requests, GIVEN, "b")
    cells = requests.where("country IS NOT NULL").select(*CELL).distinct()
    none = F.array().cast("array<string>")
    rows = (cells.join(bare.where("country IS NOT NULL"), CELL, "left").join(everywhere, "target", "left").join(given, CELL, "left")
            .select(*CELL, F.coalesce("a", "e", none).alias("a"), F.coalesce("b", none).alias("b")))
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    return rows.select(*CELL, F.size("a").cast("bigint").alias("n_unprompted"), F.size("b").cast("bigint").alias("n_provided"),
                       shared.cast("bigint").alias("n_shared"), F.when(union > 0, r4(shared / union)).alias("jaccard"),
                       list_class(F.col("a"), F.col("b")).alias("list_class"))


def context_taxonomy(requests: DataFrame, lists: DataFrame, share: float = 0.5) -> DataFrame:
    """Per target: does it ask for the place unprompted, and do lists change when the country is given?

    Result: target, asks_place, n_cells, n_changed, taxonomy. ``requests`` has feature_label; a target adapts if more than
    ``share`` of its cells have other variables with the country than without.
    """
    label = F.lower(F.coalesce("feature_label", F.lit("")))
    asks = F.exists(F.array(*map(F.lit, PLACE_WORDS)), lambda w: F.contains(label, w))
    place = requests.groupBy("target").agg(F.coalesce(F.bool_or(F.when(F.col("condition") == BARE, asks)), F.lit(False)).alias("asks_place"))
    changed = F.count_if(F.col("list_class").isin("partly changed", "disjoint", "one empty"))
    cells = lists.groupBy("target").agg(F.count(F.lit(1)).alias("n_cells"), changed.alias("n_changed"))
    adapts = F.col("n_changed") > share * F.col("n_cells")
    words = F.concat(F.when(F.col("asks_place"), "context-aware").otherwise("context-unaware"), F.lit(" and "),
                     F.when(adapts, "adaptive").otherwise("rigid"))
    return place.join(cells, "target").select("target", "asks_place", "n_cells", "n_changed", words.alias("taxonomy"))
