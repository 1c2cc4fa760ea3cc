"""Predictive structure of cells: ceilings, entropy, mutual information, agreement of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import pearson, r4, r6
from surveyspark.operators.bayes import BayesModel, best_class, term_rows
from surveyspark.operators.importance import importance_rank, top_k
from surveyspark.operators.mapping import selected_features
from surveyspark.operators.profiles import CELL
from surveyspark.session import materialize

CEILING_SHARE = (9, 10)  # of the ceiling, as a fraction
FEATURE = [*CELL, "feature"]


def as_features(importances: DataFrame, value: str = "importance_mean") -> DataFrame:
    """target, country, feature, ``value`` of an importance table."""
    return importances.select(F.col("target_variable").alias("target"), "country", F.col("feature_variable").alias("feature"), value)


# --- ceilings ----------------------------------------------------------------

def prefix_hits(prior: Column, terms: Column, y: Column) -> Column:
    """For every prefix of ``terms`` (structs with ``ll``): 1 if the class it predicts is ``y``, else 0.

    One running sum of likelihood arrays gives the predictions of all prefixes.
    """
    def longer(seen: Column, term: Column) -> Column:
        scores = F.zip_with(seen["scores"], term["ll"], lambda a, b: a + b)
        return F.struct(scores.alias("scores"), F.concat(seen["hits"], F.array((best_class(scores) == y).cast("int"))).alias("hits"))
    start = F.struct(prior.alias("scores"), F.array().cast("array<int>").alias("hits"))
    return F.aggregate(terms, start, longer, lambda seen: seen["hits"])


def ceiling_curve(model: BayesModel, importances: DataFrame) -> DataFrame:
    """Held-out accuracy of the k most important features, for every k of every cell.

    Result: target, country, k, feature (the k-th), accuracy_mean, accuracy_std (population, over
    folds). Nothing is fitted per k: each respondent's likelihoods are put in the order
    of importance and summed once. Rows stay where they are, and an
    array holds one cell's features.
    """
    p = model.profiles
    order = materialize(importance_rank(importances).select(
        F.col("target_variable").alias("target"), "country", F.col("feature_variable").alias("feature"), "rank"))
    place = F.array_position(F.array(*[F.lit(f) for f in p.features]), F.col("feature")) - 1
    places = materialize(order.df.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("rank", place.cast("int").alias("at")))).alias("_order")))
    rows = places.join_into(term_rows(model), CELL, spread=p.id_col)
    terms = rows.withColumn("_terms", F.transform("_order", lambda o: F.struct(F.get("lls", o["at"]).alias("ll"))))
    scored = model.priors.join_into(terms.drop("lls", "x", "_order"), [*CELL, "fold"], spread=p.id_col)
    hits = scored.select(*CELL, "fold", F.posexplode(prefix_hits(F.col("prior"), F.col("_terms"), F.col("y"))).alias("_at", "hit"))
    folds = hits.groupBy(*CELL, "fold", (F.col("_at") + 1).cast("bigint").alias("k")).agg((F.sum("hit") / F.count(F.lit(1))).alias("accuracy"))
    curve = folds.groupBy(*CELL, "k").agg(r4(F.avg("accuracy")).alias("accuracy_mean"), r4(F.stddev_pop("accuracy")).alias("accuracy_std"))
    return curve.join(order.df.withColumnRenamed("rank", "k"), [*CELL, "k"]).select(*CELL, "k", "feature", "accuracy_mean", "accuracy_std")


def target_entropy(classes: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Entropy of a cell's classes in bits: cell, n_classes, entropy."""
    of_cell = Window.partitionBy(*cell)  # answer classes of one cell
    shares = classes.groupBy(*cell, "y").agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(of_cell))
    return shares.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_classes"), r6(F.abs(F.sum(-F.col("p") * F.log2("p")))).alias("entropy"))


def complexity(curve: DataFrame, classes: DataFrame, share: tuple[int, int] = CEILING_SHARE) -> DataFrame:
    """One row per cell: n_classes, entropy, n_features, all_features, ceiling, k90.

    ``ceiling`` is the highest accuracy of the curve, ``all_features`` the one at its end, and ``k90`` the smallest k
    that reaches ``share`` of the ceiling, compared in whole ten-thousandths.
    """
    parts = lambda c: F.round(F.col(c) * 10000).cast("bigint")
    tops = curve.groupBy(*CELL).agg(F.max("accuracy_mean").alias("ceiling"), F.max("k").alias("n_features"),
                                    F.max_by("accuracy_mean", "k").alias("all_features"))
    reached = curve.join(tops, CELL).where(parts("accuracy_mean") * share[1] >= parts("ceiling") * share[0])
    k90 = reached.groupBy(*CELL).agg(F.min("k").alias("k90"))
    return target_entropy(classes).join(tops, CELL).join(k90, CELL).select(
        *CELL, "n_classes", "entropy", "n_features", "all_features", "ceiling", "k90")


# --- ranks and correlations --------------------------------------------------

def grouped_average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: twice the rank of ``value`` inside ``keys``, ties share the mean rank; NULL has none.

    Twice a mean rank is a whole number, so sums over ranks are exact. A group is the
    feature list of a cell or the cells of a grid, never respondents.
    """
    order = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), 2 * F.rank().over(order) + ties - 1).cast("bigint"))


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation of two whole-number columns, NULL without spread. Sums are exact."""
    whole = "decimal(20,0)"
    n = F.count(F.lit(1)).cast(whole)
    total = lambda x: F.sum(x).cast(whole)
    x, y = F.col(a), F.col(b)
    over = n * total(x * y) - total(x) * total(y)
    under = (n * total(x * x) - total(x) * total(x)).cast("double") * (n * total(y * y) - total(y) * total(y)).cast("double")
    return F.when(under > 0, over.cast("double") / F.sqrt(under))


def complexity_calibration(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Does the number of requested features follow what a cell needs?

    ``requests`` has target, country, condition and selected_code, ``cells`` is :func:`complexity`. Result: condition,
    measure (k90, entropy, ceiling), n_cells, pearson, spearman of the number of selected features with it.
    """
    chosen = selected_features(requests, [*CELL, "condition"]).groupBy(*CELL, "condition").agg(F.count(F.lit(1)).alias("k"))
    measures = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("k90", "entropy", "ceiling")))
    rows = chosen.join(cells, CELL).select("condition", *CELL, "k", F.explode(measures).alias("m")).select("condition", "k", "m.*")
    group = ["condition", "measure"]
    rows = grouped_average_rank(grouped_average_rank(rows, group, "k", "_k"), group, "value", "_v")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_cells"), r4(pearson("k", "value")).alias("pearson"),
                                    r4(correlation("_k", "_v")).alias("spearman"))


# --- mutual information ------------------------------------------------------

def mutual_information(counts: DataFrame) -> DataFrame:
    """Plug-in mutual information of every feature with its target, in nats.

    ``counts`` holds cell, feature, val, y and n (rows of rare classes have no y and are left out); a missing
    answer is an answer. Result: target, country, feature, n, mutual_information, share (of the target's
    entropy; NULL if that is 0). All marginals come from the joint counts in one pass: with L = n ln n the information is
    (L(joint) - L(answers) - L(classes) + L(all)) / n.
    """
    used = counts.where(F.col("y").isNotNull())
    sets = [[*FEATURE, "val", "y"], [*FEATURE, "val"], [*FEATURE, "y"], FEATURE]
    sums = used.groupingSets(sets, *FEATURE, "val", "y").agg(
        F.sum("n").cast("double").alias("n"), F.grouping("val").alias("_v"), F.grouping("y").alias("_y"))
    term = F.col("n") * F.ln("n")
    only = lambda v, y: F.sum(F.when((F.col("_v") == v) & (F.col("_y") == y), term).otherwise(0.0))
    parts = sums.groupBy(*FEATURE).agg(
        F.max("n").alias("n"), only(0, 0).alias("joint"), only(0, 1).alias("answers"), only(1, 0).alias("classes"), only(1, 1).alias("all"))
    information = F.greatest(F.lit(0.0), (F.col("joint") - F.col("answers") - F.col("classes") + F.col("all")) / F.col("n"))
    entropy = (F.col("all") - F.col("classes")) / F.col("n")
    return parts.select(*FEATURE, F.col("n").cast("bigint").alias("n"), r6(information).alias("mutual_information"),
                        F.when(entropy > 1e-12, r6(information / entropy)).alias("share"))


def rank_agreement(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two rankings of a cell's features: target, country, n_features, spearman.

    Both tables have target, country, feature and their value; features of both count. NULL without spread.
    """
    rows = left.select(*FEATURE, a).join(right.select(*FEATURE, b), FEATURE).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = grouped_average_rank(grouped_average_rank(rows, CELL, a, "_a"), CELL, b, "_b")
    return rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_features"), r4(correlation("_a", "_b")).alias("spearman"))


def _doubled_ranks(values: Column) -> Column:
    """Twice the average ranks of a small array without NULLs."""
    return F.transform(values, lambda v: F.aggregate(values, F.lit(1), lambda n, o: n + F.when(o < v, 2).when(o == v, 1).otherwise(0)))


def _array_correlation(pairs: Column) -> Column:
    """Pearson correlation of an array of whole-number pairs (a, b)."""
    n = F.size(pairs).cast("bigint")
    total = lambda f: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, p: s + f(p).cast("bigint"))
    sa, sb = total(lambda p: p["a"]), total(lambda p: p["b"])
    over = n * total(lambda p: p["a"] * p["b"]) - sa * sb
    under = (n * total(lambda p: p["a"] * p["a"]) - sa * sa).cast("double") * (n * total(lambda p: p["b"] * p["b"]) - sb * sb).cast("double")
    return F.when(under > 0, over / F.sqrt(under))


def country_pairs(importances: DataFrame, value: str = "importance_mean") -> DataFrame:
    """Spearman correlation of the importances of every two countries, per target: target, country, other, n_features, spearman.

    Each country is one vector over the target's features in code order, so a pair is compared place by place and features
    are never joined. Features that one of the two lacks don't count. Countries whose features are complete bring their ranks along;
    the others are ranked again per pair.
    """
    rows = as_features(importances, value).where(F.col(value).isNotNull())
    ranked = grouped_average_rank(rows, CELL, value, "_rank")
    names = rows.groupBy("target").agg(F.array_sort(F.collect_set("feature")).alias("names"))
    own = ranked.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(F.col(value).alias("v"), F.col("_rank").alias("r"))))).alias("own"))
    vectors = own.join(names, "target").select(*CELL, F.transform("names", lambda f: F.try_element_at("own", f)).alias("x"))
    vectors = materialize(vectors).df
    pairs = vectors.join(vectors.select("target", F.col("country").alias("other"), F.col("x").alias("z")), "target").where("country < other")
    both = F.filter(F.arrays_zip("x", "z"), lambda p: p["x"].isNotNull() & p["z"].isNotNull())
    pairs = pairs.select("target", "country", "other", F.size("x").alias("all"), both.alias("both"))
    given = F.transform("both", lambda p: F.struct(p["x"]["r"].alias("a"), p["z"]["r"].alias("b")))
    side = lambda s: _doubled_ranks(F.transform("both", lambda p: p[s]["v"]))
    again = F.transform(F.arrays_zip(side("x").alias("a"), side("z").alias("b")), lambda p: F.struct(
        p["a"].cast("bigint").alias("a"), p["b"].cast("bigint").alias("b")))
    pairs = pairs.withColumn("_pairs", F.when(F.size("both") == F.col("all"), given).otherwise(again))
    return pairs.select("target", "country", "other", F.size("both").cast("bigint").alias("n_features"),
                        r6(_array_correlation(F.col("_pairs"))).alias("spearman"))


def cross_country_stability(pairs: DataFrame) -> DataFrame:
    """Mean agreement of a target's importances across countries: target, n_pairs, mean_spearman, least, most.

    High values mean universal, low ones culturally contingent structure. Pairs without a correlation don't count.
    """
    known = pairs.where(F.col("spearman").isNotNull())
    return known.groupBy("target").agg(F.count(F.lit(1)).alias("n_pairs"), r4(F.avg("spearman")).alias("mean_spearman"),
                                       r4(F.min("spearman")).alias("least"), r4(F.max("spearman")).alias("most"))


# --- captured importance -----------------------------------------------------

def captured_importance(requests: DataFrame, importances: DataFrame) -> DataFrame:
    """Importance of the selected features over that of the equally many most important ones.

    Result: target, country, condition, k, n_unknown (selected features without importance, which count 0), selected_sum,
    oracle_sum, captured. ``captured`` is NULL where the oracle's sum is not positive: a ratio to it means
    nothing. Importances are summed in whole millionths. Cells without importances have no sums.
    """
    keys = [*CELL, "condition"]
    micro = lambda c: F.round(F.col(c) * 1000000).cast("bigint")
    chosen = selected_features(requests, keys).withColumnRenamed("selected_code", "feature")
    known = as_features(importances).select(*FEATURE, micro("importance_mean").alias("micro"))
    ks = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    mine = chosen.join(known, FEATURE, "left").groupBy(*keys).agg(
        F.count_if(F.col("micro").isNull()).alias("n_unknown"), F.coalesce(F.sum("micro"), F.lit(0)).alias("mine"))
    best = top_k(importances, ks).groupBy(*keys).agg(F.sum(micro("importance_mean")).alias("best"))
    rows = ks.join(mine, keys).join(best, keys, "left")
    return rows.select(*keys, "k", "n_unknown", F.when(F.col("best").isNotNull(), r6(F.col("mine") / 1000000.0)).alias("selected_sum"),
                       r6(F.col("best") / 1000000.0).alias("oracle_sum"), F.when(F.col("best") > 0, r4(F.col("mine") / F.col("best"))).alias("captured"))
