from pyspark.sql import Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import seeded_key
from surveyspark.operators import ranking
from surveyspark.operators.resampling import assign_folds, permuted, permuted_donors, random_draws
from surveyspark.session import materialize

from conftest import rows


def hot(spark, n=3000):
    """One cell holds two thirds of the rows."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(
        F.concat(F.lit("c"), F.col("id") % 7)).alias("cell"))


def test_ranges_equal_one_window(spark):
    df = hot(spark)
    key = seeded_key(1, F.col("id"))
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy(key, "id")).cast("bigint"))
    for largest in (None, 0, ranking.RANGE_ROWS * 5, ranking.RANGE_ROWS * 300):
        out = ranking.shuffled_row_number(df, ["cell"], key, "id", largest_group=largest)
        assert rows(out.select("id", "cell", "rn")) == rows(plain.select("id", "cell", "rn"))


def test_digits_grow_with_the_group():
    assert ranking.hex_digits_for(10) == 0
    assert ranking.hex_digits_for(ranking.RANGE_ROWS + 1) == 1
    assert ranking.hex_digits_for(ranking.RANGE_ROWS * 16 + 1) == 2


def test_fold_sizes_differ_by_one_at_most(spark):
    folds = assign_folds(hot(spark, 1003), ["cell"], "id", largest_cell=None)
    sizes = folds.groupBy("cell", "fold").count().groupBy("cell").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in sizes)
    again = assign_folds(hot(spark, 1003).repartition(7), ["cell"], "id", largest_cell=1)
    assert rows(folds.select("id", "fold", "pos")) == rows(again.select("id", "fold", "pos"))


def test_permutation_keeps_the_values(spark):
    df = hot(spark, 500).withColumn("v", F.col("id") % 4)
    out = permuted_donors(df, ["cell"], "id", 3)
    want = rows(df.groupBy("cell", "v").count())
    for rep in range(3):
        one = out.where(F.col("rep") == rep)
        assert rows(one.groupBy("cell", "v").count()) == want
        assert one.select("cell", "pos").distinct().count() == 500


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.2), (4, 0.5), (5, None)], "id int, v double")
    got = {r["id"]: r["r"] for r in ranking.average_rank(df, "v", "r").collect()}
    assert got == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0, 5: None}


def test_draws_take_all_when_k_exceeds_the_pool(spark):
    pool = spark.createDataFrame([("t", "c", f) for f in "abc"], "target string, country string, feature string")
    wanted = spark.createDataFrame([("t", "c", "u", 10), ("t", "c", "p", 2)],
                                   "target string, country string, condition string, k bigint")
    out = random_draws(pool, wanted, ["target", "country"], n_draws=4)
    sizes = out.groupBy("condition", "draw").agg(F.count_distinct("feature").alias("n")).collect()
    assert {(r["condition"], r["n"]) for r in sizes} == {("u", 3), ("p", 2)} and len(sizes) == 8


def test_value_order_over_partitions(spark, monkeypatch):
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("g"),
                                 F.md5(F.col("id").cast("string").cast("binary")).alias("v"))
    values = materialize(df)
    want = rows(ranking.ordered_row_number(values, ["g"], "v").select("g", "v", "rn"))
    monkeypatch.setattr(ranking, "RANGE_ROWS", 10)
    got = ranking.ordered_row_number(values, ["g"], "v")
    assert rows(got.select("g", "v", "rn")) == want


def test_average_rank_over_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(200)] + [(999, None)], "id int, v double")
    want = sorted(map(str, ranking.average_rank(df, "v", "r").collect()))
    monkeypatch.setattr(ranking, "RANGE_ROWS", 10)
    assert sorted(map(str, ranking.average_rank(df, "v", "r").collect())) == want


def test_permuted_is_the_join_with_donors(spark):
    df = spark.createDataFrame([(i % 2, i, i // 2, f"v{i}" if i % 5 else None) for i in range(60)], "cell int, id bigint, pos int, v string")
    sizes = materialize(df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    donors = permuted_donors(df.drop("pos"), ["cell"], "id", 3)
    want = rows(df.join(donors.select("cell", "pos", "rep", F.col("v").alias("new")), ["cell", "pos"]).select("cell", "id", "rep", "new").na.fill("-"))
    for largest in (60, 10):  # in one task per group, and by ranges
        got = permuted(df, sizes, ["cell"], "id", "v", 3, largest_group=largest)
        assert rows(got.select("cell", "id", F.posexplode("donors").alias("rep", "new")).na.fill("-")) == want


def test_rows_move_once_whatever_the_repeats(spark):
    df = spark.createDataFrame([(1, i, i, "a") for i in range(9)], "cell int, id bigint, pos int, v string")
    sizes = materialize(df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    plan = permuted(df, sizes, ["cell"], "id", "v", 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan
