"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the words of the mix. Sources that
would be repeated more than ``max_epochs`` times are clamped there and what they
can't use is shared out again by weight, until no source is above its cap. A
source then gives each document ``floor(target / size)`` times, and the rest of
its target once more in a seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.texts import n_words, stored
from surveyspark.operators.ranking import ordered_row_number
from surveyspark.session import materialize

# Seeded order is cut into so many ranges per source; only the one in which the
# target ends is sorted.
RANGES = 4096


@dataclass(frozen=True)
class Plan:
    """What is mixed: weights repeat over the sources in code-point order, nulls last."""

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    max_epochs: int = 2
    seed: str = "mix"


def targets(sources: DataFrame, plan: Plan) -> DataFrame:
    """Water levels: ``sources`` holds source, source_size; adds weight and target (double)."""
    named, unnamed = sources.filter("source IS NOT NULL"), sources.filter("source IS NULL")
    names = materialize(named)
    ranked, n = ordered_row_number(names, [], "source", "_rank"), names.rows
    ranked = ranked.unionByName(unnamed.withColumn("_rank", F.lit(n + 1).cast("long"))) if n else unnamed.withColumn(
        "_rank", F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(plan.weights))) + 1).cast("int"))
    filled = stored(ranked.select("source", "source_size", weight.cast("long").alias("weight"),
                                  (F.col("source_size") * plan.max_epochs).alias("_cap")), "sources")
    total = filled.agg(F.sum("source_size")).first()[0] or 0
    words, left_w, clamped = total * plan.percent, None, -1  # words x 100, to stay in whole numbers
    while True:
        # Clamp what is above its cap at this level, and share the rest anew.
        above = F.lit(False) if left_w is None else F.expr(
            f"CAST(_cap AS DECIMAL(20,0)) * {100 * left_w}BD < CAST(weight AS DECIMAL(10,0)) * {words}BD")
        got = filled.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("_cap"))).alias("cap"),
                         F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if got["n"] == clamped:
            break
        clamped, left_w, words = got["n"], got["w"], total * plan.percent - 100 * (got["cap"] or 0)
        if not left_w:
            left_w, words = 1, 100 * total * plan.max_epochs * max(plan.weights) + 1
            break
    level = words / 100 / left_w if left_w else 0.0
    return filled.select("source", "source_size", "weight",
                         F.least(F.col("weight") * F.lit(level), F.col("_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, epochs.

    ``taken`` is the number of words the mix takes, repeats counted: whole
    repetitions, and for documents early in the seeded order one more. The
    document in which the target ends gives only the words that are missing, so
    a source's taken words are its target, rounded. Null texts have size 0 and
    are taken 0 words; a null source is a source; repeated rows count as
    documents of their own; an empty table gives no rows.
    """
    plan = plan or Plan()
    key = F.md5(F.concat_ws("|", F.lit(plan.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"))
    rows = stored(rows.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * RANGES / 65536)), "sizes")
    by_range = stored(rows.groupBy("source", "_range").agg(F.sum("size").alias("_words")), "ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("_words").alias("source_size")), plan)
    goal = stored(goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                  .withColumn("_rest", F.floor(F.col("target") + F.lit(0.5)) - F.col("_whole") * F.col("source_size")), "targets")
    # Per source at most RANGES rows; words before each range of the order.
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    info = goal.alias("g").join(starts.alias("s"), F.expr("g.source <=> s.source")).select(
        F.col("g.source").alias("_source"), "source_size", "target", "_whole", "_rest", F.col("_range").alias("_r"), "_start", "_words")
    info = info.withColumn("_state", F.when(F.col("_start") + F.col("_words") <= F.col("_rest"), "all").when(
        F.col("_start") >= F.col("_rest"), "none").otherwise("cut"))
    placed = rows.join(info, F.expr("source <=> _source AND _range = _r"))
    done = placed.filter("_state <> 'cut'").withColumn("_more", F.when(F.col("_state") == "all", F.col("size")).otherwise(0))
    # One range per source is sorted.
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.filter("_state = 'cut'").withColumn(
        "_left", F.col("_rest") - F.col("_start") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))).drop("_left")
    taken = (F.col("_whole") * F.col("size") + F.col("_more")).cast("long")
    return done.unionByName(cut).select(
        "doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), F.col("target").cast("double"),
        taken.alias("taken"), "source", F.when(F.col("size") > 0, taken / F.col("size")).otherwise(0.0).alias("epochs"))


def repeated(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as taken.

    The one document per source of which a part is taken stays whole if that
    part is at least half of it, else it goes. Documents without words have no
    size to weigh and stay once.
    """
    got = mix(docs.select("doc_id", "source", "text"), plan)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("epochs") + 0.5)).cast("int")
    # A doc_id that stands for several rows gives each of them the same number of copies.
    copies = got.groupBy("doc_id", F.col("source").alias("__mixing_source")).agg(F.max(times).alias("__mixing_times")).withColumnRenamed("doc_id", "__mixing_doc")
    return (docs.join(copies, F.expr("doc_id <=> __mixing_doc AND source <=> __mixing_source"))
            .withColumn("__mixing_copy", F.explode(F.expr("CASE WHEN __mixing_times > 0 THEN sequence(1, __mixing_times) ELSE array() END")))
            .select(*docs.columns))
