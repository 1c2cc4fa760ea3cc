"""URL filter: fixed rules, and beyond them the ratio of two character language models.

DataFrame functions only.

Rules name a host and a path prefix and say allow or block; the longest that
fits decides. URLs that a rule decides are the training data of two
variable-order Markov models, one of accepted and one of rejected URLs: the
probability of a character mixes the counts behind its last ``order``
characters with those behind ever shorter contexts, each weighted by how many
different characters were seen there (Witten-Bell). A URL that no rule
fits gets the difference of its two log-likelihoods, divided by its number
of characters, and is blocked below a cut. The cut is calibrated on hosts held
out of training: it has the smallest sum of wrongly blocked and wrongly
allowed shares.

What keeps it small: every different URL counts once. Its characters are
counted with their longest context only; counts of shorter contexts are sums
of these. Probabilities are computed order by order, each joined to the one
below by the shorter context, so that a key of these joins holds at most one row per
character of the alphabet. The counts stay distributed and grow with the corpus; the driver
receives the cut alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.texts import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters of context; what pads the start, and what ends a URL.
ORDER = 5
START, END = "\u0002", "\u0003"
# Probability of a character where nothing was counted: one of all code points.
FLAT = 1.0 / 1_114_112
# Log-ratios are summed as whole millionths, so that the order of a sum doesn't matter.
UNIT = 1_000_000
# Bins of a score per unit, and the bins at both ends.
BINS, LAST_BIN = 200, 2_000
# A host is held out when the md5 of its name begins with one of these.
HELD = ("0", "1", "2", "3")


@dataclass(frozen=True)
class Rule:
    """Decides for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit(f".{self.host}"))) & F.startswith(path, F.lit(self.path))


# The rules of the registered query.
RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the text that the models read: the URL without its scheme, its host in lower case."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    host = F.translate(raw, UPPER, LOWER)
    text = F.when(at > 0, F.concat(host, F.substr(rest, F.length(raw) + 1))).otherwise(F.coalesce(url, F.lit("")))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), text


def _decided(rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, null without one."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        out = F.when(rule.fits(F.col("host"), F.col("path")), F.lit(value(rule))).otherwise(out)
    return out


def _grams(text: Column, order: int) -> Column:
    """Each character with the ``order`` before it, the end mark included; never begins inside a surrogate pair."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{order + 1}}}))"), F.lit(1))


def _counted(texts: DataFrame, order: int) -> DataFrame:
    """Every (order + 1)-gram of ``texts`` (text, label, held): gram, a and b, its counts in accepted and rejected training URLs."""
    train = lambda label: (F.col("label").eqNullSafe(F.lit(label)) & ~F.col("held")).cast("long")
    rows = texts.select(F.explode(_grams(F.col("text"), order)).alias("gram"), train(True).alias("a"), train(False).alias("b"))
    return rows.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Log-ratio of every gram of ``order + 1`` characters: gram, ratio (millionths)."""
    levels = [stored(_counted(texts, order), "grams")]
    for k in range(order, 0, -1):
        shorter = levels[-1].groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        levels.append(stored(shorter, "grams"))
    below = None
    for k, level in enumerate(reversed(levels)):
        behind = Window.partitionBy(F.left("gram", F.lit(k)))  # as many rows as characters follow one context
        for x in "ab":
            level = level.withColumn(f"n{x}", F.sum(x).over(behind)).withColumn(f"u{x}", F.sum(F.when(F.col(x) > 0, 1).otherwise(0)).over(behind))
        if below is None:
            level = level.withColumns({"la": F.lit(FLAT), "lb": F.lit(FLAT)})
        else:
            level = level.withColumn("tail", F.right("gram", F.lit(k))).join(
                below.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "tail")
        mixed = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"u{x}") * F.col(f"l{x}")) / (
            F.col(f"n{x}") + F.col(f"u{x}"))).otherwise(F.col(f"l{x}"))
        below = level.select("gram", mixed("a").alias("pa"), mixed("b").alias("pb"))
    ratio = F.floor((F.log("pa") - F.log("pb")) * float(UNIT) + 0.5)
    return stored(below.select("gram", ratio.alias("ratio")), "ratios")


def scores(texts: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """Mean log-ratio of every row of ``texts`` (id, text): id, total (millionths), n."""
    rows = texts.select("id", F.explode(_grams(F.col("text"), order)).alias("gram"))
    # Both sides are shuffled as they come from files, so Spark can split a gram that most URLs share.
    return rows.join(ratios, "gram").groupBy("id").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))


def _bin(total: Column, n: Column) -> Column:
    """Bin of a score, in whole numbers."""
    return F.greatest(F.lit(-LAST_BIN), F.least(F.lit(LAST_BIN), F.floor(total * float(BINS) / (n * float(UNIT))))).cast("int")


def calibrated(held: DataFrame) -> int:
    """Smallest bin that is allowed, from held-out scores (label, bin): at most ``2 * LAST_BIN + 1`` bins are compared.

    Ties go to the bin next to 0, then to the smaller. 0 if a class has no held-out URL.
    """
    counts = held.groupBy("bin").agg(*(F.count(F.when(F.col("label") == v, 1)).alias(k) for k, v in (("a", True), ("b", False))))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    error = (F.coalesce(F.sum("a").over(before), F.lit(0)) / F.sum("a").over(everything)
             + 1 - F.coalesce(F.sum("b").over(before), F.lit(0)) / F.sum("b").over(everything))
    counts = counts.filter(F.col("a") + F.col("b") > 0)
    one = counts.select("bin", F.when((F.sum("a").over(everything) > 0) & (F.sum("b").over(everything) > 0), error).alias("error"))
    best = one.filter("error IS NOT NULL").orderBy("error", F.abs("bin"), "bin").first()
    return best["bin"] if best else 0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``rule`` and its verdict come from the longest rule that fits (of equally long ones the first by
    code point); other pages get ``allow`` or ``block`` by their score, the mean log-ratio of a
    character, which is null where a rule decided. A null url is judged as an empty one, and one
    without ``://`` as a text without host and path. Equal urls get equal rows. Where a class has
    no training URL, both models are flat in it; without held-out URLs of both classes the
    cut is 0. An empty table gives no rows. Other columns are not read.
    """
    host, path, text = _parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rows = rows.withColumn("rule", _decided(rules, lambda r: r.text).cast("string")).withColumn(
        "label", _decided(rules, lambda r: r.allow).cast("boolean"))
    held = F.col("label").isNotNull() & F.left(F.md5("host"), F.lit(1)).isin(*HELD)
    texts = rows.select("text", "label", F.when(F.col("label").isNotNull(), F.col("host")).alias("host")).distinct()
    texts = stored(texts.withColumn("held", held).drop("host").withColumn("id", F.monotonically_increasing_id()), "urls")
    wanted = texts.filter("label IS NULL OR held")
    scored = scores(wanted, model(texts, order), order).withColumn("bin", _bin(F.col("total"), F.col("n")))
    scored = stored(scored.join(wanted, "id").select(
        "text", "label", "bin", (F.col("total") / (F.col("n") * float(UNIT))).alias("score")), "scores")
    cut = calibrated(scored.filter("label IS NOT NULL"))
    open_ = scored.filter("label IS NULL").select("text", F.lit("").alias("_none"), "score", "bin")
    # Only pages without rule meet a score.
    rows = rows.withColumn("_none", F.when(F.col("rule").isNull(), "")).join(open_, ["text", "_none"], "left")
    verdict = F.when(F.coalesce("label", F.col("bin") >= cut), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
