"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

DataFrame functions only, in two passes over the texts (characters, then
spans); what is shuffled are histograms of fixed size for the false-discovery control.

Battery. Every other run of at least 20 characters of the base-64
family is a candidate. Its encoding is inferred from its characters (hex, base
32, letters and digits, base 64), which gives an alphabet of equally likely symbols. Three tests
of that hypothesis give p-values: chi-squared of the symbol counts against
uniform, number of runs above and below the middle of the alphabet, and serial
correlation of neighbours. The least of the three, corrected for three tests,
is the candidate's p: uniform for random strings, next to zero for words, paths
and repeats.

A string counts as random if that p is not below ``FLOOR`` and it survives false-discovery control.

False-discovery control. What must be ruled out is an ordinary string that
looks even by chance. Ordinary strings draw their characters as the corpus does: one pass counts
the characters of all texts (a fixed table of letter frequencies is added, so that a
tiny corpus has a distribution too). Under that model the number of equal pairs of characters in a string has a known
mean and variance for its length and alphabet; how far a string falls below it gives a second p-value. Per length class the
candidates are taken by Benjamini and Hochberg's step-up rule at rate ``FDR``, which holds for few candidates as for many. Short
strings can't fall far, so their classes get a stricter cut or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.texts import stored, text_or_empty

# What the base patterns match, in the order of their kinds.
ASSIGN = (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+")
ASSIGN_VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

FDR, FLOOR = 0.05, 0.01
# P-values of ordinary strings are binned by their logarithm: bins per factor of ten, and the last bin.
LOG_BINS, LAST_LOG = 20, 400
SHORTEST = 20
# Upper length of each class; the last is open.
CLASSES = (24, 32, 48, 64, 128)
# Sum of the positions of a block, in two steps, keeps prefix sums near linear.
BLOCK = 256

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Encoding: what its strings look like, and its alphabet in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", LOWER + DIGITS),
    ("BASE36", "^[A-Z0-9]+$", UPPER + DIGITS),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("mixed", "^", UPPER + LOWER + DIGITS + "+/-_"),
)
SYMBOLS = UPPER + LOWER + DIGITS + "+/-_"
# Letters of ordinary text, per ten thousand.
LETTERS = {"e": 1270, "t": 906, "a": 817, "o": 751, "i": 697, "n": 675, "s": 633, "h": 609, "r": 599, "d": 425, "l": 403, "c": 278, "u": 276,
           "m": 241, "w": 236, "f": 223, "g": 202, "y": 197, "p": 193, "b": 149, "v": 98, "k": 77, "j": 15, "x": 15, "q": 10, "z": 7}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a lambda computes what it closes over anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sum of the elements before each one, by blocks, so that no step copies a long array again and again."""
    none = F.array().cast("array<long>")
    scan = lambda xs, start: F.aggregate(
        xs, F.struct(start.alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    blocks = lambda ls: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / BLOCK).cast("int")), lambda j: F.slice(ls, j * BLOCK + 1, F.lit(BLOCK)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    offset = lambda bs: _let(scan(F.transform(bs, total), F.lit(0).cast("long")), lambda starts: F.flatten(
        F.zip_with(bs, starts, scan)))
    return _let(lengths, lambda ls: _let(blocks(ls), offset))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, found), counted in code points."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    steps = lambda s: F.zip_with(s["found"], F.slice(s["gaps"], F.lit(1), F.size(s["found"])), lambda m, g: (
        F.length(g) + F.length(m)).cast("long"))
    spans = lambda s: F.zip_with(s["found"], F.zip_with(_running(steps(s)), steps(s), lambda at, step: at + step), lambda m, end: F.struct(
        (end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(both, spans)).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """P(N > z) of a standard normal, to about 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def facts(token: Column) -> Column:
    """Codes of the characters in the inferred alphabet, its size, the length, the sum of squared counts and the chi-squared p-value."""
    alphabet = F.coalesce(*(F.when(F.regexp_like(token, F.lit(p)), F.lit(a)) for _, p, a in ENCODINGS))
    seen = F.struct(alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"), F.length(token).cast("double").alias("n"),
                    token.alias("token"), F.split(token, "", -1).alias("chars"))

    def tests(s: Column) -> Column:
        counts = F.transform(F.array_distinct(s["chars"]), lambda c: s["n"] - F.length(F.replace(s["token"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
        chi, free = squares * s["size"] / s["n"] - s["n"], s["size"] - 1
        # Exact variance of the statistic for n draws; large-sample theory fails for n below the alphabet.
        p_chi = _upper_tail((chi - free) / F.sqrt(2 * free * (s["n"] - 1) / s["n"]))
        codes = F.transform(s["chars"], lambda c: F.instr(s["alphabet"], c) - 0.5)
        return F.struct(codes.alias("codes"), s["alphabet"].alias("alphabet"), s["size"].alias("size"), s["n"].alias("n"),
                        squares.alias("squares"), p_chi.alias("p_chi"))
    return _let(seen, tests)


def battery(seen: Column) -> Column:
    """Smallest p-value of the three tests, corrected for their number, in [0, 1]. ``seen`` is a lambda's variable."""
    codes, size, n = seen["codes"], seen["size"], seen["n"]
    nxt = F.slice(codes, 2, F.size(codes))
    changes = F.aggregate(F.zip_with(codes, nxt, lambda a, b: F.when((a < size / 2) != (b < size / 2), 1.0).otherwise(0.0)),
                          F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    # Neighbours differ in their half with probability one half.
    z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    mid, var = size / 2, (size * size - 1) / 12
    serial = F.aggregate(F.zip_with(codes, nxt, lambda a, b: (a - mid) * (b - mid)), F.lit(0.0),
                         lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    z_serial = serial / (var * F.sqrt(n - 1))
    least = F.least(seen["p_chi"], 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial)))
    return F.least(F.lit(1.0), 1 - F.pow(1 - F.least(F.lit(1.0), least), 3))


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, top in reversed(list(enumerate(CLASSES))):
        out = F.when(n < top, i).otherwise(out)
    return out


def character_counts(docs: DataFrame) -> dict[str, float]:
    """How often each character of the candidates' alphabets occurs in all texts, and in the fixed table."""
    text = text_or_empty()
    counts = docs.agg(*(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))), F.lit(0)).alias(f"_{i}")
                        for i, c in enumerate(SYMBOLS))).first()
    return {c: float(counts[i]) + LETTERS.get(c, 0) for i, c in enumerate(SYMBOLS)}


def moments(counts: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Per alphabet the sums of squares and cubes of its characters' shares."""
    out = {}
    for _, _, alphabet in ENCODINGS:
        total = sum(counts[c] for c in alphabet) or 1.0
        shares = [counts[c] / total for c in alphabet] if total > 1 else [1 / len(alphabet)] * len(alphabet)
        out[alphabet] = sum(x ** 2 for x in shares), sum(x ** 3 for x in shares)
    return out


def ordinary(seen: Column, known: dict[str, tuple[float, float]]) -> Column:
    """P-value of so few equal pairs of characters in an ordinary string. ``seen`` is a lambda's variable."""
    n = seen["n"]
    second, third = (F.element_at(F.create_map(*(F.lit(x) for a, m in known.items() for x in (a, m[k]))), seen["alphabet"]) for k in (0, 1))
    pairs = n * (n - 1) / 2
    variance = pairs * (second - second * second) + n * (n - 1) * (n - 2) * (third - second * second)
    z = ((seen["squares"] - n) / 2 - pairs * second) / F.sqrt(F.greatest(F.lit(1e-9), variance))
    return _log_tail(-z)


def _log_tail(z: Column) -> Column:
    """-log10 P(N > z) of a standard normal; far out by its leading term."""
    far = F.greatest(z, F.lit(3.0))
    return F.when(z < 3, -F.log10(_upper_tail(z))).otherwise((far * far / 2 + F.log(far * 2.5066282746)) / 2.302585093)


def cuts(tests: DataFrame, fdr: float = FDR) -> DataFrame:
    """Lowest accepted bin of -log10 p per length class: class, cut. At most ``len(CLASSES) + 1`` rows.

    ``tests`` holds class and bin of all candidates. The step-up rule on bins: as many candidates must reach a bin
    that its p-value times all of the class is at most ``fdr`` of them. Classes in which none does are left out.
    """
    counts = tests.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy("class")  # LAST_LOG rows at most
    up = of_class.orderBy(F.desc("bin"))
    seen = counts.withColumn("reach", F.sum("n").over(up)).withColumn("all", F.sum("n").over(of_class))
    return seen.filter(F.pow(F.lit(10.0), -F.col("bin") / LOG_BINS) * F.col("all") <= fdr * F.col("reach")).groupBy("class").agg(F.min("bin").alias("cut"))


def parts(match: Column, base: Column) -> Column:
    """What the base spans leave of a match: array of (start, end, found), each of ``SHORTEST`` characters or more."""
    over = lambda m: F.filter(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    def left(x: Column) -> Column:
        begins = F.array_distinct(F.concat(F.array(x["m"]["start"]), F.transform(x["over"], lambda b: b["end"])))
        begins = F.filter(begins, lambda s: ~F.exists(x["over"], lambda b: (b["start"] <= s) & (s < b["end"])))
        pieces = F.transform(begins, lambda s: F.struct(s.alias("start"), F.least(x["m"]["end"], F.coalesce(F.array_min(F.transform(
            F.filter(x["over"], lambda b: b["start"] >= s), lambda b: b["start"])), x["m"]["end"])).alias("end")))
        return F.transform(F.filter(pieces, lambda q: q["end"] - q["start"] >= SHORTEST), lambda q: F.struct(
            q["start"].alias("start"), q["end"].alias("end"), F.substring(
                x["m"]["found"], (q["start"] - x["m"]["start"] + 1).cast("int"), (q["end"] - q["start"]).cast("int")).alias("found")))
    return _let(F.struct(match.alias("m"), over(match).alias("over")), left)


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are kind:start:end in code points, end exclusive, by start and then
    by kind; ``base_sha256`` digests the spans of the three fixed patterns.
    Of a random string that a fixed span overlaps, the rest is tested. A null
    text is empty and has no spans; repeated rows and null ids are scanned as
    they are; an empty table gives no rows; other columns are not read.
    """
    text = text_or_empty()
    known = moments(character_counts(docs))
    value = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN_VALUE, 1)) >= 6
    rows = docs.select("doc_id", F.filter(matches(text, ASSIGN), value).alias("assign"), matches(text, ACCESS).alias("access"),
                       matches(text, HEX).alias("hex"), matches(text, CANDIDATE).alias("other"))
    tag = lambda name, k: F.transform(F.col(name), lambda m: F.struct(m["start"], F.lit(k).alias("kind"), m["end"]))
    base = F.array_sort(F.concat(tag("assign", 0), tag("access", 1), tag("hex", 2)))
    rows = rows.select("doc_id", base.alias("base"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), "other")
    # Quadratic in the spans of one text, which are few but for texts made of secrets.
    rows = rows.withColumn("other", F.flatten(F.transform("other", lambda m: parts(m, F.col("base")))))
    rows = rows.withColumn("other", F.transform("other", lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), facts(m["found"]).alias("facts"))))
    rows = stored(rows.withColumn("other", F.transform("other", lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), length_class(m["facts"]["n"]).alias("class"),
        (battery(m["facts"]) >= FLOOR).alias("even"),
        F.least(F.lit(LAST_LOG), F.floor(ordinary(m["facts"], known) * LOG_BINS)).cast("int").alias("bin")))), "secrets")
    limits = {r["class"]: r["cut"] for r in cuts(rows.select(F.explode("other").alias("o")).select("o.*"), fdr).collect()}
    passed = lambda m: m["even"] & (m["bin"] >= _cut(m["class"], limits))
    more = F.transform(F.filter("other", passed), lambda m: F.struct(m["start"], F.lit(3).alias("kind"), m["end"]))
    rows = rows.withColumn("more", more)
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS[:3]), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                       _listed(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_random"))


def _cut(kind: Column, limits: dict[int, int]) -> Column:
    out = F.lit(LAST_LOG + 1)
    for k, cut in limits.items():
        out = F.when(kind == k, cut).otherwise(out)
    return out


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
