"""URL filter against plain sums over character contexts, and its rules."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from surveyspark.llm import url_sql, urls

ROWS = [
    (1, "https://Blog.Example.NET/en/x?q=/de/"), (2, "https://example.net/en"), (3, "http://net/"), (4, "http://a.net"),
    (5, "http://x.example.com/de/1#t"), (6, "http://x.example.com/DE/1"), (7, "http://notexample.com/de/"), (8, "http://a.org/fr/"),
    (9, "a.org/fr/"), (10, None), (11, ""), (12, "://"), (13, "x://y.org/fr/é😀/" + "z" * 3000), (None, "http://a.org/fr/"), (8, "http://a.org/fr/"),
    (14, "http://Ünï.org/FR/"), (15, "http://b.org?/fr/"), (16, "ftp://example.net/en/://x.org/fr/")]


def corpus():
    rng = random.Random(3)
    out = list(ROWS)
    for i in range(300):
        host = rng.choice(["shop", "news", "m", "blog", "cheap", "x%d" % rng.randrange(30)]) + rng.choice([".example.net", ".example.com", ".example.org"])
        out.append((100 + i, f"http://{host}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(40)}{rng.choice(['', '?a=b', '#top'])}"))
    return out


def clashing(df):
    from pyspark.sql import functions as F
    return df.withColumns({n: F.lit("x") for n in ("text", "host", "id", "label", "score", "bin", "gram", "html")})


def found(spark, rows, **options):
    return sorted((tuple(r) for r in urls.judge(clashing(spark.createDataFrame(rows, "page_id bigint, url string")), **options).collect()), key=repr)


def expected(rows, order=urls.ORDER):
    """Scores by recursion over contexts."""
    upper, lower = urls.UPPER, urls.LOWER
    pages, labels = [], {}
    for page, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = rest[:end].translate(str.maketrans(upper, lower))
        path = rest[end:]
        path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
        text = host + rest[end:] if url and "://" in url else url or ""
        fits = [r for r in urls.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        held = rule is not None and md5(host.encode()).hexdigest()[0] in urls.HELD
        labels[text, rule and rule.allow] = held
        pages.append((page, host, path, rule, text))
    counts = {True: Counter(), False: Counter()}
    for (text, label), held in labels.items():
        if label is not None and not held:
            padded = urls.START * order + text + urls.END
            for i in range(order, len(padded)):
                counts[label].update(padded[i - k: i + 1] for k in range(order + 1))
    behind = {label: defaultdict(dict) for label in counts}
    for label, grams in counts.items():
        for gram, n in grams.items():
            behind[label][gram[:-1]][gram[-1]] = n

    def probability(label, context, char):
        low = probability(label, context[1:], char) if context else urls.FLAT
        seen = behind[label].get(context)
        return (seen.get(char, 0) + len(seen) * low) / (sum(seen.values()) + len(seen)) if seen else low

    def score(text):
        padded, total = urls.START * order + text + urls.END, 0
        for i in range(order, len(padded)):
            a, b = (probability(label, padded[i - order: i], padded[i]) for label in (True, False))
            total += math.floor((math.log(a) - math.log(b)) * 1e6 + 0.5)
        n = len(text) + 1
        return max(-2000, min(2000, math.floor(total * 200.0 / (n * 1e6)))), total / (n * 1e6)

    held = [(score(text)[0], label) for (text, label), out in labels.items() if label is not None and out]
    cut = 0
    if {label for _, label in held} == {True, False}:
        share = lambda want, test: sum(label == want and test(b) for b, label in held) / sum(label == want for _, label in held)
        cut = min({b for b, _ in held}, key=lambda c: (round(share(True, lambda b: b < c) + share(False, lambda b: b >= c), 9), abs(c), c))
    out = []
    for page, host, path, rule, text in pages:
        b, s = score(text) if rule is None else (None, None)
        out.append((page, host, path, rule and rule.text, "allow" if (rule.allow if rule else b >= cut) else "block", s))
    return sorted(out, key=repr)


def test_equals_plain_models(spark):
    got, want = found(spark, corpus()), expected(corpus())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == w[5] or abs(g[5] - w[5]) < 2e-6 for g, w in zip(got, want))


def test_rules(spark):
    got = {r[0]: r for r in found(spark, ROWS)}
    rules = {k: (r[1], r[2], r[3]) for k, r in got.items()}
    assert rules[1] == ("blog.example.net", "/en/x", "example.net/en/") and got[1][4] == "allow"
    assert rules[2] == ("example.net", "/en", "net/") and got[2][4] == "block"
    assert rules[3][2] == "net/" and rules[4] == ("a.net", "", None)
    assert rules[5][2] == "example.com/de/" and rules[6][2] is None and rules[7] == ("notexample.com", "/de/", None)
    assert rules[8][2] == "org/fr/" and rules[9] == rules[10] == rules[11] == rules[12] == ("", "", None)
    assert rules[13][2] == "org/fr/" and rules[14] == ("Ünï.org".replace("Ü", "Ü"), "/FR/", None) and rules[15][2] is None
    assert rules[16] == ("example.net", "/en/://x.org/fr/", "example.net/en/")


def test_equal_urls_get_equal_rows_and_empty_tables_none(spark):
    got = found(spark, corpus() + [(9000 + i, "http://q.example.org/en/1") for i in range(50)])
    assert len({r[1:] for r in got if r[0] is not None and r[0] >= 9000}) == 1
    assert found(spark, []) == [] and len(found(spark, [(1, "http://q.org/a")])) == 1


@pytest.mark.parametrize("rows", [ROWS, corpus()])
def test_equals_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert found(spark, rows) == sorted(con.execute(url_sql.twin()).fetchall(), key=repr)
