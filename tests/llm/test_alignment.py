"""Token alignment against a search over byte ranges, with the tokenizers applied to whole texts."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from surveyspark.llm import alignment

FOLDER = Path(alignment.DEFAULT_DIR)
needs_files = pytest.mark.skipif(not (FOLDER / alignment.FIRST).exists(), reason="needs the tokenizer files")


def offsets(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def expected(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    one, two = Tokenizer.from_file(str(FOLDER / alignment.FIRST)), SentencePieceProcessor(model_file=str(FOLDER / alignment.SECOND))
    one.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    docs = []
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                   for p in map(two.id_to_piece, b)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, [], [], "", []))
            continue
        at_a, at_b = offsets(bytes_a), offsets(bytes_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = [[",".join(str(i) for i, (s, e) in zip(ids, at) if lo <= s < hi) for ids, at in ((a, at_a), (b, at_b))]
                  for lo, hi in zip([0, *cuts], cuts)]
        links, first = [], 0
        for i, (s, e) in zip(a, at_a):
            while at_b[first][1] <= s:
                first += 1
            k = first
            while k < len(b) and at_b[k][0] < e:
                links.append((i, b[k]))
                k += 1
        docs.append((doc_id, a, b, ";".join(map("|".join, groups)), links))
    counts = Counter(p for d in docs for p in set(d[4]))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return sorted(((d, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                   for d, a, b, groups, links in docs), key=repr)


def found(spark, rows):
    from pyspark.sql import functions as F
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit("x") for n in ("chunk", "kind", "place", "total", "pair", "n_a")})
    return sorted((tuple(r) for r in alignment.align_corpus(table).collect()), key=repr)


def corpus():
    rng = random.Random(4)
    words = ["the", "Überraschung", "naïve", "don't", "x1y22", "<|endoftext|>", "<s>", "<0x0A>", "😀", "日本語", "a", "über-alles", "E=mc²", "....", "ﬁ"]
    gaps = [" ", " ", " ", "  ", "\n", "\t", " \n ", "　", " ", "​", "  ", "\r\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "▁"), (105, "x ▁ y"), (106, " lead"), (107, "trail "), (108, "\u0000\u0001")]
    return rows + [(1, rows[1][1]), (None, rows[2][1]), (109, "word " * 3000), (110, "ab" * 5000), (111, "᠎ x ﻿ y")]


@needs_files
def test_equals_byte_ranges(spark):
    assert found(spark, corpus()) == expected(corpus())


@needs_files
def test_chunks_share_their_counts(spark, monkeypatch):
    """Many partitions, so that every count adds up over chunks."""
    rows = corpus()
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13)
    assert sorted((tuple(r) for r in alignment.align_corpus(table).collect()), key=repr) == expected(rows)


@needs_files
def test_no_rows(spark):
    assert found(spark, []) == []


def test_runs_and_knots():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randrange(size)), size}) for _ in range(2))
        stretches, links_a, links_b = alignment.align(a, b)
        got, links = [], set(zip(links_a, links_b))
        runs = alignment.straight(np.array(a), np.array(b), stretches).tolist()
        for (i, p, j, q), run in zip(stretches.tolist(), runs):
            if run:
                got += [((k,), (k + j - i,)) for k in range(i, p)]
                links |= {(k, k + j - i) for k in range(i, p)}
            else:
                got.append((tuple(range(i, p)), tuple(range(j, q))))
        cuts = sorted(set(a) & set(b))
        assert got == [tuple(tuple(k for k, e in enumerate(x) if lo < e <= hi) for x in (a, b)) for lo, hi in zip([0, *cuts], cuts)]
        begin = lambda x, k: x[k - 1] if k else 0
        assert links == {(k, m) for k in range(len(a)) for m in range(len(b)) if begin(a, k) < b[m] and begin(b, m) < a[k]}


def test_packing():
    for numbers in ([], [0, 3], [255, 256], [70_000, 1]):
        assert alignment.unpacked(alignment.packed(np.array(numbers, np.int64))).tolist() == numbers


@needs_files
def test_plain_words_by_rank():
    """Ranks give the ids that the vocabulary file's own library gives."""
    rng = random.Random(13)
    coder = alignment.byte_coder(str(FOLDER / alignment.FIRST))
    signs = [chr(c) for c in (*range(33, 127), *range(161, 592))]
    words = ["".join(rng.choice(signs if rng.random() < 0.3 else "etaoin shrdlu".replace(" ", "")) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    words += ["don't", "<|endoftext|>", "x<|endoftext|>y", "we'll've", "1'st", "...", "ªº²³", "it's"]
    assert all(map(alignment.PLAIN.fullmatch, words))
    assert [coder.plain(w) for w in words] == coder.encode(words)
    assert coder.plain(" ".join(words)) == coder.encode([" ".join(words)])[0]
