"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from tallyrock.llm import spelling

SCHEMA = "doc_id long, text string, word string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5):
    counts = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    formed = {}
    for w, n in words.items():
        by = sorted((-words[x], x) for x in words if near(w, x))
        formed[w] = (len(by), by[0][1] if by and -by[0][0] >= 5 * n else None)
    out = []
    for w, (k, form) in formed.items():
        root = w
        while formed[root][1]:
            root = formed[root][1]
        out.append((w, form, root, words[w], k, words[form] if form else None))
    return sorted(out, key=repr)


def texts(seed, letters="abcé÷ñ", n=900):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 13))) for _ in range(12)]
    words = []
    for _ in range(n):
        w = r.choice(base)
        for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
            k = r.randrange(len(w) + 1)
            w = r.choice((w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :]))
        words += [w] * r.choice((1, 1, 2, 5, 40))
    r.shuffle(words)
    return [(k, " ".join(words[k::60]).replace("a", r.choice("aA"))) for k in range(60)]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in spelling.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_index_finds_all_near_words():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abz") for _ in range(r.choice((6, 7)))) for _ in range(700)})
    index, asking = spelling.BidirectionalIndex(words), [w for w in words if len(w) == 6] + ["qqqqqq", "abqzab"]
    got = set()
    for right in (True, False):
        asked, hit = index.within_one(index.patterns(asking), 3, right)
        got |= {(asking[a], words[b]) for a, b in zip(asked, hit, strict=True)}
    assert got == {(a, b) for a in asking for b in words if near(a, b)}


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = texts(seed) + [(None, "elevenseven " * 6), (None, None), (900, ""), (7, "same words again " * 3)] + [(7, "same words again " * 3)] * 2
        assert found(spark, rows) == brute(rows)


def test_shards_in_parts_and_long_runs(spark):
    rows = texts(5) + [(1000 + k, "x" * 3000 + " " + "x" * 2999 + " y") for k in range(6)]
    assert found(spark, rows, letters=200) == brute(rows)
    assert found(spark, []) == []
