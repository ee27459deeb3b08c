"""The Jaccard join against brute force."""

import random

import numpy as np

from tallyrock.llm import jaccard

SCHEMA = "doc_id long, text string, n_shingles string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, _), s, g in zip(rows, sets, group, strict=True):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard.components_of(docs, **options).collect()), key=repr)


def texts(seed, bases=20):
    """Texts, copies with a few edited words, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(100_000)}"
    passage, out = [word() for _ in range(25)], ["one two three", "One two  THREE", "a b c d e", "a b c d e f", "a b c d", "", None, " \n", "same " * 40, "same " * 9]
    for k in range(bases):
        base = [word() for _ in range(r.randrange(20, 120))]
        if k % 2:
            base[5:5] = passage
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randrange(4)):
                copy[at] = word()
            out.append(" ".join(copy))
    out += [" ".join(passage + [word() for _ in range(3)]) for _ in range(9)]
    return list(zip(r.sample(range(10_000), len(out)), out, strict=True))


def test_edited_copies_and_odd_rows(spark):
    rows = texts(1) + [(None, "no id at all but seven words"), (None, "no id at all but seven words"), (None, None), (7, "Same row twice"), (7, "Same row twice")]
    assert found(spark, rows) == brute(rows)


def test_hot_shingles_parts_and_no_leaders(spark, monkeypatch):
    rows = texts(2)
    want = brute(rows)
    assert found(spark, rows, hot=4) == want
    monkeypatch.setattr(jaccard, "GIVEN", 0)
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    assert found(spark, rows, hot=4, part=3, leaders=0) == want


def test_a_large_group_and_a_long_text(spark):
    r = random.Random(5)
    base, far = [f"b{k}" for k in range(70)], [f"f{k}" for k in range(60_000)]
    rows = []
    for k in range(150):
        copy = list(base)
        copy[r.randrange(70)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(900, " ".join(far)), (901, " ".join([*far[:59_000], "end"])), (902, " ".join(far[:40_000]))]
    assert found(spark, rows, hot=30, part=20) == brute(rows)
    assert found(spark, []) == []


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(3)
    for n, m, both, bits in ((40, 44, 30, 128), (500, 450, 440, 1024), (3000, 2500, 100, 64)):
        values = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = np.sort(values[:n]), np.sort(values[n - both :])
        x, y = (np.frombuffer(jaccard.bitmap(v, bits), np.uint8) for v in (a, b))
        assert jaccard.overlap(a, b) == both <= (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def test_bands_hold_all_sizes_that_can_link():
    ends = jaccard.band_ends(80, 10_000)
    band = lambda n: max(k for k, e in enumerate(ends) if e <= n)
    for n in range(1, 2000):
        assert band(n * 100 // 80) <= band(n) + 1


def test_pairs_of_a_tile_grow_with_its_classes():
    n = 400
    at = np.triu_indices(n, 1)
    best = jaccard._Best(1)
    for half in np.array_split(np.arange(len(at[0])), 7):
        a, b = at[0][half], at[1][half]
        best.add(np.zeros(len(a), np.int64), a, b, a, b, 1000 - (b - a))
    pairs = {tuple(p) for p in best.pairs()}
    assert len(pairs) <= jaccard.EACH * n and list(best.more) == [0]
    assert all((k, k + 1) in pairs for k in range(n - 1))
    few = jaccard._Best(1)
    few.add(np.zeros(6, np.int64), *(np.array(x) for x in ([0, 0, 0, 1, 1, 2], [1, 2, 3, 2, 3, 3]) * 2), np.arange(6))
    assert len(few.pairs()) == 6 and not len(few.more)
