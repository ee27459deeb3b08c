"""The manifest against a plain tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tallyrock.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        start = at - at % 16
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 16])))
        at //= 16
    return out


def brute(rows):
    leaf = lambda r: leaf_of(r, r[1])
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels_of([leaf(r) for r in groups[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            path = siblings(trees[s], at) + siblings(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[1] if r[1] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            now = leaf_of(r, text)
            for left, right in path:
                now = h(left, now, right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*[x for p in path for x in p]), now, now == root))
    return sorted(out, key=repr)


def rows_of(sizes):
    rows = []
    for s, n in sizes.items():
        for k in range(n):
            doc = len(rows) * 7 % 9973
            rows.append((doc, f"Text Ünd {k % 11}" if k % 13 else None, None if k % 5 == 0 else "en", s, k if k % 3 else None, "own"))
    return rows


def found(spark, rows, tmp_path, parts):
    where = str(tmp_path / f"m{len(rows)}-{parts}")
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{where}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, where).collect()), key=repr)


def test_groups_of_many_sizes(spark, tmp_path):
    rows = rows_of({None: 3, "": 1, "b": 16, "a": 17, "ä": 256, "c": 257, "hot": 900} | {f"s{k}": 1 for k in range(300)})
    rows += [(None, "no id", "en", "a", 1, "own"), (None, None, None, "a", None, "own"), *[(5, "Same Row", "en", "c", 8, "own")] * 40]
    assert found(spark, rows, tmp_path, 5) == brute(rows)


def test_any_partitions_and_empty(spark, tmp_path):
    rows = rows_of({"a": 40, "b": 5}) + [(1, "Long " * 200_000, "en", "a", 1_000_000, "own")]
    assert found(spark, rows, tmp_path, 1) == found(spark, rows, tmp_path, 7) == brute(rows)
    assert found(spark, [], tmp_path, 1) == []


def test_order_in_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 1000).alias("v"), "id").repartition(9)
    got = merkle.ranked(rows, "g", [F.col("v"), F.col("id")]).collect()
    want = {}
    for g in range(3):
        for pos, (_, i) in enumerate(sorted((i * 37 % 1000, i) for i in range(g, 5000, 3))):
            want[i] = pos
    assert {r["id"]: r["pos"] for r in got} == want
    assert all(r["n"] == len(range(r["g"], 5000, 3)) for r in got)
