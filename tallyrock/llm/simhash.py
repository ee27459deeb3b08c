"""SimHash near-duplicates: BK-trees over sharded fingerprints, then connected components.

The fingerprint of a text has 64 bits; bit b is 1 if more than half of the XXH64 hashes of
its word shingles have it. Two fingerprints link at ``radius`` or fewer differing bits.
Shards: the bits are dealt into ``blocks`` blocks; fingerprints that differ in at most
``radius`` bits agree on at least blocks - radius of them, so every link lies inside a shard
that is keyed by some choice of blocks - radius blocks and their bits. Each shard builds a
BK-tree (children keyed by their distance to the parent) and searches it along the edges
within the radius of the distance. A shard above ``tree_size`` fingerprints gets several
trees of about that size, and each fingerprint of the shard asks all of them.

Trees are dealt to the tasks by a shuffle of distinct fingerprints: to broadcast them, the
fingerprints of all documents would have to meet on the driver. Copies count as one
fingerprint, so a large group of copies makes no large shard. A tree reports links as
(fingerprint, fingerprint) only until its members are connected.

Defined results: a null or empty text has fingerprint zero and links like any other.
Repeated rows each get a row. A null id gets a row; it is never the smallest id. A component
that has only null ids has a null component_id. Empty tables give empty results. Texts are
read whole, however long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.text import LOWER_BYTES, table
from tallyrock.operators.components import connected_components
from tallyrock.sources.shared import cut

SHINGLE, SEED, RADIUS, BLOCKS, TREE_SIZE = 3, 42, 2, 4, 1024
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text, as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.array(hashes[k : k + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return of(text)


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The shards of a fingerprint: for each choice of blocks the choice and the bits in them."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


class BKTree:
    """Fingerprints as nodes; a child hangs on the edge that is its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the fingerprints at most ``radius`` away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                todo += [child for edge, child in edges.items() if -radius <= edge - d <= radius]
            else:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]


def tree_links(members: list[int], asking: list[int], radius: int) -> list[tuple[int, int]]:
    """Links from ``asking`` into a tree of ``members`` that connect what all its links connect."""
    tree = BKTree()
    for m in members:
        tree.add(m)
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := group.setdefault(x, x)) != x:
            group[x] = x = group.setdefault(up, up)
        return x

    found = []
    for value in asking:
        for at in tree.within(value, radius):
            a, b = root(value), root(tree.values[at])
            if a != b:
                group[a] = b
                found.append((value, tree.values[at]))
    return found


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, enough to connect each class."""
    if not 0 <= radius < blocks:
        raise ValueError("blocks must be more than radius")
    keys = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("shard")).select("fp", "shard.*")
    sizes = keys.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_size).cast("int")
    keys = keys.join(sizes, ["choice", "bits"]).withColumn("trees", trees)
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    asked = keys.withColumn("own", own).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    asked = asked.select("choice", "bits", "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
    dealt = asked.repartition("choice", "bits", "tree").sortWithinPartitions("choice", "bits", "tree", "fp")
    return dealt.mapInPandas(lambda frames: _links_of(frames, radius), "a long, b long")


def _links_of(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Trees arrive as runs of rows; a run may go on in the next frame."""
    key, members, asking = None, [], []
    for frame in frames:
        out = []
        for *k, fp, member in frame[["choice", "bits", "tree", "fp", "member"]].itertuples(index=False, name=None):
            if k != key:
                if len(asking) > 1:
                    out += tree_links(members, asking, radius)
                key, members, asking = k, [], []
            asking.append(fp & 0xFFFFFFFFFFFFFFFF)
            if member:
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
        yield _signed(out)
    if len(asking) > 1:
        yield _signed(tree_links(members, asking, radius))


def _signed(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id whose fingerprint can be reached."""
    rows = cut(docs.select(F.col(id_col), fingerprints(F.col(text)).alias("fp")), "simhash-fp")
    distinct = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    near = cut(links(distinct, radius, blocks, tree_size).distinct(), "simhash-links")
    classes = connected_components(near, "a", "b")
    named = distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = named.join(least, "class").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
