"""Exact join of texts by the Jaccard similarity of their word shingles, and its components.

Texts of equal sets are one set. A set's shingles have one order for all sets: rare ones
first, then by hash; two sets at ``percent`` or more share one of their first n - ceil(percent n / 100) + 1
shingles. Tiles are keyed by such a shingle and a band of sizes, each band's upper end 100 / percent
of its lower one, so that a set meets its own band and the next. In a tile each set has a bitmap as wide as
its band asks for, where every shingle flips a bit: bits in which two bitmaps differ are shingles that
only one has, which bounds the overlap from above. Pairs within the bound are verified by intersecting the sorted
hashes of all shingles.

Only components are asked for, so pairs whose sets are in one class already need no test. In ``LEADERS`` rounds each set
is tested against the leader it meets in most tiles, one pair a set. What still meets in tiles of
several classes is compared in full: every two classes of a tile test their best pairs first, but of
one class no more than ``EACH`` times as many, so that a tile's pairs grow with its classes and not with their square; in
later rounds four times as many, until all pairs within the bound are tested or in one class.

Shingles in the first places of more than ``HOT`` sets are counted over all sets that have one, and stand last in the
order, so a passage that many texts share makes no tile of them unless it is most of each. A
tile above ``PART`` sets is dealt to several tasks, each with about that many held.

Defined results: a null text and one without words have no shingles and are their own component. A
text of fewer words than a shingle has one. A null id is never the smallest; a component of null ids has a null
one. Repeated rows each get a row. Texts are read whole, however long; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrock.llm.text import LOWER, LOWER_BYTES, UPPER, table
from tallyrock.operators.components import connected_components
from tallyrock.sources.shared import cut

SHINGLE, PERCENT = 5, 80
HOT, PART, LEADERS, MORE = 256, 1024, 2, 4
#: How many pairs of a class with others a tile may pass on for each that two classes may.
EACH = 4
#: An odd multiplier of rolling sums, its inverse modulo 2^64, and shingles that a task passes on at once.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
SENT = 1 << 20
#: Numbers of sets that are broadcast, 16 MB, and halves of hot hashes that tasks are given, 512 KB.
BROADCAST, GIVEN = 1 << 20, 1 << 17
#: Bits of the narrowest bitmap, the size up to which bitmaps are twice as wide, the widest, words of bitmaps that are compared at once, and sets of a tile that is compared together with others.
NARROW, SMALL, WIDE, AT_ONCE, FEW = 512, 300, 1 << 15, 1 << 19, 64


_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` or more powers of the multiplier and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        steps = np.repeat(np.array([[BASE], [INVERSE]], np.uint64), 1 << n.bit_length(), axis=1)
        steps[:, 0] = 1
        _powers = np.cumprod(steps, axis=1)
    return _powers


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted: mixed differences of rolling sums over the words' bytes."""
    line = b" ".join((text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split())
    if not line:
        return np.empty(0, np.uint64)
    data = np.frombuffer(line, np.uint8)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    blanks = np.nonzero(data == 32)[0]
    starts, ends = np.concatenate(([0], blanks + 1)), np.append(blanks, len(data))
    if len(starts) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    mixed = (sums[ends] - sums[starts]) * down[starts]
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(by)
    return np.unique(mixed)


def first_places(n: int, percent: int) -> int:
    """How many shingles of n stand in the first places."""
    return n - -(-percent * n // 100) + 1 if n else 0


def band_ends(percent: int, most: int = 1 << 40) -> list[int]:
    """Least sizes of the bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


def bitmap_width(least: int) -> int:
    """Bits of a band's bitmaps: more than its least size, twice as many for small sets, up to the widest."""
    return min(WIDE, max(NARROW, 1 << (least if least > SMALL else 2 * least).bit_length()))


def bitmap(hashes: np.ndarray, bits: int) -> bytes:
    """Bit b is one if an odd number of shingles fall on it."""
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def with_sets(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(_key, _id, high, low, n, first, own, lower) of (_key, _id, _text).

    The digest of a set, its size, the least hashes, as many as it has first places, and its bitmaps as
    wide as its band of sizes and the one below ask for.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        ends = band_ends(percent)
        for frame in frames:
            digests, sizes, firsts, own, lower = [], [], [], [], []
            for text in frame["_text"]:
                hashes = shingle_hashes(text, shingle)
                digests.append(np.frombuffer(xxh3_128_digest(hashes.tobytes()), ">i8"))
                sizes.append(len(hashes))
                firsts.append(hashes[: first_places(len(hashes), percent)].view(np.int64))
                band = max(0, bisect_right(ends, len(hashes)) - 1)
                own.append(bitmap(hashes, bitmap_width(ends[band])))
                lower.append(bitmap(hashes, bitmap_width(ends[max(0, band - 1)])))
            high, low = np.array(digests, dtype=np.int64).reshape(-1, 2).T
            yield frame[["_key", "_id"]].assign(high=high, low=low, n=sizes, first=firsts, own=own, lower=lower)

    return rows.mapInPandas(of, f"_key long, _id {dict(rows.dtypes)['_id']}, high long, low long, n long, first array<long>, own binary, lower binary")


def some_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``texts`` of ``nodes``, which are distinct and written; so few that each executor can hold them do not make texts move."""
    return texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST else nodes, "node", "left_semi")


def all_places(texts: DataFrame, shingle: int) -> DataFrame:
    """(shingle, node) of every shingle of (node, _text)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sent() -> pd.DataFrame:
            return pd.DataFrame({"shingle": np.concatenate(hashes).view(np.int64), "node": np.repeat(nodes, [len(h) for h in hashes])})

        for frame in frames:
            nodes, hashes, held = [], [], 0
            for node, text in zip(frame["node"], frame["_text"], strict=True):
                nodes.append(node)
                hashes.append(shingle_hashes(text, shingle))
                held += len(hashes[-1])
                if held > SENT:
                    yield sent()
                    nodes, hashes, held = [], [], 0
            if nodes:
                yield sent()

    return texts.mapInPandas(of, "shingle long, node long")


def all_halves(texts: DataFrame, shingle: int) -> DataFrame:
    """(half) of every shingle of (node, _text)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            halves, held = [], 0
            for text in frame["_text"]:
                halves.append(_halves(shingle_hashes(text, shingle)))
                held += len(halves[-1])
                if held > SENT:
                    yield pd.DataFrame({"half": np.concatenate(halves)})
                    halves, held = [], 0
            if halves:
                yield pd.DataFrame({"half": np.concatenate(halves)})

    return texts.select("_text").mapInPandas(of, "half int")


def _half(shingle: Column) -> Column:
    return (shingle.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int").alias("half")


def _halves(hashes: np.ndarray) -> np.ndarray:
    """The same numbers as ``_half`` gives."""
    return ((hashes & np.uint64((1 << 32) - 1)).astype(np.int64) - (1 << 31)).astype(np.int32)


def _given(halves: DataFrame) -> np.ndarray | None:
    """``halves`` as a sorted array, if they are few."""
    return np.sort(np.array([r["half"] for r in halves.collect()], np.int32)) if halves.count() <= GIVEN else None


def _among(values: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Whether each value is one of a sorted array's."""
    if not len(given):
        return np.zeros(len(values), bool)
    return given[np.minimum(np.searchsorted(given, values), len(given) - 1)] == values


def having_any(sets: DataFrame, halves: DataFrame) -> DataFrame:
    """(node) of the sets with one of ``halves`` in a first place."""
    given = _given(halves)
    if given is None:
        places = sets.select(F.explode("first").alias("shingle"), "node").withColumn("half", _half(F.col("shingle")))
        return places.join(halves, "half", "left_semi").select("node").distinct()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            firsts = [np.asarray(f, np.int64).view(np.uint64) for f in frame["first"]]
            hit = _among(_halves(np.concatenate([*firsts, np.empty(0, np.uint64)])), given)
            ends = np.cumsum([0, *map(len, firsts)])
            before = np.concatenate(([0], np.cumsum(hit)))
            yield frame.loc[before[ends[1:]] > before[ends[:-1]], ["node"]]

    return sets.select("node", "first").mapInPandas(of, "node long")


def _anew(whole: DataFrame, halves: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, first) of (node, _text): first places with the shingles of ``halves`` last."""
    given = _given(halves)
    if given is None:
        marks = all_places(whole, shingle).withColumn("half", _half(F.col("shingle"))).join(halves, "half", "left_semi")
        whole = whole.join(marks.groupBy("node").agg(F.collect_list("half").alias("last")), "node")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            firsts = []
            for text, last in zip(frame["_text"], [given] * len(frame) if given is not None else frame["last"], strict=True):
                hashes = shingle_hashes(text, shingle)
                late = _among(_halves(hashes), last if given is not None else np.sort(np.asarray(last, np.int32)))
                firsts.append(np.concatenate((hashes[~late], hashes[late]))[: first_places(len(hashes), percent)].view(np.int64))
            yield pd.DataFrame({"node": frame["node"], "first": firsts})

    return whole.mapInPandas(of, "node long, first array<long>")


def ordered_places(sets: DataFrame, texts: DataFrame, shingle: int, percent: int, hot: int) -> DataFrame:
    """(shingle, node): the first places of all sets, in an order that has hot shingles last. ``sets``: (node, n, first).

    Shingles are counted by half of their hash: which ones stand last is free, as long as it is the same for all sets.
    """
    counted = lambda halves: halves.groupBy("half").agg(F.count(F.lit(1)).cast("int").alias("sets")).where(F.col("sets") > hot).select("half")
    often = cut(counted(sets.select(F.explode("first").alias("shingle")).select(_half(F.col("shingle")))), "jaccard-often")
    ordered = sets.select("node", "first")
    if not often.isEmpty():
        # the texts of sets that have one are counted in full; sets with any such shingle in a first place are ordered anew
        asked = cut(having_any(sets, often), "jaccard-asked")
        last = cut(counted(all_halves(some_texts(texts, asked), shingle)).union(often).distinct(), "jaccard-last")
        moved = cut(having_any(sets, last), "jaccard-moved")
        ordered = ordered.join(moved, "node", "left_anti").union(cut(_anew(some_texts(texts, moved), last, shingle, percent), "jaccard-anew"))
    return ordered.select(F.explode("first").alias("shingle"), "node")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` whose sets are alike."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ours = None, None
        for frame in frames:
            good = []
            for a, left, right in zip(frame["a"], frame["_left"], frame["_text"], strict=True):
                if a != last:
                    last, ours = a, shingle_hashes(left, shingle)
                theirs = shingle_hashes(right, shingle)
                both = overlap(ours, theirs)
                good.append(100 * both >= percent * (len(ours) + len(theirs) - both))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-nodes")
    needed = some_texts(texts, nodes)
    left = needed.select(F.col("node").alias("a"), F.col("_text").alias("_left"))
    rows = pairs.join(left, "a").join(needed.withColumnRenamed("node", "b"), "b").select("a", "b", "_left", "_text")
    return cut(rows.mapInPandas(of, "a long, b long"), "jaccard-links")


def within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` whose bitmaps let them be alike."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int.from_bytes(x, "little")
        for frame in frames:
            good = []
            for n, own, lower, m, other, below in zip(*(frame[c] for c in ("n", "own", "lower", "_n", "_own", "_lower")), strict=True):
                # bitmaps of one width are those of one band or, for neighbours, of the lower one
                x, y = (own, other) if len(own) == len(other) else (lower, other) if len(lower) == len(other) else (own, below)
                bound = (n + m - (number(x) ^ number(y)).bit_count()) // 2 if len(x) == len(y) else min(n, m)
                good.append((100 + percent) * bound >= percent * (n + m))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    a = sets.select(F.col("node").alias("a"), "n", "own", "lower")
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("_n"), F.col("own").alias("_own"), F.col("lower").alias("_lower"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(of, "a long, b long")


def with_class(places: DataFrame, links: DataFrame | None) -> DataFrame:
    """(shingle, node, n, class) of the shingles whose sets are of several classes."""
    if links is None:
        rows = places.select("shingle", "node", "n", F.col("node").alias("class"))
    else:
        classes = cut(connected_components(links, "a", "b"), "jaccard-classes")
        rows = places.join(classes, "node", "left").select("shingle", "node", "n", F.coalesce("component", "node").alias("class"))
    several = rows.groupBy("shingle").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).where("_low < _high").select("shingle")
    return rows.join(several, "shingle", "left_semi")


def leader_pairs(places: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each set with the leader of another class that it meets at most shingles."""
    lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("_r"), F.col("node").alias("a"), F.col("n").alias("_n"), F.col("class").alias("_class")))
    met = places.join(places.groupBy("shingle").agg(lead.alias("_lead")), "shingle").select("node", "n", "class", "_lead.*").where("class <> _class")
    met = met.where(100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")).groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("_times"))
    best = met.groupBy("b").agg(F.max(F.struct("_times", F.xxhash64("a").alias("_r"), "a")).alias("_best"))
    return best.select("_best.a", "b")


def _may_be_alike(x: dict, i: np.ndarray, j: np.ndarray, bits_i: np.ndarray, bits_j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, bound) of the pairs of rows i and j whose overlap may be large enough."""
    apart = np.bitwise_count(bits_i ^ bits_j).sum(axis=-1, dtype=np.int64)
    both = x["n"][i] + x["n"][j]
    bound = (both - apart) // 2
    good = np.nonzero((100 + percent) * bound >= percent * both)[0]
    return good, bound[good]


def _columns(frame: pd.DataFrame) -> dict:
    return {c: frame[c].to_numpy() for c in ("node", "n", "class")} | {"member": frame["member"].to_numpy(bool), "bits": frame["bits"].to_numpy()}


class _Best:
    """The ``budget`` best pairs of each two classes of a tile that are among the ``EACH * budget`` best of either class, and the tiles that have more; what is added is reduced at once."""

    def __init__(self, budget: int) -> None:
        self.budget, self.held, self.more = budget, np.empty((6, 0), np.int64), np.empty(0, np.int64)

    def add(self, tile: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> None:
        if not len(a):
            return
        # tile, lesser and greater class, falling bound, pair
        rows = np.concatenate((self.held, np.stack((tile, np.minimum(x, y), np.maximum(x, y), -bound, np.minimum(a, b), np.maximum(a, b)))), axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        first = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
        at = np.arange(rows.shape[1])
        kept = at - np.maximum.accumulate(np.where(first, at, 0)) < self.budget
        self.more = np.union1d(self.more, rows[0, ~kept])
        rows = rows[:, kept]
        # of each class's pairs, by falling bound, the first ones
        many = rows.shape[1]
        tiles, kinds, bounds = np.tile(rows[0], 2), rows[1:3].ravel(), np.tile(rows[3], 2)
        order = np.lexsort((np.tile(np.arange(many), 2), bounds, kinds, tiles))
        first = np.concatenate(([True], (tiles[order[1:]] != tiles[order[:-1]]) | (kinds[order[1:]] != kinds[order[:-1]])))
        at = np.arange(2 * many)
        kept = np.zeros(many, bool)
        kept[order[at - np.maximum.accumulate(np.where(first, at, 0)) < EACH * self.budget] % many] = True
        self.more = np.union1d(self.more, rows[0, ~kept])
        self.held = rows[:, kept]

    def pairs(self) -> np.ndarray:
        return self.held[4:].T


def _small_tiles(frame: pd.DataFrame, tile: np.ndarray, percent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Of whole tiles of few rows: each row is compared with the one so many places behind it, for all tiles at once."""
    x, best = _columns(frame), _Best(budget)
    for band in np.unique(frame["band"].to_numpy()):
        rows = np.nonzero(frame["band"].to_numpy() == band)[0]
        bits = np.frombuffer(b"".join(x["bits"][rows]), "<u8").reshape(len(rows), -1)
        size = max(1, AT_ONCE // bits.shape[1])
        left = np.arange(len(rows))
        for apart in range(1, len(rows)):
            left = left[left + apart < len(rows)]
            left = left[tile[rows[left]] == tile[rows[left + apart]]]
            if not len(left):
                break
            i, j = rows[left], rows[left + apart]
            n, m = x["n"][i], x["n"][j]
            fit = np.nonzero(x["member"][i] & (x["class"][i] != x["class"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))[0]
            for at in range(0, len(fit), size):
                some = fit[at : at + size]
                good, bound = _may_be_alike(x, i[some], j[some], bits[left[some]], bits[left[some] + apart], percent)
                p, q = i[some][good], j[some][good]
                best.add(tile[p], x["node"][p], x["node"][q], x["class"][p], x["class"][q], bound)
    return best.pairs(), best.more


class _Tile:
    """Sets of a part of a tile that are held."""

    def __init__(self, held: pd.DataFrame) -> None:
        self.held = _columns(held)
        self.bits = np.frombuffer(b"".join(self.held["bits"]), "<u8").reshape(len(held), -1)

    def pairs(self, asking: pd.DataFrame, own: bool, percent: int, budget: int) -> tuple[np.ndarray, bool]:
        """The best pairs of held and asking sets, and whether there are more."""
        held, x, best = self.held, _columns(asking), _Best(budget)
        size = max(1, AT_ONCE // max(1, self.bits.size))
        for at in range(0, len(asking), size):
            n, kind, node = (x[c][at : at + size, None] for c in ("n", "class", "node"))
            fit = (kind != held["class"]) & (100 * np.minimum(n, held["n"]) >= percent * np.maximum(n, held["n"]))
            if own:
                fit &= node > held["node"]
            i, j = np.nonzero(fit)
            bits = np.frombuffer(b"".join(x["bits"][at : at + size]), "<u8").reshape(len(n), -1)
            both = {"n": np.concatenate((n[:, 0], held["n"]))}
            for k in range(0, len(i), max(1, AT_ONCE // bits.shape[1])):
                p, q = (v[k : k + max(1, AT_ONCE // bits.shape[1])] for v in (i, j))
                good, bound = _may_be_alike(both, p, q + len(n), bits[p], self.bits[q], percent)
                p, q = p[good] + at, q[good]
                best.add(np.zeros(len(p), np.int64), x["node"][p], held["node"][q], x["class"][p], held["class"][q], bound)
        return best.pairs(), len(best.more) > 0


def _pairs_of(frames: Iterator[pd.DataFrame], keys: list[str], percent: int, budget: int) -> Iterator[pd.DataFrame]:
    """Parts arrive as runs of rows, those to hold before those that ask; the last run of a frame may go on in the next.

    Whole runs of few rows are compared together; the others one by one.
    """
    key, rows, tile = None, [], None
    out: list = []

    def add(pairs: np.ndarray, more: bool, shingle: int) -> None:
        out.append(pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "shingle": None}))
        if more:
            out.append(pd.DataFrame({"a": [None], "b": [None], "shingle": [shingle]}))

    def held() -> None:
        nonlocal tile
        frame = pd.concat(rows)
        tile = _Tile(frame)
        add(*tile.pairs(frame, True, percent, budget), key[0])

    def ended() -> None:
        nonlocal key, rows, tile
        if rows and not tile:
            held()
        key, rows, tile = None, [], None

    for frame in frames:
        names = frame[keys].to_numpy(np.int64)
        starts = np.concatenate(([0], np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1, [len(frame)]))
        sizes = np.diff(starts)
        whole = sizes <= FEW
        whole[[0, -1]] = False  # may have begun before, or go on
        if whole.any():
            inside = np.repeat(whole, sizes)
            tiles = np.repeat(np.arange(len(sizes)), sizes)[inside]
            pairs, more = _small_tiles(frame[inside], tiles, percent, budget)
            add(pairs, False, 0)
            for t in more:
                add(pairs[:0], True, names[starts[t], 0])
        for t in np.nonzero(~whole)[0]:
            run = frame.iloc[starts[t] : starts[t + 1]]
            if key is None or tuple(names[starts[t]]) != key:
                ended()
                key = tuple(names[starts[t]])
            member = run["member"].to_numpy(bool)
            if member.any():
                rows.append(run[member])
            if not member.all() and rows:
                if not tile:
                    held()
                add(*tile.pairs(run[~member], False, percent, budget), key[0])
        if out:
            yield pd.concat(out).astype({"a": "Int64", "b": "Int64", "shingle": "Int64"})
        out.clear()
    ended()
    if out:
        yield pd.concat(out).astype({"a": "Int64", "b": "Int64", "shingle": "Int64"})


def tile_pairs(places: DataFrame, signatures: DataFrame, percent: int, part: int, budget: int) -> DataFrame:
    """(a, b, shingle): pairs of tiles whose bitmaps let them be alike, up to ``budget`` of two classes and ``EACH * budget`` of one in a part; the shingles of tiles that have more."""
    band = F.size(F.filter(F.array(*[F.lit(e) for e in band_ends(percent)]), lambda e: e <= F.col("n"))) - 1
    homes = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band - 1).alias("band"), F.lit(False).alias("home")))
    rows = places.select("shingle", "node", "n", "class", F.explode(homes).alias("_t")).select("shingle", "node", "n", "class", "_t.*")
    sizes = rows.groupBy("shingle", "band").agg(F.ceil(F.count_if("home") / part).cast("int").alias("parts"), F.min("class").alias("_low"), F.max("class").alias("_high"))
    rows = rows.join(sizes.where("parts > 0 AND _low < _high").drop("_low", "_high"), ["shingle", "band"])
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(F.col("parts") - 1)
    rows = rows.join(signatures, "node").select("shingle", "band", "node", "n", "class", "home", F.when(F.col("home"), F.col("own")).otherwise(F.col("lower")).alias("bits"), mine.alias("mine"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("mine"))))
    keys = ["shingle", "band", "part"]
    rows = rows.select(*keys, (F.col("home") & (F.col("part") == F.col("mine"))).alias("member"), "node", "n", "class", "bits")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("member"), "node")
    return dealt.mapInPandas(lambda frames: _pairs_of(frames, keys, percent, budget), "a long, b long, shingle long").distinct()


def links_of(places: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, part: int = PART, leaders: int = LEADERS) -> DataFrame:
    """(a, b): links between sets that connect each component. ``places``: (shingle, node); ``sets``: (node, n, own, lower)."""
    together = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    places = places.withColumn("_sets", together).where("_sets > 1").drop("_sets")
    places = cut(places.join(sets.select("node", "n"), "node"), "jaccard-places")
    links, left = None, places.withColumn("class", F.col("node"))
    for turn in range(leaders):
        near = verified(cut(within_bound(leader_pairs(left, turn, percent), sets, percent), "jaccard-pairs"), texts, shingle, percent)
        links = near if links is None else links.union(near)
        left = cut(with_class(places, links), "jaccard-left")
        if left.isEmpty():
            return links
    signatures = sets.select("node", "own", "lower")
    tested, budget = None, 1
    while True:
        found = cut(tile_pairs(left, signatures, percent, part, budget), "jaccard-pairs")
        pairs = found.where("a is not null").select("a", "b").distinct()
        near = verified(cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-untested"), texts, shingle, percent)
        tested = pairs if tested is None else tested.union(pairs).distinct()
        links = near if links is None else links.union(near)
        more = found.where("shingle is not null").select("shingle").distinct()
        if more.isEmpty():
            return links
        left, budget = cut(with_class(left.join(more, "shingle", "left_semi").select("shingle", "node", "n"), links), "jaccard-left"), budget * MORE


def components_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT, part: int = PART, leaders: int = LEADERS) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row."""
    keyed = cut(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_key")), "jaccard-texts")
    rows = cut(with_sets(keyed.select("_key", "_id", "_text"), shingle, percent), "jaccard-sets")
    sets = cut(rows.where("n > 0").groupBy("high", "low").agg(F.min("_key").alias("node"), F.min("_id").alias("least")), "jaccard-distinct")
    texts = keyed.select(F.col("_key").alias("node"), "_text")
    once = rows.join(sets.select(F.col("node").alias("_key")), "_key", "left_semi").select(F.col("_key").alias("node"), "n", "first", "own", "lower")
    links = links_of(ordered_places(once, texts, shingle, percent, hot), once.drop("first"), texts, shingle, percent, part, leaders)
    classes = connected_components(links, "a", "b")
    classed = sets.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = classed.groupBy("class").agg(F.min("least").alias("_least"))
    named = classed.join(least, "class").select("high", "low", "_least")
    own = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("_least"))
    return rows.join(named, ["high", "low"], "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))


ORACLES = {
    "op12_jaccard_tiles": f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT uid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(list_zip({", ".join(f"w[{k + 1} : len(w) - {SHINGLE - 1 - k}]" for k in range(SHINGLE))}), lambda x: concat_ws(' ', {", ".join(f"x[{k + 1}]" for k in range(SHINGLE))})))) END AS s FROM split),
kinds AS (SELECT min(uid) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT node, n, unnest(s) AS g FROM kinds),
both_have AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM both_have WHERE 100 * c >= {PERCENT} * (na + nb - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM kinds UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
rows_of AS (SELECT k.node, t.doc_id FROM kinds k JOIN sets t ON t.s = k.s),
least AS (SELECT r.a AS node, min(d.doc_id) AS component_id FROM reach r JOIN rows_of d ON d.node = r.b GROUP BY r.a)
SELECT t.doc_id, len(t.s) AS n_shingles, CASE WHEN len(t.s) = 0 THEN t.doc_id ELSE l.component_id END AS component_id
FROM sets t LEFT JOIN kinds k ON k.s = t.s LEFT JOIN least l ON l.node = k.node
"""
}
