"""Spelling variants: words that differ by one code point, found by a bidirectional FM-index.

Words near each other agree in their first or their last half, so the vocabulary is dealt to shards
by (side, length of the shorter word, half). A shard is indexed as one cyclic text of words between
delimiters: the ranks of its rotations that start with a string are an interval, and it is kept for
the text and for its reverse, so that a string can be extended to either side. A word
of the shorter length is searched by a scheme of its side: its first half with the delimiter
before it is matched exactly, then its other half to the right with one error allowed, or its last half,
then to the left. Intervals that reach the other delimiter are words. All words
that ask a shard go through each step together. A shard of too many letters is dealt to several indexes, and
each of its words asks them all.

Defined results: a null or empty text has no words; a null id is the empty string in the key of the
deletion. Repeated rows count as often as they stand. Of several most frequent near words the first in
code-point order is the form. A word without near words has no form and is its own root. Texts are read whole,
however long, and runs of letters too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.merkle import CRC_SQL
from tallyrock.llm.text import LOWER, LOWER_BYTES, UPPER, table
from tallyrock.sources.shared import cut

#: Code points and occurrences of a word, how many times more frequent a form is, and which runs lose a code point.
LEAST_CHARS, LEAST_COUNT, TIMES, EVERY = 6, 5, 5, 199
#: Distinct runs that a task counts before it passes them on, and letters of an index.
HELD, LETTERS = 1 << 17, 1 << 15


def counted_words(docs: DataFrame, id_col: str, text: str, least: int = LEAST_CHARS, every: int = EVERY) -> DataFrame:
    """(word, n): occurrences of the runs of at least ``least`` letters, after deletions."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, counts = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}"), Counter()
        for frame in frames:
            for key, line in zip(frame["_id"], frame["_text"], strict=True):
                low = (line or "").encode("utf-8", "replace").translate(LOWER_BYTES).decode()
                for run, n in Counter(letters.findall(low)).items():
                    h = zlib.crc32(f"{key or ''}:{run}".encode())
                    if h % every == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    counts[run] += n
                if len(counts) > HELD:
                    yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": list(counts.values())})

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(codes: np.ndarray) -> np.ndarray:
    """Starts of the cyclic rotations of a text in their order."""
    n, rank, step = len(codes), codes.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        ranks = np.concatenate(([0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        if ranks[-1] == n - 1 or step >= n:
            return order
        step *= 2


class BidirectionalIndex:
    """Words between delimiters. A state is (lo, lo_r, size): intervals of equal size in the text's rotations and its reverse's."""

    def __init__(self, words: list[str]) -> None:
        text = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(text, return_inverse=True)
        self.starts = rotations(codes)
        self.word_at = np.cumsum(codes == 0) - 1
        backward = codes[::-1]
        self.left, self.right = self._ranks(codes[self.starts - 1]), self._ranks(backward[rotations(backward) - 1])
        self.before = self.left[-1].astype(np.int64)
        self.size = len(codes)

    def _ranks(self, last: np.ndarray) -> np.ndarray:
        """Row i, column c: how many of the first i characters are less than c."""
        out = np.zeros((len(last) + 1, len(self.alphabet) + 1), np.int32)
        out[np.arange(1, len(last) + 1), last + 1] = 1
        np.cumsum(out, axis=0, out=out)
        return np.cumsum(out, axis=1, out=out)

    def _rows(self, state: tuple, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ranks = self.right if right else self.left
        own, other = (state[1], state[0]) if right else state[:2]
        low = ranks[own]
        return low, ranks[own + state[2]] - low, own, other

    def extend(self, state: tuple, codes: np.ndarray, right: bool) -> tuple:
        """Each state longer by its own character."""
        low, inside, _, other = self._rows(state, right)
        at = np.arange(len(codes))
        own = self.before[codes] + low[at, codes + 1] - low[at, codes]
        other = other + inside[at, codes]
        size = (inside[at, codes + 1] - inside[at, codes]).astype(np.int64)
        return (other, own, size) if right else (own, other, size)

    def spread(self, state: tuple, right: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(which state, character, longer state) for every letter that follows a state."""
        low, inside, _, other = self._rows(state, right)
        sizes = np.diff(inside, axis=1)
        sizes[:, 0] = 0
        which, code = np.nonzero(sizes)
        own = self.before[code] + low[which, code + 1] - low[which, code]
        other = other[which] + inside[which, code]
        size = sizes[which, code].astype(np.int64)
        return which, code, (other, own, size) if right else (own, other, size)

    def within_one(self, patterns: np.ndarray, half: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``patterns``, word) that differ by one error outside the exact half.

        ``patterns`` has a row of characters for each word, delimiters at both ends. With ``right``
        the first ``half`` letters are exact and the search goes on to the right, else the last ones
        and to the left. Characters that the index lacks are negative.
        """
        n, width = patterns.shape
        # the exact half runs from its inner end to the delimiter, so that its intervals can go on inwards
        exact = list(range(half, -1, -1)) if right else list(range(width - 1 - half, width))
        rest = list(range(half + 1, width)) if right else list(range(width - 2 - half, -1, -1))
        query = np.arange(n)
        state = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64))

        def step(query: np.ndarray, state: tuple, at: int, to_right: bool) -> tuple[np.ndarray, tuple]:
            codes = patterns[query, at]
            state = self.extend(state, np.maximum(codes, 0), to_right)
            alive = (state[2] > 0) & (codes >= 0)
            return query[alive], tuple(x[alive] for x in state)

        for at in exact:
            query, state = step(query, state, at, not right)
        wrong, wrong_state = query[:0], tuple(x[:0] for x in state)
        for at in rest:
            which, code, longer = self.spread(state, right)
            into = query[which]
            inserted = (np.concatenate((wrong, into)), tuple(map(np.concatenate, zip(wrong_state, longer, strict=True))))
            wrong, wrong_state = step(*inserted, at, right)
            if at != rest[-1]:
                other = code != patterns[into, at]
                wrong = np.concatenate((wrong, into[other], query))
                wrong_state = tuple(np.concatenate((x, y[other], z)) for x, y, z in zip(wrong_state, longer, state, strict=True))
            query, state = step(query, state, at, right)
        # a whole word stands once; where a match ends in several ways it is one word all the same
        return wrong, self.word_at[self.starts[wrong_state[0]]]

    def patterns(self, words: list[str]) -> np.ndarray:
        """Rows of characters of words of one length."""
        text = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        codes = np.searchsorted(self.alphabet, text)
        found = self.alphabet[np.minimum(codes, len(self.alphabet) - 1)] == text
        return np.where(found, codes, -1)


def _near_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Indexes arrive as runs of rows, the words to hold before those that only ask; a run may go on in the next frame."""
    keys = ["right", "short", "shard", "part"]
    key, words, counts, index = None, [], [], None

    def ask(asking: list[str], times: list[int]) -> Iterator[tuple]:
        if not asking:
            return
        asked, found = index.within_one(index.patterns(asking), key[1] // 2, key[0])
        for a, b in dict.fromkeys(zip(asked.tolist(), found.tolist(), strict=True)):
            if asking[a] != words[b]:
                yield asking[a], times[a], words[b], counts[b]

    def held() -> Iterator[tuple]:
        if len(words) < 2:
            return
        own = [k for k, w in enumerate(words) if len(w) == key[1]]
        yield from ask([words[k] for k in own], [counts[k] for k in own])

    for frame in frames:
        out = []
        for k, run in frame.groupby(keys, sort=False):
            if k != key:
                if len(words) > 1 and index is None:
                    index = BidirectionalIndex(words)
                    out += held()
                key, words, counts, index = k, [], [], None
            member = run["member"].to_numpy(bool)
            words += run.loc[member, "word"].tolist()
            counts += run.loc[member, "n"].tolist()
            if not member.all() and words:
                if index is None:
                    index = BidirectionalIndex(words)
                    out += held()
                out += ask(run.loc[~member, "word"].tolist(), run.loc[~member, "n"].tolist())
        yield pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"], dtype=object)
    if len(words) > 1 and index is None:
        index = BidirectionalIndex(words)
        yield pd.DataFrame(list(held()), columns=["a", "n_a", "b", "n_b"], dtype=object)


def near_words(words: DataFrame, least: int = LEAST_CHARS, letters: int = LETTERS) -> DataFrame:
    """(word, n, near, n_near): both directions of every two words at one inserted, deleted or replaced code point."""
    size = F.length("word")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("short")).where(F.col("short") >= least)
    half = F.floor(F.col("short") / 2).cast("int")
    first, last = F.substring("word", F.lit(1), half), F.substring("word", F.col("size") - half + 1, half)
    rows = rows.select("*", F.explode(F.array(F.struct(F.lit(True).alias("right"), F.xxhash64(first).alias("half")), F.struct(F.lit(False).alias("right"), F.xxhash64(last).alias("half")))).alias("_s")).select("word", "n", "size", "short", "_s.*")
    # one row for each length
    lengths = rows.groupBy("short").agg(F.ceil(F.count(F.lit(1)) / 2 * (F.col("short") + 2) / letters).cast("long").alias("shards"))
    rows = rows.join(lengths, "short").withColumn("shard", F.pmod("half", F.col("shards")))
    sizes = rows.groupBy("right", "short", "shard").agg(F.ceil(F.count(F.lit(1)) * (F.col("short") + 2) / (2 * letters)).cast("int").alias("parts"))
    rows = rows.join(sizes, ["right", "short", "shard"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    asked = F.when(F.col("size") == F.col("short"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("part", F.explode(asked)).select("right", "short", "shard", "part", (F.col("own") == F.col("part")).alias("member"), "word", "n")
    keys = ["right", "short", "shard", "part"]
    # a number of partitions of its own: the rows are few bytes but much work, and Spark would put them into few tasks
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("member"), "word").mapInPandas(_near_of, "a string, n_a long, b string, n_b long")
    there = found.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("n_near"))
    back = found.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("n_near"))
    return there.union(back).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of a word's chain of forms. Each round doubles the links that a word has followed."""
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_CHARS, count: int = LEAST_COUNT, times: int = TIMES, letters: int = LETTERS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    found = counted_words(docs, id_col, text, least)
    words = cut(found.where((F.col("n") >= count) & (F.length("word") >= least)), "spelling-words")
    near = near_words(words, least, letters)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), "near")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("_is", -F.col("best.less") >= times * F.col("n"))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("best.near")).alias("form"), F.when(F.col("_is"), -F.col("best.less")).alias("form_n"))
    formed = cut(formed, "spelling-forms")
    return formed.join(roots(formed.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES = {
    "op13_spelling_fm": f"""
WITH RECURSIVE {CRC_SQL}
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
one AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
bytes AS (SELECT *, list_transform(range(octet_length(encode(id || ':' || run))), lambda k: ('0x' || substr(hex(encode(id || ':' || run)), 2 * k + 1, 2))::BIGINT) AS b FROM one),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
words AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_CHARS}),
cuts AS (SELECT DISTINCT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS n_near FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cuts c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cuts c ON c.rest = w.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS c, row_number() OVER (PARTITION BY word ORDER BY n_near DESC, near) AS r FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(r.c, 0) AS n_near, CASE WHEN r.n_near >= {TIMES} * w.n THEN r.near END AS form, CASE WHEN r.n_near >= {TIMES} * w.n THEN r.n_near END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (SELECT word, word AS at, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, max_by(c.at, c.k) AS root, any_value(f.n) AS n, any_value(f.n_near) AS n_near, any_value(f.form_n) AS form_n FROM formed f JOIN chain c USING (word) GROUP BY f.word, f.form
"""
}
