"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding is the BPE agenda of a SentencePiece model: candidate merges leave the agenda by
score, then place. With dropout, a candidate that leaves the agenda is skipped when a keyed
hash of it falls below ``dropout``: the key is made of the seed, the document's id and the
word's position in the text, and hashed are the merged piece, the length of its left half and
its place in the word. So every occurrence of a word is cut on its own, and all are repeatable.
Parts of a text up to ``WIDE`` characters are merged many at once, each round taking every part's
next merge off its agenda; longer ones have an agenda that is a heap, so a part of n characters
takes n log n steps. With dropout 0 the result is that of the model's own encoder, and a worker keeps the
segmentations it has met in a cache of about ``CACHE`` entries. A literal U+2581 is written as its three bytes, so that decoding gives
back every text.

Defined results: a null or empty text has no pieces and decodes to the empty text. A null id
is hashed like the empty string. Repeated rows are encoded alike. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyrock.llm.text import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, CACHE = 0.1, 20, 200_000
#: Symbols merged at once, texts and characters encoded at once, and the longest part that is kept.
ROUND, TEXTS, CHARS, LONG = 1 << 16, 256, 1 << 19, 32
#: Characters of a part from which its agenda is a heap.
WIDE = 128
_BLANK, _NONE = "▁", float("-inf")


class Pieces:
    """A SentencePiece BPE model read into tables, with its merge agenda."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = {i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.ids = {model.id_to_piece(i): i for i in every if i not in special}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        if model.get_piece_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.written = {i: p.replace(_BLANK, " ").encode() for p, i in self.ids.items()}
        self.written |= {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self._tables()
        inner = [p.lstrip(_BLANK) for p in self.ids]
        if any(_BLANK in p for p in inner) or any(p != p.lstrip(_BLANK) and len(p) - len(p.lstrip(_BLANK)) > 1 and p.lstrip(_BLANK) for p in self.ids):
            raise ValueError("a piece of this model reaches over a word's beginning")
        #: Parts of a text between which no piece can lie.
        apart = not any(p.isalpha() != p[:1].isalpha() or any(c.isalpha() for c in p) != p.isalpha() for p in inner if p)
        self.parts = re.compile(r" *[^\W\d_]+| *(?:[^ \w]|[\d_])+| +" if apart else r" *[^ ]+| +").findall

    def _tables(self) -> None:
        """Symbols are the pieces and, after them, characters that only stand inside pieces."""
        chars = sorted({c for p in self.ids for c in p} - set(self.ids))
        self.first_extra = 1 + max(self.ids.values())
        symbol = self.ids | {c: self.first_extra + k for k, c in enumerate(chars)}
        count = self.first_extra + len(chars)
        self.of_char = np.full(0x110000, -1, np.int64)
        for c, k in symbol.items():
            if len(c) == 1 and c != _BLANK:
                self.of_char[ord(c)] = k
        self.of_char[32] = symbol[_BLANK]
        self.score, self.mixed, self.length = np.full(count, _NONE), np.zeros(count, np.uint64), np.ones(count, np.uint64)
        for p, k in symbol.items():
            self.score[k], self.mixed[k], self.length[k] = self.scores.get(p, _NONE), xxh64_intdigest(p) & 0xFFFFFFFFFFFF, len(p)
        pairs = {symbol[p[:k]] << 32 | symbol[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.pair_of, self.score_of, self.hashed, self.lengths = pairs, self.score.tolist(), self.mixed.tolist(), self.length.tolist()

    def _candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of symbols merges to, and its score; -1 and minus infinity for none."""
        code = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        hit = self.pairs[k] == code
        merged = np.where(hit, self.merged[k], -1)
        return merged, np.where(hit, self.score[merged], _NONE)

    def segment_many(self, parts: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
        """The pieces of many parts, as 16-bit ids. Each round takes every part's next merge off its agenda."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for row in np.flatnonzero(sizes > WIDE).tolist():
            out[row] = self._merged_long(points[starts[row] : starts[row] + sizes[row]], int(keys[row]), dropout)
        for size in np.unique(sizes[sizes <= WIDE]).tolist():
            rows = np.flatnonzero(sizes == size)
            for at in range(0, len(rows), max(1, ROUND // size)):
                some = rows[at : at + max(1, ROUND // size)]
                where = starts[some, None] + np.arange(size)
                for row, ids in zip(some.tolist(), self._merged_rows(points[where], keys[some], dropout), strict=True):
                    out[row] = ids
        return out

    def _skips(self, merged: int, left: int, place: int, key: int, limit: int) -> bool:
        """Whether a candidate merge is dropped; ``_merged_rows`` has the same for many."""
        h = (((self.hashed[merged] ^ key) + place * 0x9E3779B1 + self.lengths[left] * 0xC2B2AE35) * 0x85EBCA6B) & 0xFFFFFFFFFFFFFFFF
        return (h >> 9 & 0xFFFFFFFF) < limit

    def _merged_long(self, points: np.ndarray, key: int, dropout: float) -> bytes:
        """The pieces of one part. A place's version tells its candidate from earlier ones that are still in the heap."""
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -2 - points, symbols)
        merged, scores = self._candidates(symbols[:-1], symbols[1:])
        heap = [(-s, p, 0, m) for p, (s, m) in enumerate(zip(scores.tolist(), merged.tolist(), strict=True)) if m >= 0]
        heapify(heap)
        now, count, limit = symbols.tolist(), len(points), int(dropout * 2**32)
        after, before, version = list(range(1, count + 1)), list(range(-1, count - 1)), [0] * count

        def offer(place: int, left: int, right: int) -> None:
            version[place] += 1
            m = self.pair_of.get(left << 32 | right) if left >= 0 and right >= 0 else None
            if m is not None:
                heappush(heap, (-self.score_of[m], place, version[place], m))

        while heap:
            _, at, v, m = heappop(heap)
            if version[at] != v or (limit and self._skips(m, now[at], at, key, limit)):
                continue
            right = after[at]
            end = after[right]
            now[at], after[at], version[right] = m, end, -1
            if end < count:
                before[end] = at
                offer(at, m, now[end])
            else:
                version[at] += 1
            if at:
                offer(before[at], now[before[at]], m)
        out, at = [], 0
        while at < count:
            out.append(now[at])
            at = after[at]
        if all(0 <= x < self.first_extra for x in out):
            return np.array(out, "<u2").tobytes()
        return self._with_bytes(out)

    def _merged_rows(self, points: np.ndarray, keys: np.ndarray, dropout: float) -> list[bytes]:
        """Rows of equal length; a symbol stays at its first character's place, linked to its neighbours."""
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -2 - points, symbols)  # below -1: characters that no piece has
        count, size = points.shape
        width = size + 1  # one place more in a row, where every chain ends
        flat = np.full((count, width), -1, np.int64)
        flat[:, :size] = symbols
        symbols = flat.ravel()
        place = np.broadcast_to(np.arange(width), (count, width)).ravel()
        after, before = np.arange(count * width) + 1, np.arange(count * width) - 1
        merged, agenda = self._candidates(symbols[:-1], symbols[1:])
        agenda = np.append(agenda, _NONE).reshape(count, width)
        merged, flat_agenda = np.append(merged, -1), agenda.ravel()
        limit = np.uint64(int(dropout * 2**32))
        live = np.arange(count) if size > 1 else np.empty(0, np.int64)
        while len(live):
            at = agenda[live].argmax(axis=1) + live * width
            going = flat_agenda[at] > _NONE
            live, at = live[going], at[going]
            if limit and len(at):
                h = ((self.mixed[merged[at]] ^ keys[live]) + place[at].astype(np.uint64) * np.uint64(0x9E3779B1) + self.length[symbols[at]] * np.uint64(0xC2B2AE35)) * np.uint64(0x85EBCA6B)
                skip = (h >> np.uint64(9) & np.uint64(0xFFFFFFFF)) < limit
                flat_agenda[at[skip]] = _NONE
                at = at[~skip]
            right = after[at]
            end = after[right]
            symbols[at] = merged[at]
            after[at] = end
            before[end] = at
            symbols[right], flat_agenda[right] = -1, _NONE
            merged[at], flat_agenda[at] = self._candidates(symbols[at], symbols[end])
            at = at[place[at] > 0]
            left = before[at]
            merged[left], flat_agenda[left] = self._candidates(symbols[left], symbols[at])
        gone = flat != -1  # places that still begin a symbol
        known = (symbols < self.first_extra).reshape(count, width) & (flat >= -1)
        plain, used = known.all(axis=1), gone.sum(axis=1)
        packed, ends = flat[gone].astype("<u2").tobytes(), 2 * np.cumsum(used)
        return [packed[e - 2 * n : e] if ok else self._with_bytes(flat[r][gone[r]].tolist()) for r, (n, e, ok) in enumerate(zip(used.tolist(), ends.tolist(), plain.tolist(), strict=True))]

    def _with_bytes(self, symbols: list[int]) -> bytes:
        """Ids of symbols of which some are characters that have no piece: their bytes stand for them."""
        extra = {k: c for c, k in enumerate(self.of_char.tolist()) if k >= self.first_extra} if any(s >= self.first_extra for s in symbols) else {}
        ids: list[int] = []
        for s in symbols:
            if 0 <= s < self.first_extra:
                ids.append(s)
            else:
                ids += [self.bytes[b] for b in chr(-2 - s if s < 0 else extra[s]).encode("utf-8", "replace")]
        return np.array(ids, "<u2").tobytes()

    def decode(self, ids) -> str:
        written = self.written
        return b"".join([written[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts with one model, dropout and seed; without dropout it keeps the segmentations it has met."""

    def __init__(self, path: str, dropout: float, seed: int, cache: int = CACHE) -> None:
        self.pieces, self.dropout, self.seed, self.cache = load(path), dropout, seed, cache
        self.known: dict[str, bytes] = {}

    def keys(self, doc_id: object, count: int) -> np.ndarray:
        """A key for each of the first ``count`` positions of a document."""
        start = np.uint64(xxh64_intdigest("" if doc_id is None else str(doc_id), self.seed))
        k = start + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        k = (k ^ k >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ k >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return k ^ k >> np.uint64(31)

    def encode_many(self, texts: list[str | None], doc_ids: list) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARS):
                size += len(texts[end] or "")
                end += 1
            split = [self.pieces.parts(" " + t) if t else [] for t in texts[at:end]]
            out += self._drawn(split, doc_ids[at:end]) if self.dropout else self._plain(split)
            at = end
        return out

    def _drawn(self, split: list[list[str]], doc_ids: list) -> list[np.ndarray]:
        keys = np.concatenate([self.keys(d, len(parts)) for d, parts in zip(doc_ids, split, strict=True)])
        done = iter(self.pieces.segment_many([w for parts in split for w in parts], keys, self.dropout))
        return [np.frombuffer(b"".join([next(done) for _ in parts]), "<u2").astype(np.int32) for parts in split]

    def _plain(self, split: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > self.cache:
            self.known.clear()
        words = sorted({w for parts in split for w in parts if w not in self.known})
        self.known.update(zip(words, self.pieces.segment_many(words, np.zeros(len(words), np.uint64), 0.0), strict=True))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u2").astype(np.int32) for parts in split]
        for w in words:
            if len(w) > LONG:  # not worth its memory
                del self.known[w]
        return out

    def encode(self, text: str | None, doc_id: object) -> list[int]:
        return self.encode_many([text], [doc_id])[0].tolist()


@lru_cache(maxsize=2)
def encoder(path: str, dropout: float, seed: int) -> Encoder:
    return Encoder(path, dropout, seed)


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(id_col, ids, lossless): the pieces of each text, and whether they decode to it."""
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # few texts at a time as Python objects
                some = batch.slice(at, TEXTS)
                texts = some.column(1).to_pylist()
                ids = coder.encode_many(texts, some.column(0).to_pylist())
                same = [coder.pieces.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([some.column(0), lists, pa.array(same)], [id_col, "ids", "lossless"])

    return rows.mapInArrow(of, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>, lossless boolean")


def decoded(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded``, the text of the pieces; null ids give null."""

    @F.pandas_udf("string")
    def of(lists: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else load(model).decode(i.tolist()) for i in lists], dtype=object)

    return rows.withColumn("decoded", of(F.col(ids)))


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")
