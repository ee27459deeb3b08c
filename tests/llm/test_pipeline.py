"""The pipeline's stages against brute force, over rows with nulls, repeats and clashing columns."""

import random
import re

import pytest

import corpus_pipeline
from tallyrock.llm import pieces, quality
from tests.llm.test_corpus import PATTERNS, alnum, brute_llr, space_words, valid
from tests.llm.test_similar import grams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, llr string, spans string, n_words string, `a.b` string"


def text_of(r, n=30):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows of documents, trusted ids, benchmark texts)"""
    r = random.Random(8)
    base = [text_of(r) for _ in range(12)]
    bench = text_of(r, 14)
    edited = base[0].split()
    edited[3] = "changed"
    texts = [
        *base, base[0], " ".join(edited), base[1], f"{base[2]} {bench}", f"mail me at someone@host.example {text_of(r)} and 4111 1111 1111 1111", "too short", "", None, "to be or not " * 20, base[11].upper(),
        text_of(r, 3000), "### $$$ " * 40,
    ]
    ids = [None if k in (5, 12) else 7 if k in (7, 8) else 100 - k for k in range(len(texts))]
    rows = [(i, t, "en", "s", len(t or ""), "own", "x", None, "y", "z") for i, t in zip(ids, texts, strict=True)]
    folder = str(tmp_path_factory.mktemp("sf"))
    trusted = [100 - k for k in (0, 1, 2, 3, 4, 6, 9, 10, 11, 13, 14, 15, 16, 19, 20)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in trusted] + [(79, 0, 0), (95, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, trusted, [bench]


def good(text, llr):
    words = space_words(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
    return len(words) >= 10 and 100 * len(twice) <= 20 * len(words) and llr >= quality.THRESHOLD


def first_of_each(rows):
    """Rows that are the first of their class of near-duplicates, by id, a null id last."""
    sets, group = [grams(x[1]) for x in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = {}
    for row, g in zip(rows, group, strict=True):
        if g not in out or (row[0] is None, row[0] or 0) < (out[g][0] is None, out[g][0] or 0):
            out[g] = row
    return list(out.values())


def masked(text):
    spans = sorted((m.start(), m.end(), k) for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0]))
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:] if spans else text


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_stages_and_run(spark, corpus):
    folder, rows, trusted, bench = corpus
    url = f"file://{folder}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ratio = brute_llr(dict(enumerate(x[1] for x in rows)), [k for k, x in enumerate(rows) if x[0] in trusted], quality.BUCKETS)
    kept = [x for k, x in enumerate(rows) if good(x[1], ratio[k])]
    got = corpus_pipeline.keep_quality(spark, docs, url)
    assert got.columns == docs.columns and plain(got.collect()) == plain(kept) and len(kept) > 8
    of = lambda some: spark.createDataFrame(some, SCHEMA).repartition(3)
    single = first_of_each(kept)
    got = corpus_pipeline.drop_near_duplicates(spark, of(kept), url)
    assert got.columns == docs.columns and {(x[0], x[1]) for x in single} == {(r["doc_id"], r["text"]) for r in got.collect()} and len(single) < len(kept)
    windows = {tuple(alnum(t)[k : k + 10]) for t in bench for k in range(len(alnum(t)) - 9)}
    clean = [x for x in single if not any(tuple(alnum(x[1])[k : k + 10]) in windows for k in range(len(alnum(x[1])) - 9))]
    got = corpus_pipeline.drop_contaminated(spark, of(single), url)
    assert got.columns == docs.columns and plain(got.collect()) == plain(clean) and len(clean) == len(single) - 1
    hidden = [(x[0], m := masked(x[1]), x[2], x[3], len(m) if m != x[1] else x[4], *x[5:]) for x in clean]
    got = corpus_pipeline.mask_personal_data(spark, of(clean), url)
    assert got.columns == docs.columns and plain(got.collect()) == plain(hidden) and hidden != clean
    out = corpus_pipeline.run(spark, url)
    decoded = pieces.decoded(out).collect()
    assert all(r["lossless"] for r in decoded) and sorted((str(r["doc_id"]), r["decoded"]) for r in decoded) == sorted((str(x[0]), x[1]) for x in hidden)


def test_rows_of_no_use(spark, corpus):
    """Empty tables, and the case of rows without an id of their own and unlike texts: none is lost."""
    folder, rows, _, _ = corpus
    url = f"file://{folder}"
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, url).count() == 0
    odd = [(None, "a " * 30), (None, "b " * 30), (5, "c " * 30), (5, "d " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 60) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, url).count() == 4
