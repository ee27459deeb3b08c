"""The pipeline's stage of near-duplicates against brute force."""

import random
import string

import corpus_pipeline
from tallyrock.llm import simhash, similar
from tallyrock.sources.shared import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited_copies(seed):
    """Texts of 60 to 140 words and copies of them with 0 to 5 words replaced, in any order of ids."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    texts = ["one two three", "One two  THREE", "one two", "", None, " \n"]
    for _ in range(25):
        base = [word() for _ in range(r.randrange(60, 140))]
        for _ in range(r.randrange(1, 8)):
            copy = list(base)
            for k in r.sample(range(len(copy)), r.randrange(6)):
                copy[k] = word()
            texts.append(" ".join(copy))
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}


def kept_of(rows):
    """Ids that brute force keeps."""
    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in alike:
        old, new = group[a], group[b]
        group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return sorted(least.values())


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return corpus_pipeline.drop_near_duplicates(spark, docs, "")


def test_edited_copies(spark):
    rows = edited_copies(4)
    out = stage(spark, rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in out.collect()) == kept_of(rows)


def test_parts_of_a_large_group(spark):
    r = random.Random(9)
    base = [f"{k}w" for k in range(100)]
    rows = [(k, " ".join(w if r.random() > 0.02 else f"{w}{k}" for w in base)) for k in range(60)] + edited_copies(5)[:40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (7, 1024):
        found, copies = similar.near_copies(docs, part=part)
        assert sorted(x["doc_id"] for x in found.join(copies, "_key", "left_anti").collect()) == kept_of(rows)
    assert similar.near_copies(docs.where("false"))[1].count() == 0


def test_the_pipeline_leaves_its_result_only(spark, tmp_path):
    import pathlib

    words = lambda k, n=30: " ".join(f"{k}x{j}" for j in range(n))
    docs = [(k, words(k % 7), "en", "s", 1) for k in range(12)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(3, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    corpus_pipeline.run(spark, f"file://{tmp_path}").count()
    assert [p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before] == ["pipeline-personal_data"]


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    words = lambda k, n=30: " ".join(f"{k}x{j}" for j in range(n))
    rows = [(None, words("a")), (None, words("b")), (1, words("b")), (2, words("c")), (2, words("d")), (2, words("d")), (3, words("e")), (3, words("hit"))]
    out = stage(spark, rows)
    kept = [(None, words("a")), (1, words("b")), (2, words("c")), (2, words("d")), (3, words("e")), (3, words("hit"))]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(kept, key=str)
    spark.createDataFrame([(1, words("hit", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, words("a")), (None, words("hit")), (3, words("e")), (3, words("hit"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([rows[0], rows[2]], key=str)


def test_links_of_fingerprints(spark):
    """Texts of one fingerprint whose sets of shingles are unlike are near copies, as in operator 8."""
    words = lambda k: " ".join(f"{k}x{j}" for j in range(10))
    rows = [(k, f"{'over and again ' * 60}{words(k)}") for k in range(4)] + [(9, words("other") + " " + words("more"))]
    assert len({simhash.fingerprint(t) for _, t in rows[:4]}) == 1 and kept_of(rows) == [0, 1, 2, 3, 9]
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == [0, 9]
