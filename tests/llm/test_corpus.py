"""The corpus operators against brute force, exact round trips and hard rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from tallyrock.llm import decontaminate, language, licences, pieces, pii, pitman_yor, quality, simhash, warc, wrappers

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "The quick brown fox jumps over the lazy dog while seven wizards boil quartz pyjamas near Vienna"
LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(6000))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("seven", "eight")), (4, None), (5, ""), (6, " \n\t "), (7, "### $$$ %% || <<>> a b c d e f g h"), (8, "to be or not to be or not to be or not to be or not"),
    (9, "Mail a@b.c_d@e.f, 10.0.0.255 999.1.1.1 or 4111 1111 1111 1111 +1 (202) 555-0123 é DE89370400440532013000"), (10, LONG), (11, LONG + " end"), (None, BASE), (12, "▁ ▁▁ <s> \x00 \x01 日本語 😀 naïve"), (12, "▁ ▁▁ <s> \x00 \x01 日本語 😀 naïve"),
    (13, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "junk") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.with_quality(docs, labels).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        t = r["text"] or ""
        words = space_words(t)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if space_words(x)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert not by_id(out)[7]["kept"] or by_id(out)[7]["llr"] >= quality.THRESHOLD
    assert quality.with_quality(none, labels.where("false")).count() == 0


def brute_llr(texts, good, buckets):
    def tokens(t):
        h = [xxh64_intdigest(x, 42) for x in re.findall(r"[^\W_]+|[^\w\s]+|_+", (t or "").translate(LOW))]
        return h

    def chain(values):
        seed = 42
        for v in values:
            seed = xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed)
        return (seed - 2**64 if seed >> 63 else seed) % buckets

    grams = {k: [chain([h]) for h in tokens(t)] + [chain(p) for p in zip(tokens(t), tokens(t)[1:], strict=False)] for k, t in texts.items()}
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for k in good for g in grams[k])
    ratio = {b: round(quality.UNIT * (math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)))) for b in raw}
    return {k: sum(ratio[g] for g in v) / (len(v) * quality.UNIT) if v else 0.0 for k, v in grams.items()}


def test_quality_ratio(spark):
    texts = {1: "alpha beta gamma, alpha!", 2: "beta beta ### delta", 3: "", 4: "Alpha BETA | gamma"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["llr"] for r in quality.with_quality(docs, labels, buckets=64).collect()}
    assert got == pytest.approx(brute_llr(texts, [1, 4], 64))


def test_simhash_components(docs, none):
    out = simhash.near_duplicates(docs).collect()
    fps = [r["fp"] & (2**64 - 1) for r in out]
    group = list(range(len(out)))
    for _ in out:
        for a in range(len(out)):
            for b in range(len(out)):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    for a, r in enumerate(out):
        assert r["component_id"] == min((out[b]["doc_id"] for b in range(len(out)) if group[b] == group[a] and out[b]["doc_id"] is not None), default=None)
    assert by_id(out)[4]["fp"] == by_id(out)[5]["fp"] == 0 and simhash.near_duplicates(none).count() == 0


def test_simhash_fingerprint():
    for text in (BASE, "one", "one Two", "a b c", LONG):
        words = space_words(text.translate(LOW))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) & (2**64 - 1) == bits


def test_bk_tree_finds_all_within():
    import random

    r = random.Random(3)
    values = [r.getrandbits(64) & 0xFF00FF00FF for _ in range(300)]
    values += [v ^ (1 << r.randrange(64)) for v in values[:100]]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:80]:
        assert sorted(tree.within(q, 3)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_split_shards_lose_no_link(spark):
    import random

    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for _ in range(400)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = {tree: {frozenset((x["a"], x["b"])) for x in simhash.links(df, tree_size=tree).collect()} for tree in (16, 10_000)}

    def classes(edges):
        up = {v: v for v in signed}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for e in edges:
            a, b = tuple(e)
            up[root(a)] = root(b)
        return {frozenset(v for v in signed if root(v) == t) for t in map(root, signed)}

    exact = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert classes(pairs[16]) == classes(pairs[10_000]) == classes(exact)


def test_decontamination(spark, docs, none):
    items = [(1, BASE.upper()), (2, "over the lazy dog"), (3, None), (4, ""), (5, "be"), (6, LONG[:300]), (7, "over the lazy dog"), (None, "not to be")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, bench).collect()
    assert len(out) == len(TEXTS)
    windows = {}
    for k, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    expected = {}
    for k, t in TEXTS:
        w, hit, ids = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    ids |= found
                    hit |= set(range(i, i + n))
        expected[k] = (len(w), len(hit), sorted(str(x) for x in ids if x is not None))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out} == expected
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, bench.where("false")).collect())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def test_pii(spark, docs, none):
    more = spark.createDataFrame([(20, "1" * 20000), (21, "a" * 20000 + "@"), (22, "+12345678 " * 60 + "000.0.0.1.2.3.4.5"), (23, "4111111111111111-1 \x01 4111-1111-1111-1111"), (24, "ssn 123-45-6789, 123-45-6789" + " " * 60 + "123-45-6789")], "doc_id long, text string")
    rows = pii.with_spans(docs.select("doc_id", "text").unionByName(more)).collect()
    for r in rows:
        brute = [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], r["text"] or "") if valid(k, m[0])]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in PATTERNS] == brute
    assert ["iban"] == [s["kind"] for s in by_id(rows)[9]["spans"] if s["kind"] not in PATTERNS]
    assert [s["start"] for s in by_id(rows)[24]["spans"]] == [4, 17] and none.count() == pii.with_spans(none).count()
    text = pii.with_spans(docs.where("doc_id = 9")).select(pii.redacted(docs["text"], pii.F.col("spans")).alias("t")).first()["t"]
    assert text == "Mail [EMAIL][EMAIL], [IP] 999.1.1.1 or [CARD] [PHONE] é [IBAN]"


def test_pii_of_many_spans(spark):
    mails = " ".join(f"user{k}@host{k}.example" for k in range(16_000))
    overlap = "1111 4111111111111111 +4111111111111111 a 1.2.3.4567@b.c"
    docs = spark.createDataFrame([(1, mails), (2, f"x{mails}"), (3, overlap), (4, "no"), (5, None)], "doc_id long, text string")
    rows = by_id(pii.with_spans(docs).withColumn("masked", pii.redacted(pii.F.col("text"), pii.F.col("spans"))).collect())
    assert rows[1]["masked"] == " ".join(["[EMAIL]"] * 16_000) and len(rows[2]["spans"]) == 16_000
    at, out = 0, ""
    spans = sorted((s["start"], s["end"], s["kind"]) for s in rows[3]["spans"])
    for k, (start, end, kind) in enumerate(spans):
        if not k or start >= at:
            out += overlap[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    assert rows[3]["masked"] == out + overlap[at:] and rows[4]["masked"] == "no" and rows[5]["masked"] is None


def test_pieces_round_trip(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = pieces.encoded(docs, dropout=0.0).collect()
    texts = dict(TEXTS)
    assert all(r["lossless"] for r in plain)
    assert all(r["ids"] == model.encode(texts[r["doc_id"]] or "") for r in plain if r["doc_id"] not in (12,))
    a, b, c = (by_id(pieces.encoded(docs, seed=s).collect()) for s in (1, 1, 2))
    assert a == b and all(r["lossless"] for r in a.values()) and a[1]["ids"] != c[1]["ids"] and len(a[1]["ids"]) > len(model.encode(BASE))
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in back)
    assert pieces.encoded(none).count() == 0


def test_wrappers(spark):
    page = "<html><head><title>T</title></head><body><nav><a>n</a></nav><div class='ad'>buy</div><article><h1>H &amp; {0}</h1>{1}</article><div id='comments'><p>no</p></div><footer>f</footer>"
    blocks = ["<p>one <b>bold</b>er</p>", "<p>x</p><p>y\n z</p>", "<p><b>open<br><p>z", ""]
    rows = [(k, f"https://h.example/{k}", page.format(k, b)) for k, b in enumerate(blocks)] + [(9, None, None), (10, "nonsense", "<p>a</p>b<form>c</form>"), (11, "http://x.y/", "")]
    out = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {0: "H & 0 one bolder", 1: "H & 1 x y z", 2: "H & 2 open z", 3: "H & 3", 9: "", 10: "a b", 11: ""}


def test_licences(docs, none):
    out = by_id(licences.scanned(docs).collect())
    assert [s["label"] for s in out[13]["spans"]] == ["cc-by-nc", "mit"] and out[13]["base_labels"] == ["mit"] and (out[13]["first_word"], out[13]["n_base"], out[13]["score"]) == (3, 1, 1.0)
    assert out[4]["n_words"] == 0 and out[4]["score"] == 0 and out[10]["spans"] == [] and licences.scanned(none).count() == 0


def test_automaton_matches_brute_force():
    import random

    r = random.Random(1)
    for _ in range(100):
        texts = [[r.randrange(3) for _ in range(r.randrange(1, 9))] for _ in range(3)]
        stream = [r.randrange(4) for _ in range(20)]
        subs = {}
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for j in range(i + 1, len(x) + 1):
                    subs.setdefault(tuple(x[i:j]), set()).add((t, j))
        most = [max([0, *(n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in subs)]) for i in range(len(stream))]
        got = {(q.start, q.length): set(q.at) for q in licences.Automaton(texts).runs(stream, 0, 1)}
        for i, n in enumerate(most):
            if n and not (i + 1 < len(most) and most[i + 1] == n + 1):
                assert got[i + 1 - n, n] == subs[tuple(stream[i + 1 - n : i + 1])]


def test_language(spark):
    words = {"en": "the and of to house river water walking", "de": "der und von zu haus fluss wasser gehen", "fr": "le et de un maison riviere eau marcher"}
    rows = [(k, " ".join(w.split()[(k * j) % 8] for j in range(1, 30)), lang) for k in range(90) for lang, w in [list(words.items())[k % 3]]]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", None), (902, "", "de"), (None, "der und", "de")], "doc_id long, text string, lang string")
    contents = language.dictionaries(docs.where("doc_id % 2 = 0"))
    out = language.predicted(docs, contents).collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 90 and r["doc_id"] % 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert {r["lang_pred"] for r in out if (r["doc_id"] or 0) >= 900} == {"und"} and all(0 <= r["score"] <= 1 for r in out)
    assert language.dictionaries(docs.where("false")) == {}


def test_pitman_yor(docs, none):
    learned = pitman_yor.F.crc32(pitman_yor.F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    out = pitman_yor.scored(docs, learned, hot=5, burn_in=1, samples=2).collect()
    counts = Counter(w for k, t in TEXTS if k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for w in pitman_yor.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(TEXTS)
    assert len(out) == len(TEXTS)
    for r in out:
        tokens = pitman_yor.tokens_of(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)) and r["score"] <= 0
    again = pitman_yor.scored(docs, learned, hot=0, burn_in=1, samples=2).collect()
    assert by_id(again)[1]["score"] == pytest.approx(by_id(out)[1]["score"])
    assert pitman_yor.scored(none, learned).count() == 0


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "short é"), (4, "http://a/4", None), (5, "u\r\nX: y", "short é")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.page_records(pages).write.format("warc").mode("append").save(path)
    rows = by_id(spark.read.format("warc").load(path).collect(), "record_id")
    assert rows["<urn:page:1>"]["refers_to"] == "<urn:page:2>" and rows["<urn:page:1>"]["record_type"] == "revisit" and rows["<urn:page:1>"]["payload_length"] == 2000
    assert bytes(rows["<urn:page:2>"]["payload"]) == big.encode() and bytes(rows["<urn:page:3>"]["payload"]) == "short é".encode() and rows["<urn:page:5>"]["record_type"] == "response"
    only = spark.read.format("warc").load(path).where("record_type = 'revisit' and target_uri = 'http://a/1'")
    assert [r["record_id"] for r in only.collect()] == ["<urn:page:1>"]
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and reader.only == {"record_type": {"revisit"}}
    data = warc.record({"record_type": "resource", "record_id": "<a>"}, b"p1") + warc.record({"record_type": "response", "record_id": "<b>"}, b"p2")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.warc").write_bytes(data + b"WARC/1.1\r\nWARC-Type: cut")
    assert [(r["record_id"], bytes(r["payload"])) for r in spark.read.format("warc").load(str(tmp_path / "plain")).collect()] == [("<a>", b"p1"), ("<b>", b"p2")]
    assert hashlib.sha1(big.encode()).hexdigest() == rows["<urn:page:1>"]["payload_digest"].removeprefix("sha1:")


def test_warc_of_odd_rows(spark, tmp_path):
    warc.register(spark)
    big = "é" * 600
    rows = [(1, "u", big, "x"), (1, "u", big, "x"), (None, "u", big, "x"), (0, None, big, "x"), (2, "u", None, "x"), (2, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(2)
    path = f"file://{tmp_path}/odd"
    warc.page_records(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where("record_type in ('response', 'revisit')").collect()
    assert sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in back) == sorted(
        [("<urn:page:1>", "response", "")] * 2 + [("<urn:page:>", "revisit", "<urn:page:1>"), ("<urn:page:0>", "revisit", "<urn:page:1>")] + [("<urn:page:2>", "response", "")] * 2
    )
    none = f"file://{tmp_path}/none"
    warc.page_records(pages.where("false")).write.format("warc").mode("append").save(none)
    assert spark.read.format("warc").load(none).where("record_type in ('response', 'revisit')").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: many\r\n\r\n" + warc.record({"record_type": "response", "record_id": "<b>"}, b"p"))
    (tmp_path / "bad" / "b.warc").write_bytes(b"no archive\n\n" * 300_000)
    assert [r["record_id"] for r in spark.read.format("warc").load(str(tmp_path / "bad")).collect()] == ["<x>", "<b>"]
    (tmp_path / "hostile").mkdir()
    head = lambda name, more: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\n{more}\r\n\r\n".encode()
    odd = head("a", "X-Payload-Length: ²\r\nContent-Length: 0") + head("b", "Content-Length: " + "9" * 5000) + head("c", f"X-Payload-Length: {'1' * 30}\r\nContent-Length: 3") + b"abc\r\n\r\n"
    (tmp_path / "hostile" / "a.warc").write_bytes(odd + warc.record({"record_type": "request", "record_id": "<r>"}, b"x" * 300_000) + warc.record({"record_type": "response", "record_id": "<d>"}, b"p"))
    back = spark.read.format("warc").load(str(tmp_path / "hostile")).where("record_type = 'response'").collect()
    assert [(r["record_id"], r["payload_length"], bytes(r["payload"])) for r in back] == [("<a>", None, b""), ("<b>", None, b""), ("<c>", None, b"abc"), ("<d>", 1, b"p")]



LICENCE_WORDS = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def test_licence_bases_against_brute_force(docs):
    """The base columns of every text by a plain search of words."""
    for r in licences.scanned(docs).collect():
        words = [w.encode() for w in alnum(dict(TEXTS)[r["doc_id"]])]
        places = [(k, label) for label, phrase in LICENCE_WORDS.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == [w.encode() for w in phrase.split()]]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)) and list(r["base_labels"]) == sorted({x for _, x in places})
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_chains_against_every_chain():
    """The best chain of matches, by trying all of them."""
    import random

    def every(pieces, k, gap):
        yield pieces[k][1]
        for j, (s, n, e) in enumerate(pieces):
            start, length, end = pieces[k]
            over = max(0, s + n - start, e - (end - length))
            if (s + n, e) <= (start + length, end) and j != k and s + n >= start - gap and e < end and s < start and over < length:
                for best in every(pieces, j, gap):
                    yield best + length - over

    r = random.Random(7)
    for _ in range(300):
        pieces = sorted({(r.randrange(20), n, n + r.randrange(12)) for n in [r.randrange(1, 6) for _ in range(6)]}, key=lambda p: (p[0] + p[1], p[2]))
        most = max(c for k in range(len(pieces)) for c in every(pieces, k, 3))
        cover, first, last = licences.Scanner._chain(list(pieces), 30, 3)
        assert cover == most / 30 and first <= last


def test_language_is_the_smallest_by_plain_zstandard(spark):
    """Predictions of all rows by compressing each text with each dictionary, one by one."""
    import random

    import zstandard

    r = random.Random(3)
    pools = {"en": "the and of to house river water walking", "de": "der und von zu haus fluss wasser gehen"}
    rows = [(k, " ".join(r.choice(pools[lang].split()) for _ in range(r.randrange(5, 60))), lang) for k in range(40) for lang in [("en", "de")[k % 2]]]
    rows += [(50, "word " * 200_000, "en"), (51, "und", None), (52, "wasser river", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    contents = language.dictionaries(docs.where("doc_id < 30"))
    packers = {}
    for lang, content in contents.items():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=language.LEVEL)
        packers[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
    out = {x["doc_id"]: x for x in language.predicted(docs, contents).collect()}
    for k, t, _ in rows:
        sizes = {g: len(p.compress(language.letters(t))) for g, p in packers.items()}
        assert out[k]["lang_pred"] == min(sizes, key=sizes.get)  # of equal sizes the language with more rows
        small, large = sorted(sizes.values())
        assert out[k]["score"] == pytest.approx(1 - small / large) and out[k]["accepted"] == (1 - small / large >= language.MARGIN)
