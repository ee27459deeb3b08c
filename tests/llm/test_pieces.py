"""Merge-dropout against a plain agenda, and a draw of its own for every occurrence of a word."""

import random
import time

import sentencepiece
from xxhash import xxh64_intdigest

from tallyrock.llm import pieces


def plainly_merged(model, part, key, dropout):
    """Ids of a part by the rule itself: the best candidate that is left, by score, then place, is skipped or merged."""
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    nodes, skipped = [(k, c) for k, c in enumerate(part.replace(" ", "▁"))], set()
    while True:
        found = [(-scores[a + b], k, a, b) for (k, a), (_, b) in zip(nodes, nodes[1:], strict=False) if a + b in scores and (k, a, b) not in skipped]
        if not found:
            break
        _, k, a, b = min(found)
        h = ((((xxh64_intdigest(a + b) & 0xFFFFFFFFFFFF) ^ key) + k * 0x9E3779B1 + len(a) * 0xC2B2AE35) * 0x85EBCA6B) % 2**64
        if (h >> 9) % 2**32 < int(dropout * 2**32):
            skipped.add((k, a, b))
            continue
        at = [n for n, _ in nodes].index(k)
        nodes[at : at + 2] = [(k, a + b)]
    ids = []
    for _, piece in nodes:
        ids += [model.piece_to_id(piece)] if piece in scores else [model.piece_to_id(f"<0x{x:02X}>") for x in piece.replace("▁", " ").encode()]
    return ids


def test_dropout_against_a_plain_agenda():
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coder, r = pieces.Encoder(pieces.MODEL, 0.3, 5), random.Random(3)
    words = [" " + "".join(r.choice("aeinrstlé日x") for _ in range(r.randrange(1, n))) for n in (12, 12, 12, 60, 200, 400) for _ in range(8)]
    for dropout in (0.0, 0.3):
        keys = coder.keys("id", len(words))
        got = coder.pieces.segment_many(words, keys, dropout)
        for word, key, ids in zip(words, keys.tolist(), got, strict=True):
            assert list(memoryview(ids).cast("H")) == plainly_merged(model, word, key, dropout)
    # wide parts by both ways
    long = [w for w in words if len(w) > 30]
    keys = coder.keys("id", len(long))
    was, pieces.WIDE = pieces.WIDE, 20
    try:
        by_heap = coder.pieces.segment_many(long, keys, 0.3)
    finally:
        pieces.WIDE = was
    pieces.WIDE = 10_000
    try:
        assert by_heap == coder.pieces.segment_many(long, keys, 0.3)
    finally:
        pieces.WIDE = was


def test_long_unbroken_text():
    r = random.Random(4)
    text = "".join(r.choice("abcdefghijklmnop") for _ in range(256_000))
    coder, began = pieces.Encoder(pieces.MODEL, 0.1, 5), time.process_time()
    assert coder.pieces.decode(coder.encode(text, 1)) == text
    assert time.process_time() - began < 10  # seconds, where quadratic work took half a minute


def test_every_occurrence_is_cut_on_its_own():
    coder = pieces.Encoder(pieces.MODEL, 0.1, 20)
    model, word = pieces.load(pieces.MODEL), "international"
    parts = model.parts(f" {word}" * 3000)
    ways = model.segment_many(parts, coder.keys(1, len(parts)), 0.1)
    assert len(set(ways)) > 8
    # the model's own way needs all merges of the agenda, so it gets rarer with each
    plain = model.segment_many([" " + word], coder.keys(1, 1), 0.0)[0]
    assert 0.2 < ways.count(plain) / len(ways) < 0.95
    one = coder.encode(f"{word} " * 50, 1)
    assert one == coder.encode(f"{word} " * 50, 1) != coder.encode(f"{word} " * 50, 2)
    assert one != coder.encode(word, 1) * 50 and coder.pieces.decode(one) == f"{word} " * 50
    texts = [f"{word} {k}" for k in range(300)] + [None, ""]
    assert [x.tolist() for x in coder.encode_many(texts, list(range(302)))] == [coder.encode(t, k) for k, t in enumerate(texts)]
