"""The models against a recursive version, held-out rows, and texts in parts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from orogen.llm import shared, toxicity

from .corpus import sentence, table, vocabulary


def _grams(word: bytes) -> list[bytes]:
    signed = b"\x01" + word + b"\x02"
    return [signed[max(0, i - 4) : i + 1] for i in range(1, len(signed))]


def plain_ratio(counts: tuple[Counter, Counter], word: bytes) -> float:
    """log P_1 - log P_0 of a word, with every sum written out. counts: sequences of class 0 and 1."""
    d = toxicity.DISCOUNT
    before: dict[bytes, set] = {}
    level = {g for c in counts for g in c}
    while level:
        for g in level:
            if len(g) > 1:
                before.setdefault(g[1:], set()).add(g)
        level = {g[1:] for g in level if len(g) > 1} - {g for c in counts for g in c}
        level = {g for g in level if len(g) > 1}

    def shared_p(g: bytes) -> float:
        if not g:
            return 1 / 256
        beside = [s for s in before if len(s) == len(g) and s[:-1] == g[:-1]]
        total = sum(len(before[s]) for s in beside)
        if not total:
            return shared_p(g[1:])
        return (max(len(before.get(g, ())) - d, 0) + d * len(beside) * shared_p(g[1:])) / total

    def p(c: int, g: bytes) -> float:
        beside = {s: n for s, n in counts[c].items() if s[:-1] == g[:-1]}
        if not beside:
            return shared_p(g[1:])
        return (max(beside.get(g, 0) - d, 0) + d * len(beside) * shared_p(g[1:])) / sum(beside.values())

    return sum(math.log(p(1, g)) - math.log(p(0, g)) for g in _grams(word))


def test_model_equals_the_recursive_version():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))).encode() for _ in range(60)]
    counts = tuple(Counter(g for w in rng.choices(words, k=n) for g in _grams(w)) for n in (40, 15))
    keys = {int.from_bytes(g, "big"): g for c in counts for g in c}
    grams = np.array(sorted(keys))
    model = toxicity.build(grams, *(np.array([counts[c][keys[k]] for k in grams]) for c in (1, 0)))
    for word in [*words, b"zzz", b"abzz", b"a"]:
        got = model.word_ratios(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
        assert got == pytest.approx(plain_ratio(counts, word), abs=1e-4), word


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words, bad = vocabulary(rng), ["qwortless", "zgrubbo", "xyxyx"]
    texts, toxic = [], []
    for i in range(500):
        some = sentence(rng, rng.randint(30, 120), words).split()
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            for _ in range(3):
                some.insert(rng.randrange(len(some)), rng.choice(bad) + rng.choice(["", "er", "ed", "."]))
        texts.append(" ".join(some))
    return texts, toxic


def test_held_out_texts(spark, corpus):
    texts, toxic = corpus
    odd = [None, "", " \n", texts[0], texts[0], "QWORTLESS zgrubboed! " * 20000]
    docs = table(spark, texts + odd, ids=list(range(len(texts))) + [10**6, 10**6 + 1, None, 10**6, 0, 10**6 + 5])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None), (7, 1), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(texts) + len(odd)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    hit = [r.predicted == toxic[r.doc_id] for r in rows if r.held_out and r.doc_id < len(texts)]
    assert len(hit) > 70 and np.mean(hit) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[10**6 + 5].predicted == 1 and by[10**6 + 1].predicted == 0 and by[None].score == by[10**6 + 1].score
    full = toxicity.scored(docs, labels)
    assert set(full.columns) == {*docs.columns, "held_out", "predicted"} and full.filter("key <> 7").count() == 0


def test_without_labels_or_documents(spark, corpus):
    docs = table(spark, corpus[0][:3])
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity_scores(docs, nothing).collect()] == [0.0] * 3
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (6, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, one).collect()} == {1.0}
    assert toxicity.toxicity_scores(docs.limit(0), one).count() == 0


def test_a_long_text_in_parts_is_the_text():
    rng = random.Random(3)
    text = sentence(rng, 20000, vocabulary(rng))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "short one", None, "", text[:50]])], names=["text"])
    for ahead in (0, 3):
        whole: dict[int, list] = {}
        for part in shared.segments(batch, toxicity._TABLE, ahead=ahead, most=1000):
            words = shared.Words(part.raw, part.offsets, toxicity._TABLE)
            for k in range(len(part.row)):
                mine = [i for i in range(len(words.doc)) if words.doc[i] == k]
                own = [i for i in mine if words.start[i] - part.offsets[k] < part.own[k]]
                whole.setdefault(int(part.row[k]), []).extend(bytes(part.raw[words.start[i] : words.end[min(i + ahead, mine[-1])]]).decode() for i in own)
                assert len(mine) - len(own) <= ahead
        want = text.split()
        assert whole[0] == [" ".join(want[i : i + 1 + ahead]) for i in range(len(want))] and len(whole[1]) == 2 and whole.get(3, []) == []


def test_hashes_are_xxh64():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 50_000).astype(np.uint8)
    start = rng.integers(0, 48_000, 3000)
    stop = start + np.r_[rng.integers(0, 70, 2500), rng.integers(900, 1400, 500)]
    assert shared.hashes(raw, start, stop).tolist() == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42) for a, b in zip(start, stop, strict=True)]


def test_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    from orogen.llm import rules, sentencepieces

    # the Thue-Morse word and its complement: equal under every polynomial modulo 2^64
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    text = np.frombuffer(f"{one}\n{other}\n{one} x y {other} x z".encode(), np.uint8)
    counts = rules.text_counts(text, np.array([0, len(text)]))
    assert counts["n_dup_lines"][0] == 0 and counts["n_repeat_words"][0] == 0
    docs = table(spark, [one, other])
    rows = sentencepieces.encoded(docs, sentencepieces.load("/opt/tokenizers/piece_bpe_32k.model"), keep_ids=True).collect()
    assert all(r.round_trip for r in rows) and len({r.ids_digest for r in rows}) == 2
