"""Phrases against counts of all phrases of all texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from orogen.llm import phrases

from .corpus import table, vocabulary


def plain(rows, threshold, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    kept = {key: a for key, a in f.items() if a >= threshold and len(key[1]) > 1}
    longest: dict = {}
    for (lang, p), a in kept.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = (lang, p[i : i + k])
                longest[key] = max(longest.get(key, 0), a)
    told = []
    for (lang, p), a in kept.items():
        if 100 * longest.get((lang, p), 0) >= 80 * a:
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        told.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in told if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def corpus(seed: int, n: int):
    rng = random.Random(seed)
    words, rows = vocabulary(rng, 60), []
    stock = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(8)]
    for _ in range(n):
        some = []
        for _ in range(rng.randint(1, 60)):
            some.append(rng.choice(stock) if rng.random() < 0.2 else rng.choice(words[: rng.randint(3, 60)]))
            some.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]))
        rows.append((rng.choice(["en", "de", None]), "".join(some)))
    # ties, letters of several bytes, capitals, runs of one word, nothing
    rows += [("en", "X y x Y x y x y"), ("fr", "é ü é ü é ü. É ü"), ("de", "ja " * 40), (None, None), (None, ""), ("en", " \t.,;")] * 4
    return rows + rows[:10]


def test_equals_counts_of_everything(spark):
    rows = corpus(1, 120)
    docs = table(spark, [t for _, t in rows], [lang for lang, _ in rows])
    got = sorted(tuple(r) for r in phrases.collocations(docs, threshold=5).collect())
    want = plain(rows, 5)
    assert got == want and len(want) > 40


def test_first_ones_alone(spark):
    rows = corpus(4, 80)
    docs = table(spark, [t for _, t in rows], [lang for lang, _ in rows])
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=7, threshold=4).collect()) == plain(rows, 4, 7)


def test_long_texts_are_cut_without_loss(spark):
    rng = random.Random(9)
    words = vocabulary(rng, 30)
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", "]) for _ in range(500_000))
    assert len(text) > 2 * phrases.segments.__globals__["PIECE_BYTES"]
    rows = [("en", text), ("en", "w" * 3_000_000 + " a b a b a b a b")]
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, [t for _, t in rows], ["en"] * 2), threshold=30).collect())
    assert got == plain(rows, 30)


def test_shared_slots_start_early_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLOT_BITS", (4, 4))
    rows = corpus(5, 80)
    docs = table(spark, [t for _, t in rows], [lang for lang, _ in rows])
    assert sorted(tuple(r) for r in phrases.collocations(docs, threshold=6).collect()) == plain(rows, 6)


def test_empty_table(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [None, "", "one two"])).count() == 0


def test_a_phrase_waits_for_both_subphrases():
    block = b"\na b c"
    since = np.full(1 << 18, 255, np.uint8)
    found = {k: [p.as_py() for p in some] for k, some, *_ in phrases._counted(block, 3, b"en", 0, since, 18)}
    assert found == {1: ["a", "b", "c"]}
    values = next(phrases._counted(block, 3, b"en", 0, since, 18))[2]
    since[(values[:2] >> np.uint64(46)).astype(int)] = [0, 2]
    assert [k for k, *_ in phrases._counted(block, 3, b"en", 2, since, 18)] == [1]
    found = {k: ([p.as_py() for p in some], until.tolist()) for k, some, _, _, until in phrases._counted(block, 3, b"en", 3, since, 18)}
    assert found[2] == (["a b"], [3 + phrases.SHARDS])
    assert [k for k, *_ in phrases._counted(block, 3, b"en", 7, since, 18)] == []


def test_many_small_texts_make_one_block_of_a_lang(spark):
    rng = random.Random(7)
    words = vocabulary(rng, 40)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice(words) for _ in range(6))) for _ in range(2500)]
    docs = table(spark, [t for _, t in rows], [lang for lang, _ in rows]).coalesce(1)
    phrases.small_batches(spark)
    found = phrases.blocks(docs).collect()
    assert sorted(r["lang"] for r in found) == ["de", "en"] and sum(r["own"] for r in found) == 15_000
    # a scan sends no phrases, only their hashes
    scan = phrases._scan(phrases.blocks(docs), 0, np.full(1 << 18, 255, np.uint8), 18)
    assert scan.columns == ["hash", "until", "n"] and scan.count() == 80


def test_phrases_of_four_words_that_share_a_slot_with_shorter_ones(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLOT_BITS", (6, 6))
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    rows = corpus(11, 150)
    docs = table(spark, [t for _, t in rows], [lang for lang, _ in rows])
    want = plain(rows, 4)
    assert sorted(tuple(r) for r in phrases.collocations(docs, threshold=4).collect()) == want and any(len(r[2].split()) == 4 for r in want)
