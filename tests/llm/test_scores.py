from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np

from orogen.llm import classifier, langid, ngrams

from .corpus import sentence, table, vocabulary


def brute_scores(texts, order, least):
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(tuple(w[i : i + k]) for w in words for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, words))

    def one(w, i, k):
        gram = tuple(w[i - k + 1 : i + 1])
        if k == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else math.log(0.4) + one(w, i, k - 1)

    return [sum(one(w, i, min(order, i + 1)) for i in range(len(w))) for w in words]


def test_backoff_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(ngrams, "BUCKET_BYTES", 2500)
    rng = random.Random(3)
    words = ["The", "the", "of", "a", "b", "c", "rare1", "é"] + vocabulary(rng, 60)
    texts = [None, "", " \n ", "one", "the the the"] + [sentence(rng, rng.randint(1, 80), words) for _ in range(60)] + ["x " * 3000]
    texts += texts[-2:]
    for order in (1, 2, 3):
        got = {r.doc_id: r for r in ngrams.scores(table(spark, texts), order=order).collect()}
        for i, want in enumerate(brute_scores(texts, order, 2)):
            assert abs(got[i].log_score - want) < 1e-4 * max(1, abs(want)), (order, i)
            assert got[i].n_words == len((texts[i] or "").split())
    assert got[1].mean_log_score is None
    assert ngrams.scores(table(spark, [])).count() == 0


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (ngrams.unpack(ngrams.pack(x), np.uint64) == x).all()


def test_languages_on_held_out_texts(spark):
    rng = random.Random(4)
    kinds = {"aa": vocabulary(rng, 200, "aeioukst"), "bb": vocabulary(rng, 200, "bdgmnrzu"), "cc": vocabulary(rng, 200, "éèàçñü")}
    langs = [rng.choice(list(kinds)) for _ in range(300)]
    texts = [sentence(rng, rng.randint(5, 60), kinds[x]) for x in langs] + [None, "", "123 ...", "ab" * 50_000]
    langs += [None, "aa", "bb", None]
    got = {r.doc_id: r for r in langid.predicted(table(spark, texts, langs)).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (300, 301, 302))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_vector_is_the_sum_of_bound_letters():
    g = {c: langid.letter_vectors(np.array([c]))[0] for c in (0, ord("a"), ord("b"))}
    a, b, gap = g[ord("a")], g[ord("b")], g[0]
    bound = lambda x, y, z: x * np.roll(y, 1) * np.roll(z, 2)
    found, has = langid.vectors(["Ab", ""])
    assert has.tolist() == [True, False]
    assert np.allclose(found[0], bound(gap, a, b) + bound(a, b, gap))


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in langid.predicted(table(spark, ["abc"])).collect()} == {"und"}
    assert langid.predicted(table(spark, [])).count() == 0


def test_machine_separates_held_out_texts(spark):
    rng = random.Random(5)
    words = vocabulary(rng)
    quality = [int(rng.random() < 0.8) for _ in range(500)]
    texts = [sentence(rng, rng.randint(30, 90), words) if q else " ".join(w.upper() + "!!" for w in sentence(rng, 40, words[:5]).split()) for q in quality] + [None, "", "x" * 200_000]
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)] + [(0, quality[0], 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.quality_scores(table(spark, texts), labels).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == quality[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.quality_scores(table(spark, ["a", None]), none).collect()} == {0.5}
    assert classifier.quality_scores(table(spark, []), labels).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(6)
    doc, feature, value = np.repeat([0, 1], 5), np.tile(np.arange(5), 2), rng.random(10)
    linear, pairs = rng.random(5), rng.random((5, 3))
    got, _ = classifier.raw_scores(doc, feature, value, 2, 0.5, linear, pairs)
    for d in range(2):
        x = value[doc == d]
        want = 0.5 + x @ linear + sum(pairs[i] @ pairs[j] * x[i] * x[j] for i in range(5) for j in range(i))
        assert abs(got[d] - want) < 1e-12


def test_a_text_of_many_different_letters_is_bundled_in_bounded_memory(spark):
    import tracemalloc

    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 500_000)))
    langid.vectors(["warm up"])
    tracemalloc.start()
    found, has = langid.vectors([text, "kurz"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert has.all() and peak < 500e6
    parts = sum(langid.vectors([text[k : k + langid._CUT]])[0][0] for k in range(0, len(text), langid._CUT))
    assert np.allclose(found[0], parts)


def test_the_stage_keeps_columns_that_the_machine_has_too(spark):
    rows = [(i, "fine words of prose " * 9 if i % 2 else "### buy |", -7.0, 3, "mine") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, held_out string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    kept = classifier.accepted(docs, labels)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert got and {(r.score, r.predicted, r.held_out) for r in got} == {(-7.0, 3, "mine")} and all(r.doc_id % 2 for r in got)
