"""The near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

from orogen.llm import components, simhash

from .corpus import sentence, table, vocabulary
from .test_matches import roots_of


def jaccard(x, y):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (x, y))
    return len(x & y) / len(x | y)


def test_appended_and_replaced_blocks_are_near_copies(spark):
    rng = random.Random(31)
    words = vocabulary(rng, 3000)
    base = [sentence(rng, 300, words) for _ in range(80)]
    near = [f"{t} {sentence(rng, 69, words)}" for t in base[:40]]
    for t in base[40:]:
        w, at = t.split(), rng.randrange(20, 240)
        near.append(" ".join([*w[:at], *sentence(rng, 26, words).split(), *w[at + 26 :]]))
    assert all(0.8 <= jaccard(x, y) < 0.83 for x, y in zip(base, near, strict=True))
    kept = {r.doc_id for r in simhash.deduplicated(table(spark, base + near)).collect()}
    assert kept == set(range(80))


def test_a_bucket_is_compared_beyond_its_least_text(spark):
    rng = random.Random(32)
    words = vocabulary(rng, 3000)
    texts = [sentence(rng, 60, words)]
    for _ in range(12):
        long = sentence(rng, 120, words).split()
        # a chain: each is similar to the next one alone
        texts += [" ".join(long[k : k + 100]) for k in (0, 8, 16)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    buckets = spark.createDataFrame([(1, i, 0, len(texts)) for i in range(len(texts))], "key long, same long, lead long, size long")
    sets = simhash._shingle_sets(spark.createDataFrame(list(enumerate(texts)), "same long, text string"))
    none = spark.createDataFrame([], "node long, root long")
    want = roots_of(len(texts), links)
    for part in (5, 1024):
        got = [(r.a, r.b) for r in simhash._rest_links(buckets, sets, none, 0.8, part).collect()]
        assert roots_of(len(texts), got) == want
        assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in got)
    known = components.components(spark.createDataFrame(links[:9], "a long, b long"))
    got = [(r.a, r.b) for r in simhash._rest_links(buckets, sets, known, 0.8, 7).collect()]
    assert roots_of(len(texts), links[:9] + got) == want
    assert {r.doc_id for r in simhash.deduplicated(table(spark, texts), part=3).collect()} == set(want)


def test_the_stage_equals_brute_force_over_a_query_set(spark):
    """Near copies of every kind; recall of the links of doc_ids divisible by 20, and no text goes without a link."""
    rng = random.Random(33)
    words = vocabulary(rng, 3000)
    texts = []
    for _ in range(60):
        t = sentence(rng, rng.randint(60, 300), words).split()
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 8)):
            w = [x if rng.random() > 0.02 else "edit" for x in t]
            texts.append(" ".join([*w, *sentence(rng, len(t) // rng.randint(8, 40), words).split()][rng.randint(0, 5) :]))
    rng.shuffle(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    got, roots = simhash.near_groups(table(spark, texts).select("doc_id", "text"))
    found = {r.doc_id: r.root for r in got.join(roots, got["same"] == roots["node"], "left").collect()}
    asked = [(i, j) for i, j in links if i % 20 == 0 or j % 20 == 0]
    assert len(asked) > 20 and sum(found[i] is not None and found[i] == found[j] for i, j in asked) >= 0.99 * len(asked)
    want = roots_of(len(texts), links)
    groups = {}
    for i, r in found.items():
        groups.setdefault(r if r is not None else ("alone", i), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values())


def test_rows_are_judged_by_their_text_and_not_by_doc_id_alone(spark):
    rng = random.Random(34)
    words = vocabulary(rng, 3000)
    a, b, c = (sentence(rng, 80, words) for _ in range(3))
    texts, ids = [a, b, b.upper(), c, c, None, ""], [3, 3, 9, None, None, None, None]
    kept = simhash.deduplicated(table(spark, texts, ids=ids)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted([("3", a), ("3", b), ("None", c)])
    assert len(kept) == 4
    assert {r.doc_id for r in simhash.deduplicated(table(spark, [c, c], ids=[None, 8])).collect()} == {8}


def test_many_near_copies_of_one_text_give_rows_in_proportion(spark):
    rng = random.Random(35)
    words = vocabulary(rng, 3000)
    base = sentence(rng, 200, words).split()
    texts = []
    for _ in range(300):
        w = base.copy()
        for _ in range(2):
            w[rng.randrange(200)] = "other"
        texts.append(" ".join(w))
    assert [r.doc_id for r in simhash.deduplicated(table(spark, texts)).collect()] == [0]
