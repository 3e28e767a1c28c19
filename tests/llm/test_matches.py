from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from orogen.llm import components, decontamination, passages, simhash

from .corpus import sentence, table, vocabulary


def roots_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(5, 5)]
    want = roots_of(200, links)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {n: want[n] for n in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups_equal_brute_force(spark):
    rng = random.Random(8)
    words = vocabulary(rng)
    base = [sentence(rng, 150, words) for _ in range(8)]
    texts = [None, "", "  \n", "A b", "a B", "ÀB c", "w " * 20_000]
    for t in base:
        texts += [t, t.upper(), *(" ".join(w if rng.random() > 0.006 else "new" for w in t.split()) for _ in range(8))]
    got = {r.doc_id: r for r in simhash.grouped(table(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert [got[i].component_id for i in range(len(texts))] == roots_of(len(texts), links)
    assert simhash.grouped(table(spark, [])).count() == 0
    both = simhash.grouped(table(spark, ["a b", "a b", "a b"], ids=[4, None, 4])).collect()
    assert sorted(str(r.doc_id) for r in both) == ["4", "4", "None"] and {r.component_id for r in both} == {4}


def test_dense_buckets_give_the_same_groups(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    values = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 7))) for s in seeds for _ in range(30)})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius in (3, 4):
        want = roots_of(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius])
        for dense in (2, 10**6):
            found = {r.node: r.root for r in components.components(simhash.links(fps, radius, dense)).collect()}
            groups = {}
            for k, v in enumerate(signed):
                groups.setdefault(found.get(v, v), set()).add(k)
            brute = {}
            for k, r in enumerate(want):
                brute.setdefault(r, set()).add(k)
            assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in brute.values()}


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = random.Random(10)
    words = vocabulary(rng, 2000)
    base = [sentence(rng, 200, words) for _ in range(12)]
    near = [" ".join(["changed", *t.split()[1:]]) for t in base[:6]]
    texts = base + base[:4] + near + [None, "", "", "short one"]
    kept = {r.doc_id for r in simhash.deduplicated(table(spark, texts)).collect()}
    assert kept == set(range(12)) | {22, 25}
    assert simhash.deduplicated(table(spark, texts)).columns == table(spark, texts).columns
    assert simhash.deduplicated(table(spark, [])).count() == 0
    assert simhash.deduplicated(table(spark, ["a", "b", "b"], ids=[None, 3, 3])).count() == 2


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_equals_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert decontamination.lcs(a, b)[0] == plain_lcs(a, b)


def benchmark(spark, texts):
    return spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def test_benchmark_items_are_found(spark):
    rng = random.Random(12)
    words = vocabulary(rng, 3000)
    items = [sentence(rng, n, words) + "." for n in (14, 25, 40, 60, 35)]
    clean = [sentence(rng, 300, words) for _ in range(60)]
    put = lambda item: f"{sentence(rng, 90, words)} {item} {sentence(rng, 120, words)}"
    reworded = " ".join(w if k % 7 else f"{w} so" for k, w in enumerate(items[2].split()))
    texts = clean + [put(i) for i in items[:4]] + [items[4].upper() + "!!", put(reworded), None, "", put(items[0]) * 40]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, texts), benchmark(spark, [*items, None, ""])).collect()}
    assert got == {(60, 100), (61, 101), (62, 102), (63, 103), (64, 104), (65, 102), (68, 100)}
    left = {r.doc_id for r in decontamination.decontaminated(table(spark, texts), benchmark(spark, items)).collect()}
    assert left == set(range(60)) | {66, 67}


def test_decontamination_of_empty_tables(spark):
    assert decontamination.contaminated(table(spark, []), benchmark(spark, ["a b c d e f g h i"])).count() == 0
    assert decontamination.contaminated(table(spark, ["a b c"]), benchmark(spark, [])).count() == 0


def test_compact_windows_cover_all_subsequences():
    rng = np.random.default_rng(13)
    value = rng.permutation(60).astype(np.uint64) << np.uint64(40)
    first, size = np.array([0, 25]), np.array([25, 35])
    i, c, j = passages.compact_windows(value, first, size, 6)
    for lo, hi in ((0, 25), (25, 60)):
        for a in range(lo, hi):
            if a + 6 <= hi:
                at = a + int(value[a : a + 6].argmin())
                assert ((i <= a) & (c == at) & (j >= a + 5)).sum() == 1
    # a node is the minimum of all that it reaches over
    assert all(value[x : z + 1].min() == value[y] for x, y, z in zip(i, c, j, strict=True))


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(14)
    words = vocabulary(rng, 3000)
    line = sentence(rng, 9, words)
    parts = [sentence(rng, n, words) for n in (51, 55, 70, 120)]
    texts = [f"{line} {sentence(rng, 120, words)}" for _ in range(30)]
    for p in parts:
        texts += [f"{sentence(rng, rng.randint(0, 80), words)} {p} {sentence(rng, rng.randint(0, 80), words)}" for _ in range(3)]
    many = sentence(rng, 60, words)
    texts += [f"{sentence(rng, 70, words)} {many} {sentence(rng, 30, words)}" for _ in range(25)]
    edited = sentence(rng, 200, words)
    texts += [edited, " ".join("other" if k == 100 else w for k, w in enumerate(edited.split())), None, "", parts[0][:40], "same " * 3000]
    got = passages.repeated_passages(table(spark, texts)).collect()
    runs = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(d)
    linked = roots_of(len(texts), [(r.doc_id, r.match_doc_id) for r in got])
    for docs in runs.values():
        assert len({linked[d] for d in docs}) == 1, docs
    assert {x for r in got for x in (r.doc_id, r.match_doc_id)} == {d for docs in runs.values() if len(docs) > 1 for d in docs}
    assert all(r.last_word - r.first_word >= 44 and r.similarity >= 0.8 for r in got)
    assert passages.repeated_passages(table(spark, [])).count() == 0
