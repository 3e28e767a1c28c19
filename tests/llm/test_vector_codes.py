"""Codes against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from orogen.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int, error long, code string"


def plain(rows, entries=256, rounds=4):
    """The contract, one distance after the other."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    each = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * each : (p + 1) * each]
    first = sorted((i, v) for i, v, _ in kept if i is not None)
    first = [v for k, (i, v) in enumerate(first) if not k or first[k - 1][0] != i][:entries]
    books = [[cut(v, p) for v in first] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, some in members.items():
                books[p][k] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    told = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(4)]
        told.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for *_, error, label in told:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in told), key=repr)


def ours(spark, rows):
    table = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)
    return sorted((tuple(r) for r in vectorcodes.compressed(table).collect()), key=repr)


@pytest.mark.parametrize(("size", "spread"), [(1, 1.0), (290, 1.0), (290, 3e3), (60, 4e8)])
def test_equals_plain_integers(spark, size, spread):
    rng = random.Random(size)
    rows = [(rng.randint(0, 10**9), [rng.gauss(0, spread) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(size)]
    # repeated rows, ties between equal vectors, no vec_id, unusable vectors
    rows += rows[:20] + [(10**10 + k, rows[0][1], 3) for k in range(5)] + [(None, rows[-1][1], None)]
    rows += [(-5, None, 1), (-4, [None] + [0.0] * 7, 1), (-3, [math.nan] * 8, 1), (-2, [-math.inf] + [0.0] * 7, None), (-1, [], 2)]
    want = plain([r for r in rows if r[1] != []])
    assert ours(spark, rows) == want


def test_floors_of_negative_means_and_unused_entries(spark):
    # all vectors equal: every part goes to entry 0, the others stay
    rows = [(k, [-0.0004] * 4, 1) for k in range(3)] + [(9, [-0.9] * 4, 1), (10, [-0.8] * 4, 1)]
    assert ours(spark, rows) == plain(rows)


def test_empty_table_and_odd_lengths(spark):
    assert ours(spark, []) == [] and ours(spark, [(1, None, 1), (2, [math.nan] * 4, 1)]) == []
    with pytest.raises(ValueError, match="equal parts"):
        ours(spark, [(1, [1.0, 2.0, 3.0], 1)])


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(13)
    for most in (10, 1 << 26, 1 << 29, 1 << 40):
        x, c = rng.integers(-most, most, (40, 16)), rng.integers(-most, most, (30, 16))
        exact = x.astype(object) @ c.astype(object).T
        assert [[v % (1 << 64) for v in row] for row in exact] == [[int(v) % (1 << 64) for v in row] for row in vectorcodes.products(x, c)]
        assert all((sum(part.astype(object) * (1 << 24 * k) for k, part in enumerate(vectorcodes.limbs(x, 24))) == x).ravel())


def test_distances_past_a_long_are_refused_or_exact(spark):
    x = np.array([[1 << 40, 0, 0, 0], [-(1 << 40), 1, 0, 0]])
    entry, least = vectorcodes.nearest(x, np.array([[1 << 40, 0, 0, 3], [-(1 << 40), 0, 0, 0]]))
    assert entry.tolist() == [0, 1] and [int(d) for d in least] == [9, 1]
    with pytest.raises(ArithmeticError):
        vectorcodes.integers(np.array([[1e30]]))
