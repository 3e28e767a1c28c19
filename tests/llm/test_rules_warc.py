from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orogen.llm import rules, warc

from .corpus import sentence, table, vocabulary


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in rules.SYMBOLS), dup, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    few = ["a", "b", "ab", "#x", "é", "日本", "\x00", "|"]
    texts = [None, "", " \n\t ", "a", "a b c a b c", "x\n\nx\n x\nx", "\x1c a b", "long " * 30_000] + ["".join(rng.choice(few) + rng.choice(" \n\t  ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += texts[-3:]
    got = rules.profile(table(spark, texts), rules.F.col("lang")).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)[:80]


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.25), (200, 0.0078125), (700, 0.015625)):
        for x in (0, 1, 3, n // 2, n):
            exact = float(sum(math.comb(n, k) * Fraction(p) ** k * (1 - Fraction(p)) ** (n - k) for k in range(x + 1)))
            assert rules.binomial_tail(np.array([x]), np.array([n]), p)[0] == pytest.approx(exact, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(2)
    words = vocabulary(rng)
    good = [sentence(rng, 60, words) for _ in range(1500)]
    bad = [" ".join(w + "###" for w in sentence(rng, 60, words).split()) for _ in range(100)]
    few = [sentence(rng, 60, words) + " ###" * 30 for _ in range(20)]
    docs = table(spark, good + bad + few, ["en"] * 1600 + [None] * 20)
    labels = spark.createDataFrame([(i, int(i < 1500 or i >= 1600), 0) for i in range(1620)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert all(got[i].kept for i in range(1500))
    assert not any(got[i].kept for i in range(1500, 1600))
    # too few labels for a cutoff in this stratum: nothing is rejected beyond the base rules
    assert all(got[i].kept and got[i].stratum == "und" for i in range(1600, 1620))
    chosen = rules.cutoffs(rules.profile(docs, rules.F.col("lang")), labels).collect()
    assert all(r.p_value <= 0.05 / (5 * 2) or r.cutoff == rules.BINS - 1 for r in chosen)


def test_rules_on_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judged(table(spark, []), labels).count() == 0
    assert [r.kept for r in rules.judged(table(spark, ["a b", None]), labels).collect()] == [False, False]


PAGES = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, None), (7, "http://a/\r\n3", ""), (3, "u", "é日"), (2, "http://b", "<p>same</p>"), (8, "u", "x" * 100_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra", b"p") for r in rows], "page_id long, url string, html string, header string, payload binary")


def test_archive_round_trip(spark):
    got = warc.archived(spark, pages(spark, PAGES)).collect()
    assert len(got) == len(PAGES)
    for r in got:
        html = next((h or "" for p, _, h in PAGES if p == r.page_id)).encode()
        first = min(p for p, _, h in PAGES if (h or "").encode() == html)
        assert r.payload_bytes == len(html)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))


def test_records_are_rebuilt_and_checked(spark, tmp_path):
    archive = warc.write_archive(pages(spark, PAGES), f"file://{tmp_path}/a")
    assert archive.payloads.count() == 4
    for r in warc.records_of(archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
    broken = warc.Archive(archive.payloads.withColumn("payload", warc.F.encode(warc.F.lit("other"), "UTF-8")), archive.headers)
    with pytest.raises(Exception, match="does not match its SHA-256"):
        warc.records_of(broken).collect()


def test_small_payloads_are_all_responses(spark, tmp_path):
    archive = warc.write_archive(pages(spark, PAGES), f"file://{tmp_path}/b", revisit_from=100)
    assert {r.record_type for r in warc.read_back(archive).collect()} == {"response"}
    assert warc.read_back(warc.write_archive(pages(spark, []), f"file://{tmp_path}/c")).count() == 0
