from __future__ import annotations

import datetime
import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from orogen.llm import pii, sentencepieces
from orogen.llm.queries import PIECES

from .corpus import table


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else (2 * int(d)) // 10 + 2 * int(d) % 10 for k, d in enumerate(reversed(digits))) % 10 == 0


TEXTS = [
    "call +1 (706) 555-3138 or 706-555-3138, card 4111 1111 1111 1111 and 4644348398010899!!",
    "from 83.229.25.121 not 300.1.1.1 on 2024-02-29, 31/12/1999, never 2023-02-30",
    'mail jo.doe@mail.example.com; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
    "clean text, 12 apples and 3.14 pies; 2024",
    "", None, "again +1 (706) 555-3138 and 83.229.25.121", "x" * 100_000 + " jo.doe@mail.example.com",
]


def test_formats_are_kept_and_values_stay_linked(spark):
    got = {r.doc_id: r.text for r in pii.pseudonymised(table(spark, TEXTS), "first").collect()}
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0])
    assert phone and phone.group() != "+1 (706) 555-3138" and phone.group() in got[6]
    assert "706-555-3138" not in got[0] and re.search(r", card (\d{4} ){3}\d{4} and \d{16}!!$", got[0])
    cards = [re.sub(" ", "", m) for m in re.findall(r"(?:\d{4} ){3}\d{4}|\d{16}", got[0])]
    assert luhn(cards[0]) == luhn("4111111111111111") and luhn(cards[1]) == luhn("4644348398010899")
    ip = re.match(r"from (\S+) not 300\.1\.1\.1 on (\S+), (\S+), never 2023-02-30$", got[1])
    assert ip and all(int(o) < 256 for o in ip[1].split(".")) and ip[1] in got[6] and ip[1] != "83.229.25.121"
    assert datetime.date.fromisoformat(ip[2]) and datetime.datetime.strptime(ip[3], "%d/%m/%Y")
    assert re.fullmatch(r'mail [0-9a-f]{16}@example\.com; token = "[0-9a-f]{40}" end', got[2])
    assert [got[i] for i in (3, 4, 5)] == [TEXTS[3], "", None]
    other = {r.doc_id: r.text for r in pii.pseudonymised(table(spark, TEXTS), key="second").collect()}
    assert other[6] != got[6] and other[3] == got[3]


def test_columns_stay_and_report(spark):
    docs = table(spark, TEXTS)
    out = pii.pseudonymised(docs, "first")
    assert out.schema.fieldNames() == docs.schema.fieldNames() and out.filter("length(text) <> n_chars").count() == 0
    rows = {r.doc_id: r for r in pii.report(docs, "first").collect()}
    assert (rows[0].n_found, rows[0].kinds, rows[3].n_found, rows[5].n_found) == (4, "number,phone", 0, 0)
    assert pii.report(table(spark, []), "first").count() == 0


def test_runs_without_bound_and_all_ways_to_write_a_number(spark):
    n = 100_000
    texts = ["a@b" + ".c" * n, "a." * n + "@b.c", "1." * n, "1-" * n, "(1" * n, "token=" + "x" * n, "token=" * n, "@" * n, "+1 " * n, "12/" * n, "a@b-" * n]
    texts += ["+17065553138", "+1 706 555 3138", "+1-706-555-3138", "+44 20 7946 0958", "+442079460958", "id 123-45-6789."]
    got = [r.text for r in pii.pseudonymised(table(spark, texts), "first").orderBy("doc_id").collect()]
    digits = [re.sub("[^0-9]", "", t) for t in got[-6:]]
    assert digits[0] == digits[1] == digits[2] != "17065553138" and digits[3] == digits[4] != "442079460958"
    assert re.fullmatch(r"id \d{3}-\d{2}-\d{4}\.", got[-1]) and got[-1] != texts[-1]
    assert re.fullmatch(r"[0-9a-f]{16}@example\.com", got[0])


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 4):
        found = spark.range(10**n).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), n, "0"), "k", "t").alias("x")).distinct().collect()
        assert len(found) == 10**n and all(len(r.x) == n for r in found)
    day = F.date_add(F.lit("1999-12-25").cast("date"), F.col("id").cast("int"))
    assert spark.range(3000).select(pii.permuted_date(day, "k").alias("x")).distinct().count() == 3000
    pair = pii.feistel((F.col("id") / 12).cast("long"), F.col("id") % 12, F.lit(7), F.lit(12), "k", F.lit("t"))
    assert {(r.s.l, r.s.r) for r in spark.range(84).select(pair.alias("s")).collect()} == set(itertools.product(range(7), range(12)))


def test_plan_has_no_python(spark):
    plan = pii.report(table(spark, TEXTS), "first")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


needs_model = pytest.mark.skipif(not os.path.exists(PIECES), reason="the model file is not here")


@needs_model
def test_ids_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    known = SentencePieceProcessor(model_file=PIECES)
    model = sentencepieces.load(PIECES)
    rng = random.Random(15)
    texts = ["Hello  world\n x é中😀\t a", "", None, " ", "a" * 300 + "b" * 77, "x" * 70 + " " * 40 + "y", "日本語テキスト" * 30, "\x00q ß ﬁ"]
    texts += ["".join(rng.choice("aeinrst hoTHE.,éß01日  ") for _ in range(rng.randint(1, 120))) for _ in range(150)]
    texts += texts[-2:]
    rows = sentencepieces.encoded(table(spark, texts), model, keep_ids=True)
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == known.encode(t or ""), repr(t)
        assert got[i].round_trip and got[i].n_pieces == len(got[i].ids)
    by_shuffle = {r.doc_id: r for r in sentencepieces.encoded(table(spark, texts), model, keep_ids=True, most_broadcast=0).collect()}
    assert by_shuffle == got
    back = {r.doc_id: r.text for r in sentencepieces.decoded(rows, model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert sentencepieces.encoded(table(spark, []), model).count() == 0


def test_viterbi_equals_brute_force(spark):
    rng = random.Random(16)
    pieces = sorted({"a", "b", "c", sentencepieces.MARK, *("".join(rng.choice("abc" + sentencepieces.MARK) for _ in range(rng.randint(2, 4))) for _ in range(30))})
    model = sentencepieces.of_pieces(["<unk>", *pieces], [0.0, *(round(-rng.random() * 8, 3) for _ in pieces)], [False] + [True] * len(pieces), kind="unigram")
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def best(unit):
        ways = []
        for k in range(len(unit)):
            for cut in itertools.combinations(range(1, len(unit)), k):
                parts = [unit[a:b] for a, b in zip((0, *cut), (*cut, len(unit)), strict=True)]
                if all(p in model.ids or len(p) == 1 for p in parts):
                    ways.append(sum(model.scores[model.ids[p]] if p in model.ids else -1e6 for p in parts))
        return max(ways)

    for r in sentencepieces.encoded(table(spark, texts), model, keep_ids=True).collect():
        got = sum(model.scores[i] if i else -1e6 for i in r.ids)
        assert abs(got - sum(best(u) for u in sentencepieces.units(texts[r.doc_id]))) < 1e-6
