"""The table of started phrases takes half a byte a slot and goes from the tasks after each scan."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.core.broadcast import Broadcast

from orogen.llm import phrases

from .corpus import table


def test_half_bytes_hold_every_scan():
    rng = np.random.default_rng(1)
    slots = rng.integers(0, 16, 1 << 16).astype(np.uint8)
    halves = phrases._halves(slots)
    assert halves.nbytes == len(slots) // 2 and (phrases._bits(halves) == slots).all()
    some = rng.integers(0, len(slots), 1000)
    assert (phrases._Table(halves)[some] == slots[some]).all()
    # the last scan in which a phrase that a longer one follows can reach the threshold
    assert phrases.SHARDS * (phrases.LONGEST - 1) - 1 < phrases._LONG < phrases._NEVER


def test_the_drivers_tables_are_small_and_do_not_stay(spark, monkeypatch):
    rng = random.Random(7)
    docs = table(spark, [" ".join(rng.choice("abcd") for _ in range(60)) for _ in range(400)], langs=["en"] * 400)
    want = sorted((r.phrase, r.n) for r in phrases.counts(docs)[0].collect())
    held, gone, destroy, bits = [], [], Broadcast.destroy, 24
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: held.append(value.nbytes) or send(self, value))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: gone.append(1) or destroy(self, blocking))
    monkeypatch.setattr(phrases, "SLOT_BITS", (bits, bits))
    tracemalloc.start()
    got = sorted((r.phrase, r.n) for r in phrases.counts(docs)[0].collect())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and any(len(p.split()) == 4 for p, _ in want)
    assert set(held) == {1 << bits - 1} and len(gone) == len(held)
    assert most < 1 << bits, most
