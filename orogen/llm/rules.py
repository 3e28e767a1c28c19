"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule rejects a text whose statistic exceeds a cutoff. Labelled good texts are the holdout: for each stratum and rule a
cutoff is admissible if the exact binomial test at level delta / (rules * strata) rules out a false rejection rate above
alpha / rules. Cutoffs of one rule are tested from the loosest to the strictest and the first failure ends the walk, so the
walk itself costs no correction; rules and strata are corrected by the union bound. With probability 1 - delta, no stratum
then loses more than alpha of its good texts. Of the admissible cutoffs that one is taken which rejects most bad texts net of
good ones, the loosest of equals; a stratum with too few labels has no cutoffs at all.

Defined cases: a null or empty text has no words and fails the base rules; a null stratum is the stratum "und"; texts of a
stratum without labels meet the base rules only; labels that contradict each other for one doc_id count as bad; repeated rows
are judged each for themselves; extra columns are ignored; without documents or labels the result is empty or base rules only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Words, mixed, pieces, table_of_bytes, written

#: Fixed by the contract: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bins of a statistic; the cutoff k rejects bins above k, the last one rejects nothing.
BINS = 64
RULES = ("symbols", "dup_lines", "repeats", "capitals", "long_words")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in SYMBOLS]] = True
    return table


def _run_sums(flags: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[stop] - sums[start]


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two flags for each (doc, value): whether it occurs at least twice, and whether an equal one came before."""
    key = mixed(value ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    again[order[1:][same]] = True
    return twice, again


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text, all at once: see _COUNTS."""
    words = Words(raw, offsets, table_of_bytes())
    n = len(offsets) - 1
    first, stop = offsets[:-1], offsets[1:]
    blank = table_of_bytes()[raw] == 0
    blank &= raw != 0
    found = {
        "n_words": words.per_doc(),
        "word_chars": _run_sums(((raw & 0xC0) != 0x80) & ~blank, first, stop),
        "n_symbols": _run_sums(_symbol_table()[raw], first, stop),
        "n_capitals": _run_sums((raw >= 65) & (raw <= 90), first, stop),
    }
    # a window of three words is known by the hash of its words
    near = words.doc[2:] == words.doc[:-2]
    grams = mixed(words.hash[:-2] + np.uint64(3) * mixed(words.hash[1:-1] + np.uint64(5) * mixed(words.hash[2:])))[near] if len(words.doc) > 2 else np.zeros(0, np.uint64)
    at = np.flatnonzero(near) if len(words.doc) > 2 else np.zeros(0, np.int64)
    twice, _ = repeated(words.doc[at], grams)
    inside = np.zeros(len(words.doc), dtype=bool)
    for k in range(3):
        inside[at[twice] + k] = True
    found["n_repeat_words"] = np.bincount(words.doc[inside], minlength=n)
    # lines: cut at \n, known by the hash of their bytes
    line_table = np.arange(256, dtype=np.uint8)
    line_table[10] = 0
    lines = Words(raw, offsets, line_table)
    with_word = _run_sums(~blank, lines.start, lines.end) > 0
    doc, value = lines.doc[with_word], lines.hash[with_word]
    _, again = repeated(doc, value)
    return found | {"n_dup_lines": np.bincount(doc[again], minlength=n), "n_lines": np.bincount(doc, minlength=n)}


def profile(docs: DataFrame, stratum: Column) -> DataFrame:
    """doc_id, stratum and the counts of every text."""
    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in pieces(batch):
                counts = text_counts(raw, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)], names=["doc_id", "stratum", *_COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(stratum.cast("string"), F.lit("und")).alias("stratum"), F.col("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    """Fixed by the contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bins() -> dict[str, Column]:
    """The bin of each rule's statistic, 0 to BINS - 1; a statistic without its denominator is 0."""
    share = lambda a, b, scale: F.least(F.floor(F.coalesce(F.try_divide(F.col(a) * F.lit(scale), F.col(b)), F.lit(0))), F.lit(BINS - 1)).cast("int")
    return {
        "symbols": share("n_symbols", "n_words", 32),
        "dup_lines": share("n_dup_lines", "n_lines", BINS),
        "repeats": share("n_repeat_words", "n_words", BINS),
        "capitals": share("n_capitals", "word_chars", BINS),
        "long_words": share("word_chars", "n_words", 2),
    }


def binomial_tail(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(Binomial(n, p) <= x), exact: the regularised incomplete beta I(1 - p; n - x, x + 1) by its continued fraction."""
    return np.array([1.0 if b >= a else _beta(1 - p, a - b, b + 1) for b, a in zip(map(int, x), map(int, n), strict=True)])


def _beta(z: float, a: float, b: float) -> float:
    if z <= 0 or z >= 1:
        return float(z >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z))
    if z > (a + 1) / (a + b + 2):
        return 1 - _fraction(1 - z, b, a) * front / b
    return _fraction(z, a, b) * front / a


def _fraction(z: float, a: float, b: float) -> float:
    """Lentz's evaluation."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * z / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def cutoffs(profiles: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff (bins above it are rejected), n_good, false_rejections, p_value of what was selected.

    The labelled profiles are counted by stratum, rule and bin before anything is gathered: one group then holds two rows for
    each bin at most.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = profiles.filter(~base_failed()).join(marks, "doc_id")
    bins = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), b.alias("bin")) for rule, b in _bins().items()))).alias("at")
    counted = known.select("stratum", "quality", bins).groupBy("stratum", "at.rule", "at.bin").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    strata = max(1, known.select("stratum").distinct().count())
    rate, level = alpha / len(RULES), delta / (len(RULES) * strata)

    def select(found: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(found["bin"], weights=found[c], minlength=BINS).astype(np.int64) for c in ("good", "bad"))
        above = lambda x: np.append(x[::-1].cumsum()[::-1][1:], 0)  # noqa: E731  rejected by each cutoff
        lost, caught = above(good), above(bad)
        p = binomial_tail(lost, np.full(BINS, good.sum()), rate)
        best = BINS - 1
        for k in range(BINS - 2, -1, -1):
            if p[k] > level:
                break
            if caught[k] / max(1, bad.sum()) - lost[k] / max(1, good.sum()) > caught[best] / max(1, bad.sum()) - lost[best] / max(1, good.sum()):
                best = k
        return pd.DataFrame({"stratum": [found["stratum"].iloc[0]], "rule": [found["rule"].iloc[0]], "cutoff": [best], "n_good": [int(good.sum())], "false_rejections": [int(lost[best])], "p_value": [float(p[best])]})

    return counted.groupBy("stratum", "rule").applyInPandas(select, "stratum string, rule string, cutoff int, n_good long, false_rejections long, p_value double")


def judged(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Every document with its counts, base_failed, kept, and rejected_by (the names of the rules it failed)."""
    profiles = written(profile(docs, F.col("lang") if stratum is None else stratum), "rules-profile")
    chosen = cutoffs(profiles, labels, alpha, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    chosen = chosen.select(F.col("stratum"), *(F.col(r).alias(f"cut_{r}") for r in RULES))
    failed = [F.when(b > F.coalesce(F.col(f"cut_{rule}"), F.lit(BINS)), F.lit(rule)) for rule, b in _bins().items()]
    return (
        profiles.join(chosen, "stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.array_compact(F.array(*failed)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .select("doc_id", *_COUNTS[:5], "base_failed", "kept", "stratum", F.concat_ws(",", "rejected_by").alias("rejected_by"))
    )
