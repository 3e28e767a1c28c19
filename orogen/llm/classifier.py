"""Factorisation machine for quality: hashed words, structure statistics and metadata, pairs scored in linear time.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)). The machine is fitted on a bounded
sample of labelled rows (`most_rows`, 12,000 by default) and scores every whole text. Metadata are the sizes of the text
alone: lang, source, doc_id and labels are never inputs.

Defined cases: a null text counts as empty and is scored by its (zero) statistics; labels that contradict each other for one
doc_id count as 0; without any usable labels every score is 0.5; repeated rows are scored alike; a null doc_id is not held out
and never trains; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import _run_sums, text_counts
from .shared import Words, fold_of, held_out, pieces, sampled, small_batches, table_of_bytes

#: Hashed words have the features 0 to WORDS - 1; the statistics follow, each cut into STEPS intervals.
WORDS, STEPS = 1 << 15, 16
STATISTICS = ("symbols", "capitals", "digits", "marks", "dup_lines", "repeats", "word_length", "lines", "size", "words", "bars", "distinct")
FEATURES = WORDS + STEPS * len(STATISTICS)
RANK = 8


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, feature and value of the non-zero features of some texts, in order of doc."""
    n, first, stop = len(offsets) - 1, offsets[:-1], offsets[1:]
    words = Words(raw, offsets, table_of_bytes("alnum", lower=True))
    key, count = np.unique(words.doc * WORDS + (words.hash >> np.uint64(40)).astype(np.int64) % WORDS, return_counts=True)
    doc, value = key // WORDS, np.log1p(count).astype(np.float32)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n))
    value /= np.maximum(norm, 1e-9)[doc]
    counts = text_counts(raw, offsets)
    size, total = (stop - first).astype(float), counts["n_words"].astype(float)
    per = lambda a, b: a / np.maximum(b, 1.0)
    bytes_in = lambda chosen: _run_sums(np.isin(raw, np.frombuffer(chosen, np.uint8)), first, stop)
    shares = {
        "symbols": per(counts["n_symbols"], total),
        "capitals": per(counts["n_capitals"], counts["word_chars"]),
        "digits": per(bytes_in(b"0123456789"), size),
        "marks": per(bytes_in(b"!?;:@=\"'_"), total),
        "dup_lines": per(counts["n_dup_lines"], counts["n_lines"]),
        "repeats": per(counts["n_repeat_words"], total),
        "word_length": per(counts["word_chars"], total) / 16,
        "lines": per(counts["n_lines"], total),
        "size": np.log1p(size) / 14,
        "words": np.log1p(total) / 14,
        "bars": per(bytes_in(b"|"), total),
        "distinct": 1 - per(np.bincount(doc, minlength=n), total),
    }
    levels = np.stack([np.clip((np.sqrt(np.clip(shares[s], 0, 1)) * STEPS).astype(np.int64), 0, STEPS - 1) for s in STATISTICS], axis=1)
    extra = WORDS + np.arange(len(STATISTICS)) * STEPS + levels
    where = np.repeat(np.arange(n), len(STATISTICS))
    doc, feature = np.concatenate([doc, where]), np.concatenate([key % WORDS, extra.ravel()])
    value = np.concatenate([value, np.full(len(where), 0.5, np.float32)])
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], value[order]


def raw_scores(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, bias: float, linear: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine before the sigmoid, and sum_i v_if x_i. Each text has at least the statistics, so reduceat sees no empty run."""
    runs = np.searchsorted(doc, np.arange(n))
    x = value[:, None] * pairs[feature]
    sums = np.add.reduceat(x, runs, axis=0)
    squares = np.add.reduceat((x * x).sum(axis=1), runs)
    return bias + np.add.reduceat(value * linear[feature], runs) + ((sums * sums).sum(axis=1) - squares) / 2, sums


def fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, least_epochs: int = 6, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, AdaGrad, batches in a fixed random order; few rows are seen more often, up to 80 times."""
    epochs = max(least_epochs, min(80, 1500 * batch // max(1, len(label))))
    rng = np.random.default_rng(10)
    linear, pairs = np.zeros(FEATURES, np.float32), (rng.standard_normal((FEATURES, RANK)) * 0.02).astype(np.float32)
    seen_l, seen_p, bias, seen_b = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32), 0.0, 1e-2
    bounds = np.append(np.searchsorted(doc, np.arange(len(label))), len(doc))
    for _ in range(epochs):
        shuffled = rng.permutation(len(label))
        for at in range(0, len(label), batch):
            rows = shuffled[at : at + batch]
            index = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            f, v = feature[index], value[index]
            z, sums = raw_scores(local, f, v, len(rows), bias, linear, pairs)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]).astype(np.float32) / len(rows)
            used, slot = np.unique(f, return_inverse=True)
            step = error[local] * v
            g = np.bincount(slot, weights=step, minlength=len(used)).astype(np.float32) + decay * linear[used]
            seen_l[used] += g * g
            linear[used] -= rate * g / np.sqrt(seen_l[used])
            each = step[:, None] * (sums[local] - v[:, None] * pairs[f])
            g = np.stack([np.bincount(slot, weights=each[:, k], minlength=len(used)) for k in range(RANK)], axis=1).astype(np.float32) + decay * pairs[used]
            seen_p[used] += g * g
            pairs[used] -= rate * g / np.sqrt(seen_p[used])
            g = float(error.sum())
            seen_b += g * g
            bias -= rate * g / seen_b**0.5
    return bias, linear, pairs


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, label: str = "quality") -> tuple[float, np.ndarray, np.ndarray] | None:
    """The machine, or None if there are no labels. `most_rows` bounds the labelled rows that it sees; none of them is held out.

    The chosen labels are few by that bound, so they go to where the texts are; the texts' features meet in one task, which the
    bound holds to some ten thousand texts. Of rows with one doc_id the smallest text counts.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    chosen = sampled(marks, F.col("doc_id"), most_rows, marks.count())
    matched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one_each = matched.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in pieces(batch):
                doc, feature, value = features(raw, offsets)
                cuts = np.append(np.searchsorted(doc, np.arange(part.num_rows)), len(doc)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(cuts, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value))], names=["doc_id", "label", "feature", "value"]
                )

    def learn(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("doc_id", ignore_index=True)
        doc = np.repeat(np.arange(len(found)), found["feature"].map(len))
        bias, linear, pairs = fit(doc, np.concatenate(found["feature"]).astype(np.int64), np.concatenate(found["value"]).astype(np.float32), found["label"].to_numpy(np.float32))
        return pd.DataFrame({"bias": [bias], "linear": [linear.astype("<f4").tobytes()], "pairs": [pairs.astype("<f4").tobytes()]})

    rows = one_each.select("doc_id", "text", "label").mapInArrow(numbers, "doc_id long, label int, feature array<int>, value array<float>")
    got = rows.groupBy().applyInPandas(learn, "bias double, linear binary, pairs binary").collect()
    if not got:
        return None
    return got[0]["bias"], np.frombuffer(got[0]["linear"], "<f4"), np.frombuffer(got[0]["pairs"], "<f4").reshape(FEATURES, RANK)


def scored(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, cutoff: float = 0.7) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= cutoff), in place of columns so named. The machine's size is fixed: FEATURES * (RANK + 1) numbers."""
    small_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, most_rows))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    plain = docs.select(*kept)
    schema = plain.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in pieces(batch):
                score = np.full(part.num_rows, 0.5)
                if machine.value is not None:
                    doc, feature, value = features(raw, offsets)
                    z, _ = raw_scores(doc, feature, value, part.num_rows, *machine.value)
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score.astype(np.float64))], names=[*part.schema.names, "score"])

    out = plain.mapInArrow(run, schema)
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """The rows of docs that the machine predicts 1 for, with their own columns, whatever these are named."""
    own = [c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
    told = scored(docs.toDF(*own), labels, most_rows).filter("predicted = 1")
    return told.select(*own).toDF(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs.select("doc_id", "text"), labels, most_rows).select("doc_id", "held_out", "score", "predicted")
