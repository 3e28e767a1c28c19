"""Toxicity by two class-conditional Kneser-Ney models over letters.

Words (letters and digits, lower-cased A-Z) are sequences of bytes between a start and an end sign, so that inflected and invented forms of
a toxic word are known by their stems. For each class c the model is

    P_c(x | context) = (max(n_c(context x) - D, 0) + D k_c(context) P(x | shorter context)) / n_c(context)

with the four bytes before x, or the word's beginning, as context, n_c the number of training texts of the class (a word counts once for a
text, equal texts count once), k_c the different x after the context. The shorter contexts belong to both classes: P backs off through
shared continuation counts, the number of different bytes that precede a sequence. A context without counts in one class is left to the shared
model whole. Where neither class knows a sequence the shared probability cancels out of the comparison.

A toxic text is an ordinary one with toxic words in between: under it a word has likelihood (1 - EPSILON) P_0 + EPSILON P_1, under an ordinary
one P_0. The sum of the words' log ratios is normalised by the length (divided by the root of the number of words, the growth of its noise) and
brought to a probability by a logistic curve, which is fitted on labelled rows that the models beside it have not seen.

The models are fitted on a bounded sample of the labelled rows: about `most_rows` for each class, chosen by a hash of doc_id, none of them held
out; at most MOST_GRAMS letter sequences are kept, the most frequent ones. Every whole text is scored.

Defined cases: a null text counts as empty; a text without words has the score of no evidence; labels that contradict each other for one doc_id
count as 0; without labels every score is 0, with labels of one class alone their value; repeated rows are scored alike; a null
doc_id is not held out and never trains; columns named held_out, score or predicted are replaced; an empty table gives an empty result. Long
texts are looked at in parts of about a megabyte, cut between words; a run of more than LONGEST_WORD bytes without a separator is cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Segment, Words, sampled, segments, small_batches, table_of_bytes

#: Bytes of a sequence, the context's and the predicted one.
ORDER = 5
EPSILON, DISCOUNT = 0.02, 0.75
MOST_GRAMS, LONGEST_WORD = 1 << 18, 1 << 20
_TABLE = table_of_bytes("alnum", lower=True)
_START, _END = 1, 2
#: Slope and offset of the curve before any label is seen, and the weight of that belief.
_PRIOR, _BELIEF = np.array([5.0, -6.0]), 0.01


def fold5(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is the held-out part. Null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def letter_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words, and their ends: the word, and the sequence that ends there, its bytes as one number."""
    size = end - start + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - first[word]
    letters = np.zeros(len(word), np.int64)
    inner = (place > 0) & (place < size[word] - 1)
    letters[inner] = _TABLE[raw[(start[word] + place - 1)[inner]]]
    letters[first], letters[first + size - 1] = _START, _END
    key = letters.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(place[k:] >= k, letters[:-k] << (8 * k), 0)
    told = place > 0
    return word[told], key[told]


class Model(NamedTuple):
    """Log ratios toxic / ordinary of known sequences, and of any other byte after known contexts; keys are sorted."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    other: np.ndarray

    def word_ratios(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log P_1 - log P_0 of each word."""
        word, key = letter_keys(raw, start, end)
        found, known = _looked_up(self.grams, self.ratio, key)
        after, _ = _looked_up(self.contexts, self.other, key >> 8)
        return np.bincount(word, weights=np.where(known, found, after), minlength=len(start))


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    known = keys[at] == asked
    return np.where(known, values[at], 0.0), known


def _shared(grams: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length below ORDER the sequences that something precedes, sorted, and P(last byte | the bytes before)."""
    length = (np.frexp(grams.astype(np.float64))[1] + 7) // 8
    some, counted = np.zeros(0, np.int64), {}
    for n in range(ORDER, 1, -1):
        some = np.union1d(grams[length == n], some)
        some, count = np.unique(some & ((1 << 8 * (n - 1)) - 1), return_counts=True)
        counted[n - 1] = (some, count)
    found, shorter = {}, (np.zeros(1, np.int64), np.full(1, 1 / 256))
    for n in range(1, ORDER):
        keys, count = counted[n]
        _, slot = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.bincount(slot, weights=count), np.bincount(slot)
        below = shorter[1][np.searchsorted(shorter[0], keys & ((1 << 8 * (n - 1)) - 1))]
        found[n] = shorter = (keys, (count - DISCOUNT + DISCOUNT * kinds[slot] * below) / total[slot])
    return found


def build(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The model of sorted sequences with their counts in both classes."""
    seen = toxic + ordinary > 0
    grams, counts = grams[seen], (ordinary[seen].astype(float), toxic[seen].astype(float))
    shared, below = _shared(grams), np.zeros(len(grams))
    length = (np.frexp(grams.astype(np.float64))[1] + 7) // 8
    for n in range(2, ORDER + 1):
        of = length == n
        keys, p = shared[n - 1]
        below[of] = p[np.searchsorted(keys, grams[of] & ((1 << 8 * (n - 1)) - 1))]
    contexts, slot = np.unique(grams >> 8, return_inverse=True)
    logs, others = [], []
    for n in counts:
        total, kinds = np.bincount(slot, weights=n), np.bincount(slot, weights=n > 0)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(n - DISCOUNT, 0) / np.maximum(total[slot], 1) + left[slot] * below
        logs.append(np.log(p))
        others.append(np.log(left))
    return Model(grams, (logs[1] - logs[0]).astype(np.float32), contexts, (others[1] - others[0]).astype(np.float32))


def _distinct_words(part: Segment, by_text: bool) -> tuple[np.ndarray, Words, np.ndarray]:
    """The words of the parts; the index of one word for each different one (of a text); which of these each word is."""
    words = Words(part.raw, part.offsets, _TABLE)
    told = words.hash + (words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if by_text else np.uint64(0))
    _, at, which = np.unique(told, return_index=True, return_inverse=True)
    return at, words, which


def evidence(model: Model, part: Segment) -> tuple[np.ndarray, np.ndarray]:
    """For each part of a text the sum of its words' log ratios, ordinary text with toxic words against ordinary text, and its words."""
    at, words, which = _distinct_words(part, by_text=False)
    ratio = model.word_ratios(part.raw, words.start[at], words.end[at])
    each = np.log1p(EPSILON * np.expm1(np.minimum(ratio, 50.0)))
    return words.per_doc(each[which]), words.per_doc()


def _evidence_of_rows(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
    for part in segments(batch, _TABLE, unbroken=LONGEST_WORD):
        some, count = evidence(model, part)
        np.add.at(total, part.row, some)
        np.add.at(n, part.row, count)
    return total / np.sqrt(np.maximum(n, 1))


def logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slope and offset by Newton's method, drawn a little towards _PRIOR."""
    rows, w = np.stack([x, np.ones(len(x))], axis=1), _PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        g = rows.T @ (p - label) + _BELIEF * (w - _PRIOR)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + _BELIEF * np.eye(2), g)
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    # more evidence never lowers a score
    return np.array([max(w[0], 1e-3), w[1]])


class Fitted(NamedTuple):
    model: Model | None
    slope: float
    offset: float
    prior: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.model is None:
            return np.full(batch.num_rows, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * _evidence_of_rows(self.model, batch) + self.offset, -40, 40)))


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, label: str = "toxic") -> Fitted:
    """The models and the curve. About `most_rows` labelled rows of each class are seen, none of them held out."""
    spark = docs.sparkSession
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold5(F.col("doc_id")) != 0))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(label) > 0).cast("int").alias("label"))
    rows = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(rows) < 2:
        return Fitted(None, 0.0, 0.0, float(max(rows, default=0)))
    one, other = (sampled(marks.filter(F.col("label") == c), F.col("doc_id"), most_rows, rows[c]) for c in (0, 1))
    matched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(one.unionByName(other)), "doc_id")
    # equal texts count once; the least doc_id decides on which side of the calibration they are
    texts = matched.groupBy("text").agg(F.min("label").alias("label"), (F.crc32(F.min("doc_id").cast("string").cast("binary")) % 5 == 4).alias("kept_back"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = (2 * batch.column("kept_back").cast(pa.int32()).to_numpy(zero_copy_only=False) + batch.column("label").to_numpy()).astype(np.int64)
            for part in segments(batch, _TABLE, unbroken=LONGEST_WORD):
                at, words, _ = _distinct_words(part, by_text=True)
                word, key = letter_keys(part.raw, words.start[at], words.end[at])
                told, n = np.unique(key << 2 | side[part.row[words.doc[at]]][word], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(told >> 2), pa.array((told & 3).astype(np.int32)), pa.array(n)], names=["gram", "side", "n"])

    sums = {f"n{s}": F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(4)}
    table = texts.select("text", "label", "kept_back").mapInArrow(count, "gram long, side int, n long").groupBy("gram").agg(*sums.values())
    found = table.orderBy((F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")).desc(), "gram").limit(MOST_GRAMS).toArrow().sort_by("gram")
    grams, (o, t, o_back, t_back) = found.column("gram").to_numpy(), (found.column(f"n{s}").to_numpy() for s in range(4))
    beside = spark.sparkContext.broadcast(build(grams, t, o))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_evidence_of_rows(beside.value, batch)), batch.column("label")], names=["x", "label"])

    points = texts.filter("kept_back").select("text", "label").mapInArrow(measure, "x double, label int").toArrow()
    order = np.lexsort((points.column("label").to_numpy(), points.column("x").to_numpy()))
    slope, offset = logistic(points.column("x").to_numpy()[order], points.column("label").to_numpy()[order])
    return Fitted(build(grams, t + t_back, o + o_back), float(slope), float(offset), 0.0)


def scored(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, cutoff: float = 0.5) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= cutoff), in place of columns so named."""
    small_batches(docs.sparkSession)
    fitted = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, most_rows))
    plain = docs.select(*(c for c in docs.columns if c not in ("held_out", "score", "predicted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted.value.scores(batch))], names=[*batch.schema.names, "score"])

    out = plain.mapInArrow(run, plain.select("*", F.lit(0.0).alias("score")).schema)
    is_out = F.coalesce(fold5(F.col("doc_id")) == 0, F.lit(False))
    return out.withColumn("held_out", is_out).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs.select("doc_id", "text"), labels, most_rows).select("doc_id", "held_out", "score", "predicted")
