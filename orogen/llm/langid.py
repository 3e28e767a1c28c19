"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The letters of an n-gram are bound: the vector of the k-th letter is rotated by
k places and the vectors are multiplied. The n-grams of a text are bundled: their vectors are added. A language's prototype
bundles the unit vectors of its training texts, and a text gets the language whose prototype has the largest cosine with it.

Defined cases: a null text or one without a letter gets "und" and score 0; so does every text if nothing can be learned; equal
cosines go to the smaller name; a null lang never trains; a null doc_id is not held out and never trains; repeated rows are
judged alike; a text of any length is bundled in cuts, each of which has its own ends (two n-grams in some 260,000); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_of, held_out, pieces, sampled, small_batches

DIMENSIONS = 1024
#: n-grams seen most often in a piece are bundled by a dense product, the rest one by one.
_DENSE = 1536
#: Characters that are bundled together.
_CUT = 1 << 18
_PIECE = 1 << 20


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0, the gap between words, has one too. They follow from the code point alone."""
    return np.stack([np.random.default_rng([6, int(c)]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1 for c in letters]) if len(letters) else np.zeros((0, DIMENSIONS), np.int8)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has a letter. Three-letter n-grams, gaps between words included.

    Bundles add, so a text of more than _CUT characters is bundled cut by cut and needs no more memory than a short one.
    """
    cuts = [(k, t[at : at + _CUT]) for k, t in enumerate(texts) for at in range(0, max(1, len(t)), _CUT)]
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    first = size = 0
    for last in range(len(cuts)):
        size += len(cuts[last][1])
        if size >= _CUT or last + 1 == len(cuts):
            own = np.array([k for k, _ in cuts[first : last + 1]])
            found, some = _bundled([t for _, t in cuts[first : last + 1]])
            np.add.at(out, own, found)
            np.logical_or.at(has, own, some)
            first, size = last + 1, 0
    return out, has


def _bundled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    out, has = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, bool)
    points = np.frombuffer(" ".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    sizes = np.array([len(t) + 3 for t in texts])
    doc = np.repeat(np.arange(n), sizes)[: len(points)]
    low = _folded()[points]
    keep = (low != 0) | (np.append(0, low[:-1]) != 0)
    keep |= np.append(True, doc[1:] != doc[:-1])
    low, doc = low[keep], doc[keep]
    has[doc[low != 0]] = True
    if len(low) < 3:
        return out, has
    letters, at = np.unique(low, return_inverse=True)
    a = len(letters)
    same = (doc[2:] == doc[:-2]) & (low[1:-1] != 0)
    code = ((at[:-2] * a + at[1:-1]) * a + at[2:])[same]
    doc = doc[:-2][same]
    grams, slot, often = np.unique(code, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    slot, grams = rank[slot], grams[order]
    base = letter_vectors(letters)
    turned, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    bound = lambda g: base[g // (a * a)] * turned[g // a % a] * twice[g % a]
    v = len(grams)
    dense = min(v, _DENSE)
    often_bound = bound(grams[:dense]).astype(np.float32)
    block = max(1, (1 << 21) // v)
    for start in range(0, n, block):
        lo, hi = np.searchsorted(doc, [start, start + block])
        rows = min(block, n - start)
        counts = np.bincount((doc[lo:hi] - start) * v + slot[lo:hi], minlength=rows * v).reshape(rows, v)
        part = counts[:, :dense].astype(np.float32) @ often_bound
        r, c = np.nonzero(counts[:, dense:])
        for cut in range(0, len(r), 1 << 12):
            rr, cc = r[cut : cut + (1 << 12)], c[cut : cut + (1 << 12)] + dense
            first = np.flatnonzero(np.append(True, rr[1:] != rr[:-1]))
            part[rr[first]] += np.add.reduceat(bound(grams[cc]) * counts[rr, cc].astype(np.float32)[:, None], first, axis=0)
        out[start : start + rows] = part
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for part, _, _ in pieces(batch, most=_PIECE):
            yield part, [t or "" for t in part.column("text").to_pylist()]


def prototypes(docs: DataFrame, most_rows: int = 20_000) -> tuple[list[str], np.ndarray]:
    """The names of the languages and their unit prototypes, learned from about `most_rows` rows that are not held out.

    Each input partition adds up its own languages; Spark adds these sums. Every language of these rows has a prototype, so there are no
    more of them than rows.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    chosen = sampled(usable, F.col("doc_id"), most_rows, usable.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for part, texts in _parts(batches):
            found, has = vectors(texts)
            lang = np.array(part.column("lang").to_pylist(), dtype=object)
            for name in set(lang[has]):
                mine = has & (lang == name)
                sums[name] = sums.get(name, 0.0) + _unit(found[mine]).astype(np.float64).sum(axis=0)
                rows[name] = rows.get(name, 0) + int(mine.sum())
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "rows": [rows[k] for k in sums], "sums": [sums[k].tolist() for k in sums]})

    partial = chosen.mapInArrow(run, "lang string, rows long, sums array<double>")
    total = partial.select("lang", "rows", F.posexplode("sums").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"), F.sum("rows").alias("rows"))
    whole = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"), F.max("rows").alias("rows"))
    got = sorted(whole.collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in got], _unit(np.array([r["v"] for r in got], dtype=np.float64).reshape(len(got), DIMENSIONS)).astype(np.float32)


def predicted(docs: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 if negative) of every document."""
    small_batches(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(prototypes(docs, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = learned.value
        for part, texts in _parts(batches):
            found, has = vectors(texts)
            if names:
                cosine = _unit(found) @ known.T
                best = cosine.argmax(axis=1)
                told = np.where(has, np.array(names, dtype=object)[best], "und")
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            else:
                told, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(told.tolist(), pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
