"""Stupid-backoff language-model scores over hashed n-gram count tables.

S(w | context) = count(context w) / count(context) if the n-gram was counted at least `least` times, else 0.4 S(w | shorter
context), and count(w) / N for single words. The counts come from all texts.

The texts are dealt into chunks of bounded size by a hash of doc_id and text. Every chunk explodes its n-grams, adds up equal ones and sends
each once, to the bucket of its hash; a bucket adds up the chunks' counts (the count table of that bucket) and joins the totals
back to the n-grams that each chunk asked for; the chunk sums the scores of its documents. However frequent an n-gram is, a
bucket sees it once for each chunk. The rows that travel are sorted arrays, packed: an n-gram costs some six bytes instead of
the thirty of a row. The number of buckets and chunks grows with the bytes of text.

Defined cases: words are the runs between the separators of the shared reader, lower-cased A-Z; a null text or one without
words has n_words 0, log_score 0 and mean_log_score null; a first word has no context; repeated rows count as often as they occur;
rows with one doc_id, or none, are dealt by their texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, mixed, table_of_bytes

BACKOFF = 0.4
#: Bytes of text in a chunk, and n-grams of it in a bucket's share, on average.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 24 << 20


def pack(values: np.ndarray) -> bytes:
    """An array in zstd, its bytes transposed: the high bytes of sorted values hardly change."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel()


def _grams(words: Words, order: int) -> list[np.ndarray]:
    """For each length k = 1 .. order the hashes of the k-grams that end at each word; 0 where the text has no such k-gram."""
    found = [words.hash | np.uint64(1)]
    for k in range(2, order + 1):
        gram = np.zeros(len(words.hash), np.uint64)
        if len(gram) >= k:
            inside = words.doc[k - 1 :] == words.doc[: len(gram) - k + 1]
            # a k-gram is its first k - 1 words and its last word
            gram[k - 1 :] = np.where(inside, mixed(found[-1][k - 2 : -1] * np.uint64(3) + words.hash[k - 1 :] + np.uint64(k)) | np.uint64(1), np.uint64(0))
        found.append(gram)
    return found


def _chunk_words(table: pa.Table) -> tuple[Words, int]:
    text = table.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2] if len(text) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Words(raw, offsets - offsets[0], table_of_bytes("", lower=True)), len(text)


def _distinct(words: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [np.unique(g[g != 0], return_counts=True) for g in _grams(words, order)]


def _bucket_bounds(buckets: int) -> np.ndarray:
    """The least hash of each bucket: buckets are ranges of the hash."""
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)


def scores(docs: DataFrame, order: int = 2, least: int = 2) -> DataFrame:
    """doc_id, n_words, n_backoffs, log_score (natural logarithm, summed over the words), mean_log_score of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, buckets = total // CHUNK_BYTES + 1, total // BUCKET_BYTES + 1
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def explode(table: pa.Table) -> pa.Table:
        words, _ = _chunk_words(table)
        rows: dict[str, list] = {c: [] for c in ("chunk", "k", "bucket", "grams", "counts")}
        for k, (gram, count) in enumerate(_distinct(words, order), 1):
            cuts = np.append(np.searchsorted(gram, _bucket_bounds(buckets)), len(gram))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                for name, x in zip(rows, (table.column("chunk")[0].as_py(), k, int(b), pack(gram[part]), pack(count[part].astype(np.int32))), strict=True):
                    rows[name].append(x)
        return pa.table(rows, schema=pa.schema([("chunk", pa.int64()), ("k", pa.int32()), ("bucket", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        asked = [unpack(x.as_py(), np.uint64) for x in table.column("grams")]
        each = np.concatenate([unpack(x.as_py(), np.int32) for x in table.column("counts")]).astype(np.float64)
        gram, slot = np.unique(np.concatenate(asked), return_inverse=True)
        whole = np.bincount(slot, weights=each).astype(np.int64)[slot]
        ends = np.cumsum([len(a) for a in asked])
        return pa.table({"chunk": table.column("chunk"), "k": table.column("k"), "bucket": table.column("bucket"), "totals": pa.array([pack(x) for x in np.split(whole, ends[:-1])], pa.binary())})

    exploded = dealt.groupBy("chunk").applyInArrow(explode, "chunk long, k int, bucket long, grams binary, counts binary")
    counted = exploded.groupBy("k", "bucket").applyInArrow(count, "chunk long, k int, bucket long, totals binary")
    n_words = _total_words(dealt)

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        words, n = _chunk_words(texts)
        parts = sorted(zip(table.column("k").to_pylist(), table.column("bucket").to_pylist(), range(table.num_rows), strict=True))
        known = {k: np.concatenate([unpack(table.column("totals")[i].as_py(), np.int64) for kk, _, i in parts if kk == k]) for k in {p[0] for p in parts}}
        value, backed = np.zeros(len(words.doc)), np.zeros(len(words.doc), np.int64)
        shorter = np.full(len(words.doc), float(n_words))
        for k, gram in enumerate(_grams(words, order), 1):
            has = gram != 0
            counts = np.zeros(len(gram))
            if has.any():
                counts[has] = known[k][np.unique(gram[has], return_inverse=True)[1]]
            # the context of a word is the (k - 1)-gram that ends one word before it
            below = shorter if k == 1 else np.append(0.0, shorter[:-1])
            good = has & (counts >= (1 if k == 1 else least))
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(good, np.log(counts / below), np.where(has, value + math.log(BACKOFF), value))
            backed += has & ~good
            shorter = counts
        n_doc = words.per_doc()
        log = np.round(words.per_doc(value).astype(np.float64), 6)
        return pa.table(
            {"doc_id": texts.column("doc_id"), "n_words": pa.array(n_doc.astype(np.int64)), "n_backoffs": pa.array(words.per_doc(backed).astype(np.int64)), "log_score": pa.array(log)}
        )

    out = dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, n_backoffs long, log_score double")
    return out.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))


def _total_words(dealt: DataFrame) -> int:
    """The words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len((t.as_py() or b"").split()) for t in batch.column("text").cast(pa.binary()))])], names=["n"])

    return dealt.select("text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
