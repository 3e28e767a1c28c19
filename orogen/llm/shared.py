"""What the operators of this subpackage share: tables in the shared folder and vectorised reading of texts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; a longer text is looked at alone.
PIECE_BYTES = 1 << 20
#: The seed of all hashes of words: Spark's own.
SEED = 42
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="orogen-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut and lost executors cost nothing. by: a column of folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes tables that written() made and that nothing reads any more. With `shuffles` also what finished jobs left: Spark deletes their
    shuffle files once the driver has collected its garbage, so that is asked for: long operators would fill the disks of a cluster with them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles and tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on, where the session has Spark's own default of 10,000: a batch of texts is held
    by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, rows)


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 2 is the held-out part. Null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def table_of_bytes(hold: str = "", lower: bool = False) -> np.ndarray:
    """For each byte 0 where it separates words and else the byte itself. hold "alnum": only letters, digits and bytes over 127 make words."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    if hold == "alnum":
        table[[b for b in range(128) if not chr(b).isalnum()]] = 0
    else:
        table[list(_SPACES)] = 0
    return table


class Words:
    """The words of some texts as arrays: doc (row of each word), start and end (bytes), hash (64 bits)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        self.offsets, self.raw = offsets, raw
        mapped = table[raw]
        # byte 0 of a text itself is a word character
        inside = mapped != 0
        if (raw == 0).any() and table[0] == 0 and table[1] != 0:
            inside |= raw == 0
        n = len(raw)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n + 1, dtype=bool)
        before[0], before[1:] = False, inside
        first = inside & (~before[:-1] | edge[:-1])
        after = np.empty(n + 1, dtype=bool)
        after[n], after[:-1] = False, inside
        last = inside & (~after[1:] | edge[1:])
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        if hashed:
            self.hash = hashes(mapped, self.start, self.end)

    def per_doc(self, values: np.ndarray | None = None) -> np.ndarray:
        """For each text the number of its words, or the sum of their values."""
        return np.bincount(self.doc, weights=values, minlength=len(self.offsets) - 1)


#: The five odd constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
#: Longer runs are hashed one by one; there are few of them for their bytes.
_LONG = 1024


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of bytes, equal to Spark's xxhash64 of the run as a string."""
    size = stop - start
    found = np.zeros(len(start), np.uint64)
    for i in np.flatnonzero(size > _LONG):
        found[i] = xxhash.xxh64_intdigest(raw[start[i] : stop[i]].tobytes(), seed)
    some = np.flatnonzero(size <= _LONG)
    if len(some):
        with np.errstate(over="ignore"):
            found[some] = _short_hashes(raw, start[some], size[some], np.uint64(seed))
    return found


def _short_hashes(raw: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    held = np.concatenate([raw, np.zeros(8, np.uint8)])
    at, size = at.astype(np.int64), size.astype(np.int64)
    eight = np.ndarray((len(raw) + 1,), "<u8", held, strides=(1,))
    four = np.ndarray((len(raw) + 1,), "<u4", held, strides=(1,))
    end, acc = at + size, np.full(len(at), seed + _P5, np.uint64)
    striped = np.flatnonzero(size >= 32)
    if len(striped):
        where, last = at[striped], end[striped]
        lanes = [np.full(len(striped), first, np.uint64) for first in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        go = np.arange(len(striped))
        while len(go):
            for k in range(4):
                lanes[k][go] = _turned(lanes[k][go] + eight[where[go] + 8 * k] * _P2, 31) * _P1
            where[go] += 32
            go = go[where[go] + 32 <= last[go]]
        total = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            total = (total ^ (_turned(lane * _P2, 31) * _P1)) * _P1 + _P4
        acc[striped], at = total, at.copy()
        at[striped] = where
    acc += size.astype(np.uint64)
    go = np.flatnonzero(at + 8 <= end)
    while len(go):
        acc[go] = _turned(acc[go] ^ (_turned(eight[at[go]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[go] += 8
        go = go[at[go] + 8 <= end[go]]
    go = np.flatnonzero(at + 4 <= end)
    acc[go] = _turned(acc[go] ^ (four[at[go]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[go] += 4
    go = np.flatnonzero(at < end)
    while len(go):
        acc[go] = _turned(acc[go] ^ (held[at[go]].astype(np.uint64) * _P5), 11) * _P1
        at[go] += 1
        go = go[at[go] < end[go]]
    acc = (acc ^ (acc >> np.uint64(33))) * _P2
    acc = (acc ^ (acc >> np.uint64(29))) * _P3
    return acc ^ (acc >> np.uint64(32))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: each bit of the result depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `most` bytes of text each: rows, bytes, offsets. A null text counts as empty."""
    start = 0
    while start < batch.num_rows:
        text = batch.column(column)
        sizes = _offsets(text)
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, side="right")) - 1)
        part = batch.slice(start, stop - start)
        offsets = sizes[start : stop + 1]
        data = text.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield part, raw, (offsets - offsets[0]).astype(np.int64)
        start = stop


class Segment(NamedTuple):
    """Parts of texts: row (of the batch) of each, bytes, offsets, how many of each part's bytes are its own, whether it starts its text."""

    row: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray
    own: np.ndarray
    starts: np.ndarray


def segments(batch: pa.RecordBatch, table: np.ndarray, ahead: int = 0, column: str = "text", most: int = PIECE_BYTES, unbroken: int | None = None) -> Iterator[Segment]:
    """The texts of a batch in parts of about `most` bytes, so that memory does not grow with the length of a text.

    Short texts come together and whole. A long one is cut before bytes that `table` maps to 0, and each of its parts is followed by up to
    `ahead` further words, which are not its own: whatever starts in a part's own bytes and ends within so many words is seen once. `unbroken` bounds the bytes after `most` in which
    a separator is looked for; beyond them the text is cut anyway.
    """
    text = batch.column(column)
    sizes = _offsets(text)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, side="right")) - 1)
        offsets = sizes[start : stop + 1]
        if stop > start + 1 or offsets[-1] - offsets[0] <= most:
            own = np.diff(offsets)
            yield Segment(np.arange(start, stop), raw[offsets[0] : offsets[-1]], offsets - offsets[0], own, np.ones(len(own), bool))
        else:
            whole, at = raw[offsets[0] : offsets[1]], 0
            while at < len(whole):
                cut = _next_blank(whole, min(at + most, len(whole)), table)
                if unbroken is not None:
                    cut = min(cut, at + most + unbroken)
                end = _after_words(whole, cut, ahead, table)
                yield Segment(np.array([start]), whole[at:end], np.array([0, end - at]), np.array([cut - at]), np.array([at == 0]))
                at = cut
        start = stop


def _next_blank(raw: np.ndarray, at: int, table: np.ndarray, step: int = 1 << 12) -> int:
    """The first separating byte from `at` on, or the end."""
    while at < len(raw):
        blank = np.flatnonzero((table[raw[at : at + step]] == 0) & ((raw[at : at + step] != 0) | (table[1] == 0)))
        if len(blank):
            return at + int(blank[0])
        at += step
    return len(raw)


def _next_word(raw: np.ndarray, at: int, table: np.ndarray, step: int = 1 << 12) -> int:
    while at < len(raw):
        word = np.flatnonzero((table[raw[at : at + step]] != 0) | ((raw[at : at + step] == 0) & (table[1] != 0)))
        if len(word):
            return at + int(word[0])
        at += step
    return len(raw)


def _after_words(raw: np.ndarray, at: int, n: int, table: np.ndarray) -> int:
    for _ in range(n):
        at = _next_blank(raw, _next_word(raw, at, table), table)
    return at


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    buffer = text.buffers()[1]
    if buffer is None:
        return np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(buffer, dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def sampled(df: DataFrame, key: Column, most: int, rows: int) -> DataFrame:
    """About `most` of the `rows` rows of df, chosen by a hash of key; all of them if there are no more."""
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / rows))
