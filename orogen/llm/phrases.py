"""Phrase collocation mining by dynamic itemset counting: exact counts of phrases, scored by the weakest cut.

The texts are cut into blocks once, which are dealt into SHARDS shards. The shards are scanned in a cycle, and phrases of all lengths are counted
in the same scans: a word from the first scan on, a longer phrase from the scan after both its subphrases (without the last and without the
first word) have reached the threshold, and each for exactly one full cycle. So a pair is counted while words still are, and a phrase of four
words seldom waits for the fourth pass over the texts. The scans end when no started phrase lacks a shard.

Which phrases have started is told to the tasks by a table of slots: for each hash of a phrase the scan in which it was first seen to have
reached the threshold, in half a byte. The driver holds that table, a bit a slot and the bits of one scan, and its copies for the tasks go after each scan. It has a size fixed beforehand (see _slots), whatever the number of phrases. Phrases that share a slot can only be
started early, all over the cluster in the same scan, and whatever is started is counted for a full cycle; so the counts are exact
and every phrase that reaches the threshold has been counted, as both its subphrases reached it too.

A scan adds up equal phrases of a block exactly, by numbers given to its words, and sends on their hashes and counts alone. The running sums that
tell who has reached the threshold are kept by hash, and only of phrases that are still short of it and still in their cycle; a phrase never
has more than its hash. After the scans one pass over all blocks takes the phrases whose slots have reached the threshold as they are written, and
these are added up by (lang, phrase): hashes that meet only let one more phrase into that pass, and the counts are exact.

Defined cases: a null text counts as empty; a null lang is "und"; repeated rows count as often as they occur; blanks of any number separate words,
and words of any length are words; extra columns are ignored; an empty table or one without frequent phrases gives an empty result. A long text is
cut between words into parts of about a megabyte, each followed by the words that its phrases reach into; only a word as long as that is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, forget, hashes, mixed, segments, small_batches, table_of_bytes, written

LONGEST, THRESHOLD, SHARDS, COVERED, TOP = 4, 30, 4, 80, 2000
#: Fixed by the contract: what ends a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a slot at least and at most: tables of 128 kB to 128 MB.
SLOT_BITS = (18, 28)
#: Fits half a byte: phrases of k words have reached the threshold by scan SHARDS * k - 1.
_NEVER = 15
#: Slots of a bitmap of Spark's.
_MAP = 1 << 15
#: Bytes of one lang that make a block, and of all langs that a task holds: equal phrases of a block are one row.
BLOCK_BYTES, HELD_BYTES = 1 << 20, 4 << 20
#: Slots after the scans: phrases of up to three words have reached the threshold, those of four words too, these alone.
_SHORT, _BOTH, _LONG = 0, 1, 14
_SCALE = 2_000_000


def _table() -> np.ndarray:
    """Bytes that separate words are 0, those that end a piece too; A-Z are lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[0x20, 0x09, *ENDS]] = 0
    return table


_BYTES = _table()
_IS_END = np.zeros(256, bool)
_IS_END[list(ENDS)] = True


def _slots(total_bytes: int) -> int:
    """Bits of the slot: one slot for some 64 bytes of text, within SLOT_BITS. That is more than the phrases of up to three words that can
    reach the threshold; beyond 17 GB of text phrases share slots and more are counted that do not reach it."""
    return min(max(SLOT_BITS[0], (total_bytes // 64).bit_length()), SLOT_BITS[1])


def blocks(docs: DataFrame) -> DataFrame:
    """lang, block, own, shard: words with single blanks between, \\n before a word that begins a piece. `own` is the number of leading words
    whose phrases belong to the block; up to three more follow where a long text goes on."""

    def row(lang: str, block: bytes, own: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([block], pa.binary()), pa.array([own], pa.int64())], names=["lang", "block", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bytes, int]]] = {}
        sizes: dict[str, int] = {}

        def told(lang: str) -> pa.RecordBatch:
            some = held.pop(lang)
            del sizes[lang]
            return row(lang, b"".join(x for x, _ in some), sum(n for _, n in some))

        for batch in batches:
            langs, codes = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for part in segments(batch, _BYTES, ahead=LONGEST - 1):
                words = Words(part.raw, part.offsets, _BYTES, hashed=False)
                n_ends = np.concatenate([[0], np.cumsum(_IS_END[part.raw])])
                begins = np.ones(len(words.doc), bool)
                begins[1:] = (words.doc[1:] != words.doc[:-1]) | (n_ends[words.start[1:]] > n_ends[words.end[:-1]])
                own = words.start - part.offsets[words.doc] < part.own[words.doc]
                code = codes[part.row[words.doc]]
                for c in np.unique(code):
                    # words that are not the part's own come last: only a part alone has them, and it stays a block of its own
                    of, lang = np.flatnonzero(code == c), str(langs[c])
                    block, n = _joined(part.raw, words.start[of], words.end[of], begins[of]), int(own[of].sum())
                    if n < len(of):
                        yield row(lang, block, n)
                        continue
                    held.setdefault(lang, []).append((block, n))
                    sizes[lang] = sizes.get(lang, 0) + len(block)
                    if sizes[lang] >= BLOCK_BYTES:
                        yield told(lang)
                    elif sum(sizes.values()) >= HELD_BYTES:
                        yield told(max(sizes, key=sizes.get))
        for lang in list(held):
            yield told(lang)

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    return plain.mapInArrow(run, "lang string, block binary, own long").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARDS)).cast("int"))


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, begins: np.ndarray) -> bytes:
    """The words, each after \\n if it begins a piece and after a blank if not."""
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.repeat(start - 1 - first, size) + np.arange(int(size.sum()))
    out = _BYTES[raw[np.maximum(at, 0)]]
    out[first] = np.where(begins, 10, 32)
    return out.tobytes()


def _numbered(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact numbers of the words that follow the separators at `first`, and the place of one word for each number."""
    alike = raw.copy()
    alike[first] = 32
    offsets = np.append(first, len(raw)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(alike)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    least = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    least[ids[::-1]] = np.arange(len(ids))[::-1]
    return ids, least


def _texts(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Runs of bytes as strings."""
    size = end - start
    stop = np.cumsum(size)
    at = np.repeat(start - (stop - size), size) + np.arange(int(size.sum()))
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(0, stop).astype(np.int32)), pa.py_buffer(raw[at]))


class _Phrases:
    """The different phrases of one length in a block: id of the phrase that starts at each word (-1: none that has started), and for each
    id the first such word, the hash and the scan in which its count began or begins."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, value: np.ndarray, begun: np.ndarray):
        self.ids, self.least, self.value, self.begun = ids, least, value, begun

    def longer(self, k: int, joins: np.ndarray, step: int, since: np.ndarray, bits: int) -> _Phrases:
        """The phrases of k words, one more than these, that have started by scan `step`. joins: whether a word is in the piece of the one before."""
        left, right = self.ids[:-1], self.ids[1:]
        at = np.flatnonzero((left >= 0) & (right >= 0) & joins[k - 1 : k - 1 + len(left)])
        _, place, which = np.unique(left[at] * np.int64(len(self.value)) + right[at], return_index=True, return_inverse=True)
        least = at[place]
        one, other = left[least], right[least]
        reached = since[_slot(self.value, bits)].astype(np.int64)
        # a slot that is shared may be on before the subphrase itself has begun
        ready = np.maximum(reached + 1, self.begun)
        begun = np.maximum(ready[one], ready[other])
        value = mixed(self.value[one] * np.uint64(3) + self.value[other] + np.uint64(k))
        started = begun <= step
        ids = np.full(len(left), -1, np.int64)
        ids[at] = np.where(started, np.cumsum(started) - 1, -1)[which]
        return _Phrases(ids, least[started], value[started], begun[started])


def _slot(value: np.ndarray, bits: int) -> np.ndarray:
    return (value >> np.uint64(64 - bits)).astype(np.int64)


class _Table:
    """What half bytes say of some slots; two slots are a byte, the even one its lower half."""

    def __init__(self, halves: np.ndarray):
        self.halves = halves

    def __getitem__(self, slot: np.ndarray) -> np.ndarray:
        return self.halves[slot >> 1] >> (slot & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15)


def _bits(halves: np.ndarray) -> np.ndarray:
    """Slots of a part of a table, one by one."""
    return np.stack([halves & np.uint8(15), halves >> np.uint8(4)], axis=1).ravel()


def _halves(slots: np.ndarray) -> np.ndarray:
    return slots[::2] | slots[1::2] << np.uint8(4)


def _begun(block: bytes, own: int, lang: bytes, step: int, since: np.ndarray, bits: int) -> Iterator[tuple[int, _Phrases, np.ndarray, Callable[[np.ndarray], pa.Array]]]:
    """For each length the different phrases of a block that have started by scan `step`: length, phrases, counts, what writes some of them."""
    raw = np.frombuffer(block, np.uint8)
    first = np.flatnonzero((raw == 32) | (raw == 10))
    start, end, joins = first + 1, np.append(first[1:], len(raw)), raw[first] == 32
    ids, least = _numbered(raw, first)
    salt = np.uint64(xxhash.xxh64_intdigest(lang, 42))
    some = _Phrases(ids, least, mixed(hashes(raw, start[least], end[least]) ^ salt), np.zeros(len(least), np.int64))
    for k in range(1, LONGEST + 1):
        if k > 1:
            some = some.longer(k, joins, step, since, bits)
        mine = some.ids[:own]
        yield k, some, np.bincount(mine[mine >= 0], minlength=len(some.value)), lambda which: _texts(raw, start[some.least[which]], end[some.least[which] + k - 1])  # noqa: B023
        if not len(some.value):
            return


def _counted(block: bytes, own: int, lang: bytes, step: int, since: np.ndarray, bits: int, texts: bool = True) -> Iterator[tuple[int, pa.Array | None, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the different phrases of a block that are counted in scan `step`: length, phrases, hashes, counts, scan after the last."""
    for k, some, n, write in _begun(block, own, lang, step, since, bits):
        told = np.flatnonzero((n > 0) & (step < some.begun + SHARDS))
        if len(told):
            yield k, write(told) if texts else None, some.value[told], n[told], some.begun[told] + SHARDS


def _scan(shard: DataFrame, step: int, table: np.ndarray, bits: int) -> DataFrame:
    """hash, until, n of the phrases of each block that are counted in one scan. The lowest bit of a hash is whether a longer phrase can follow.
    Its `slots` are the table's copies, to be destroyed once it has been written."""
    slots = shard.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = _Table(slots.value)
        for batch in batches:
            for lang, block, own in zip(*(batch.column(c) for c in ("lang", "block", "own")), strict=True):
                for k, _, value, n, until in _counted(block.as_py(), own.as_py(), lang.as_py().encode(), step, since, bits, texts=False):
                    key = value & ~np.uint64(1) | np.uint64(k < LONGEST)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(until.astype(np.int32)), pa.array(n)], names=["hash", "until", "n"])

    found = shard.select("lang", "block", "own").mapInArrow(run, "hash long, until int, n long")
    found.slots = slots
    return found


def _reached(running: DataFrame, bits: int, threshold: int, step: int, since: np.ndarray, longest: np.ndarray) -> bool:
    """Sets the slots whose running sum is at the threshold: of phrases that a longer one can follow in `since`, where it was not before, of the longest
    in the bits of `longest`. Whether there are new ones in `since`. They come as bitmaps of _MAP slots, each set in its place."""
    slot = F.shiftrightunsigned("hash", 64 - bits) + 1
    of = running.filter(F.col("n") >= threshold).select(slot.alias("slot"), F.col("hash").bitwiseAND(1).alias("short"))
    maps = of.groupBy("short", F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    new = False
    for row in maps:
        at, on = (row["part"] - 1) * _MAP, np.frombuffer(row["bits"], np.uint8)
        if not row["short"]:
            part = longest[at // 8 : (at + _MAP) // 8]
            part |= on[: len(part)]
            continue
        part = since[at // 2 : (at + _MAP) // 2]
        slots = _bits(part)
        fresh = np.unpackbits(on, bitorder="little")[: len(slots)].astype(bool) & (slots == _NEVER)
        if fresh.any():
            slots[fresh], new = step, True
            part[:] = _halves(slots)
    return new


def _ended(since: np.ndarray, longest: np.ndarray) -> None:
    """Makes the table of the scans that of the slots after them."""
    for at in range(0, len(longest), _MAP // 8):
        part = since[at * 4 : at * 4 + _MAP // 2]
        slots, long = _bits(part), np.unpackbits(longest[at : at + _MAP // 8], bitorder="little").astype(bool)
        short = slots != _NEVER
        slots[long], slots[short] = _LONG, _SHORT
        slots[short & long] = _BOTH
        part[:] = _halves(slots)


def _written_out(cut: DataFrame, known: Broadcast, bits: int) -> DataFrame:
    """lang, phrase, k, n of the phrases of each block whose slot has reached the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = _Table(known.value)
        for batch in batches:
            for lang, block, own in zip(*(batch.column(c) for c in ("lang", "block", "own")), strict=True):
                for k, some, n, write in _begun(block.as_py(), own.as_py(), lang.as_py().encode(), _BOTH + 1, reached, bits):
                    slot = reached[_slot(some.value, bits)]
                    told = np.flatnonzero((n > 0) & ((slot == _BOTH) | (slot == (_SHORT if k < LONGEST else _LONG))))
                    same = lambda x, kind: pa.repeat(pa.scalar(x, kind), len(told))  # noqa: B023, E731
                    if len(told):
                        yield pa.RecordBatch.from_arrays([same(lang.as_py(), pa.string()), write(told), same(k, pa.int32()), pa.array(n[told])], names=["lang", "phrase", "k", "n"])

    return cut.select("lang", "block", "own").mapInArrow(run, "lang string, phrase string, k int, n long")


def counts(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k, n of the phrases of all texts that reach the threshold, and lang, n of all words; both are written."""
    small_batches(docs.sparkSession)
    cut = written(blocks(docs), "phrases-blocks", by="shard")
    total = cut.agg(F.coalesce(F.sum(F.octet_length("block")), F.lit(0))).first()[0]
    bits, running, last, step = _slots(total), None, -1, 0
    since, longest = np.full(1 << bits - 1, _NEVER << 4 | _NEVER, np.uint8), np.zeros(1 << bits - 3, np.uint8)
    while step <= last + SHARDS:
        new = _scan(cut.filter(F.col("shard") == step % SHARDS), step, since, bits)
        slots = new.slots
        if running is not None:
            new = new.unionByName(running.filter((F.col("n") < threshold) & (F.col("until") > step)))
        before, running = running, written(new.groupBy("hash").agg(F.max("until").alias("until"), F.sum("n").alias("n")), "phrases-running")
        # written, so no task asks for this table again
        slots.destroy()
        if _reached(running, bits, threshold, step, since, longest):
            last = step
        if before is not None:
            forget(before, shuffles=step % SHARDS == 0)
        step += 1
    _ended(since, longest)
    slots = docs.sparkSession.sparkContext.broadcast(since)
    known = _written_out(cut, slots, bits).groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("n").alias("n")).filter(F.col("n") >= threshold)
    known, words = written(known, "phrases-known"), written(cut.groupBy("lang").agg(F.sum("own").alias("n")), "phrases-words")
    slots.destroy()
    forget(cut, running)
    return known, words


def _subphrases(phrase: Column, shortest: int, longest: int) -> Column:
    """All runs of words of a phrase with shortest to longest words, as an array of phrases."""
    words = F.split(phrase, " ")
    runs = [F.when(F.size(words) >= at + k, F.array_join(F.slice(words, at + 1, k), " ")) for k in range(shortest, longest + 1) for at in range(LONGEST - k + 1)]
    return F.array_compact(F.array(*runs))


def collocations(docs: DataFrame, top: int = TOP, threshold: int = THRESHOLD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each lang."""
    known, words = counts(docs, threshold)
    candidates = known.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    # the largest count of a longer candidate around a phrase
    inner = candidates.filter("k > 2").select("lang", "a", F.explode(F.array_distinct(_subphrases(F.col("phrase"), 2, LONGEST - 1))).alias("phrase"), F.col("phrase").alias("around"))
    around = inner.filter("phrase <> around").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = candidates.join(around, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(38, 0)) * 100 < CAST(a AS DECIMAL(38, 0)) * {COVERED}")
    pieces = F.split("phrase", " ")
    cuts = alone.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).select(
        "*", F.array_join(F.slice(pieces, F.lit(1), F.col("at")), " ").alias("head"), F.array_join(F.slice(pieces, F.col("at") + 1, F.col("k") - F.col("at")), " ").alias("tail")
    )
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    scored = scored.withColumn("score", F.expr(f"(CAST({_SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a lang, so that no task ranks a whole lang
    parted = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    ahead = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
