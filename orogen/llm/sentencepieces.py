"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units (the marks for blanks and what follows them; no piece crosses such a cut). Of all texts each distinct unit is
encoded once: its substrings up to the longest piece are exploded, equi-joined to the piece table, grouped by unit, and folded
with a higher-order aggregate. The encoded units are joined back to the texts.

The fold follows the model's kind. For a unigram model it is Viterbi's: the best sum of scores. The scores of a BPE model are the order
of its merges and no probabilities, and their best sum is another segmentation than the model's own. There the fold visits the
edges by order of merge (equal ones from the left, by their ends) and takes an edge if it spans exactly two symbols of what it has so far. That
gives the merges' own result, since each piece is made of pieces that merge earlier.

Defined cases: the blank becomes U+2581, one more stands before the text, as the model's normaliser has it; characters without a piece become
the byte pieces of their UTF-8; a null or empty text has no ids and decodes to null or ""; U+2581 in a text decodes to a blank, as
in the model itself, so such a text's round trip is false; repeated rows are encoded alike; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import CHUNK_BYTES
from .shared import hashes, pieces, small_batches, written

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A unit with more characters is folded in Python, since the fold's state is one bit for each character of a long.
_BITS = 62
#: Up to so many distinct units are sent to all tasks (some 20 bytes each); more are joined by shuffle.
MOST_BROADCAST = 8_000_000
#: Bytes of text that a task looks at together; a longer text is looked at alone.
PART_BYTES = 1 << 19


@dataclass(frozen=True)
class Model:
    """The pieces of a model: text, order of merge or score, and the ids of single bytes."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    bytes_from: dict[int, int]
    kind: str
    unknown: int
    ids: dict[str, int] = field(repr=False)

    @property
    def width(self) -> str:
        return "<u2" if len(self.pieces) <= 1 << 16 else "<u4"

    @property
    def longest(self) -> int:
        return max((len(p) for p, ok in zip(self.pieces, self.plain, strict=True) if ok), default=1)


def load(path: str) -> Model:
    """Reads a model file on the driver; only its table of pieces is used."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces, scores = [p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)]
    plain = [not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(n)]
    single = {int(pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
    # a unigram model's scores are logarithms of probabilities; those of BPE are 0, -1, -2, ...
    whole = all(float(s).is_integer() for s, ok in zip(scores, plain, strict=True) if ok)
    return of_pieces(pieces, scores, plain, single, "bpe" if whole else "unigram", p.unk_id())


def of_pieces(pieces: list[str], scores: list[float], plain: list[bool] | None = None, single: dict[int, int] | None = None, kind: str = "bpe", unknown: int = 0) -> Model:
    plain = plain or [True] * len(pieces)
    return Model(pieces, scores, plain, single or {}, kind, unknown, {p: i for i, p in enumerate(pieces) if plain[i]})


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece (its marks as blanks), id, rank (0 merges first; equal scores have equal ranks), score."""
    order = {s: k for k, s in enumerate(sorted({s for s, ok in zip(model.scores, model.plain, strict=True) if ok}, reverse=True))}
    rows = [(p.replace(MARK, " "), i, order[s], float(s)) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.plain, strict=True)) if ok]
    return spark.createDataFrame(rows, "piece string, id int, rank int, score double")


def units(text: str | None) -> list[str]:
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def cut_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some texts as the model sees them, in bytes: marks are blanks here, and one stands before each text that is not empty. Bytes,
    where each text begins (and the end), where each unit begins. No unit is empty and each byte is in one."""
    mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, np.int64)
    if len(mark):
        raw = raw.copy()
        raw[mark] = 32
        raw, offsets = np.delete(raw, np.concatenate([mark + 1, mark + 2])), offsets - 2 * np.searchsorted(mark, offsets)
    some = np.diff(offsets) > 0
    raw = np.insert(raw, offsets[:-1][some], 32)
    offsets = offsets + np.append(0, np.cumsum(some))
    blank = raw == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[offsets[:-1][some]] = True
    return raw, offsets, np.flatnonzero(first)


def _within(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of some runs, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def distinct_units(docs: DataFrame) -> DataFrame:
    """unit: every distinct unit of the texts, its marks as blanks. Tasks send most of theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for _, raw, offsets in pieces(batch, most=PART_BYTES):
                raw, _, start = cut_units(raw, offsets)
                stop = np.append(start[1:], len(raw))
                value, at = np.unique(hashes(raw, start, stop), return_index=True)
                place = np.searchsorted(seen, value)
                new = np.append(seen, np.uint64(0))[place] != value
                new |= place == len(seen)
                seen = np.insert(seen, place[new], value[new])
                size = (stop - start)[at[new]]
                found = pa.py_buffer(raw[_within(start[at[new]], size)])
                yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), found)], names=["unit"])
                if len(seen) > 1 << 20:
                    seen = seen[:0]

    return docs.select("text").filter("text <> ''").mapInArrow(run, "unit string").distinct()


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _start(e: Column) -> Column:
    return F.lit(63) - F.shiftright(e, 24).bitwiseAND(F.lit(63))


def _stop(e: Column) -> Column:
    return F.shiftright(e, 30).bitwiseAND(F.lit(63))


def _ends(e: Column) -> Column:
    return _bit(_start(e)).bitwiseOR(_bit(_stop(e)))


def _inner(e: Column, mask: Column) -> Column:
    """The cuts of mask strictly inside an edge."""
    return F.bit_count(mask.bitwiseAND(_bit(_stop(e)) - _bit(_start(e) + 1)))


def lattice(found: DataFrame, model: Model) -> DataFrame:
    """unit, edges: sorted longs of rank (24 bits), end, 63 - start (6 bits each) and id (24 bits) of the pieces in each unit, and
    for a unigram model scores beside them. BPE starts from single characters, so its edges have two and more.

    The piece table has a fixed size and goes to the units, so that nothing is shuffled. An edge of length 0 stands in each unit, or
    units without a piece would be lost.
    """
    least = 1 if model.kind == "unigram" else 2
    none = found.sparkSession.createDataFrame([("", 0, (1 << 24) - 1, 0.0)], "piece string, id int, rank int, score double")
    table = piece_table(found.sparkSession, model).filter(F.length("piece") >= least).unionByName(none)
    n = F.length("unit")
    # units too long for the fold's state get the edge of length 0 alone; two plain sequences stay in generated code
    longest = F.when(n <= _BITS, n).otherwise(0)
    starts = found.select("unit", F.explode(F.sequence(F.lit(0), F.greatest(longest - least, F.lit(0)))).alias("start"))
    room = F.least(F.when(n <= _BITS, n).otherwise(0) - F.col("start"), F.lit(model.longest))
    sizes = F.when(room >= least, F.sequence(F.lit(least), room)).otherwise(F.array().cast("array<int>"))
    sized = starts.select("unit", "start", F.explode(F.when(F.col("start") == 0, F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes)).alias("size"))
    exploded = sized.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size")))
    edge = F.shiftleft(F.col("rank").cast("long"), 36) + F.shiftleft((F.col("start") + F.col("size")).cast("long"), 30) + F.shiftleft((F.lit(63) - F.col("start")).cast("long"), 24) + F.col("id")
    edges = exploded.join(F.broadcast(table), "piece")
    if model.kind != "unigram":
        return edges.select("unit", edge.alias("edge")).groupBy("unit").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    both = edges.select("unit", F.struct(edge.alias("edge"), "score").alias("at")).groupBy("unit").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return both.select("unit", F.col("at.edge").alias("edges"), F.col("at.score").alias("scores"))


def merged(edges: Column, size: Column) -> Column:
    """The cuts that are left (a bit for each place) after the merges of a BPE model."""
    return F.aggregate(edges, _bit(size + 1) - 1, lambda m, e: F.when((m.bitwiseAND(_ends(e)) == _ends(e)) & (_inner(e, m) == 1), m.bitwiseAND(F.bitwise_not(_bit(_stop(e)) - _bit(_start(e) + 1)))).otherwise(m))


def best_path(edges: Column, scores: Column, size: Column) -> Column:
    """Viterbi: the cuts of the path with the best sum of scores; edges and scores are sorted by the end of the edge.

    A single character without an edge of its own may be crossed at a price below any piece's.
    """
    none = F.struct(F.lit(-1e18).alias("s"), F.lit(0).cast("long").alias("m"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("s"), F.lit(1).cast("long").alias("m"))), F.array_repeat(none, size))

    def step(acc: Column, at: Column) -> Column:
        a, b, s = at["a"], at["b"], at["s"]
        here, there = F.element_at(acc, a + 1), F.element_at(acc, b + 1)
        better = F.struct((here["s"] + s).alias("s"), here["m"].bitwiseOR(_bit(b)).alias("m"))
        return F.when(here["s"] + s > there["s"], F.transform(acc, lambda x, i: F.when(i == b, better).otherwise(x))).otherwise(acc)

    single = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct((i + 1).alias("b"), i.alias("a"), F.lit(-1e6).alias("s")))
    pieces = F.zip_with(edges, scores, lambda e, s: F.struct(_stop(e).cast("int").alias("b"), _start(e).cast("int").alias("a"), s.alias("s")))
    return F.element_at(F.aggregate(F.array_sort(F.concat(single, pieces)), start, step), -1)["m"]


def encoded_units(docs: DataFrame, model: Model) -> DataFrame:
    """unit, edges (the chosen pieces; null for a unit that is too long for the lattice) of every distinct unit of the texts."""
    size = F.length("unit")
    # in order of the units, so that the sort before they are grouped again finds them sorted
    latticed = lattice(distinct_units(docs).sortWithinPartitions("unit"), model)
    cuts = latticed.withColumn("cuts", best_path(F.col("edges"), F.col("scores"), size) if model.kind == "unigram" else merged(F.col("edges"), size))
    held = lambda e: (F.col("cuts").bitwiseAND(_ends(e)) == _ends(e)) & (_stop(e) > _start(e))
    kept = F.filter("edges", lambda e: held(e) & (_inner(e, F.col("cuts")) == 0))
    return cuts.select("unit", F.when(size <= _BITS, F.transform(kept, lambda e: e.bitwiseAND(F.lit((1 << 36) - 1)))).alias("edges"))


def _char_ids(model: Model, c: str) -> list[int]:
    if c in model.ids:
        return [model.ids[c]]
    return [model.bytes_from.get(b, model.unknown) for b in c.encode()] if model.bytes_from else [model.unknown]


class Characters:
    """The ids of characters alone: one of their own, or those of their bytes."""

    def __init__(self, model: Model):
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in model.ids.items():
            if len(p) == 1:
                self.single[32 if p == MARK else ord(p)] = i
        self.unknown, self.has_bytes = model.unknown, bool(model.bytes_from)
        self.byte = np.array([model.bytes_from.get(b, model.unknown) for b in range(256)], np.int32)

    def filled(self, names: list[str], edges: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some units, and where each unit's begin (and the end): the chosen edges, and the characters between them."""
        points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        ends = np.append(0, np.cumsum([len(u) for u in names]))
        chosen = edges.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(names)), edges.value_lengths().to_numpy(zero_copy_only=False))
        start, stop = 63 - ((chosen >> 24) & 63), (chosen >> 30) & 63
        first = ends[row] + start
        ids, count = self.single[points], np.ones(len(points), np.int64)
        inner = _within(first + 1, stop - start - 1)
        count[inner], ids[inner], ids[first] = 0, 0, chosen & 0xFFFFFF
        alone = np.flatnonzero(ids < 0)
        ids[alone] = self.unknown
        if self.has_bytes:
            c = points[alone]
            count[alone] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        cuts = np.cumsum(count)
        out = np.repeat(ids, count)
        if self.has_bytes and len(alone):
            raw = np.frombuffer(points[alone].tobytes().decode("utf-32-le").encode(), np.uint8)
            out[_within(cuts[alone] - count[alone], count[alone])] = self.byte[raw]
        return out, np.append(0, cuts)[ends]


def fold_long(unit: str, model: Model) -> list[int]:
    """The same fold for a unit of any length: edges by rank, two neighbouring symbols at a time, or the best path."""
    n, longest = len(unit), model.longest
    if model.kind == "unigram":
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, n + 1):
            ways = [(best[s][0] + model.scores[model.ids[unit[s:e]]], s) for s in range(max(0, e - longest), e) if unit[s:e] in model.ids]
            best.append(max([*ways, (best[e - 1][0] - 1e6, e - 1)], key=lambda w: (w[0], -w[1])))
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        return [i for a, b in zip(cuts[::-1], cuts[-2::-1], strict=False) for i in ([model.ids[unit[a:b]]] if unit[a:b] in model.ids else _char_ids(model, unit[a:b]))]
    edges = sorted((-model.scores[i], s + k, -s, i) for s in range(n - 1) for k in range(2, min(longest, n - s) + 1) if (i := model.ids.get(unit[s : s + k])) is not None)
    after, before = list(range(1, n + 1)) + [0], [0] + list(range(n))
    cut, piece = bytearray([1]) * (n + 1), {}
    for _, e, minus, i in edges:
        s = -minus
        if cut[s] and cut[e]:
            m = after[s]
            if m < e and after[m] == e:
                cut[m] = 0
                after[s], before[e] = e, s
                piece[s] = i
                piece.pop(m, None)
    out: list[int] = []
    s = 0
    while s < n:
        out += [piece[s]] if s in piece else _char_ids(model, unit[s])
        s = after[s]
    return out


def unit_table(docs: DataFrame, model: Model) -> DataFrame:
    """hash, ids (packed) of every distinct unit, written to the shared folder."""
    chosen = encoded_units(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, alone = shared.value, Characters(shared.value)
        for batch in batches:
            short = batch.column("edges").is_valid()
            for part, raw, offsets in pieces(batch.filter(short), "unit", PART_BYTES):
                ids, cuts = alone.filled(part.column("unit").to_pylist(), part.column("edges"))
                packed = ids.astype(known.width)
                found = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((cuts * packed.itemsize).astype(np.int32)), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([pa.array(hashes(raw, offsets[:-1], offsets[1:]).view(np.int64)), found], names=["hash", "ids"])
            for part, raw, offsets in pieces(batch.filter(pc.invert(short)), "unit", PART_BYTES):
                found = [np.array(fold_long(u.replace(" ", MARK), known), known.width).tobytes() for u in part.column("unit").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(hashes(raw, offsets[:-1], offsets[1:]).view(np.int64)), pa.array(found, pa.binary())], names=["hash", "ids"])

    return written(chosen.mapInArrow(run, "hash long, ids binary"), "pieces-units")


class Lookup:
    """The encoded units as sorted arrays: some 20 bytes for a unit."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        self.keys, self.ends, self.ids = keys, ends, ids

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of some units, all of which are there, begin, and how many they are."""
        at = np.searchsorted(self.keys, wanted)
        if len(at) and (not len(self.keys) or (self.keys[np.minimum(at, len(self.keys) - 1)] != wanted).any()):
            raise KeyError("a unit is not in the table")
        stops = self.ends[at].astype(np.int64)
        starts = np.where(at > 0, self.ends[at - 1], 0).astype(np.int64)
        return starts, stops - starts


def _collected(table: DataFrame, n: int, width: str) -> Lookup:
    """The table of n units on the driver, partition by partition and packed; the caller has checked its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in pieces(batch, "ids"):
                yield pa.RecordBatch.from_pydict({"hashes": [np.asarray(part.column("hash")).astype("<i8").tobytes()], "sizes": [np.diff(offsets).astype("<u4").tobytes()], "ids": [raw.tobytes()]})

    key, size, flat, at = np.empty(n, np.uint64), np.empty(n, np.uint32), bytearray(), 0
    for r in table.mapInArrow(run, "hashes binary, sizes binary, ids binary").toLocalIterator():
        some = np.frombuffer(r["hashes"], "<u8")
        key[at : at + len(some)], size[at : at + len(some)] = some, np.frombuffer(r["sizes"], "<u4")
        flat += r["ids"]
        at += len(some)
    flat = np.frombuffer(flat, width)
    size //= np.dtype(width).itemsize
    order = np.argsort(key).astype(np.uint32)
    first = np.cumsum(size, dtype=np.int64) - size
    ordered = np.empty(len(flat), width)
    at = 0
    # the ids in order of the hashes, some units at a time: an index over all of them would be eight times as large
    for cut in range(0, len(order), 200_000):
        some = order[cut : cut + 200_000]
        where = _within(first[some], size[some].astype(np.int64))
        ordered[at : at + len(where)] = flat[where]
        at += len(where)
    return Lookup(key[order], np.cumsum(size[order], dtype=np.uint32 if len(flat) < 1 << 32 else np.uint64), ordered)


class Shown:
    """The bytes that each id decodes to, marks as blanks, in one row."""

    def __init__(self, model: Model):
        shown = _shown(model)
        self.size = np.array([len(x) for x in shown], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)


def _shown(model: Model) -> list[bytes]:
    shown = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(model.pieces, model.plain, strict=True)]
    for b, i in model.bytes_from.items():
        shown[i] = bytes([b])
    return shown


def _rows(raw: np.ndarray, offsets: np.ndarray, lookup: Lookup, shown: Shown, keep_ids: bool) -> dict[str, pa.Array]:
    """The columns of some texts, all units of which are in lookup."""
    whole, bounds, start = cut_units(raw, offsets)
    value, slot = np.unique(hashes(whole, start, np.append(start[1:], len(whole))), return_inverse=True)
    first, size = lookup.places(value)
    first, size = first[slot], size[slot]
    ids = lookup.ids[_within(first, size)]
    ends = np.append(0, np.cumsum(size))[np.searchsorted(start, bounds)]
    pieces_of = shown.size[ids]
    back = shown.bytes[_within(shown.first[ids], pieces_of)]
    back_ends = np.append(0, np.cumsum(pieces_of))[ends]
    packed, told, text = memoryview(ids.tobytes()), back.tobytes(), raw.tobytes()
    digest, trip = [], []
    for k in range(len(offsets) - 1):
        digest.append(xxhash.xxh64_hexdigest(packed[ends[k] * ids.itemsize : ends[k + 1] * ids.itemsize]))
        # the blank before the text goes
        trip.append(told[back_ends[k] + (back_ends[k + 1] > back_ends[k]) : back_ends[k + 1]] == text[offsets[k] : offsets[k + 1]])
    out = {"n_pieces": pa.array(np.diff(ends)), "ids_digest": pa.array(digest, pa.string()), "round_trip": pa.array(trip, pa.bool_())}
    return out | ({"ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))} if keep_ids else {})


def encoded(docs: DataFrame, model: Model, keep_ids: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_pieces, ids_digest (XXH64 of the packed ids), round_trip (they decode to the text), and with keep_ids also ids."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(spark)
    table = unit_table(plain, model)
    schema = "doc_id long, n_pieces long, ids_digest string, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    n = table.count()
    if n <= most_broadcast:
        shared = spark.sparkContext.broadcast((_collected(table, n, model.width), Shown(model)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, offsets in pieces(batch, most=PART_BYTES):
                    rows = _rows(raw, offsets, *shared.value, keep_ids)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *rows.values()], names=["doc_id", *rows])

        return plain.mapInArrow(run, schema)
    # beyond that bound: chunks of texts ask for their units, and the answers meet the texts again
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(total // CHUNK_BYTES + 1)))
    shared_shown = spark.sparkContext.broadcast(Shown(model))
    width = model.width

    def texts_of(part: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in part.to_batches():
            yield from pieces(batch, most=PART_BYTES)

    def ask(part: pa.Table) -> pa.Table:
        seen = []
        for _, raw, offsets in texts_of(part):
            raw, _, start = cut_units(raw, offsets)
            seen.append(np.unique(hashes(raw, start, np.append(start[1:], len(raw)))))
        seen = np.unique(np.concatenate(seen)).view(np.int64)
        return pa.table({"chunk": pa.array(np.full(len(seen), part.column("chunk")[0].as_py())), "hash": pa.array(seen)})

    def answer(part: pa.Table, told: pa.Table) -> pa.Table:
        key, ids = told.column("hash").to_numpy().view(np.uint64), told.column("ids").to_pylist()
        order = np.argsort(key)
        flat = np.frombuffer(b"".join(ids[k] for k in order), width)
        lookup = Lookup(key[order], np.cumsum([len(ids[k]) // flat.itemsize for k in order], dtype=np.int64), flat)
        found = [{"doc_id": some.column("doc_id")} | _rows(raw, offsets, lookup, shared_shown.value, keep_ids) for some, raw, offsets in texts_of(part)]
        return pa.concat_tables([pa.table(x) for x in found])

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, hash long")
    told = asked.join(table, "hash").select("chunk", "hash", "ids")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(answer, schema)


def decoded(rows: DataFrame, model: Model) -> DataFrame:
    """rows with text, from their column ids: pieces looked up in an array of the whole model, joined, and bytes put together.

    Only DataFrame functions: the model is one array literal of fixed size.
    """
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([([x.hex() for x in _shown(model)],)], "_pieces array<string>"))
    whole = F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at("_pieces", i + 1)), ""))
    text = F.regexp_replace(F.decode(whole, "UTF-8"), "^ ", "")
    return rows.join(table, F.lit(True)).withColumn("text", text).drop("_pieces")
