"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most r bits differ in at most floor(r / segments) bits in
some segment, so each fingerprint asks the table of every segment for all values in a small Hamming ball, and the complete
distance decides. Equal fingerprints are one entry of the tables.

A segment value that very many fingerprints share (a large group of near copies) would give all pairs of them. Fingerprints that
meet in such a bucket are linked by midpoints instead: x and y differ in at most 2s bits if and only if some value lies within s
bits of both. Everything within s bits of one value is linked to the least of them, which the distance bound allows, so the
same components come out with rows in proportion to the fingerprints. (For an odd radius the last bit is tried on one side.)

Defined cases: a null or empty text, or one of separators alone, has fingerprint zero and is linked like any other; fewer words
than a shingle form one shingle; rows with one doc_id are rows of their own with the same component; a null doc_id gets the
component of its group and is never its name unless alone; extra columns are ignored; an empty table gives an empty result.

deduplicated() is the pipeline's stage: fingerprints of five-word shingles meet as above, and min-hashes beside them, since no ball that
can be enumerated reaches a similarity of 0.8; the shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import forget, mixed, small_batches, written

#: Fixed by the contract.
SEED, WORDS, RADIUS = 42, 4, 4
#: A bucket with more fingerprints is linked by midpoints. Keys of buckets (16 bytes each) that may be broadcast.
DENSE, MOST_SENT = 64, 1 << 17


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text. bytes.lower() changes A-Z alone and bytes.split() cuts at the contract's separators."""
    return int(_fingerprints([text], words)[0])


def _fingerprints(texts: list[bytes], words: int, seed: int = SEED) -> np.ndarray:
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        found = text.lower().split()
        if not found:
            continue
        line = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        n = max(1, len(found) - words + 1)
        starts = [0, *(ends[: n - 1].tolist())]
        stops = (ends[words - 1 :] - 1).tolist() if len(found) >= words else [len(line)]
        hashes += [digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)]
        sizes[k] = n
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    value = np.array(hashes, dtype=np.uint64)
    first = np.append(0, np.cumsum(sizes[some])[:-1])
    for bit in range(64):
        ones = np.add.reduceat(((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), first)
        out[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and fp, the fingerprint as a signed long, of every row."""
    plain = docs.select(*keep, "text")
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            step = 512
            fp = [_fingerprints([t.as_py() or b"" for t in text.slice(at, step)], words) for at in range(0, len(text), step)]
            whole = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(whole.view(np.int64))], names=[*keep, "fp"])

    return plain.mapInArrow(run, schema)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    ends = [round(64 * k / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _ball(width: int, radius: int) -> Column:
    """All masks of at most `radius` (0, 1 or 2) bits below width, each once, as an array that is computed and not written out in the plan."""
    one = f"transform(sequence(0, {width - 1}), i -> shiftleft(1L, i))"
    two = f"flatten(transform(sequence(0, {width - 1}), i -> transform(sequence(i, {width - 1}), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    return F.expr(("array(0L)", f"concat(array(0L), {one})", f"concat(array(0L), {two})")[radius])


def _met(fps: DataFrame, radius: int, dense: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entries that fingerprints ask for (segment, value, asks), those of the tables (segment, value, fp), and the buckets of
    more than `dense` entries.

    The ball of a segment's radius is shared by both sides: half of it around the one that asks, half around the entry. Three segments
    of 21 bits keep buckets sparse up to some four million fingerprints, two of 32 bits beyond; either finds every pair.
    """
    cuts = _cuts(3 if fps.count() <= 1 << 22 else 2)
    asking, stored = -(-(radius // len(cuts)) // 2), radius // len(cuts) // 2

    def entries(ball: int) -> Column:
        def around(k: int, a: int, w: int) -> Column:
            own = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1))
            return F.transform(_ball(w, ball), lambda m: F.struct(F.lit(k).alias("segment"), own.bitwiseXOR(m).alias("value")))

        return F.concat(*(around(k, a, w) for k, (a, w) in enumerate(cuts)))

    table = fps.select("fp", F.inline(entries(stored)))
    probes = fps.select(F.col("fp").alias("asks"), F.inline(entries(asking)))
    large = table.groupBy("segment", "value").agg(F.count("*").alias("size")).filter(F.col("size") > dense).select("segment", "value")
    return probes, table, written(large, "simhash-dense")


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """a, b: links that join exactly the fingerprints of fps(fp) (each once) that a chain of distances up to radius joins."""
    probes, table, large = _met(fps, radius, dense)
    crowded = large.count()
    # a few keys of crowded buckets go to all tasks, more are joined by a shuffle
    of_large = F.broadcast(large) if crowded <= MOST_SENT else large.hint("merge")
    # pairs of a crowded bucket are never made; merge: no side may be sent to every task, however well it is packed
    sparse = table.join(of_large, ["segment", "value"], "left_anti") if crowded else table
    near = (probes["segment"] == sparse["segment"]) & (probes["value"] == sparse["value"]) & (F.col("asks") < F.col("fp")) & (_distance("asks", "fp") <= radius)
    found = probes.join(sparse.hint("merge"), near).select(F.col("asks").alias("a"), F.col("fp").alias("b"))
    if not crowded:
        return found
    met = probes.join(of_large, ["segment", "value"], "left_semi").select(F.col("asks").alias("fp"))
    met = met.unionByName(table.join(of_large, ["segment", "value"], "left_semi").select("fp")).distinct()
    return found.unionByName(midpoint_links(written(met, "simhash-met"), radius))


def midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: each fingerprint linked to the least one that lies around the same midpoint. A midpoint has no more neighbours than its
    ball has places (2,081), so the rows that meet at one have that bound."""
    around = fps.select(F.col("fp").alias("a"), F.explode(F.transform(_ball(64, radius - radius // 2), lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))
    # an odd radius: the nearer side is within radius // 2
    close = F.when(_distance("a", "middle") <= radius // 2, F.col("a"))
    met = around.withColumn("b", F.min(close).over(Window.partitionBy("middle"))).filter("a <> b")
    return met.filter(_distance("a", "b") <= radius).select("a", "b").distinct()


def grouped(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "simhash-fp")
    once = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-once")
    roots = components(links(once.select("fp"), radius))
    told = once.join(roots.hint("merge"), once["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = told.groupBy("root").agg(F.min("least").alias("component_id"))
    of = told.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(of.hint("merge"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage that drops near-duplicates: a link needs five-word shingles of this Jaccard similarity. Fingerprints of such texts lie
#: some ten bits apart, beyond any ball that can be enumerated, so texts that share one of BANDS bands of ROWS min-hashes of the same shingles
#: are candidates too; the bands miss (1 - 0.8^4)^16, some 0.0002, of the pairs at 0.8 whatever the edit.
SIMILARITY, SHINGLE = 0.8, 5
BANDS, ROWS = 16, 4
#: Texts that a task compares with each other at once.
PART = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_key(text: Column) -> Column:
    """A hash of the words of a text, lower-cased A-Z: texts with one key are copies. XXH64: among ten billion different texts some three
    pairs are expected to share one."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " ")))


def _shingles(text: bytes) -> np.ndarray:
    """The hashes of the shingles of a text, in order; fewer words are one shingle."""
    w = text.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(w[k : k + SHINGLE]), SEED) for k in range(max(1, len(w) - SHINGLE + 1))], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes."""
    ones = np.zeros(64, np.uint64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * ones > np.uint64(len(hashes)), bitorder="little").view(np.uint64)[0])


def _packed(hashes: np.ndarray) -> np.ndarray:
    """The set of the hashes: 4 bytes each, sorted."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


_SALTS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def _bands(shingles: np.ndarray) -> list[int]:
    """For each band a hash of its min-hashes, of a packed set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, mixed(shingles[at : at + 2048, None].astype(np.uint64) ^ _SALTS).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        out = mixed(out * np.uint64(3) + least[row::ROWS])
    return out.view(np.int64).tolist()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, same (words_key), fp (the fingerprint of the shingles), bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [_shingles(t.as_py() or b"") for t in part.column("text").cast(pa.binary())]
                fp = np.array([_majority(h) for h in found], np.uint64).view(np.int64)
                bands = pa.array([_bands(_packed(h)) for h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), pa.array(fp), bands], names=["doc_id", "same", "fp", "bands"])

    return docs.select("doc_id", words_key(F.col("text")).alias("same"), "text").mapInArrow(run, "doc_id long, same long, fp long, bands array<long>")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """same, shingles (packed) of texts(same, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_packed(_shingles(t.as_py() or b"")).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(out, pa.binary())], names=["same", "shingles"])

    return texts.select("same", "text").mapInArrow(run, "same long, shingles binary")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    of = lambda x, s: sets.select(F.col("same").alias(x), F.col("shingles").alias(s)).hint("merge")
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                shared = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                keep.append(shared >= least * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _leads(keyed: DataFrame, key: str) -> DataFrame:
    """keyed(key, same) with lead, the least text of the key, and size, for keys of at least two texts."""
    of = keyed.groupBy(key).agg(F.min("same").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    # written, so that both sides of the join are plain shuffles and Spark can split a key that very many rows have
    return keyed.join(written(of, "dedup-keys").hint("merge"), key)


def _rest_links(buckets: DataFrame, sets: DataFrame, roots: DataFrame, least: float, part: int = PART) -> DataFrame:
    """a, b: links that join all similar texts of the buckets(key, same, lead, size) that roots(node, root) does not join yet.

    In each bucket the texts outside the component of its least are compared with all of the bucket, except those of their own
    component. Both sides are dealt into parts, so a group has a bound and a bucket is worked on by many tasks. In a bucket of two
    the pair was compared already.
    """
    named = lambda x, as_: roots.select(F.col("node").alias(x), F.col("root").alias(as_)).hint("merge")
    known = buckets.filter("size > 2").join(named("same", "own"), "same", "left").join(named("lead", "led"), "lead", "left")
    known = known.select("key", "same", F.coalesce("own", "same").alias("root"), (F.coalesce("own", "same") != F.coalesce("led", "lead")).alias("other"))
    known = written(known, "dedup-known")
    counts = known.groupBy("key").agg(F.count("*").alias("n"), F.count_if("other").alias("k")).filter("k > 0")
    counts = counts.select("key", F.ceil(F.col("n") / part).alias("n"), F.ceil(F.col("k") / part).alias("k"))
    known = written(known.join(written(counts, "dedup-counts").hint("merge"), "key"), "dedup-rest")
    deal = lambda of: F.pmod(F.xxhash64("same", F.lit(of)), F.col(of))
    alls = known.select("key", "same", "root", F.lit(False).alias("asks"), deal("n").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    others = known.filter("other").select("key", "same", "root", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"), deal("k").alias("i"))
    dealt = alls.unionByName(others).join(sets.hint("merge"), "same")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, root, asks = (table.column(c).to_numpy() for c in ("same", "root", "asks"))
        found = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("shingles")]
        size = np.array([len(x) for x in found])
        place = np.unique(np.concatenate(found), return_inverse=True)[1]
        start = np.append(0, np.cumsum(size))
        mark = np.zeros(int(place.max()) + 1, np.int32)
        a, b = [], []
        for row in np.flatnonzero(asks):
            apart = root != root[row]
            if not apart.any():
                continue
            mine = place[start[row] : start[row + 1]]
            mark[mine] = 1
            shared = np.add.reduceat(mark[place], start[:-1])
            mark[mine] = 0
            near = np.flatnonzero(apart & (shared >= least * (size + size[row] - shared)))
            # one link for each component that is joined
            joined, one = np.unique(root[near], return_index=True)
            a += [int(rep[row])] * len(one)
            b += rep[near[one]].tolist()
            root = np.where(np.isin(root, joined), root[row], root)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select("key", "i", "j", "same", "root", "asks", "shingles").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """The texts of docs(doc_id, text) (doc_id, same) and their groups: same, root for every class of copies that is linked to another.

    Texts with the same words are one class, whatever their number. Classes meet by their fingerprints, as in grouped(), and by the bands
    of their shingles. In each bucket all are compared with the least, so a bucket gives rows in proportion to its size; what
    this leaves apart is compared with all of the bucket.
    """
    small_batches(docs.sparkSession)
    texts = written(_texts(docs), "dedup-texts")
    classes = written(texts.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "dedup-classes")
    once = written(classes.groupBy("fp").agg(F.min("same").alias("lead"), F.count("*").alias("size")), "dedup-leads")
    equal = classes.select("same", "fp").join(once.filter("size > 1").hint("merge"), "fp").select(F.col("same").alias("a"), F.col("lead").alias("b"))
    ends = [once.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")).hint("merge") for x in "ab"]
    near = links(once.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    buckets = written(_leads(classes.select("same", F.explode("bands").alias("key")), "key"), "dedup-buckets")
    banded = buckets.select(F.col("same").alias("a"), F.col("lead").alias("b"))
    found = equal.unionByName(near).unionByName(banded).filter("a <> b")
    found = written(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "dedup-pairs")
    # one row of each class gives the shingles
    wanted = found.select(F.col("a").alias("same")).unionByName(found.select(F.col("b").alias("same"))).unionByName(buckets.select("same")).distinct()
    chosen = classes.join(wanted.hint("merge"), "same", "left_semi").select("same", F.col("doc_id").alias("of"))
    keyed = docs.select("doc_id", words_key(F.col("text")).alias("same"), "text")
    keyed = keyed.join(chosen.hint("merge"), "same").filter(F.col("doc_id").eqNullSafe(F.col("of")))
    sets = written(_shingle_sets(keyed).groupBy("same").agg(F.first("shingles").alias("shingles")), "dedup-shingles")
    linked = written(_similar(found, sets, similarity), "dedup-links")
    roots = written(components(linked), "dedup-roots")
    more = written(_rest_links(buckets, sets, roots, similarity, part).distinct(), "dedup-rest-links")
    if not more.isEmpty():
        roots = components(linked.unionByName(more))
    forget(classes, once, buckets, found, sets)
    return texts.select("doc_id", "same"), roots


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """The rows of docs without near-duplicates: of a group of texts linked by similarity the row with the smallest doc_id stays.

    A row is its doc_id and its words: rows with one doc_id and different texts are judged apart, and a row with a null doc_id
    goes if a like text has one. Of rows alike in both one stays.
    """
    taken = {c.lower() for c in docs.columns}
    row = next(n for n in ("row_key", *(f"row_key_{k}" for k in range(len(taken) + 1))) if n not in taken)
    texts, roots = near_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), similarity, part)
    named = texts.join(roots.select(F.col("node").alias("same"), "root").hint("merge"), "same", "left")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "same")
    stays = named.groupBy(F.coalesce("root", "same").alias("root")).agg(F.min(order).alias("first"))
    stays = written(stays.select(F.xxhash64("first.same", "first.doc_id").alias(row)), "dedup-stays")
    keyed = docs.withColumn(row, F.xxhash64(words_key(F.col("text")), F.col("doc_id").cast("long")))
    return keyed.join(stays.hint("merge"), row).dropDuplicates([row]).select(*docs.columns)
