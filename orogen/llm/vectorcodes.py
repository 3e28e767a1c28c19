"""Vector code compression: four codebooks of 256 entries, fitted and applied in exact integer arithmetic.

Every component x becomes floor(scale * x). The squared distance of a part x to an entry c is |x|^2 - 2 x.c + |c|^2. The products x.c of
a block of vectors with all entries come from float64 BLAS: integers are broken into limbs of so many bits that a sum of limb products
stays below 2^53, where float64 counts exactly, and the limbs' products are added up in int64 at their weights. int64 counts modulo
2^64, so every distance below 2^63 is exact whatever the steps between; blocks whose distances might not be are computed with
Python's integers. The first least entry wins.

A round is one scan: each task adds up its parts by entry and sends at most 4 * 256 rows of sums (in two limbs, which Spark adds as decimals),
however many vectors it saw. The codebooks alone, 256 vectors, come to the driver.

Defined cases: a vector that is null or holds a null, NaN or infinite component is left out, as is one whose length is not the table's
(the most frequent length of usable vectors, the longest of several); that length must be a multiple of four, or ValueError. Fewer than 256 vec_ids
make smaller codebooks; of rows with one vec_id the least vector gives the entry, and a null vec_id gives none but is coded like
any other. Equal vectors get equal codes. Null labels are one label. An empty table gives an empty result. Components whose
scaled value passes 2^62 have no long and raise ArithmeticError, as does an error past a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task looks at together.
BLOCK = 4096
#: Sums travel as limbs of so many bits.
_HALF = 24


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components; false for null."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ArithmeticError("a scaled component passes 2^62")
    return scaled.astype(np.int64)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as float64 limbs of `bits` bits, least first; the last one carries the sign. x = sum of limb k * 2^(bits k)."""
    found, most = [], int(np.abs(x).max()) if x.size else 0
    while most >= 1 << bits:
        found.append((x & np.int64((1 << bits) - 1)).astype(np.float64))
        x = x >> np.int64(bits)
        most = (most >> bits) + 1
    return [*found, x.astype(np.float64)]


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T modulo 2^64, by float64 products of limbs that stay below 2^53."""
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2
    total = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of c and the squared distance."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if most * most * x.shape[1] >= 1 << 63:
        return _nearest_of_large(x, c)
    distance = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * products(x, c)
    entry = distance.argmin(axis=1)
    return entry, distance[np.arange(len(x)), entry]


def _nearest_of_large(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with integers of any size, row by row: such blocks are rare."""
    entry, least = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    wide = c.astype(object)
    for i, row in enumerate(x.astype(object)):
        difference = wide - row
        distance = (difference * difference).sum(axis=1)
        entry[i] = min(range(len(c)), key=lambda k: (distance[k], k))  # noqa: B023
        least[i] = distance[entry[i]]
    return entry, least


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches and their vectors as integers; all are usable and of one width."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def _sums(vectors: DataFrame, books: np.ndarray, width: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """For each used slot (part * ENTRIES + entry) the number of its parts and their componentwise sums, exact."""
    each = width // PARTS
    names = [f"{half}{k}" for half in ("low", "high") for k in range(each)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(PARTS * ENTRIES, np.int64)
        low, high = np.zeros((PARTS * ENTRIES, each), np.int64), np.zeros((PARTS * ENTRIES, each), np.int64)
        for _, x in _blocks(batches, width, scale):
            for p in range(PARTS):
                part = x[:, p * each : (p + 1) * each]
                slot = p * ENTRIES + nearest(part, books[p])[0]
                count += np.bincount(slot, minlength=PARTS * ENTRIES)
                order = np.argsort(slot, kind="stable")
                used, first = np.unique(slot[order], return_index=True)
                low[used] += np.add.reduceat(part[order] & np.int64((1 << _HALF) - 1), first, axis=0)
                high[used] += np.add.reduceat(part[order] >> np.int64(_HALF), first, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(half[used, k]) for half in (low, high) for k in range(each))], names=["slot", "n", *names])

    sent = vectors.select("embedding").mapInArrow(add, "slot long, n long, " + ", ".join(f"{n} long" for n in names))
    exact = lambda n: F.sum(F.col(n).cast("decimal(38,0)")).alias(n)
    rows = sent.groupBy("slot").agg(F.sum("n").alias("n"), *(exact(n) for n in names)).collect()
    return {r["slot"]: (r["n"], [int(r[f"low{k}"]) + (int(r[f"high{k}"]) << _HALF) for k in range(each)]) for r in rows}


def width_of(vectors: DataFrame) -> int:
    """The most frequent length of usable vectors, the longest of several; 0 if there are none."""
    found = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found["width"] if found else 0


def codebooks(vectors: DataFrame, width: int, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """(part, entry, position): the entries after `rounds` rounds from the first vec_ids. vectors: vec_id, embedding, all usable."""
    each = width // PARTS
    known = vectors.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = [r["embedding"] for r in known.orderBy("vec_id").limit(ENTRIES).collect()]
    if not first:
        first = [[0.0] * width]
    books = np.ascontiguousarray(integers(np.array(first), scale).reshape(len(first), PARTS, each).swapaxes(0, 1))
    for _ in range(rounds):
        for slot, (n, sums) in _sums(vectors, books, width, scale).items():
            books[slot // ENTRIES, slot % ENTRIES] = [s // n for s in sums]
    return books


def coded(vectors: DataFrame, books: np.ndarray, width: int, scale: int = SCALE) -> DataFrame:
    """vectors with code and error in place of the embedding."""
    each = width // PARTS
    others = [c for c in vectors.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width, scale):
            found = [nearest(x[:, p * each : (p + 1) * each], books[p]) for p in range(PARTS)]
            code = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            # four distances below 2^61 add up within a long
            errors = sum(e if int(e.max(initial=0)) < 1 << 61 else e.astype(object) for _, e in found)
            if int(errors.max(initial=0)) >= 1 << 63:
                raise ArithmeticError("an error passes 2^63")
            codes = pa.array([code[k : k + 2 * PARTS] for k in range(0, len(code), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), codes, pa.array(errors.astype(np.int64))], names=[*others, "code", "error"])

    schema = vectors.select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return vectors.select("embedding", *others).mapInArrow(run, schema)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: error summed over equal labels.

    Sums are made by label before anything is shuffled. Labels with more than a thousandth of the rows are under a thousand by that, so
    their sums are broadcast; the other rows are joined by label.
    """
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    n = codes.count()
    large = F.broadcast(sums.filter(F.col("rows") * 1000 > n).select(F.col("label").alias("large"), F.col("label_error").alias("large_error"), F.lit(True).alias("is_large")))
    small = sums.filter(F.col("rows") * 1000 <= n).select(F.col("label").alias("small"), "label_error")
    told = codes.join(large, F.col("label").eqNullSafe(F.col("large")), "left")
    of_large = told.filter("is_large").withColumn("label_error", F.col("large_error"))
    of_small = told.filter("is_large IS NULL").join(small, F.col("label").eqNullSafe(F.col("small")))
    kept = [*codes.columns, "label_error"]
    return of_large.select(*kept).unionByName(of_small.select(*kept))


def compressed(embeddings: DataFrame, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector of embeddings (vec_id, embedding, label)."""
    fine = embeddings.select("vec_id", "label", "embedding").filter(usable(F.col("embedding")))
    width = width_of(fine)
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    vectors = fine.filter(F.size("embedding") == width)
    if not width:
        return vectors.limit(0).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    books = codebooks(vectors, width, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = written(coded(vectors, books, width, scale), "vector-codes")
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
