"""Evaluation: fitted models at very many query points.

The models are small and go to the queries if their size and number, which are checked, are at most BROADCAST_BYTES and BROADCAST_MODELS; the
queries then are a stateless map without a shuffle. Otherwise models and queries are dealt and sorted by model_id together, the queries of
one model to as many parts as they need, and a task passes over them batch by batch: it holds one batch and the last model, however many
there are. Linear models whose terms have one shape are evaluated together, so many small models cost as much as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FieldError
from . import dense
from .modified import ModifiedKernel
from .shared import written

BROADCAST_BYTES, BROADCAST_MODELS, PART_ROWS, CELLS = 64 << 20, 1000, 200_000, 1 << 18
SCALARS, GRADIENTS = "model_id long, query_id long, value double", "model_id long, query_id long, gx double, gy double, gz double"


class Field:
    """One fitted model in memory."""

    def __init__(self, row):
        self.error = row["error"]
        self.kernel, self.shape = row["kernel"], row["shape"]
        self.terms = dense.Terms(np.array(row["owner"], np.int64), np.array(row["coefficient"], float), np.array(row["point"], float).reshape(-1, 4), np.array(row["direction"], float).reshape(-1, 3))
        self.weight, self.polynomial = np.array(row["weight"], float), np.array(row["polynomial"], float)
        self.transform = None if row["transform"] is None else np.array(row["transform"], np.float32).reshape(3, 3)
        self.order, self.truncated = row["polynomial_order"], row["truncated"]
        points = row["basis_points"]
        self.modified = None if points is None else ModifiedKernel(np.array(points, float).reshape(-1, 3), self.kernel, self.shape, self.transform)

    def shape_key(self) -> tuple:
        """Fields with equal keys are evaluated together; a modified kernel and a transform are a field's own."""
        if self.modified is not None or self.transform is not None:
            return (id(self),)
        return self.kernel, self.shape, self.order, self.truncated, len(self.polynomial), (self.terms.direction != 0).any(axis=1).tobytes()

    def modified_at(self, points: np.ndarray, direction: np.ndarray) -> np.ndarray:
        n = len(points)
        return self.modified.matrix(dense.Terms(np.arange(n), np.ones(n), points, np.tile(direction, (n, 1))), self.terms) @ self.weight


class Fields:
    """Fields of one shape, stacked: terms by (field, term)."""

    def __init__(self, fields: list[Field]):
        self.one = fields[0]
        self.directed = (self.one.terms.direction != 0).any(axis=1)
        self.point, self.direction = np.stack([f.terms.point for f in fields]), np.stack([f.terms.direction for f in fields])
        self.weight = np.stack([f.terms.coefficient * f.weight[f.terms.owner] for f in fields])
        self.polynomial = np.stack([f.polynomial for f in fields])
        some = (self.weight != 0).any(axis=0)
        if self.one.modified is None and not some.all():
            # terms without weight add nothing
            self.directed, self.point, self.direction, self.weight = self.directed[some], self.point[:, some], self.direction[:, some], self.weight[:, some]

    def __call__(self, field: np.ndarray, points: np.ndarray, gradient: bool) -> np.ndarray:
        """The scalars (n, 1) or gradients (n, 3) at points (n, 4) of the fields with these numbers."""
        cells = 4 * len(self.one.terms.owner) if self.one.modified is not None else self.weight.shape[1]
        step = max(1, CELLS // max(1, cells))
        out = np.zeros((len(points), 3 if gradient else 1))
        for k in range(0, len(points), step):
            out[k : k + step] = self._block(field[k : k + step], points[k : k + step], gradient)
        return out

    def _block(self, field: np.ndarray, points: np.ndarray, gradient: bool) -> np.ndarray:
        one, n = self.one, len(points)
        axes = np.eye(3)
        if one.modified is not None:
            return np.stack([one.modified_at(points, d) for d in (axes if gradient else np.zeros((1, 3)))], axis=1)
        # one field is not copied for every point
        own = (lambda a: a[:1]) if len(self.point) == 1 else (lambda a: a[field])
        out = np.zeros((n, 3 if gradient else 1))
        for mine in (~self.directed, self.directed) if self.weight.shape[1] else ():
            if mine.any():
                out += self._kernel(own(self.point[:, mine]), own(self.direction[:, mine]), own(self.weight[:, mine]), points, bool(self.directed[mine].any()), gradient)
        if self.polynomial.shape[1]:
            for k, d in enumerate(axes if gradient else np.zeros((1, 3))):
                basis = dense.polynomial_matrix(dense.Terms(np.arange(n), np.ones(n), points, np.tile(d, (n, 1))), one.order, one.truncated)
                out[:, k] += (basis * own(self.polynomial)).sum(axis=1)
        return out

    def _kernel(self, at: np.ndarray, direction: np.ndarray, weight: np.ndarray, points: np.ndarray, directed: bool, gradient: bool) -> np.ndarray:
        """The sum over terms that all are directed, or all are values."""
        one = self.one
        d = [points[:, k, None] - at[:, :, k] for k in range(3)]
        if one.transform is None:
            square = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + (points[:, 3, None] - at[:, :, 3]) ** 2
            q, metric = d, np.eye(3)
        else:
            m = one.transform.astype(float)
            t = [sum(m[i, j] * d[j] for j in range(3)) for i in range(3)]
            square, metric = t[0] * t[0] + t[1] * t[1] + t[2] * t[2], (one.transform.T @ one.transform).astype(float)
            q = [sum(m[i, j] * t[i] for i in range(3)) for j in range(3)]
        k, f, g = dense.radial(one.kernel, np.sqrt(square), one.shape, int(directed) + int(gradient))
        if (directed or gradient) and f is None:
            raise FieldError("LinearDerivativeUnavailable")
        if not directed:
            return np.stack([(f * c * weight).sum(axis=1) for c in q], axis=1) if gradient else (k * weight).sum(axis=1)[:, None]
        along = sum(q[j] * direction[:, :, j] for j in range(3))
        if not gradient:
            return (-f * along * weight).sum(axis=1)[:, None]
        turned = direction @ metric
        return np.stack([(-(f * turned[:, :, j] + g * along * q[j]) * weight).sum(axis=1) for j in range(3)], axis=1)


class Known:
    """Fitted models by model_id, those of one shape stacked."""

    def __init__(self, rows):
        alike: dict[tuple, list[tuple[int, Field]]] = {}
        self.failed, self.place = set(), {}
        for row in rows:
            field = Field(row)
            if field.error is not None:
                self.failed.add(row["model_id"])
            else:
                alike.setdefault(field.shape_key(), []).append((row["model_id"], field))
        self.stacks = [Fields([f for _, f in some]) for some in alike.values()]
        for stack, some in enumerate(alike.values()):
            self.place |= {model_id: (stack, k) for k, (model_id, _) in enumerate(some)}

    def answers(self, queries: pd.DataFrame, gradient: bool) -> pd.DataFrame:
        """The queries of models that are known, with their answers; NaN for a model with an error."""
        ids, back = np.unique(queries["model_id"].to_numpy(), return_inverse=True)
        where = np.array([self.place.get(i, (-1 if i in self.failed else -2, 0)) for i in ids.tolist()], np.int64).reshape(-1, 2)[back]
        points = np.concatenate([queries[["x", "y", "z"]].to_numpy(float), np.zeros((len(queries), 1))], axis=1)
        out = np.full((len(queries), 3 if gradient else 1), np.nan)
        order = np.argsort(where[:, 0], kind="stable")
        cuts = np.flatnonzero(np.append(True, where[order[1:], 0] != where[order[:-1], 0])) if len(order) else []
        for mine in np.split(order, cuts[1:]):
            if len(mine) and where[mine[0], 0] >= 0:
                out[mine] = self.stacks[where[mine[0], 0]](where[mine, 1], points[mine], gradient)
        told = pd.concat([queries[["model_id", "query_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["gx", "gy", "gz"] if gradient else ["value"])], axis=1)
        return told[where[:, 0] > -2]


def evaluate(models: DataFrame, queries: DataFrame, gradient: bool = False) -> DataFrame:
    """The scalar or gradient of each query's model at queries(model_id, query_id, x, y, z); null for a model with an error, no row
    for a model that is not there."""
    spark = models.sparkSession
    schema = GRADIENTS if gradient else SCALARS
    points = queries.select("model_id", "query_id", "x", "y", "z")
    # fitted once for the check of the size and for what follows it; what the caller has cached stays as it is
    models = models if models.is_cached or models.storageLevel.useMemory or models.storageLevel.useDisk else written(models, "models")
    numbers, count = models.agg(F.coalesce(F.sum(F.size("point") + F.size("direction") + F.size("weight") + 2 * F.size("owner")), F.lit(0)), F.count("*")).first()
    if numbers * 8 <= BROADCAST_BYTES and count <= BROADCAST_MODELS:
        known = spark.sparkContext.broadcast(Known(models.collect()))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    yield known.value.answers(part, gradient)

        return points.mapInPandas(run, schema)
    # few models have more queries than a part: at most one for each PART_ROWS queries
    many = F.broadcast(points.groupBy("model_id").agg((F.floor(F.count("*") / PART_ROWS) + 1).alias("parts")).filter("parts > 1"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = points.filter("model_id is not null").join(many, "model_id", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), parts)).drop("parts")
    copies = models.filter("model_id is not null").join(many, "model_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    both = copies.withColumn("asks", F.lit(False)).unionByName(dealt.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    sorted_rows = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "model_id", "part").sortWithinPartitions("model_id", "part", "asks")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list[dict] = []
        for batch in batches:
            asks = batch["asks"].to_numpy(bool)
            # the queries of the last model may go on in the next batch
            rows = last + [_typed(r) for r in batch[~asks].to_dict("records")]
            last = rows[-1:]
            if asks.any():
                yield Known(rows).answers(batch[asks], gradient)

    return sorted_rows.mapInPandas(meet, schema)


def _typed(row: dict) -> dict:
    """A model's row from Pandas, where nulls beside it have changed its types."""
    null = lambda v: None if v is None or isinstance(v, float) and np.isnan(v) else v
    return row | {c: null(row[c]) for c in ("error", "transform", "basis_points")} | {"polynomial_order": int(row["polynomial_order"]), "truncated": bool(row["truncated"])}
