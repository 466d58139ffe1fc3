"""Whitening of embeddings by shifted CholeskyQR (operator 12).

The centred rows A of the fit list are orthogonalised in passes over the stored list.  A pass sums
the Gram matrix of the present rows Q block by block on the workers; its Cholesky factor, with a
shift for as long as the matrix is not known to be safe, gives the next triangular solve.  Q is never
stored: a pass applies all solves so far to its block.  The product of the factors is R of A = QR, and
the singular value decomposition of R, a matrix of dimensions squared, gives the components.  Squaring
the condition number is thus undone by the passes: eigenvalues have the accuracy of A itself.

Only sums reach the driver: one matrix of dimensions squared for each pass, added up in Spark.

Defined cases: a row whose vector is null, empty, or holds null or non-finite entries (or one
beyond 2^45, which has no whole number of the contract's kind) is left out; repeated rows
and rows with null ``vec_id`` are kept and transformed each, while the fit list has each distinct vector
once; vectors of different lengths are fitted apart; components whose eigenvalue is zero in double
precision (fewer distinct vectors or independent dimensions than components) are left out, so a list of
one vector gives no row; tied eigenvalues give some orthonormal basis of their space, the same for
all rows; an empty table gives an empty table; other columns are not looked at, whatever their
names, and a very long text beside a vector is never read.  A deviation that does not fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, read_table, ship_package

OFFSET = 1_000_000
SCALE = 64
ROWS = 4096  # of a block that is orthogonalised at once


@dataclass(frozen=True)
class Whitening:
    """What is fitted on one list: size, sums, components by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # one row for each
    eigenvalues: np.ndarray
    trace: float


def whole_numbers(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of each entry; null where the vector has no such numbers."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = (F.size(entries) > 0) & F.forall(entries, lambda c: F.coalesce(F.abs(c) <= 2.0**45, F.lit(False)))
    return F.when(fine, F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET))


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    lists = batch.column("x")
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), len(lists[0]) if len(lists) else 0
    whole = flat.reshape(-1, width) if width else flat.reshape(0, 0)
    for a in range(0, len(whole), ROWS):
        yield whole[a : a + ROWS]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S`` in whole numbers, wider than 64 bits where they need it."""
    reach = n * float(np.max(np.abs(x), initial=0)) + float(np.max(np.abs(sums), initial=0))
    return n * x - sums if reach < 2**62 else n * x.astype(object) - sums.astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangle ``factor``, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def summed(fit: DataFrame, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum of ``block`` over all blocks: added up in each task, then in Spark place by place."""
    ship_package(fit.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _blocks(batch):
                part = block(x)
                total = part if total is None else total + part
        if total is not None:
            flat = np.ascontiguousarray(total).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    parts = fit.select("x").mapInArrow(run, f"at int, value {kind}")
    out = np.zeros(int(np.prod(shape)), dtype=np.int64 if kind == "long" else np.float64)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).toLocalIterator():
        out[row["at"]] = row["value"]
    return out.reshape(shape)


def factors(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, width: int, passes: int = 8) -> tuple[np.ndarray, float]:
    """R of the centred rows, and the trace of their Gram matrix, by shifted CholeskyQR.

    ``gram`` gives the Gram matrix of the rows after the solves by a list of factors.
    """
    unit = np.finfo(np.float64).eps / 2
    found: list[np.ndarray] = []
    whole, trace = np.eye(width), 0.0
    for k in range(passes):
        g = gram(found)
        if k == 0:
            trace = float(np.trace(g))
            if trace == 0:
                return np.zeros((width, width)), 0.0
        spread = np.linalg.eigvalsh(g)
        live = spread > 0.5
        # Directions without variance stay near 0 however often they are enlarged.
        if k and np.all(np.abs(spread[live] - 1) < 1e-12) and (np.all(live) or k > 3):
            break
        shift = 11 * (n * width + width * (width + 1)) * unit * float(np.trace(g))
        shift = min(shift, float(np.trace(g)) / 4)
        if k and spread[0] > 1e-4:
            shift = 0.0
        r = np.linalg.cholesky(g + shift * np.eye(width)).T
        found.append(r)
        whole = r @ whole
    return whole, trace


def fit_whitening(fit: DataFrame, width: int, most: int = 16) -> Whitening:
    """Fit on the distinct vectors ``x`` of one length; ``fit`` is read once for each pass."""
    counted = summed(fit, lambda x: np.concatenate([x.sum(axis=0), [len(x)]]), (width + 1,), "long")
    n, sums = int(counted[-1]), counted[:-1]

    def gram(solves: list[np.ndarray]) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            q = reduce(solve, solves, centred(x, n, sums))
            return q.T @ q

        return summed(fit, block, (width, width), "double")

    r, trace = factors(gram, n, width)
    _, sizes, components = np.linalg.svd(r)
    real = sizes > sizes[0] * width * np.finfo(np.float64).eps * 8 if trace else np.zeros(width, dtype=bool)
    kept = min(most, int(real.sum()))
    return Whitening(n, sums, components[:kept], sizes[:kept] ** 2 / n, trace / n)


def whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    return centred(x, w.n, w.sums) @ w.components.T / np.sqrt(w.eigenvalues)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.eigenvalues)
    if not k:
        return 0.0

    def block(x: np.ndarray) -> np.ndarray:
        y = whitened(x, w)
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    found = summed(fit, block, (k * k + k,), "double") / w.n
    mean = found[k * k :]
    return float(np.max(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k))))


def _transformed(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    ship_package(rows.sparkSession)

    @F.pandas_udf("struct<deviation: long, whitened: array<double>>")
    def transform(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in frames:
            far, out = [], []
            for a in range(0, len(xs), ROWS):
                x = np.stack(xs.iloc[a : a + ROWS].to_list()).astype(np.int64)
                d = deviations(x, w.n, w.sums)
                if d.dtype == object or float(np.max(np.abs(d), initial=0)) ** 2 * d.shape[1] >= 2**62:
                    d = d.astype(object)
                square = (d * d).sum(axis=1)
                if d.dtype == object and max(square) >= 2**63:
                    raise OverflowError("a deviation does not fit a long")
                far.extend(int(v) for v in square)
                out.extend(whitened(x, w))
            yield pd.DataFrame({"deviation": pd.Series(far, dtype="int64"), "whitened": out})

    explained = F.array(*[F.lit(float(v)) for v in w.eigenvalues / w.trace])
    each = rows.select("vec_id", transform("x").alias("t")).select("vec_id", F.col("t.deviation").alias("deviation"), F.posexplode("t.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 16) -> DataFrame:
    """One row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = vectors.select(vectors["vec_id"], whole_numbers(vectors[column]).alias("x")).where("x is not null")
    # Copies meet in partial aggregates before the shuffle, however many there are.
    fit = materialise(rows.select("x").distinct())
    done = []
    for row in fit.select(F.size("x").alias("width")).distinct().orderBy("width").collect():
        width = row["width"]
        alike = fit.where(F.size("x") == width)
        w = fit_whitening(alike, width, most)
        if len(w.eigenvalues):
            done.append(_transformed(rows.where(F.size("x") == width), w, identity_error(alike, w)))
    discard(fit)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    none = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return reduce(DataFrame.unionByName, done) if done else none


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
