"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers, of which each distinct one counts once for the fit. X is the matrix of
these rows, centred. Starting from a random direction v, the bidiagonalisation takes in turns
r = Xv - b u and Xᵀr, both as Spark jobs over all rows, and keeps every new u and v at right
angles to all earlier ones. After as many steps as there are dimensions X = U B Vᵀ holds with a
small bidiagonal B, whose singular value decomposition, on the driver, gives the components
(V times its right vectors) and the deviations along them.

A vector u is as long as the table and is never stored: all of them are Xq for a short q, so
only short vectors live on the driver. One job takes a step: a task adds up, over its rows, the
products of Xp with itself, with all earlier Xq, and with X. What Xp still has of the earlier
directions is then taken off, from p and from Xᵀr alike. A job that is lost has nothing to
recover but its own sums.

When a direction gives nothing new, because X has less rank or equal singular values, the
iteration goes on with another random one; it ends when no direction is left.

Rows: those whose vector is null, has a null or non-finite entry, an entry of 2^53 or more after
scaling, or another length than most vectors (of equally frequent lengths the largest) are
dropped. Repeated rows all come out, and count once for the fit. Components of no deviation (in
a table of n distinct vectors there are fewer than n others) can't be whitened and do not come
out; an empty table, or one with a single distinct vector, gives no rows. A ``deviation`` above
the largest long is null. Ids may be null or repeat. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
SEED = 7
# largest size of a scaled entry: whole numbers up to it are exact in a double
LARGEST = float(1 << 53)
# rows of a stored block
BLOCK_ROWS = 2_048
# directions along which X has less than this part of its norm count as none
NOTHING = 1e-11
LONG_MAX = (1 << 63) - 1


@dataclass
class Fit:
    n: int
    sums: np.ndarray  # per dimension, whole numbers
    blocks: DataFrame  # (x): up to BLOCK_ROWS distinct vectors as little-endian longs


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    components: np.ndarray  # one column each, by falling deviation
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the scaled vectors of the rows that have one."""

    def scaled(entry: Column) -> Column:
        # tried, as a filter may look at x before it looks at the size of the entries
        return F.try_add(F.floor(entry.cast("double") * SCALE), F.lit(SHIFT))

    vector = F.col(vector_col)
    sound = F.forall(
        vector, lambda e: F.coalesce(F.abs(e.cast("double") * SCALE) < LARGEST, F.lit(False))
    )
    usable = table.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), F.transform(vector, scaled).alias("x")
    )
    length = usable.groupBy(F.size("x").alias("length")).count().agg(
        F.max(F.struct("count", "length")).alias("most")
    ).first()["most"]
    return usable.filter(F.size("x") == (length["length"] if length else 0)).filter("size(x) > 0")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    rows = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            x = _matrix(batch["x"].slice(at, BLOCK_ROWS))
            sums = [str(sum(map(int, column))) for column in x.T] if abs(x).max() > 1 << 40 \
                else [str(s) for s in x.sum(axis=0).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype("<i8").tobytes()]), pa.array([len(x)], pa.int64()),
                 pa.array([sums], pa.list_(pa.string()))],
                ["x", "rows", "sums"],
            )


def fit_list(vectors: DataFrame) -> Fit | None:
    """Each distinct vector once, in blocks, with the exact sums of every dimension."""
    stored = materialize(
        vectors.select("x").distinct().mapInArrow(_blocks, "x binary, rows long, sums array<string>"),
        "whitening-fit",
    )
    n = stored.agg(F.sum("rows")).first()[0]
    if not n:
        return None
    sums = stored.select(F.posexplode("sums").alias("at", "held")).groupBy("at").agg(
        F.sum(F.col("held").cast("decimal(38,0)")).alias("total")
    ).orderBy("at").collect()
    return Fit(n, np.array([int(r["total"]) for r in sums], object), stored.select("x"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off as whole numbers."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * b) / n for s, b in zip(sums, base.tolist())])
    return (x - base) - rest


def _summed(fit: Fit, product) -> np.ndarray:
    """Sum over all blocks of a short vector that ``product`` gives for the centred rows."""
    n, sums = fit.n, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch["x"]:
                x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, len(sums))
                part = product(centred(x, n, sums))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())],
                ["at", "value"],
            )

    rows = fit.blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")
    ).collect()
    return np.array([value for _, value in sorted(map(tuple, rows))])


def _step(fit: Fit, p: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Products of Xp with the Xq of ``earlier``, with itself and with X."""

    def product(x: np.ndarray) -> np.ndarray:
        r = x @ p
        return np.concatenate([(x @ earlier).T @ r, [r @ r], x.T @ r])

    sums, known = _summed(fit, product), earlier.shape[1]
    return sums[:known], sums[known], sums[known + 1:]


def _apart(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``vector`` at right angles to all ``others``; twice is enough."""
    if others:
        basis = np.array(others)
        for _ in range(2):
            vector = vector - basis.T @ (basis @ vector)
    return vector


def bidiagonalise(fit: Fit, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """(V, B, squared norm of X): columns of V at right angles, X V = U B, B bidiagonal."""
    dims = len(fit.sums)
    square = float(_summed(fit, lambda x: np.array([(x * x).sum()]))[0])
    least = NOTHING * square ** 0.5
    draw = np.random.default_rng(seed)
    # columns so far: v; q with u = Xq; Xᵀu
    vs: list[np.ndarray] = []
    qs: list[np.ndarray] = []
    backs: list[np.ndarray] = []
    small = np.zeros((dims, dims))
    follows, beta = None, 0.0
    while len(vs) < dims and square:
        fresh = follows is None
        if fresh:
            follows, beta = _apart(draw.standard_normal(dims), vs), 0.0
            follows /= np.linalg.norm(follows)
        v, at = follows, len(vs)
        p = v - beta * qs[-1] if beta else v
        earlier = np.array(qs).T if qs else np.zeros((dims, 0))
        held, norm, back = _step(fit, p, earlier)
        if qs:  # what rounding left of the earlier directions
            p = p - earlier @ held
            back = back - np.array(backs).T @ held
        alpha = max(norm - held @ held, 0.0) ** 0.5
        vs.append(v)
        if at and beta:
            small[at - 1, at] = beta
        if alpha <= least:
            if fresh:  # a random direction holds nothing: no other will
                break
            # no u of its own: its row of B stays zero
            qs.append(np.zeros(dims))
            backs.append(np.zeros(dims))
            follows = None
            continue
        small[at, at] = alpha
        qs.append(p / alpha)
        backs.append(back / alpha)
        onward = _apart(backs[-1] - alpha * v, vs)
        beta = float(np.linalg.norm(onward))
        follows = onward / beta if beta > least else None
    k = len(vs)
    return np.array(vs).T.reshape(dims, k), small[:k, :k], square


def whiten_fit(fit: Fit, components: int = COMPONENTS, seed: int = SEED) -> Whitening:
    basis, small, square = bidiagonalise(fit, seed)
    _, singular, right = np.linalg.svd(small) if small.size else (None, np.zeros(0), None)
    kept = min(components, int((singular > NOTHING * square ** 0.5).sum()))
    found = basis @ right.T[:, :kept] if kept else np.zeros((len(fit.sums), 0))
    deviations = singular[:kept] / fit.n ** 0.5
    explained = singular[:kept] ** 2 / square if kept else np.zeros(0)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x @ found) / deviations
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    error = 0.0
    if kept:
        sums = _summed(fit, moments) / fit.n
        mean, both = sums[:kept], sums[kept:].reshape(kept, kept)
        error = float(abs(both - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitening(fit.n, fit.sums, found, deviations, explained, error)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of (n x - S)^2, exact."""
    size = float(n) * abs(centred(x, n, sums)).max(initial=0.0)
    if size * size * x.shape[1] < 1 << 61 and float(n) * abs(x).max(initial=0) < 1 << 61:
        far = n * x - sums.astype(np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
    return [value if value <= LONG_MAX else None for value in exact]


def whitened(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    components: int = COMPONENTS, seed: int = SEED,
) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    kind = table.schema[id_col].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    vectors = materialize(whole_vectors(table, id_col, vector_col), "whole-vectors")
    fit = fit_list(vectors)
    model = fit and whiten_fit(fit, components, seed)
    if not model or not len(model.deviations):
        return table.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(model.deviations)
        for batch in batches:
            x = _matrix(batch["x"])
            z = (centred(x, model.n, model.sums) @ model.components) / model.deviations
            rows, every = np.repeat(np.arange(len(x)), known), len(x) * known
            far = pa.array(_deviation(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(rows)),
                 pa.array(np.tile(np.arange(1, known + 1), len(x)), pa.int32()),
                 pa.array(np.full(every, model.n), pa.int64()), far.take(pa.array(rows)),
                 pa.array(z.ravel(), pa.float64()), pa.array(np.tile(model.explained, len(x))),
                 pa.array(np.full(every, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
