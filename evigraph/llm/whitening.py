"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.blocks import block_numbers, matrix_of, pack_blocks, usable
from evigraph.llm.common import map_arrow, width, written

SCALE = 256
COMPONENTS = 4
# Part of the total variance below which what is left is rounding noise.
NOISE = 1e-12
SEED = 20_250_101


def totals(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors of a length and their exact sum per dimension (position -1 counts)."""

    def run(batches):
        count, sums = 0, [0] * dim
        for batch in batches:
            for data in batch.column("matrix"):
                x = matrix_of(data.as_py(), "<i8", dim)
                count += len(x)
                # a block's sums fit 64 bits unless its entries are huge
                wide = len(x) and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 1 << 63
                part = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
                sums = [s + int(p) for s, p in zip(sums, part, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dim), pa.int32()), pa.array([count, *sums], pa.decimal128(38, 0))], ["position", "amount"]
        )

    found = map_arrow(blocks.where(F.col("dim") == dim).select("matrix"), run, "position int, amount decimal(38,0)", 8)
    amounts = {r.position: int(r.amount) for r in found.groupBy("position").agg(F.sum("amount").alias("amount")).collect()}
    return amounts.get(-1, 0), [amounts.get(i, 0) for i in range(dim)]


def summed(blocks: DataFrame, dim: int, mean: np.ndarray, function) -> np.ndarray:
    """Sum over all centred blocks of the vector that ``function`` makes of a block.

    Tasks add up their blocks, Spark adds up the tasks; the driver receives one number a position.
    """

    def run(batches):
        whole = None
        for batch in batches:
            for data in batch.column("matrix"):
                part = function(matrix_of(data.as_py(), "<i8", dim) - mean)
                whole = part if whole is None else whole + part
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole, pa.float64())], ["position", "amount"])

    found = map_arrow(blocks.where(F.col("dim") == dim).select("matrix"), run, "position int, amount double", 8)
    rows = found.groupBy("position").agg(F.sum("amount").alias("amount")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.position] = r.amount
    return out


def bidiagonalise(multiply, dim: int, energy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right Lanczos vectors (columns), diagonal and superdiagonal of the upper bidiagonal form of X.

    ``multiply(w, W)`` returns X'Xw, W'X'Xw and |Xw|^2 in one pass over the rows. A left vector is a
    combination of X's columns, so the pass makes left vectors anew from their weights W and none is
    stored. Both sides are orthogonalised against all earlier vectors. ``energy`` is the squared
    Frobenius norm of X: where the recurrence breaks down before the squares of the bidiagonal form
    exhaust it, it goes on from a new direction, so repeated singular values are all found.
    """
    rng = np.random.default_rng(SEED)
    right = np.zeros((dim, 0))
    weights = np.zeros((dim, 0))  # left vector j is X @ weights[:, j]
    images = np.zeros((dim, 0))  # X' @ left vector j
    alphas, betas = [], []
    noise = 1e-13 * np.sqrt(energy)

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def unit(v: np.ndarray) -> np.ndarray:
        v = orthogonal(v)
        return v / np.linalg.norm(v)

    v = unit(rng.normal(size=dim))
    beta, before, left = 0.0, np.zeros(dim), energy
    while True:
        w = v - beta * before
        for _ in range(3):
            back, along, square = multiply(w, weights)
            w, image = w - weights @ along, back - images @ along
            alpha = np.sqrt(max(square - along @ along, 0.0))
            # seldom more than one pass: only where most of Xw lies along earlier left vectors
            if along @ along <= 1e-6 * square or alpha <= noise * np.linalg.norm(w):
                break
        if alpha > noise * np.linalg.norm(w):
            before, image = w / alpha, image / alpha
        else:
            alpha, before, image = 0.0, np.zeros(dim), np.zeros(dim)
        right = np.column_stack((right, v))
        weights, images = np.column_stack((weights, before)), np.column_stack((images, image))
        alphas.append(alpha)
        left -= alpha**2
        if right.shape[1] == dim:
            break
        rest = orthogonal(image)
        beta = np.linalg.norm(rest)
        if beta > noise:
            v = unit(rest / beta)
        elif left <= energy * NOISE:
            break
        else:
            beta, v = 0.0, unit(rng.normal(size=dim))
        betas.append(beta)
        left -= beta**2
    return right, np.array(alphas), np.array(betas)


def principal(right: np.ndarray, alphas: np.ndarray, betas: np.ndarray, n: int, count: int, energy: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of the covariance, largest first, from the bidiagonal form."""
    _, singular, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    keep = np.flatnonzero(singular[:count] ** 2 > energy * NOISE)
    vectors = right @ turned[keep].T
    vectors /= np.linalg.norm(vectors, axis=0)
    peak = np.abs(vectors).argmax(axis=0)
    return singular[keep] ** 2 / n, vectors * np.sign(vectors[peak, np.arange(len(keep))])


def fit(blocks: DataFrame, dim: int, count: int = COMPONENTS) -> dict:
    """Mean, components and eigenvalues of all vectors of one length, and the check of the whitened ones."""
    n, sums = totals(blocks, dim)
    mean = np.array([s / n for s in sums])
    energy = float(summed(blocks, dim, mean, lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0])
    model = {"n": n, "sums": sums, "mean": mean, "values": np.zeros(0), "vectors": np.zeros((dim, 0)), "explained": np.zeros(0), "error": 0.0}
    if not energy > 0 or not np.isfinite(energy):
        return model

    def multiply(v, weights):
        def products(x):
            u = x @ v
            return np.concatenate((x.T @ u, (x @ weights).T @ u, [u @ u]))

        got = summed(blocks, dim, mean, products)
        return got[:dim], got[dim:-1], got[-1]

    values, vectors = principal(*bidiagonalise(multiply, dim, energy), n, count, energy)
    k = len(values)
    if not k:
        return model
    project = vectors / np.sqrt(values)

    def moments(x):
        y = x @ project
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    got = summed(blocks, dim, mean, moments) / n
    error = np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max()
    return model | {"values": values, "vectors": vectors, "explained": values * n / energy, "error": float(error)}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; None where it does not fit a long."""
    widest = max((n * abs(int(e)) + max(map(abs, sums)) for e in (x.min(), x.max())), default=0) if x.size else 0
    if widest**2 * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vec_id, embedding``.

    Entries c become x = floor(256 c). The fit takes each distinct x vector once: ``n`` vectors with sums
    S per dimension. Components are numbered from 1 by falling variance; ``whitened`` is x - S/n
    projected on the component over its standard deviation, ``explained`` its part of the total
    variance, ``identity_error`` the largest entry of the whitened vectors' covariance minus the
    identity, ``deviation`` the sum of (n x - S)^2 (null where it does not fit a long).

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; a null ``vec_id``
    stays. Vectors of different length are whitened apart, each length with its own fit, one after the
    other. A component without variance (up to rounding, 1e-12 of the whole) cannot be whitened and has
    no rows, so equal vectors only, or a single one, give none. Repeated rows all return. Other columns
    are ignored.

    Bidiagonalisation takes a pass over packed, centred rows a step, at most as many as there are
    dimensions; what reaches the driver is a few numbers a dimension.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.where(usable("embedding")).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("x"),
            F.size("embedding").alias("dim"),
        )
    )
    once = rows.select("x", "dim").distinct().withColumn("tid", F.xxhash64("x"))
    blocks = written(pack_blocks(block_numbers(once), [], "x", "<i8", width(spark)))
    # one fit for each length that occurs
    models = {dim: fit(blocks, dim, components) for (dim,) in blocks.select("dim").distinct().orderBy("dim").collect()}
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def transform(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                model = models[dim]
                k = len(model["values"])
                if not k:
                    continue
                part = batch.filter(pa.array(dims == dim))
                x = part.column("x").flatten().to_numpy().reshape(-1, dim)
                far = deviations(x, model["n"], model["sums"])
                ids = part.column("vec_id").to_pylist()
                white = (x - model["mean"]) @ (model["vectors"] / np.sqrt(model["values"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i in ids for _ in range(k)], pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1), len(ids)), pa.int32()),
                        pa.array(np.full(k * len(ids), model["n"]), pa.int64()),
                        pa.array([d for d in far for _ in range(k)], pa.int64()),
                        pa.array(white.ravel(), pa.float64()),
                        pa.array(np.tile(model["explained"], len(ids)), pa.float64()),
                        pa.array(np.full(k * len(ids), model["error"]), pa.float64()),
                    ],
                    names,
                )

    return map_arrow(rows, transform, schema)
