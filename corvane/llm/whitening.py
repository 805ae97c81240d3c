"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors are put on a grid of whole numbers, x = floor(scale * c) + shift, and
each different one counts once (the fit list).  The covariance is never
formed: a Spark pass takes an orthonormal block Q to V Q = Z'(Z Q) / n, with Z
the centred rows, as sums of one small matrix a task.  Between passes the
driver, which holds d x (block * kept) numbers, orthonormalises (QR) and solves
the Rayleigh-Ritz problem over the last ``kept`` blocks and their images, then
restarts from the best Ritz vectors.  It ends when a pass of its own over the
Ritz vectors, a certificate, shows every residual |V u - e u| of the k
components under ``tolerance`` times the largest eigenvalue.

Centring is exact: n x - S is computed in whole numbers and divided once.

Defined results: rows whose vector is null, or holds a null, NaN or infinite
entry, are left out, and so are vectors of a length other than the most
frequent one (of equally frequent ones the longest); null and repeated keys
are rows of their own; no remaining row gives no rows; components whose
eigenvalue is under ``rank_floor`` of the largest have no whitening and are
left out, so a constant table has none; of a component's two signs the one
with a positive first largest entry is taken; equal eigenvalues leave the
choice of their vectors to the seed.  Sums beyond 64 bits are an error.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

#: Tasks that add up the partial sums of all others; the driver gets one row of each.
ADDERS = 16
#: Rows that a task holds as floating-point numbers at once.
ROWS = 4_096


@dataclass(frozen=True)
class WhitenConfig:
    components: int = 16
    block: int = 32  # columns that one pass multiplies
    kept: int = 4  # blocks that a Rayleigh-Ritz step spans
    scale: float = 64.0
    shift: int = 1_000_000
    tolerance: float = 1e-12
    rank_floor: float = 1e-12
    most_passes: int = 400
    seed: int = 7


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # S, whole numbers
    vectors: np.ndarray  # d x k, unit columns
    values: np.ndarray  # k eigenvalues, falling
    trace: float
    identity_error: float
    residual: float  # the largest certified one, over the largest eigenvalue
    passes: int
    config: WhitenConfig


def on_grid(rows: DataFrame, key: str, vector: str, config: WhitenConfig) -> DataFrame:
    """(key, x) of the rows with a usable vector, x as whole numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = rows.select(key, F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", finite))
    x: Column = F.transform("v", lambda c: F.floor(c * config.scale) + F.lit(config.shift).cast("long"))
    return usable.select(key, x.alias("x"))


def _blocks(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole-number matrix of at most ROWS rows) of a batch's vectors."""
    for first in range(0, batch.num_rows, ROWS):
        column = batch.column(at).slice(first, ROWS)
        yield first, column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(fit: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``kernel`` (a flat array) over the fit list: one row a task, added by ADDERS tasks, then here."""
    arrow = pa.list_(pa.float64() if kind == "double" else pa.int64())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch):
                one = kernel(x)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], arrow)], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, s in _blocks(batch):
                total = s.sum(axis=0) if total is None else total + s.sum(axis=0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], arrow)], ["s"])

    schema = f"s array<{kind}>"
    rows = fit.select("x").mapInArrow(part, schema).repartition(ADDERS).mapInArrow(add, schema).collect()
    return np.sum([np.array(r["s"]) for r in rows], axis=0)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (x * n - sums) / n


def _next_block(basis: np.ndarray, wanted: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block beyond ``basis``, from the wanted directions and random ones where these vanish."""
    d = basis.shape[0]
    width = min(width, d - basis.shape[1])
    w = wanted[:, :width]
    w = np.hstack([w, np.zeros((d, width - w.shape[1]))])
    norm = np.linalg.norm(w, axis=0)
    lost = norm < 1e-14 * max(1.0, norm.max(initial=0.0))
    w = np.where(lost, rng.standard_normal((d, width)), w / np.where(lost, 1.0, norm))
    for _ in range(3):
        w = w - basis @ (basis.T @ w)
        w, r = np.linalg.qr(w)
        weak = np.abs(np.diag(r)) < 1e-8
        w = np.where(weak, rng.standard_normal((d, width)), w)
    w = w - basis @ (basis.T @ w)
    return np.linalg.qr(w)[0]


def fit(rows: DataFrame, config: WhitenConfig = WhitenConfig(), key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(the remaining rows with their grid vector, the whitening of their fit list; None where nothing is left)."""
    grid = on_grid(rows, key, vector, config)
    lengths = grid.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return grid, None
    d = int(top["d"])
    grid = grid.filter(F.size("x") == d)
    distinct = materialize(grid.select("x").distinct(), "whiten-fit")
    counted = _summed(distinct, lambda x: np.append(x.sum(axis=0), len(x)), "bigint")
    n, sums = int(counted[-1]), counted[:-1]
    k, block = min(config.components, d), min(d, max(config.block, config.components))
    passes = 0

    def image(q: np.ndarray, extra: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(V q, and with ``extra`` the covariance of Z q and the sum of its squares of Z): one pass."""

        def kernel(x: np.ndarray) -> np.ndarray:
            z = _centred(x, n, sums)
            p = z @ q
            return np.concatenate([(z.T @ p).ravel(), (p.T @ p).ravel(), [np.einsum("ij,ij->", z, z)]]) if extra else (z.T @ p).ravel()

        nonlocal passes
        passes += 1
        total = _summed(distinct, kernel) / n
        cut = q.size
        return total[:cut].reshape(q.shape), total[cut:]

    rng = np.random.default_rng(config.seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    step = np.linalg.qr(rng.standard_normal((d, block)))[0]
    best = np.inf
    while True:
        new, _ = image(step)
        basis, images = np.hstack([basis, step]), np.hstack([images, new])
        small = basis.T @ images
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, images @ turn
        residual = moved - ritz * value
        worst = float(np.linalg.norm(residual[:, :k], axis=0).max())
        top_value = max(float(value[0]), 0.0)
        if worst <= config.tolerance * top_value or basis.shape[1] == d:
            q = np.linalg.qr(ritz[:, :k])[0]
            q = q * np.where((q * ritz[:, :k]).sum(axis=0) < 0, -1.0, 1.0)
            true, rest = image(q, extra=True)
            inner = rest[:-1].reshape(k, k)
            value_k, turn_k = np.linalg.eigh((inner + inner.T) / 2)
            value_k, turn_k = value_k[::-1], turn_k[:, ::-1]
            vectors, moved_k = q @ turn_k, true @ turn_k
            checked = float(np.linalg.norm(moved_k - vectors * value_k, axis=0).max())
            if checked <= config.tolerance * top_value or basis.shape[1] == d and checked >= best:
                break  # the last: full basis, and rounding alone is left
            best = min(best, checked)
            basis, images = vectors, moved_k
            residual = moved_k - vectors * value_k
            ritz, moved = vectors, moved_k
        elif basis.shape[1] + block > config.kept * block:
            basis, images = ritz[:, :block], moved[:, :block]
        if passes >= config.most_passes:
            raise RuntimeError(f"no certificate after {passes} passes: residual {worst / (top_value or 1.0):.1e}")
        step = _next_block(basis, residual, block, rng)
    good = value_k > config.rank_floor * top_value if top_value > 0 else np.zeros(k, dtype=bool)
    vectors, value_k = vectors[:, good], value_k[good]
    lead = np.argmax(np.abs(vectors), axis=0)
    vectors = vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    root = np.sqrt(value_k)
    inner = turn_k.T @ inner @ turn_k
    error = np.abs(inner[np.ix_(good, good)] / np.outer(root, root) - np.eye(len(root))).max(initial=0.0)
    return grid, Whitening(n, sums, vectors, value_k, float(rest[-1]), float(error), checked / (top_value or 1.0), passes, config)


def transform(grid: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened): of each grid row the exact sum of (n x - S)^2, and its whitened coordinates."""
    n, sums, vectors, root = model.n, model.sums, model.vectors, np.sqrt(model.values)
    kind = next(f.dataType.simpleString() for f in grid.schema if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _blocks(batch, 1):
                off = x * n - sums
                if (off.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) > 9.2e18:
                    raise OverflowError("a deviation does not fit 64 bits")
                white = (off / n) @ vectors / root
                flat = pa.array(white.ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, max(1, white.shape[1]), dtype=np.int32), flat) if white.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), pa.array((off * off).sum(axis=1)), lists], [key, "deviation", "whitened"])

    return grid.mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def components(rows: DataFrame, config: WhitenConfig = WhitenConfig(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: one row for each remaining row and component."""
    grid, model = fit(rows, config, key, vector)
    if model is None or not len(model.values):
        return grid.limit(0).select(key, F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    out = transform(grid, model, key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*[F.lit(float(v / model.trace)) for v in model.values]), F.col("at"))
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
