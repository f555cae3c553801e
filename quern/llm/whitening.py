"""Embedding whitening: principal components by matrix-free block Lanczos.

The covariance V is never formed: a pass over the vectors gives V Q for a block Q of a few columns, each task summing
c' (c Q) over its centred rows c.  Blocks build an orthonormal basis, each reorthogonalised in full against all before;
the Rayleigh-Ritz pairs of the basis are the components once their residuals are at rounding level.  Where a block breaks down
(the basis is invariant) random directions take its place, and a converged set is probed again from a random block, so
that a repeated eigenvalue is not missed.  What comes to the driver has the size of dimension times basis, whatever the rows.

Entries are integers x (see entries), so sums are exact, n x - S is exact, and centring costs no digits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tables as tables

COMPONENTS = 32
#: Columns of a block, each pass over the vectors.
BLOCK = 16
#: Entries of vectors that one step handles.
STEP = 1 << 20
_LIMIT = 9e18


def entries(embeddings: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id and x = floor(64 c) + 1000000 of each vector without null or non-finite entries.

    64 c beyond 9e18 either way counts as that.  Repeated and null ids are rows of their own.
    """
    v = F.col(vector_col)
    clean = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(v, lambda e: F.floor(F.greatest(F.least(e.cast("double") * 64, F.lit(_LIMIT)), F.lit(-_LIMIT))).cast("bigint") + F.lit(1000000).cast("bigint"))
    return embeddings.select(F.col(id_col).alias("vec_id"), F.when(clean, x).alias("x")).where("x is not null")


class Centre(NamedTuple):
    """Of the fit list: rows, exact sums of each dimension, and whether n x - S and its squares fit 64 bits."""

    n: int
    sums: list[int]
    differences_fit: bool
    squares_fit: bool

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers, or Python's where these could overflow."""
        return self.n * x - np.array(self.sums, np.int64) if self.differences_fit else self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, differences: np.ndarray) -> np.ndarray:
        return differences.astype(np.float64) / self.n

    def deviations(self, differences: np.ndarray) -> pa.Array:
        """Sums of squares by row, exact; null beyond a long."""
        if self.squares_fit:
            return pa.array((differences * differences).sum(1), pa.int64())
        totals = [sum(int(d) ** 2 for d in row) for row in differences]
        return pa.array([t if t < 1 << 63 else None for t in totals], pa.int64())


def _rows(batches, width: int):
    """vec_id and the matrix of x of each step of Arrow batches."""
    for batch in batches:
        step = max(1, STEP // width)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centre(x: DataFrame, width: int) -> Centre:
    def run(batches):
        n, sums, low, high = 0, np.zeros(width, object), None, None
        for _, m in _rows(batches, width):
            if not len(m):
                continue
            n += len(m)
            high_half, low_half = m >> 32, m & 0xFFFFFFFF  # halves add up within 64 bits
            sums = sums + high_half.sum(0).astype(object) * (1 << 32) + low_half.sum(0).astype(object)
            low = m.min(0) if low is None else np.minimum(low, m.min(0))
            high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if n:
            import decimal

            with decimal.localcontext(prec=38):
                yield pa.RecordBatch.from_arrays([pa.array(range(width)), pa.array([n] * width), pa.array([decimal.Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array(low), pa.array(high)], ["place", "n", "total", "low", "high"])

    parts = x.mapInArrow(run, "place bigint, n bigint, total decimal(38,0), low bigint, high bigint")
    got = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("place").collect()
    n = got[0]["n"] if got else 0
    sums = [int(r["total"]) for r in got]
    reach = max((max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(got, sums)), default=0)
    most = max((max(abs(n * r["high"]), abs(n * r["low"]), abs(s)) for r, s in zip(got, sums)), default=0)
    return Centre(n, sums, most < 1 << 62, most < 1 << 62 and width * reach * reach < 1 << 63)


def _summed(x: DataFrame, width: int, of_rows) -> dict[tuple[int, int], float]:
    """of_rows gives a matrix of each step; their sum over all vectors, by (row, column): a row for each task and place is shuffled."""

    def run(batches):
        total = None
        for _, m in _rows(batches, width):
            part = of_rows(m)
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "value"])

    parts = x.mapInArrow(run, "i bigint, j bigint, value double")
    got = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((int(got["i"].max()) + 1, int(got["j"].max()) + 1)) if len(got) else np.zeros((0, 0))
    out[got["i"], got["j"]] = got["value"]
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """An orthonormal block, orthogonal to basis, of the directions of block; those that have broken down become random ones."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        for attempt in range(20):
            v = rng.normal(size=len(block)) if attempt else column
            least = 1e-10 * (scale if attempt == 0 else np.linalg.norm(v))
            for _ in range(2):  # twice is enough
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            if (size := np.linalg.norm(v)) > least:
                v = v / size
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
        if basis.shape[1] + out.shape[1] == len(block):
            break
    return out


def block_lanczos(apply, width: int, wanted: int, block: int = BLOCK, tolerance: float = 1e-13, passes: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and eigenvectors (as columns) of the symmetric width x width matrix behind apply(Q).

    The basis holds 4 * wanted + 4 * block columns at most (thick restart), or all of width.  Done when the basis is complete, or
    when the wanted residuals are below tolerance times the largest eigenvalue (or have stopped falling below 1e-11 of it) and a
    probe from a random block, up to a settled next pair, has changed none of them.
    """
    wanted = min(wanted, width)
    room = min(width, 4 * wanted + 4 * block)
    rng = np.random.default_rng(5)
    basis = image = np.zeros((width, 0))
    q = _orthonormal(rng.normal(size=(width, min(block, width))), basis, rng, 1.0)
    found, before = None, []
    for _ in range(passes):
        moved = apply(q)
        basis, image = np.column_stack([basis, q]), np.column_stack([image, moved])
        t = basis.T @ image
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        ritz, moved_ritz = basis @ s, image @ s
        scale = max(abs(values[0]), abs(values[-1]), np.finfo(float).tiny)
        if basis.shape[1] >= width:
            break
        residual = np.linalg.norm(moved_ritz - ritz * values, axis=0) / scale
        worst = residual[:wanted].max()
        before.append(worst)
        flat = worst < 1e-11 and len(before) > 8 and worst > 0.9 * before[-9]
        settled = len(values) > wanted and (worst <= tolerance or flat)
        if settled and found is not None:  # in a probe, the next pair must be clear as well
            settled = residual[wanted] <= max(1e-6, 0.1 * (values[wanted - 1] - values[wanted]) / scale)
        if settled:
            if found is not None and np.abs(found - values[:wanted]).max() <= 1e-9 * scale:
                break
            found, before = values[:wanted].copy(), []
            basis, image = ritz[:, :wanted], moved_ritz[:, :wanted]
            q = _orthonormal(rng.normal(size=(width, block)), basis, rng, 1.0)
            continue
        rest = moved
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        if basis.shape[1] + block > room and room < width:
            keep = wanted + block
            basis, image = ritz[:, :keep], moved_ritz[:, :keep]
        q = _orthonormal(rest, basis, rng, scale)
    return values[:wanted], ritz[:, :wanted]


class Whitening(NamedTuple):
    x: DataFrame  # vec_id and x of the fit list, written
    centre: Centre
    values: np.ndarray  # eigenvalues above rounding, falling
    vectors: np.ndarray  # a column each, its largest entry positive
    explained: np.ndarray
    identity_error: float

    def project(self, differences: np.ndarray) -> np.ndarray:
        return self.centre.centred(differences) @ self.vectors / np.sqrt(self.values)


def fit(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Components of the vectors that entries() keeps, of the dimension that most of them have (the larger one of equals);
    vectors of another length lack entries of it and are left out.

    Components whose eigenvalue is zero to rounding (below 1e-14 * dimension of the largest) cannot be whitened and are
    left out: none are left of no or only equal vectors.
    """
    x = tables.written(entries(embeddings, vector_col))
    size = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = size["size"] if size else 0
    if not width:
        return Whitening(x.limit(0), Centre(0, [], True, True), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    of_width = x.where(F.size("x") == width)
    centre = _centre(of_width, width)

    def apply(q: np.ndarray) -> np.ndarray:
        def of_rows(m):
            c = centre.centred(centre.differences(m))
            return c.T @ (c @ q)

        return _summed(of_width, width, of_rows) / centre.n

    values, vectors = block_lanczos(apply, width, components, block)
    above = values > max(1e-14 * width * values[0], 0)
    values, vectors = values[above], vectors[:, above]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)[0] < 0, -1, 1)
    k = len(values)

    def of_rows(m):
        """Products of whitened coordinates, and in a last row the sum of squared deviations."""
        c = centre.centred(centre.differences(m))
        w = c @ vectors / np.sqrt(values)
        return np.vstack([w.T @ w, np.full((1, k), (c * c).sum())])

    if not k:
        return Whitening(of_width, centre, values, vectors, values, 0.0)
    sums = _summed(of_width, width, of_rows) / centre.n
    return Whitening(of_width, centre, values, vectors, values / sums[k, 0], float(np.abs(sums[:k] - np.eye(k)).max()))


def whitened(model: Whitening) -> DataFrame:
    """Rows of each vector of the fit list and each component: vec_id, component from 1, n, deviation (null beyond a long),
    whitened, explained and identity_error.  Empty where there are no components."""
    width, k = len(model.centre.sums), len(model.values)
    kind = model.x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return model.x.sparkSession.createDataFrame([], schema)
    part = model._replace(x=None)  # what tasks need

    def run(batches):
        for ids, m in _rows(batches, width):
            differences = part.centre.differences(m)
            rows = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(rows), part.centre.n, np.int64)),
                    part.centre.deviations(differences).take(pa.array(rows)),
                    pa.array(part.project(differences).ravel()),
                    pa.array(np.tile(part.explained, len(m))),
                    pa.array(np.full(len(rows), part.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return model.x.mapInArrow(run, schema)


def query(embeddings: DataFrame) -> DataFrame:
    """whitened(fit(embeddings))."""
    return whitened(fit(embeddings))
