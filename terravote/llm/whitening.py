"""Embedding whitening (operator 12): Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

With X the centred rows, right vectors v (as long as a vector) live on the driver; left vectors u (as long as the table)
don't: u = Xw for a short w, so a task makes its own part of u from its rows whenever it is needed.  A pass over the rows
makes y = Xv, its products with all earlier u, and X'y, all added up over the tasks; u is y orthogonalised against all
earlier u, once more where most of it goes, and v is X'u orthogonalised against all earlier v.  What the steps leave is a
small bidiagonal matrix B = U'XV, whose singular value decomposition gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Up to so many dimensions all steps are taken, which is exact whatever the spectrum; beyond, steps end when the wanted
#: singular vectors have settled to this share of the greatest singular value.
FULL, SETTLED = 64, 1e-14
#: Seed of the first right vector, and of those that go on where the steps break down.
SEED = 12


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) with floor(1024 c) + 100000, of the rows whose vector is whole."""
    c = F.col("embedding").cast("array<double>")
    fine = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return df.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda e: F.floor(e * 1024) + F.lit(100000).cast("long")).alias("x"))


def _matrix(column, width: int):
    """The x-vectors of a batch as a matrix of 64-bit integers; shorter ones stand for vectors padded with zeros."""
    import numpy as np

    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), width), 100000, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Centre:
    """The exact mean S/n of the x-vectors, as whole part and remainder, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base, self.rest = n, [s // n for s in sums], [s % n for s in sums]

    def rows(self, x):
        import numpy as np

        return (x - np.array(self.base, np.int64)).astype(np.float64) - np.array(self.rest, np.float64) / self.n

    def deviation(self, x) -> list[int]:
        """Per row the sum over dimensions of (n x - S)^2, exact."""
        import numpy as np

        d = x - np.array(self.base, np.int64)
        if (int(np.abs(d).max(initial=0)) + 1) ** 2 * self.n**2 * x.shape[1] < 2**63:
            d = self.n * d - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * d.astype(object) - np.array(self.rest, object)
        return (d * d).sum(axis=1).tolist()


def _added(rows: DataFrame, make, size: int, kind: str = "double") -> list:
    """The sums over all rows of the ``size`` numbers that ``make(batch matrix)`` gives."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for b in batches:
            now = make(b.column("x"))
            held = now if held is None else [a + c for a, c in zip(held, now)]
        if held is not None:
            values = pa.array([float(v) for v in held]) if kind == "double" else pa.array([Decimal(int(v)) for v in held], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), values], ["i", "value"])

    found = rows.select("x").mapInArrow(run, f"i int, value {kind}").groupBy("i").agg(F.sum("value").cast(kind).alias("value")).collect()
    out = [0] * size
    for r in found:
        out[r["i"]] = r["value"]
    return out


def bidiagonalise(rows: DataFrame, centre: Centre, width: int, wanted: int):
    """Singular values and right singular vectors (columns) of the centred rows, greatest first."""
    import numpy as np

    rng = np.random.default_rng(SEED)

    def product(v, ws):
        """Of y = Xv: its products with the earlier u, X'y and y'y."""
        k = len(ws)

        def make(column):
            x = centre.rows(_matrix(column, width))
            y = x @ v
            return np.concatenate([(x @ np.array(ws).T).T @ y if k else [], x.T @ y, [y @ y]])

        out = np.array(_added(rows, make, k + width + 1))
        return out[:k], out[k:-1], out[-1]

    def orthogonal(r, vs):
        for _ in range(2):
            if vs:
                m = np.array(vs)
                r = r - m.T @ (m @ r)
        return r

    def fresh(vs):
        r = orthogonal(rng.standard_normal(width), vs)
        return r / np.linalg.norm(r)

    vs, ws, gs, alphas, betas = [fresh([])], [], [], [], []
    scale = 0.0
    while True:
        v = vs[-1]
        c, z, yy = product(v, ws)
        scale = max(scale, float(yy) ** 0.5)
        w = v - np.array(ws).T @ c if ws else v
        z = z - np.array(gs).T @ c if ws else z
        left = max(float(yy - c @ c), 0.0)
        if ws and left < 0.1 * yy:  # most went: what is left is orthogonalised again
            c, z, yy = product(w, ws)
            w, z, left = w - np.array(ws).T @ c, z - np.array(gs).T @ c, max(float(yy - c @ c), 0.0)
        alpha = left**0.5
        if alpha <= 1e-14 * scale * width:  # nothing of X lies along v
            alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, z = w / alpha, z / alpha
        ws.append(w)
        gs.append(z)
        alphas.append(alpha)
        r = orthogonal(z - alpha * v, vs)
        beta = float(np.linalg.norm(r)) if alpha else 0.0
        b = np.diag(alphas) + np.diag(betas, 1)
        p, sigma, q = np.linalg.svd(b)
        if len(vs) == width:
            break
        if width > FULL and len(sigma) >= wanted and np.abs(beta * p[-1, :wanted]).max() <= SETTLED * sigma[0]:
            break
        if beta <= 1e-14 * scale * width:
            betas.append(0.0)
            vs.append(fresh(vs))
        else:
            betas.append(beta)
            vs.append(r / beta)
    return sigma, np.array(vs).T @ q.T


def whitened(df: DataFrame, wanted: int = 8) -> DataFrame:
    """vec_id, component, n, deviation (decimal(38,0)), whitened, explained, identity_error for every whole vector and
    every component up to ``wanted``.

    Vectors become whole numbers x = floor(1024 c) + 100000; n, their sums and every row's deviation are exact.  All rows are
    fitted.  Components are eigenvectors of the covariance (divisor n), by falling eigenvalue e; whitened is the
    centred row along one, over the square root of e; explained is e over the trace; identity_error is the largest
    absolute entry of whitened's covariance minus the identity, measured over all rows.

    Rows stay where they are and nothing is shuffled but sums, a few numbers a task; the driver holds vectors and matrices
    as wide as an embedding.  A step takes one pass over the rows or two.

    Null vectors and vectors with null or non-finite components take no part.  Vectors shorter than the longest count as
    padded with zeros.  Null vec_id and repeated rows: rows like any others.  Components without variance (all, if the rows
    are equal) are left out.  Equal eigenvalues: any basis of theirs, the same for all rows.  Empty table: no rows.  Other
    columns are ignored, whatever their names.
    """
    import numpy as np

    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = saved(quantised(df))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    if not n or not width:
        return df.sparkSession.createDataFrame([], out)

    def exact(column):
        x = _matrix(column, width)
        return (x if int(np.abs(x).max(initial=0)) * len(x) < 2**63 else x.astype(object)).sum(axis=0).tolist()

    centre = Centre(n, [int(s) for s in _added(rows, exact, width, "decimal(38,0)")])
    sigma, right = bidiagonalise(rows, centre, width, wanted)
    least = width * np.finfo(float).eps * float(sigma[0])
    some = [i for i in range(min(wanted, len(sigma))) if sigma[i] > least]
    if not some:
        return df.sparkSession.createDataFrame([], out)
    k, axes = len(some), right[:, some]
    roots = sigma[some] / n**0.5
    # The trace is the sum of all deviations over n^3.
    trace = float(_added(rows, lambda c: [sum(centre.deviation(_matrix(c, width)))], 1, "decimal(38,0)")[0]) / float(n) ** 3
    explained = (roots**2 / trace).tolist()
    turn = axes / roots

    def products(column):
        z = centre.rows(_matrix(column, width)) @ turn
        return (z.T @ z).ravel()

    # The centred rows' exact sum is zero, so the whitened rows need no other centring.
    error = float(np.abs(np.array(_added(rows, products, k * k)).reshape(k, k) / n - np.eye(k)).max())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("x"), width)
            z, m = centre.rows(x) @ turn, len(x)
            deviation = [Decimal(d) for d in centre.deviation(x)]
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(at)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
