"""Operator 11: principal components and whitening of embeddings by shifted CholeskyQR."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries become floor(SCALE * c) + OFFSET
SCALE, OFFSET = 1024.0, 100_000
#: doubles hold every integer up to here
EXACT = float(1 << 52)
EPS = float(np.finfo(np.float64).eps)


def integers(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that remain, their integer vectors): rows that are null or hold null, NaN or infinity are left out."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.asarray(vectors.is_valid())
    keep[row[~np.isfinite(values)]] = False  # an Arrow null is NaN by now
    at = np.flatnonzero(keep)
    dims = np.unique(lengths[at])
    if len(dims) > 1:
        raise ValueError(f"vectors of {dims[0]} and of {dims[-1]} entries")
    x = np.floor(SCALE * values[keep[row]])
    if len(x) and np.abs(x).max() >= EXACT:
        raise ValueError("an entry is too large to be an exact integer")
    return at, x.astype(np.int64).reshape(len(at), dims[0] if len(dims) else 0) + OFFSET


def pieces(vectors: pa.ListArray, entries: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """integers of a batch, in slices of about `entries` numbers whatever the batch holds."""
    total = len(vectors.flatten())
    step = max(1, int(entries * max(1, len(vectors)) / max(1, total)))
    for i in range(0, len(vectors), step):
        at, x = integers(vectors.slice(i, step))
        yield at + i, x


def solve_right(a: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """X of X r = a for an upper triangular r, by forward substitution over blocks of columns."""
    x = a.copy()
    for s in range(0, r.shape[0], block):
        e = min(s + block, r.shape[0])
        x[:, s:e] -= x[:, :s] @ r[:s, s:e]
        for j in range(s, e):
            x[:, j] -= x[:, s:j] @ r[s:j, j]
            x[:, j] /= r[j, j]
    return x


@dataclass
class Centre:
    """Count and exact sums of the fit list, with the mean as integer and rest, so that x - S/n loses nothing for large x."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        parts = [divmod(s, self.n) for s in self.sums]
        self.base = np.array([q for q, _ in parts], np.int64)
        self.rest = np.array([r for _, r in parts], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; null where 64 bits can't hold one."""
        y = x - self.base  # n x - S = n y - rest
        largest = float(np.abs(y).max(initial=0)) * self.n + self.n
        if largest * largest * max(1, x.shape[1]) < 2.0**62:
            z = self.n * y - self.rest
            return (z * z).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def moments(rows: DataFrame) -> Centre | None:
    """n and S of all remaining rows: a row a task, summed by place in the JVM; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            for at, x in pieces(b.column(0)):
                if not len(at):
                    continue
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError(f"vectors of {len(total)} and of {x.shape[1]} entries")
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                n += len(at)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(total)], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["n", "d", "sums"])

    part = rows.mapInArrow(run, "n long, d int, sums array<long>")
    by_place = part.select("n", "d", F.posexplode_outer("sums").alias("j", "s")).groupBy("j")
    found = by_place.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).orderBy("j").collect()
    if not found or found[0]["most"] == 0:
        return None
    if any(r["least"] != r["most"] for r in found):
        raise ValueError(f"vectors of {found[0]['least']} and of {found[0]['most']} entries")
    return Centre(found[0]["n"], [r["s"] for r in found])


def gram(rows: DataFrame, width: int, made) -> np.ndarray:
    """The sum of q^T q over the rows that `made` gives for each slice of integer vectors: a triangle a task, summed by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for b in batches:
            for at, x in pieces(b.column(0)):
                if len(at):
                    q = made(x)
                    total += q.T @ q
                    seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([total[i, i:] for i in range(width)], pa.list_(pa.float64()))], ["i", "g"])

    part = rows.mapInArrow(run, "i int, g array<double>").select("i", F.posexplode("g").alias("k", "v"))
    found = part.groupBy("i", "k").agg(F.sum("v").alias("v")).toPandas()  # width^2 / 2 numbers
    out = np.zeros((width, width))
    i, j = found["i"].to_numpy(), (found["i"] + found["k"]).to_numpy()
    out[i, j] = out[j, i] = found["v"]
    return out


def factor(g: np.ndarray, n: int) -> np.ndarray:
    """The upper triangular Cholesky factor of a Gram matrix, of a shifted one where it is not definite to working precision."""
    d, norm = len(g), float(np.linalg.norm(g, 2))
    shift = 11 * (min(n, 1 << 16) * d + d * (d + 1)) * EPS / 2 * norm
    tries = [shift * 100.0**k for k in range(6)]
    if np.linalg.eigvalsh(g)[0] > shift:
        tries.insert(0, 0.0)
    for s in tries:
        try:
            return np.linalg.cholesky(g + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("the Gram matrix has no factor")


@dataclass
class Whitening:
    """Components (columns) with their eigenvalues and shares of the trace, over the centre of the fit list."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.values))


def fit(rows: DataFrame, centre: Centre, k: int, passes: int = 6) -> Whitening:
    """The k leading components of the covariance of all rows, without ever forming that covariance.

    Each pass sends the centred rows through the triangular solves of the factors so far and sums their Gram matrix; its Cholesky
    factor is the next one. The first is shifted where needed; two or three passes leave orthonormal rows. The factors' product R,
    with the root of the last Gram matrix, has the rows' singular values and right vectors. Components whose singular value is
    zero to working precision are left out.
    """
    d = len(centre.sums)
    spark = rows.sparkSession
    factors: list[np.ndarray] = []
    r = np.eye(d)
    g = None
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((centre, factors))

        def orthogonal(x: np.ndarray, shared=shared) -> np.ndarray:
            c, rs = shared.value
            q = c.centred(x)
            for f in rs:
                q = solve_right(q, f)
            return q

        g = gram(rows, d, orthogonal)
        if not g.any():
            return Whitening(centre, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
        if np.abs(g - np.eye(d)).max() < 1e-7 or len(factors) == passes - 1:
            break
        factors = [*factors, factor(g, centre.n)]
        r = factors[-1] @ r
    w, v = np.linalg.eigh(g)
    _, s, vt = np.linalg.svd(np.sqrt(np.maximum(w, 0))[:, None] * (v.T @ r))
    at = np.flatnonzero(s > 16 * d * EPS * s[0])[:k]
    e = s**2 / centre.n
    return Whitening(centre, vt[at].T.copy(), e[at], e[at] / e.sum())


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def made(x: np.ndarray) -> np.ndarray:
        w = shared.value.apply(x)
        return np.column_stack([w, np.ones(len(w))])  # the last column brings the sums

    g = gram(rows, k + 1, made) / model.centre.n
    mean = g[:k, k]
    return float(np.abs(g[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """Per remaining row and component up to k: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null, NaN or infinity are dropped; null ids stay null, repeated rows count and each give
    their rows, other columns are not read. An empty table, a single distinct vector or vectors without entries give no rows; with
    fewer varying directions than k there are as many components. Vectors of different lengths, and entries of 2^42 and more, raise. Equal
    eigenvalues take any basis of their space, the same for all rows. deviation is null where it does not fit 64 bits.

    About six narrow passes over the vectors; what leaves a task is a d x d triangle, and a d x d matrix goes out with the next pass.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    spec = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(vector_col)
    centre = moments(rows)
    model = fit(rows, centre, k) if centre else None
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], spec)
    error = identity_error(rows, model)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        c = len(m.values)
        for b in batches:
            for at, x in pieces(b.column(1)):
                if not len(at):
                    continue
                ids = b.column(0).take(pa.array(np.repeat(at, c)))
                dev = pa.array(m.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), c)))
                size = len(at) * c
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(at))), pa.array(np.full(size, m.centre.n, np.int64)), dev,
                     pa.array(m.apply(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(size, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return embeddings.select(id_col, vector_col).mapInArrow(run, spec)
