"""Whitening of embeddings: exact covariances by digit-slice matrix products, then an eigendecomposition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, table

SCALE, SHIFT = 64, 1_000_000
#: Rows of one matrix product, and bits of one limb: 2 * LIMB + log2(ROWS) bits stay below the 53 of a double.
ROWS, LIMB = 2_048, 20
#: Sums leave a task as signed digits of this many bits, each in a long, so that Spark's own sums of them stay exact.
DIGIT, DIGITS = 32, 6
LONG = np.iinfo(np.int64)


def as_integers(values: np.ndarray) -> np.ndarray:
    """floor(64 * value) + 1000000 as longs; what no long can hold becomes the nearest one."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    inside = np.clip(scaled, -(2.0**62), 2.0**62)
    out = inside.astype(np.int64) + SHIFT
    out[scaled > 2.0**62] = [min(LONG.max, int(min(v, 2.0**70)) + SHIFT) for v in scaled[scaled > 2.0**62]]
    out[scaled < -(2.0**62)] = [max(LONG.min, int(max(v, -(2.0**70))) + SHIFT) for v in scaled[scaled < -(2.0**62)]]
    return out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as doubles of LIMB bits each, lowest first; the last one is signed. As many as the largest number needs."""
    out = []
    while True:
        rest = x >> LIMB
        if not ((x >= -(1 << LIMB)) & (x < 1 << LIMB)).all():
            out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
            x = rest
        else:
            return [*out, x.astype(np.float64)]


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x of longs as Python integers: products of limbs are exact in doubles, and recombine as big integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        by_place: dict[int, np.ndarray] = {}
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64)
                product = product if i == j else product + product.T
                by_place[i + j] = by_place.get(i + j, 0) + product
        for place, product in by_place.items():
            total += product.astype(object) << (LIMB * place)
    return total


def digits_of(number: int) -> list[int]:
    """DIGITS signed numbers below 2 ** DIGIT whose sum by place is the number."""
    sign, number = (-1 if number < 0 else 1), abs(number)
    return [sign * (number >> (DIGIT * k) & ((1 << DIGIT) - 1)) for k in range(DIGITS)]


def number_of(digits) -> int:
    return sum(int(d) << (DIGIT * k) for k, d in enumerate(digits))


def clean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(ident, values): rows whose vector has no null and no entry that isn't finite, all of the most frequent length."""
    big = F.lit(float("inf"))
    fine = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    rows = vectors.select(F.col(key).alias("ident"), F.col(vector).cast("array<double>").alias("values")).filter(F.col("values").isNotNull() & (F.size("values") > 0)).filter(fine)
    sizes = rows.groupBy(F.size("values").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size("values") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def exact_sums(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Count, sum of each dimension, and x'x of the integer vectors, exactly: every task's products are merged by Spark, entry by entry.

    The driver gets a triangle of the square table of the vectors' length, whatever the number of rows.
    """
    schema = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))

    def make():
        def run(batches):
            n, sums, gram = 0, None, None
            for batch in batches:
                if batch.num_rows:
                    x = as_integers(_matrix(batch.column(0)))
                    part = exact_gram(x)
                    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                    own = (high.astype(object) << 32) + low.astype(object)
                    n, sums, gram = n + len(x), own if sums is None else sums + own, part if gram is None else gram + part
            if n:
                entries = [(-1, -1, n), *((-1, j, s) for j, s in enumerate(sums)), *((i, j, gram[i, j]) for i in range(len(gram)) for j in range(i + 1))]
                yield [e[0] for e in entries], [e[1] for e in entries], *zip(*(digits_of(int(e[2])) for e in entries), strict=True)

        return run

    parts = arrow_map(rows.select("values"), lambda: _as_lists(make()), schema)
    merged = parts.groupBy("i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)]).collect()
    found = {(r.i, r.j): number_of(r[2:]) for r in merged}
    if not found:
        return 0, [], np.zeros((0, 0), object)
    width = max(j for i, j in found if i == -1) + 1
    gram = np.zeros((width, width), object)
    for (i, j), value in found.items():
        if i >= 0:
            gram[i, j] = gram[j, i] = value
    return found[-1, -1], [found[-1, j] for j in range(width)], gram


def _as_lists(run):
    return lambda batches: ([list(c) for c in columns] for columns in run(batches))


def eigen(v: np.ndarray, most_sweeps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order, and unit eigenvectors as columns with their largest entry positive.

    LAPACK's vectors are polished by Jacobi rotations in extended precision, so small eigenvalues keep their digits.
    """
    wide = v.astype(np.longdouble)
    _, q = np.linalg.eigh(v.astype(np.float64))
    q = q.astype(np.longdouble)
    for _ in range(2):  # to orthogonality beyond double precision
        q = q @ (1.5 * np.eye(len(q), dtype=np.longdouble) - 0.5 * (q.T @ q))
    d = q.T @ wide @ q
    d = (d + d.T) / 2
    eps = np.finfo(np.longdouble).eps
    for _ in range(most_sweeps):
        scale = np.sqrt(np.abs(np.diag(d)))
        off = np.abs(np.triu(d, 1))
        todo = np.argwhere(off > np.maximum(1e-9 * np.outer(scale, scale), eps * np.abs(d).max() * len(d)))
        if not len(todo):
            break
        for a, b in todo:
            if d[a, b] == 0:
                continue
            theta = (d[b, b] - d[a, a]) / (2 * d[a, b])
            t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            turn = np.array([[c, t * c], [-t * c, c]], np.longdouble)
            pair = [a, b]
            d[:, pair] = d[:, pair] @ turn
            d[pair] = turn.T @ d[pair]
            q[:, pair] = q[:, pair] @ turn
    values = np.diag(d)
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    values = np.where(values > eps * len(d) * max(values.max(), 0), values, 0)
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(len(q))] < 0, -1, 1)
    return values.astype(np.float64), q.astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """What tasks need to whiten a vector: how many were fitted, their sums, and each component's vector, root and share."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # one column a component, over the square root of its eigenvalue; zeros where that is zero
    values: np.ndarray
    explained: tuple[float | None, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off in integers."""
        whole, rest = np.array([s // self.n for s in self.sums], object), np.array([s % self.n / self.n for s in self.sums])
        if max(abs(int(w)) for w in whole) < 1 << 62 and len(x) and int(np.abs(x.astype(np.float64)).max()) < 1 << 61:
            return (x - whole.astype(np.int64)).astype(np.float64) - rest
        return (x.astype(object) - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2 as Python integers; in longs where they are sure to fit."""
        low, high = (int(f(x, initial=0)) for f in (np.min, np.max))
        most = self.n * max(abs(low), abs(high)) + max(map(abs, self.sums))
        if most < 1 << 62:
            away = x * self.n - np.array(self.sums, np.int64)
            if int(max(away.max(initial=0), -away.min(initial=0))) ** 2 * x.shape[1] < 1 << 62:
                return (away * away).sum(axis=1).tolist()
            away = away.astype(object)
        else:
            away = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(d) for d in (away * away).sum(axis=1)]


def fitted(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of rows of clean_vectors(); None without rows."""
    n, sums, gram = exact_sums(rows)
    if not n:
        return None
    # Covariance times n squared, in integers: centred before anything is rounded.
    scatter = gram * n - np.outer(np.array(sums, object), np.array(sums, object))
    v = np.array([[_ratio(int(e), n * n) for e in row] for row in scatter], np.longdouble)
    values, vectors = eigen(v)
    trace = _ratio(sum(int(scatter[k, k]) for k in range(len(scatter))), n * n)
    values, vectors = values[:components], vectors[:, :components]
    directions = np.divide(vectors, np.sqrt(values), out=np.zeros_like(vectors), where=values > 0)
    return Whitening(n, tuple(int(s) for s in sums), directions, values, tuple(float(e / trace) if trace else None for e in values))


def _ratio(a: int, b: int) -> np.longdouble:
    """a / b to extended precision: the whole part and 64 bits of the rest."""
    whole, rest = divmod(a, b)
    return np.longdouble(whole) + np.longdouble((rest << 64) // b) / np.longdouble(1 << 64)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, over components of positive eigenvalue."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model.values)

    def make():
        def run(batches):
            sums, products = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                if batch.num_rows:
                    w = shared.value.whitened(as_integers(_matrix(batch.column(0))))
                    sums, products = sums + w.sum(axis=0), products + w.T @ w
            at = [(i, j) for i in range(-1, width) for j in range(width)]
            yield [i for i, _ in at], [j for _, j in at], [float(sums[j] if i < 0 else products[i, j]) for i, j in at]

        return run

    parts = arrow_map(rows.select("values"), make, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    table = np.zeros((width + 1, width))
    for r in parts:
        table[r.i + 1, r.j] = r.x
    # Rows are whitened around S / n already, so their mean is what rounding left.
    mean = table[0] / model.n
    off = table[1:] / model.n - np.outer(mean, mean) - np.eye(width)
    use = model.values > 0
    return float(np.abs(off[np.ix_(use, use)]).max()) if use.any() else None


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per row and component: key, component (from 1 by falling eigenvalue), n, deviation, whitened, explained, identity_error, deviation_text.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are those of other lengths than the
    most frequent one (the longest of ties). Entries c count as floor(64 * c) + 1000000; what no long can hold becomes the nearest
    long. deviation, the sum over dimensions of (n * x - S) ** 2, is exact; it is null where no long can hold it, and
    deviation_text always has it in digits. Where an eigenvalue is zero to extended precision, whitened is null, explained is
    0, and identity_error is that of the others; both are null where all vectors are equal. Repeated rows and null keys
    count as any other. No rows in, no rows out; other columns are left out.
    """
    if dict(vectors.dtypes)[key] != "bigint":
        vectors = vectors.withColumn(key, F.col(key).cast("long"))
    rows = clean_vectors(vectors, key, vector)
    model = fitted(rows, components)
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    model, x = shared.value, as_integers(_matrix(part.column(1)))
                    width, use = len(model.values), model.values > 0
                    w, away = model.whitened(x), model.deviations(x)
                    again = np.repeat(np.arange(len(x)), width)
                    values = pa.array(w.ravel(), pa.float64(), mask=~np.tile(use, len(x)))
                    fits = pa.array([d if d <= LONG.max else None for d in away], pa.int64())
                    share = pa.array(list(model.explained), pa.float64())
                    yield part.column(0).take(pa.array(again)), np.tile(np.arange(1, width + 1, dtype=np.int32), len(x)), np.full(len(again), model.n), fits.take(pa.array(again)), values, share.take(pa.array(np.tile(np.arange(width), len(x)))), pa.array([error] * len(again), pa.float64()), pa.array(map(str, away), pa.string()).take(pa.array(again))

        return run

    return arrow_map(rows.select("ident", "values"), make, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened by the components of all of them."""
    return whitened(table(spark, sf_dir, "embeddings"))
