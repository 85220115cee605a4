"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

The scatter of whole-number vectors is a whole-number matrix, and its characteristic polynomial
has whole coefficients. They are found modulo many primes by Hessenberg reduction (a task each)
and joined by Chinese remainders. Roots are isolated by counting sign changes of the shifted
polynomial, which for real-rooted polynomials is exact; components follow by inverse iteration
in long decimals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Moments leave a task as two parts of at most this many bits below the upper one.
_PART_BITS = 60
#: Relative width of a root's bracket, and decimal digits of the inverse iteration.
_ROOT_BITS = 160
_DIGITS = 110


# Moments -----------------------------------------------------------------------------------


def exact_products(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` of whole numbers as Python integers.

    Products run in doubles as long as their sums stay below 2**53.
    """
    out = np.zeros((rows.shape[1],) * 2, object)
    top = max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0
    if top >= 1 << 26:
        wide = rows.astype(object)
        return wide.T @ wide
    step = max(1, (1 << 53) // max(1, top * top))
    for at in range(0, len(rows), step):
        part = rows[at : at + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of ``x``, exactly.

    Every task returns one row per pair of dimensions; the driver gets one per pair in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            count += len(x)
            for at in range(0, len(x), 1 << 13):
                part = x[at : at + (1 << 13)]
                small = part.size == 0 or max(abs(int(part.max())), abs(int(part.min()))) < 1 << 49
                sums += part.sum(axis=0).astype(object) if small else part.astype(object).sum(axis=0)
                products += exact_products(part)
        if count:
            i, j = np.triu_indices(dim)
            cells = [(-1, -1, count)] + [(-1, k, v) for k, v in enumerate(sums)]
            cells += list(zip(i.tolist(), j.tolist(), products[i, j]))
            low = (1 << _PART_BITS) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c[0] for c in cells], pa.int32()),
                    pa.array([c[1] for c in cells], pa.int32()),
                    pa.array([Decimal(int(c[2]) >> _PART_BITS) for c in cells], pa.decimal128(38, 0)),
                    pa.array([Decimal(int(c[2]) & low) for c in cells], pa.decimal128(38, 0)),
                ],
                ["i", "j", "high", "low"],
            )

    cells = rows.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    summed = cells.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    count, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for r in summed.collect():
        value = (int(r["high"]) << _PART_BITS) + int(r["low"])
        if r["j"] < 0:
            count = value
        elif r["i"] < 0:
            sums[r["j"]] = value
        else:
            products[r["i"]][r["j"]] = products[r["j"]][r["i"]] = value
    return count, sums, products


# Characteristic polynomial -------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Exact for all numbers below 2**32."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if n % base == 0:
            return n == base
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product exceeds ``bound``."""
    out, product, at = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(at):
            out.append(at)
            product *= at
        at -= 2
    return out


def characteristic_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo the prime ``p``, lowest first."""
    h = np.array(matrix % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            swap, with_ = [m, m + below[0]], [m + below[0], m]
            h[swap] = h[with_]
            h[:, swap] = h[:, with_]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        weight = np.zeros(k, np.int64)
        run = 1
        for i in range(k - 1, -1, -1):  # column k - 1, row i: times the subdiagonal between them
            weight[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weight[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix) of a positive semidefinite matrix, lowest first.

    Their absolute values are sums of products of eigenvalues, bounded by the trace, and their
    signs alternate; the primes (a task each) cover the bound.
    """
    d = len(matrix)
    mean = sum(matrix[k][k] for k in range(d)) // d + 1
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    primes = primes_beyond(bound)
    whole = np.array(matrix, object).reshape(d, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, characteristic_mod(whole, p).tolist()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                ["p", "coefficients"],
            )

    tasks = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64))
    value, product = [0] * (d + 1), 1
    for r in sorted(tasks.mapInArrow(run, "p bigint, coefficients array<bigint>").collect()):
        inverse = pow(product, -1, r["p"])
        for k, c in enumerate(r["coefficients"]):
            size = c if (d - k) % 2 == 0 else -c
            value[k] += product * ((size - value[k]) * inverse % r["p"])
        product *= r["p"]
    return [v if (d - k) % 2 == 0 else -v for k, v in enumerate(value)]


# Roots and components ------------------------------------------------------------------------


def above(poly: list[int], at: int, bits: int) -> int:
    """Number of roots (with multiplicity) greater than ``at / 2**bits`` of a real-rooted polynomial."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]
    for low in range(d):
        for k in range(d - 1, low - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def bracket(poly: list[int], k: int) -> tuple[int, int, int]:
    """``(low, high, bits)``: the ``k``-th largest root, a positive one, lies in (low, high] / 2**bits."""
    top = -poly[-2]  # the trace
    bits = max(0, _ROOT_BITS - top.bit_length() + 8)
    low, high = 0, top << bits
    while True:
        while high - low > 1:
            mid = (low + high) // 2
            if above(poly, mid, bits) >= k:
                low = mid
            else:
                high = mid
        if low.bit_length() > _ROOT_BITS:
            return low, high, bits
        low, high, bits = low << 64, high << 64, bits + 64


def _solver(matrix: list[list[int]], root: Decimal):
    """A function that solves (matrix - root I) y = b by one decomposition with pivots."""
    d = len(matrix)
    a = [[Decimal(v) - root if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    size = max(abs(v) for row in a for v in row) or Decimal(1)
    tiny = size.scaleb(-_DIGITS + 8)
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        order[k], order[best] = order[best], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        for i in range(k + 1, d):
            f = a[i][k] / a[k][k]
            if f:
                a[i][k] = f
                row, pivot = a[i], a[k]
                for j in range(k + 1, d):
                    row[j] -= f * pivot[j]

    def solve(b: list[Decimal]) -> list[Decimal]:
        y = [b[i] for i in order]
        for i in range(d):
            y[i] -= sum((a[i][j] * y[j] for j in range(i)), Decimal(0))
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
        return y

    return solve


def _dot(a: list[Decimal], b: list[Decimal]) -> Decimal:
    return sum((x * y for x, y in zip(a, b)), Decimal(0))


def component(matrix: list[list[int]], poly: list[int], k: int) -> tuple[Fraction, list[float]]:
    """The ``k``-th largest root and a unit vector of its null space.

    Components of one multiple root start from the same vectors in every task and are made
    orthogonal in order, so together they are an orthonormal basis.
    """
    low, high, bits = bracket(poly, k)
    place = k - above(poly, high, bits)
    d = len(matrix)
    with localcontext() as context:
        context.prec = _DIGITS
        root = Decimal(low + high) / Decimal(1 << (bits + 1))
        solve = _solver(matrix, root)
        basis: list[list[Decimal]] = []
        for start in range(place):
            draws = np.random.default_rng([13, start]).integers(-1000, 1000, d)
            vector = [Decimal(int(v)) for v in draws]
            for _ in range(4):
                vector = solve(vector)
                for other in basis:
                    share = _dot(vector, other)
                    vector = [v - share * o for v, o in zip(vector, other)]
                length = _dot(vector, vector).sqrt()
                vector = [v / length for v in vector]
            basis.append(vector)
        return Fraction(low + high, 1 << (bits + 1)), [float(v) for v in basis[-1]]


def components(spark: SparkSession, matrix: list[list[int]], count: int = COMPONENTS):
    """``(number, share of the trace, root, unit vector)`` of the positive roots, largest first.

    Every component is a task; the driver gets ``count`` vectors.
    """
    poly = characteristic(spark, matrix)
    zeros = next(k for k, v in enumerate(poly) if v)
    positive = len(poly) - 1 - zeros
    trace = -poly[-2]
    if not positive:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root, vector = component(matrix, poly, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k], pa.int64()), pa.array([float(root / trace)], pa.float64()),
                        pa.array([f"{root.numerator}/{root.denominator}"]), pa.array([vector], pa.list_(pa.float64())),
                    ],
                    ["k", "share", "root", "vector"],
                )

    tasks = spark.range(1, min(count, positive) + 1).repartition(min(count, positive))
    found = tasks.mapInArrow(run, "k bigint, share double, root string, vector array<double>").collect()
    return sorted((r["k"], r["share"], Fraction(r["root"]), r["vector"]) for r in found)


# Whitening -----------------------------------------------------------------------------------


def _finite(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def _identity_error(white: DataFrame, count: int, width: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity, centred first."""
    means = white.agg(*[F.avg(F.col("w")[k]) for k in range(width)]).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            w = _matrix(batch.column(0), width) - np.array(list(means))
            total += w.T @ w
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    cells = white.select("w").mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    gap = F.abs(F.col("v") / count - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return cells.agg(F.max(gap)).first()[0]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           count: int = COMPONENTS) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``.

    One row per vector and component, up to ``count``. Each entry c becomes the whole number
    ``x = floor(SCALE * c) + OFFSET``; components are unit eigenvectors of the covariance of x
    (divisor n), by falling eigenvalue. ``deviation`` is the exact sum over dimensions of
    (n x - S) squared (null where a long can not hold it), ``whitened`` the projection of
    x - S / n over the root of the eigenvalue, ``explained`` the eigenvalue's share of the trace,
    ``identity_error`` the largest absolute entry of whitened's covariance minus the identity,
    measured over all rows.

    Rows whose vector is null, empty or has a null or non-finite entry are left out, and so are
    rows of another dimension than the most frequent (of equals the largest). A direction
    without variance can not be whitened: only components with a positive eigenvalue are
    returned, none for an empty table, one vector, or equal vectors. Repeated rows count each; a
    null id stays null. Entries beyond a long are saturated. Other columns are not read.

    The driver gets sums per pair of dimensions and the components, sizes that depend on the
    dimension alone.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(_finite(F.col("vector")))
    # The offset moves sums and numbers alike, so deviations are taken without it.
    rows = hand_over(
        rows.select("id", F.transform("vector", lambda c: F.floor(c * SCALE)).alias("x")).withColumn("dim", F.size("x")),
        "rows",
    )
    out = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, " \
          "whitened double, explained double, identity_error double"
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], out)
    dim = dims["dim"]
    rows = rows.where(F.col("dim") == dim)
    n, sums, products = moments(rows, dim)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    unit = math.gcd(*[v for row in scatter for v in row])
    found = components(spark, [[v // unit for v in row] for row in scatter], count) if unit else []
    if not found:
        return spark.createDataFrame([], out)
    width = len(found)
    # Scatter is n squared times the covariance.
    turn = np.array([v for _, _, _, v in found]).T / np.sqrt([float(r * unit / n**2) for _, _, r, _ in found])
    top = max(abs(s) for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            largest = n * max(abs(int(x.max())), abs(int(x.min()))) + top
            if largest * largest * dim < 1 << 62:
                gap = n * x - np.array(sums, np.int64)
                deviation = np.square(gap).sum(axis=1).tolist()
            else:
                gap = n * x.astype(object) - np.array(sums, object)
                deviation = [v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]
            white = (gap / n).astype(np.float64) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                ["id", "deviation", "w"],
            )

    kind = vectors.schema[id_col].dataType.simpleString()
    white = hand_over(
        rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation bigint, w array<double>"), "white"
    )
    error = _identity_error(white, n, width)
    shares = F.array(*[F.lit(s) for _, s, _, _ in found])
    long = white.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
