"""Whitening of embeddings by exact characteristic polynomial.

The scatter matrix of the integer vectors is gathered exactly. Its characteristic
polynomial is found modulo many primes by Hessenberg reduction, the primes being
dealt over tasks, and put together by Chinese remaindering. All roots are real, so
sign variations of the shifted polynomial count the roots above a point exactly
(Descartes): bisection isolates each root, multiple ones too. Components are
null vectors of the scatter minus a root, by inverse iteration.

The driver holds what the dimension bounds: the scatter matrix, the polynomial and
the components. Rows are read three times and never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Exact whole numbers of a double.
EXACT = 1 << 53
_LIMB = 40
#: Entries are held within these, so that sums of products stay whole numbers of three limbs.
_FAR = float(1 << 62)
#: Relative width to which roots are narrowed, in bits.
ROOT_BITS = 64


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows whose vector has no null, NaN or infinite entry."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def commonest_length(rows: DataFrame) -> int:
    """Length of most vectors, the longer of equally frequent ones; 0 without rows."""
    found = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def matrix(vectors: pa.Array, d: int, scale: int) -> np.ndarray:
    """``floor(scale * entry)`` as doubles, a row a vector."""
    with np.errstate(over="ignore"):
        flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
    return np.clip(flat, -_FAR, _FAR).reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in whole numbers of any size."""
    most = np.abs(y).max(initial=0)
    if most * most * len(y) < EXACT:
        return (y.T @ y).astype(np.int64).astype(object)
    whole = np.array([[int(v) for v in row] for row in y], object)
    return whole.T.dot(whole)


def moments(rows: DataFrame, d: int, scale: int) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and sums of products of the whole-number vectors: every task adds up its own rows, a grouping adds up the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column(0), d, scale)
                n += len(y)
                small = np.abs(y).max(initial=0) * len(y) < EXACT
                total += y.sum(0).astype(np.int64).astype(object) if small else np.array([[int(v) for v in row] for row in y], object).sum(0)
                square += products(y)
        if n:
            found = [(-1, -1, n), *((i, -1, int(v)) for i, v in enumerate(total)), *((i, j, int(square[i, j])) for i in range(d) for j in range(i, d))]
            low = (1 << _LIMB) - 1
            columns = [[x[0] for x in found], [x[1] for x in found], [x[2] & low for x in found], [(x[2] >> _LIMB) & low for x in found], [x[2] >> 2 * _LIMB for x in found]]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], ["i", "j", "a", "b", "c"])

    parts = rows.select("vector").mapInArrow(partial, "i int, j int, a bigint, b bigint, c bigint")
    n, sums, square = 0, [0] * d, np.zeros((d, d), object)
    for i, j, a, b, c in parts.groupBy("i", "j").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect():
        value = a + (b << _LIMB) + (c << 2 * _LIMB)
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            square[i, j] = square[j, i] = value
    return n, sums, square


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2**32."""
    odd = (n - 1) >> ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 7, 61):
        x, e = pow(base, odd, n), odd
        while e != n - 1 and x not in (1, n - 1):
            x, e = x * x % n, 2 * e
        if x != n - 1 and e % 2 == 0:
            return False
    return True


def primes_for(bits: float) -> list[int]:
    """Primes below 2**31, from above, whose product has more than ``bits`` bits."""
    found, have, n = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if is_prime(n):
            found.append(n)
            have += math.log2(n)
        n -= 2
    return found


def polynomial_modulo(a: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of ``det(x - a)`` modulo each prime: similarity to Hessenberg form, then the recurrence of its leading minors; all primes at once."""
    d, p = len(a), primes.astype(np.int64)
    h = np.stack([(a % int(q)).astype(np.int64) for q in p])
    each, m1 = np.arange(len(p)), p[:, None]
    for m in range(1, d - 1):
        swap = m + np.argmax(h[:, m:, m - 1] != 0, axis=1)
        h[each, m], h[each, swap] = h[each, swap], h[each, m].copy()
        left, right = h[each, :, m].copy(), h[each, :, swap].copy()
        h[each, :, swap], h[each, :, m] = left, right
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(h[:, m, m - 1], p, strict=True)])
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % m1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % m1[:, :, None]) % m1[:, :, None]
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % m1[:, :, None]).sum(2)) % m1
    minors = np.zeros((len(p), d + 1, d + 1), np.int64)
    minors[:, 0, 0] = 1
    for k in range(1, d + 1):
        before = minors[:, k - 1]
        now = -(before * h[:, k - 1, k - 1, None] % m1)
        now[:, 1:] += before[:, :-1]
        run = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            run = run * h[:, i, i - 1] % p
            now -= minors[:, i - 1] * (run * h[:, i - 1, k - 1] % p)[:, None] % m1
        minors[:, k] = now % m1
    return minors[:, d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray, together: int = 16) -> list[int]:
    """Coefficients of ``det(x - a)``, constant first, of a symmetric matrix of whole numbers without negative eigenvalues; ``together`` primes a row of work.

    No coefficient exceeds the product of all ``1 + eigenvalue``, which is largest where all are equal.
    """
    d = len(a)
    primes = primes_for(d * math.log2(1 + Fraction(sum(int(a[i, i]) for i in range(d)), d)) + 4)
    work = [(primes[i : i + together],) for i in range(0, len(primes), together)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                found = polynomial_modulo(a, np.array(own))
                yield pa.record_batch([pa.array(own, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "rest"])

    dealt = spark.createDataFrame(work, "primes array<bigint>").repartition(len(work))
    modulus = math.prod(primes)
    out = [0] * (d + 1)
    for prime, rest in dealt.mapInArrow(solve, "prime bigint, rest array<bigint>").collect():
        others = modulus // prime
        unit = others * pow(others, -1, prime)
        for i, r in enumerate(rest):
            out[i] += r * unit
    return [v - modulus if 2 * (v := x % modulus) > modulus else v for x in out]


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """Number of roots over ``at / 2**bits``: sign variations of the polynomial shifted there, exact as all roots are real."""
    d = len(poly) - 1
    c = [x << bits * (d - i) for i, x in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], at: int, bits: int) -> int:
    value, d = 0, len(poly) - 1
    for i in range(d, -1, -1):
        value = value * at + (poly[i] << bits * (d - i))
    return (value > 0) - (value < 0)


def root(poly: list[int], k: int, top: int, precision: int = ROOT_BITS) -> tuple[int, int]:
    """``m, bits``: the ``k``-th largest root, which is positive, lies in ``(m, m + 1] / 2**bits``, and ``m`` has ``precision`` bits.

    Bisection by exact counts until the root stands alone, by signs from there; roots that are equal go on by counts.
    """
    low, high, bits, above_low, above_high = 0, top, 0, len(poly) - 1, 0
    while True:
        if high - low == 1:
            if low.bit_length() >= precision:
                return low, bits
            more = precision if low == 0 else precision - low.bit_length()
            low, high, bits = low << more, high << more, bits + more
        middle = (low + high) // 2
        if above_low - above_high == 1:
            # the sign of p over all roots is +; above k of them, it is (-1)^k
            sign = sign_at(poly, middle, bits)
            over = sign == (-1) ** above_low
            found = above_low if over else above_high
        else:
            found = roots_above(poly, middle, bits)
        if found >= k:
            low, above_low = middle, found
        else:
            high, above_high = middle, found


def top_roots(spark: SparkSession, poly: list[int], count: int, top: int) -> list[tuple[int, int]]:
    """The ``count`` largest roots, falling; each is a task of its own."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                m, bits = root(poly, k, top)
                yield pa.record_batch([pa.array([k]), pa.array([str(m)]), pa.array([bits])], ["k", "m", "bits"])

    rows = spark.range(1, count + 1, 1, count).mapInArrow(solve, "k bigint, m string, bits bigint").collect()
    return [(int(r["m"]), r["bits"]) for r in sorted(rows)]


def null_vectors(a: np.ndarray, roots: list[tuple[int, int]], rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors, a column a root: inverse iteration on ``a - root``, whose diagonal is rounded only after the exact subtraction; each is kept orthogonal to those before it."""
    d, unit = len(a), max(1, max(int(abs(x)) for x in a.flat))
    rounded = np.array([[float(Fraction(int(x), unit)) for x in row] for row in a])
    rng, found = np.random.Generator(np.random.PCG64(7)), np.zeros((d, 0))
    for m, bits in roots:
        shifted = rounded.copy()
        for i in range(d):
            shifted[i, i] = float(Fraction((int(a[i, i]) << bits) - m, unit << bits))
        v = rng.standard_normal(d)
        for _ in range(rounds):
            for _ in range(2):
                v -= found @ (found.T @ v)
            v /= np.linalg.norm(v)
            try:
                v = np.linalg.solve(shifted, v)
            except np.linalg.LinAlgError:
                v = np.linalg.solve(shifted + np.eye(d) * 2.0**-52, v)
            v /= np.linalg.norm(v)
        for _ in range(2):
            v -= found @ (found.T @ v)
        found = np.column_stack([found, v / np.linalg.norm(v)])
    return found


RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE, offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row and leading component.

    A vector's entry c counts as the whole number ``floor(scale * c) + offset``. ``deviation``
    is the exact sum of the squares of n times a row's distances from the mean; NULL where that doesn't fit a
    long. ``whitened`` is the centred vector projected on a component over the root
    of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error``
    the largest absolute entry of the whitened rows' covariance, gathered from them, minus the identity.

    Rows with a null vector, or null, NaN or infinite entries, take no part, nor do vectors of another
    length than most have (the longer of equally frequent lengths); a null id is an id like
    others, and repeated rows count each. Whole numbers beyond 2**62 count as 2**62. Components without
    variance (fewer independent rows than dimensions) have ``whitened`` NULL and ``explained`` 0; without any variance (one row)
    ``explained`` and ``identity_error`` are NULL. An empty table, or empty vectors, give no rows. Other columns are not read. ``offset`` cancels out in every result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, id_column, column)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {RESULT}"
    d = commonest_length(rows)
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == d)
    n, sums, square = moments(rows, d, scale)
    s = np.array(sums, object)
    scatter = n * square - np.outer(s, s)
    trace = sum(int(scatter[i, i]) for i in range(d))
    poly = characteristic_polynomial(spark, scatter)
    zeros = next(i for i, x in enumerate(poly) if x)
    count, solid = min(components, d), min(components, d - zeros)
    roots = top_roots(spark, poly[zeros:], solid, trace + 1) if solid else []
    values = [Fraction(2 * m + 1, 2 << bits) / (n * n) for m, bits in roots]
    weights = null_vectors(scatter, roots) / np.array([math.sqrt(v) for v in values])[None, :] if solid else np.zeros((d, 0))

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """n times the distances from the mean, in whole numbers, and as doubles over n."""
        y = matrix(batch.column("vector"), d, scale)
        if (np.abs(y).max(initial=0) * n + max(abs(x) for x in sums)) < EXACT:
            m = n * y.astype(np.int64) - s.astype(np.int64)
            return m, m / n
        m = n * np.array([[int(v) for v in row] for row in y], object).reshape(-1, d) - s
        return m, np.array([[float(Fraction(v, n)) for v in row] for row in m]).reshape(-1, d)

    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((solid, solid)), np.zeros(solid)
        for batch in batches:
            z = centred(batch)[1] @ weights
            total += z.T @ z
            first += z.sum(0)
        cells = [(i, j, total[i, j]) for i in range(solid) for j in range(i, solid)] + [(i, -1, first[i]) for i in range(solid)]
        yield pa.record_batch([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([float(c[2]) for c in cells], pa.float64())], ["i", "j", "x"])

    error = None
    if solid:
        gathered = {(i, j): x / n for i, j, x in rows.mapInArrow(second_moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect()}
        error = max(abs(x - gathered[i, -1] * gathered[j, -1] - (i == j)) for (i, j), x in gathered.items() if j >= 0)
    share = [float(v * n * n / trace) for v in values] + [0.0 if trace else None] * (count - solid)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, distance = centred(batch)
            if m.dtype == np.int64 and float(np.abs(m).max(initial=0)) ** 2 * d < 2.0**62:
                deviation = (m * m).sum(1).tolist()
            else:
                deviation = [x if (x := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in m]
            z = np.column_stack([distance @ weights, np.full((len(m), count - solid), np.nan)]).reshape(-1)
            at = pa.array(np.repeat(np.arange(len(m)), count))
            component = np.tile(np.arange(1, count + 1, dtype=np.int32), len(m))
            yield pa.record_batch(
                [
                    batch.column("id").take(at), pa.array(component), pa.array(np.full(len(at), n)), pa.array(deviation, pa.int64()).take(at),
                    pa.array(z, mask=component > solid), pa.array(share * len(m), pa.float64()), pa.array([error] * len(at), pa.float64()),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
