"""Distinct counts over huge identifier sets (problem 3): set registers with a logarithmic base.

A sketch has m registers. An identifier's hash picks a register and gives it a uniform
variate u in (0, 1); the register keeps the maximum of floor(1 - log_b u), at most q + 1
(0: no identifier yet). Sketches of the same m and b merge by the maximum, register by register, in any
order and number of times, so repeated deliveries don't count. The base b is tunable: a
small one makes union, intersection and Jaccard estimates sharper at the same m, a large
one makes registers smaller.

Building is a plain aggregation: (group, register) -> max. Registers that stay 0 need no
row. With n identifiers spread over m registers, P(K <= k) = exp(-(n/m) b^-k); counts and
the joint quantities of two sets are maximum-likelihood estimates under that law. The
stated error of a count is ``relative_error(m, b)`` (one standard error).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

M, BASE = 1024, 1.2
_TAIL = 200.0


def limit_for(base: float) -> int:
    """Highest register value q + 1: enough for 10^18 identifiers."""
    return math.ceil(math.log(1e18) / math.log(base)) + 1


def relative_error(m: int = M, base: float = BASE) -> float:
    """One relative standard error of a count: sqrt(((b + 1) / (b - 1) ln b - 1) / m), the registers' information limit."""
    return math.sqrt(((base + 1) / (base - 1) * math.log(base) - 1) / m)


def register_of(identifier: Column, m: int = M) -> Column:
    return F.pmod(F.xxhash64(identifier, F.lit(1)), F.lit(m)).cast("int")


def value_of(identifier: Column, base: float = BASE) -> Column:
    """floor(1 - log_b u) with u in (0, 1) from 53 bits of a second hash."""
    bits = F.shiftrightunsigned(F.xxhash64(identifier, F.lit(2)), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    value = F.floor(F.lit(1.0) - F.log(u) / F.lit(math.log(base)))
    return F.least(F.greatest(value, F.lit(1)), F.lit(limit_for(base))).cast("int")


def registers(rows: DataFrame, groups: Sequence[str], identifiers: Sequence[str], m: int = M, base: float = BASE) -> DataFrame:
    """Mergeable partial results: (groups, slot, k), one row per register above 0.

    The registers of the i-th identifier column have slots i * m to i * m + m - 1. Null
    identifiers don't count; a null group value is a group of its own here, so that coarser
    groups can be rolled up from these rows.
    """
    # One pass: each row explodes into its identifiers before the map-side maximum.
    items = F.array(*[F.struct(F.lit(i * m).alias("first"), F.col(c).cast("string").alias("id")) for i, c in enumerate(identifiers)])
    return (
        rows.select(*groups, F.explode(items).alias("i"))
        .where("i.id is not null")
        .select(*groups, (F.col("i.first") + register_of(F.col("i.id"), m)).alias("slot"), value_of(F.col("i.id"), base).alias("k"))
        .groupBy(*groups, "slot")
        .agg(F.max("k").alias("k"))
    )


def merge(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Registers of coarser groups, or of several partial results put together: the maximum per register."""
    return parts.groupBy(*groups, "slot").agg(F.max("k").alias("k"))


def _what(identifiers: Sequence[str], m: int) -> Column:
    """Name of the identifier column a slot belongs to."""
    return F.get(F.array(*[F.lit(c) for c in identifiers]), F.floor(F.col("slot") / F.lit(m)).cast("int")).alias("what")


def cardinalities(values: np.ndarray, counts: np.ndarray, starts: np.ndarray, m: int, base: float) -> np.ndarray:
    """Maximum-likelihood counts of many sketches at once, from their histograms of register values above 0.

    ``values`` and ``counts`` hold the histograms one after another, ``starts`` where each
    begins (none is empty). The derivative of each log likelihood falls in the log rate, so
    bisection finds all maxima together.
    """
    values, counts = values.astype(float), counts.astype(float)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    zero = m - np.add.reduceat(counts, starts)
    top = values >= limit_for(base)  # the top register has no upper end
    upper, below = np.where(top, 0.0, base**-values), base ** -(values - 1)
    low, high = np.full(len(starts), -25.0), np.full(len(starts), 45.0)
    for _ in range(48):
        middle = (low + high) / 2
        rate = np.exp(middle)
        r = rate[owner]
        gap = np.clip(r * (below - upper), 1e-300, _TAIL)
        slope = np.add.reduceat(counts * (gap / np.expm1(gap) - r * upper), starts) - rate * zero
        up = slope > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return m * np.exp((low + high) / 2)


def _cardinality(histogram: dict[int, int], m: int, base: float) -> float:
    if not histogram:
        return 0.0
    return float(cardinalities(np.array(list(histogram)), np.array(list(histogram.values())), np.array([0]), m, base)[0])


def counts(parts: DataFrame, groups: Sequence[str], identifiers: Sequence[str], m: int = M, base: float = BASE) -> DataFrame:
    """(groups, what, estimate, rel_error) from registers: a histogram per group, then the likelihood's maximum.

    A group's histogram has at most ``limit_for(base)`` entries, whatever the group's size.
    """
    histogram = (
        parts.groupBy(*groups, _what(identifiers, m), "k")
        .agg(F.count("*").cast("int").alias("n"))
        .groupBy(*groups, "what")
        .agg(F.collect_list(F.struct("k", "n")).alias("h"))
        .select(*groups, "what", F.col("h.k").alias("ks"), F.col("h.n").alias("ns"))
    )
    schema = T.StructType([*(histogram.schema[g] for g in groups), T.StructField("what", T.StringType()), T.StructField("estimate", T.DoubleType()), T.StructField("rel_error", T.DoubleType())])
    error = relative_error(m, base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sizes = pdf["ks"].map(len).to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                found = cardinalities(np.concatenate(pdf["ks"].to_list()), np.concatenate(pdf["ns"].to_list()), starts, m, base)
                yield pdf[[*groups, "what"]].assign(estimate=found, rel_error=error)

    return histogram.mapInPandas(run, schema)


def joint_estimate(only_a: np.ndarray, only_b: np.ndarray, m: int, base: float) -> tuple[float, float, float, float]:
    """(union, intersection, jaccard, jaccard standard error): what ``joint_estimates`` gives without the other errors."""
    union, both, jaccard, error, _, _ = joint_estimates(only_a, only_b, m, base)
    return union, both, jaccard, error


def _outcomes(k: np.ndarray, l: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of register values: the coefficients (corner, rate, pair) of the rates in P(A <= k - i, B <= l - j), and their signs."""
    tail = lambda v: np.where(v < 0, np.inf, base ** -np.maximum(v, 0.0))
    corners = [(tail(k - i), tail(l - j), 1.0 if i == j else -1.0) for i in (0, 1) for j in (0, 1)]
    return np.stack([np.stack([a, b, np.maximum(a, b)]) for a, b, _ in corners]), np.array([s for _, _, s in corners])


def _score_and_information(rates: np.ndarray, coefficients: np.ndarray, signs: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the observed pairs, its gradient in the three rates, and the observed information (outer products)."""
    finite = np.where(np.isinf(coefficients), 0.0, coefficients)
    gone = np.isinf(coefficients).any(axis=1)
    e = np.where(gone, 0.0, np.exp(-np.minimum(np.einsum("r,crp->cp", rates, finite), 700.0))) * signs[:, None]
    p = np.maximum(e.sum(axis=0), 1e-300)
    slope = -np.einsum("cp,crp->rp", e, finite) / p
    return float(n @ np.log(p)), slope @ n, (slope * n) @ slope.T


def joint_estimates(only_a: np.ndarray, only_b: np.ndarray, m: int, base: float) -> tuple[float, float, float, float, float, float]:
    """(union, intersection, jaccard, jaccard error, union error, intersection error) of two sets from their aligned registers, by maximum likelihood.

    With rates x, y, z a register for "only a", "only b", "both", the pair of register values has
    P(A <= k, B <= l) = exp(-x b^-k - y b^-l - z b^-min(k, l)). All three rates maximise the likelihood of
    the observed pairs together (scoring steps, halved until the likelihood rises, from the counts of either set). The inverse of the
    information at the maximum is the covariance of the rates; the errors, one standard error each, follow from it
    by their derivatives. Those of union and intersection are in identifiers, as an intersection may be 0.
    """
    na, nb = (_cardinality(dict(zip(*np.unique(s[s > 0], return_counts=True))), m, base) / m for s in (only_a, only_b))
    if na == 0 or nb == 0:
        return m * (na + nb), 0.0, 0.0, 0.0, m * (na + nb) * relative_error(m, base), 0.0
    wide = limit_for(base) + 1
    coded, n = np.unique(only_a.astype(np.int64) * wide + only_b, return_counts=True)
    n = n.astype(float)
    coefficients, signs = _outcomes((coded // wide).astype(float), (coded % wide).astype(float), base)
    least = 1e-7 * min(na, nb)
    start = max(((na - z, nb - z, z) for z in (s * min(na, nb) for s in (0.02, 0.2, 0.5, 0.8, 0.98))), key=lambda r: _score_and_information(np.array(r), coefficients, signs, n)[0])
    rates = np.maximum(np.array(start), least)
    value, gradient, information = _score_and_information(rates, coefficients, signs, n)
    for _ in range(40):
        # A rate at its lower bound that wants to go lower stays out of the step.
        free = (rates > least) | (gradient > 0)
        step = np.zeros(3)
        ridge = 1e-9 * np.trace(information) * np.eye(3)
        step[free] = np.linalg.solve((information + ridge)[np.ix_(free, free)], gradient[free])
        scale = 1.0
        while scale > 1e-4:
            tried = np.maximum(rates + scale * step, least)
            result = _score_and_information(tried, coefficients, signs, n)
            if result[0] >= value - 1e-12:
                break
            scale /= 2
        else:
            break
        moved = np.abs(tried - rates).max() / rates.max()
        rates, (value, gradient, information) = tried, result
        if moved < 1e-7:
            break
    x, y, z = rates
    union = x + y + z
    covariance = np.linalg.inv(information + 1e-9 * np.trace(information) * np.eye(3))
    error = lambda d: float(np.sqrt(max(d @ covariance @ d, 0.0)))
    of_jaccard = error(np.array([-z, -z, x + y]) / union**2)
    z_shown = 0.0 if z <= 2 * least else z
    return float(m * union), float(m * z_shown), float(z_shown / union), of_jaccard, m * error(np.ones(3)), m * error(np.array([0.0, 0.0, 1.0]))


_JOINT = ("union_est", "intersection_est", "jaccard_est", "jaccard_error", "union_error", "intersection_error")


def joint(parts: DataFrame, groups: Sequence[str], key: str, identifiers: Sequence[str], m: int = M, base: float = BASE, max_keys: int = 2_000) -> DataFrame:
    """(groups, what, key_a, key_b, union_est, intersection_est, jaccard_est, jaccard_error, union_error, intersection_error) for all pairs of keys in a group.

    For keys of a small dictionary, such as entity types or days: more than ``max_keys`` of them in a group are refused,
    as their pairs grow with the square. The sketches of one (group, what) are brought together, packed, in three bytes a
    register, or four where the base makes values that need two (below 1.18); null keys don't form a set. Takes m up to 65,536.
    """
    if m > 1 << 16:
        raise ValueError("joint estimates take at most 65,536 registers")
    width = 1 if limit_for(base) < 256 else 2
    # Two bytes a register for its number, then its value.
    packed = F.lpad(F.hex((F.col("slot") % m * 256**width + F.col("k")).cast("bigint")), 4 + 2 * width, "0")
    sketch = parts.where(F.col(key).isNotNull()).groupBy(*groups, _what(identifiers, m), key).agg(F.unhex(F.array_join(F.collect_list(packed), "")).alias("s"))
    most = parts.where(F.col(key).isNotNull()).select(*groups, key).distinct().groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) > max_keys:
        raise ValueError(f"{most} keys in one group; at most {max_keys} are paired")
    fields = [*(parts.schema[g] for g in groups), T.StructField("what", T.StringType()), *(T.StructField(f"{key}_{x}", parts.schema[key].dataType) for x in "ab")]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in _JOINT)])
    a = sketch.withColumnsRenamed({key: f"{key}_a", "s": "sa"})
    b = sketch.withColumnsRenamed({key: f"{key}_b", "s": "sb"})
    pairs = a.join(b, [*groups, "what"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))

    def dense(s: bytes) -> np.ndarray:
        out = np.zeros(m, np.int64)
        x = np.frombuffer(s, np.uint8).reshape(-1, 2 + width).astype(np.int64)
        out[x[:, 0] * 256 + x[:, 1]] = x[:, 2] if width == 1 else x[:, 2] * 256 + x[:, 3]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [joint_estimates(dense(x), dense(y), m, base) for x, y in zip(pdf["sa"], pdf["sb"])]
            yield pd.concat([pdf[[f.name for f in fields]].reset_index(drop=True), pd.DataFrame(rows, columns=list(_JOINT))], axis=1)

    # Few rows, much work on each: spread them over all tasks.
    return pairs.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, schema)


def all_groupings(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    """Every combination of the dimensions, finest first, the total last."""
    return [c for size in range(len(dimensions), -1, -1) for c in combinations(dimensions, size)]


def grouped_counts(rows: DataFrame, dimensions: Sequence[str], identifiers: Sequence[str], m: int = M, base: float = BASE) -> DataFrame:
    """(dimensions, grouping, what, estimate, rel_error) per combination of dimensions and for every subset of them.

    ``grouping`` lists the dimensions of the row's group; the others are null. Rows with a
    null identifier don't count for it, rows with a null dimension form no group of it.
    Repeated rows change nothing; an empty table gives an empty result. The finest
    registers are built once and written; each coarser grouping merges the smallest finer one.
    """
    from .storage import written

    dims = list(dimensions)
    built = {tuple(dims): written(registers(rows, dims, identifiers, m, base), "registers")}
    for g in all_groupings(dims)[1:]:
        parent = next(p for p in reversed(list(built)) if set(g) < set(p) and len(p) == len(g) + 1)
        merged = merge(built[parent], list(g))
        # What coarser groupings are rolled up from is written, or each of them would compute it again.
        built[g] = written(merged, "registers") if len(g) > 1 else merged
    out = None
    for g, parts in built.items():
        for d in g:
            parts = parts.where(F.col(d).isNotNull())
        full = parts.select(
            *[F.col(d) if d in g else F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dims],
            F.lit(",".join(g) or "all").alias("grouping"),
            "slot",
            "k",
        )
        out = full if out is None else out.unionByName(full)
    return counts(out, [*dims, "grouping"], identifiers, m, base)
