"""Vector expressions on array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def let(value, body) -> Column:
    """body(value) with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def unit_vector(a) -> Column:
    """v / (|v| + 1e-12); a zero vector stays zero and non-finite entries count as zero."""
    finite = F.transform(col(a), lambda x: F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), 0.0).otherwise(x.cast("double")))
    return let(finite, lambda v: let(norm(v) + 1e-12, lambda n: F.transform(v, lambda x: x / n)))


def mix(a, b, wa, wb) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * wa + y * wb)


def mean_vector(rows: DataFrame, key: list[str], vec: str = "vec", unit: bool = True) -> DataFrame:
    """Mean vector of each group with its size n (A11, A13): averaged by position, so partial
    sums combine before the shuffle and no group is gathered."""
    flat = rows.select(*key, F.posexplode(vec).alias("pos", "x"))
    sums = flat.groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = sums.groupBy(*key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vec"))
    return out.withColumn("vec", unit_vector("vec")) if unit else out


def mean_of(rows, field: str) -> Column:
    """Mean of the vectors in a field of an array of structs, for the few vectors of one row."""
    add = lambda s, x: F.zip_with(s, x[field], lambda a, b: a + b.cast("double"))
    zero = F.transform(F.element_at(col(rows), 1)[field], lambda x: F.lit(0.0))
    return F.aggregate(col(rows), zero, add, lambda s: F.transform(s, lambda x: x / F.size(col(rows))))


def saturation(n, k: float) -> Column:
    """min(1, log(1 + n) / log(1 + k))."""
    return F.least(F.lit(1.0), F.log1p(col(n).cast("double")) / F.log1p(F.lit(float(k))))


def fused(e_def, e_dom, pools: list[tuple], lam: float = 0.6) -> Column:
    """Definition and domain vectors, then each pool prototype (vector, size, saturation size,
    weight) added as far as it points the same way (V08)."""
    def one(v: Column, a: Column, p, n, k: float, w: float) -> Column:
        gain = F.coalesce(saturation(n, k) * F.greatest(F.lit(0.0), dot(a, p)) * w, F.lit(0.0))
        p0 = F.coalesce(col(p), F.transform(a, lambda x: F.lit(0.0)))
        return let(gain, lambda g: F.zip_with(v, p0, lambda x, y: x + y * g))

    def add(a: Column) -> Column:
        v = a
        for pool in pools:
            v = one(v, a, *pool)
        return unit_vector(v)

    return let(unit_vector(mix(e_def, e_dom, lam, 1 - lam)), add)
