"""Exact interpolated percentiles by counting ever narrower ranges of values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

RANGES = 1_000
EXPONENTS = 1_100  # more than a double has on either side of 1
FETCHED = 10_000  # values of one range that may be looked at one by one


def _cell(lo: float, hi: float) -> Column:
    """A number that never falls as the value rises: the exponent with the sign, or the place in a narrow range."""
    v = F.col("v")
    if lo > 0 and hi <= 2 * lo < math.inf or hi < 0 and lo >= 2 * hi > -math.inf:
        return F.floor((v - lo) / (hi - lo) * (RANGES - 1))
    exponent = F.floor(F.least(F.log2(F.abs(v)), F.lit(float(EXPONENTS)))) + EXPONENTS
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * exponent).cast("bigint")


def exact_percentiles(values: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """``(share, percentile)``, linear between neighbours like ``percentile``.

    Each pass cuts the range that holds a wanted rank into parts and counts them, for all ranks at
    once; only counts and bounds reach the driver. A wide range is cut by the exponents of the
    numbers, one within a power of two into ``RANGES`` equal parts, so a few passes are enough for any
    values, infinite ones included. A part that holds one value, or few enough to fetch, ends the
    search. No task ever orders the values. Nulls and not-a-number do not count.
    """
    spark = values.sparkSession
    rows = values.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    total, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not total:
        return spark.createDataFrame([], "share double, percentile double")
    at = {s: s * (total - 1) for s in shares}
    wanted = sorted({r for x in at.values() for r in (math.floor(x), math.ceil(x))})
    found: dict[int, float] = {}
    # rank -> (lower bound, upper bound, rows below the lower bound, rows inside)
    search = {rank: (low, high, 0, total) for rank in wanted} if low < high else {}
    if not search:
        found = dict.fromkeys(wanted, low)
    while search:
        ranges = sorted({(lo, hi) for lo, hi, _, _ in search.values()})
        few = [r for r in ranges if next(n for lo, hi, _, n in search.values() if (lo, hi) == r) <= FETCHED]
        for lo, hi in few:
            inside = sorted(r["v"] for r in rows.where(F.col("v").between(lo, hi)).collect())
            for rank, (a, b, below, _) in list(search.items()):
                if (a, b) == (lo, hi):
                    found[rank] = inside[rank - below]
                    del search[rank]
        ranges = [r for r in ranges if r not in few]
        if not ranges:
            break
        cells = F.array(*[F.when(F.col("v").between(lo, hi), F.struct(
            F.lit(i).alias("i"), _cell(lo, hi).alias("cell"), F.col("v").alias("v")))
            for i, (lo, hi) in enumerate(ranges)])
        counted = rows.select(F.inline(F.filter(cells, lambda c: c.isNotNull()))).groupBy("i", "cell").agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for rank, (lo, hi, below, _) in list(search.items()):
            for part in sorted((c for c in counted if ranges[c["i"]] == (lo, hi)), key=lambda c: c["cell"]):
                if rank < below + part["n"]:
                    search[rank] = (part["lo"], part["hi"], below, part["n"])
                    if part["lo"] == part["hi"]:
                        found[rank] = part["lo"]
                        del search[rank]
                    break
                below += part["n"]
    result = []
    for share in shares:
        a, b = found[math.floor(at[share])], found[math.ceil(at[share])]
        part = at[share] - math.floor(at[share])
        result.append((share, a if a == b or not part else (1 - part) * a + part * b))
    return spark.createDataFrame(result, "share double, percentile double")
