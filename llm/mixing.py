"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source would be taken ``r = target / source size`` times. The whole part
of ``r`` is certain; the fractions are rounded dependently: two documents exchange
probability, keeping their expected words together, until one of them is 0 or 1. So a
source's taken words differ from its target by less than one document.

The exchange runs as a reduction tree: hash buckets of a source first, each leaving at most
one undecided document, then the undecided of several buckets together, until one is left
per source. Rows that are decided at a level are final; nothing is joined back. Draws come
from a hash of the document, so reruns and other layouts agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinshelf.session import union_all
from llm.common import materialise, runs_on_workers, word_count

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MOST = 3.0  # times a source's size
LEAF_ROWS = 2_000
FAN_IN = 200
SEED = 7


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Targets share the total by weight; one that would pass ``most`` times its source's size
    stops there, and the rest share what it leaves, until none is above. Only sums reach the
    driver.
    """
    ranked = materialise(_ranked(sizes).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ).drop("rank"), "sources")
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # the level only rises, so a source that has stopped stays so
        above = F.col("weight") * level > cap
        full, n, weight = ranked.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.count_if(above),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not weight:
            break
        stopped, level = n, (total - full) / weight
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0, by code point with null last: numbered within ranges of the order,
    plus the rows of the ranges before."""
    keyed = sizes.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source")
    parts = materialise(keyed.withColumn("_part", F.spark_partition_id()), "source_ranges")
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source"))
    return parts.withColumn("_row", row).join(before, "_part").select(
        "source", "source_size", (F.col("_before") + F.col("_row") - 1).alias("rank"))


def _draws(doc_ids: np.ndarray, sizes: np.ndarray, level: int) -> np.ndarray:
    """Uniform draws in [0, 1) from the rows themselves (a 64-bit mixing function)."""
    with np.errstate(over="ignore"):
        z = doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)
        z += np.uint64((SEED * 1_000_003 + level) * 0xD1B54A32D192ED03 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / 2.0**53


def pivot(fraction: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rounds fractions in turn, pair by pair; at most one entry stays strictly between 0 and 1.

    A pair's expected words ``p_i s_i + p_j s_j`` and each entry's expectation are kept.
    """
    p = fraction.tolist()
    held, size_of = -1, 0.0  # the undecided document and its words
    for i, (s, u) in enumerate(zip(size.tolist(), draw.tolist())):
        if not 0.0 < p[i] < 1.0:
            continue
        if s == 0:
            p[i] = float(u < p[i])  # no words to balance
            continue
        if held < 0:
            held, size_of = i, float(s)
            continue
        mine, other = p[i] * s, p[held] * size_of
        up = min(s - mine, other)  # words that can move from the held document to this one
        down = min(mine, size_of - other)
        if u * (up + down) < down:
            mine, other = mine + up, other - up
        else:
            mine, other = mine - down, other + down
        p[i], p[held] = _settled(mine, s), _settled(other, size_of)
        if 0.0 < p[i] < 1.0:
            held, size_of = i, float(s)
        elif not 0.0 < p[held] < 1.0:
            held = -1
    return np.array(p)


def _settled(words: float, size: float) -> float:
    p = words / size
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _rounder(level: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("size", "descending"), ("draw", "ascending"), ("doc_id", "ascending")])  # the last one left is small
        size = rows["size"].to_numpy()
        named = rows["doc_id"] if pa.types.is_integer(rows.schema.field("doc_id").type) else rows["draw"]
        ids = named.cast(pa.int64()).fill_null(-1).to_numpy()
        p = pivot(rows["fraction"].to_numpy(), size, _draws(ids, size, level))
        return rows.set_column(rows.column_names.index("fraction"), "fraction", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, size: Column | None = None,
        leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    ``size`` is a document's words by default. Null text has size 0 and a null source is a
    source of its own, the last. A source of size 0 has target 0. A document is taken the
    whole part of its source's ratio or once more, so never more than ``most`` times, rounded
    up. Repeated rows are drawn for one by one. An empty table gives no rows. Other columns
    are ignored.
    """
    sized = docs.select("doc_id", "source", (word_count() if size is None else size).alias("size"))
    sized = materialise(sized, "sizes")
    counted = materialise(sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows")), "source_sizes")
    target = source_targets(counted.select("source", "source_size"), weights, most)
    facts = target.alias("t").join(counted.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select(
        "t.*", "c.rows")
    joined = sized.alias("d").join(facts.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source"))).select(
        "d.*", "f.source_size", "f.target", F.ceil(F.col("rows") / leaf_rows).alias("buckets"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = joined.select(
        "*", F.floor(ratio).cast("bigint").alias("base"), (ratio - F.floor(ratio)).alias("fraction"),
        F.xxhash64("doc_id", "size", F.lit(SEED)).alias("draw")
    ).withColumn("bucket", F.pmod("draw", F.col("buckets"))).drop("buckets")
    done = []
    for level in range(64):
        solved = materialise(rows.groupBy("source", "bucket").applyInArrow(_rounder(level), rows.schema), "rounded")
        open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        done.append(solved.where(~open_))
        if not solved.where("bucket > 0").limit(1).count():
            last = solved.where(open_)
            chance = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + 1)), F.lit(1_000_003)) / 1_000_003.0
            done.append(last.withColumn("fraction", (chance < F.col("fraction")).cast("double")))
            break
        rows = solved.where(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("bigint"))
    final = union_all(done)
    copies = F.col("base") + F.col("fraction").cast("bigint")
    return final.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mix itself: every row of ``docs``, with all columns, as often as it is taken.

    Null ids and sources are values like others; rows of no words are never multiplied beyond what
    ``mix`` says. Rows alike in id, source and size share their copies evenly, in the order of the hash
    of the whole row, so reruns agree. An empty table gives no rows."""
    key = F.struct("doc_id", "source", word_count().alias("size"))
    plan = mix(docs, weights, most).groupBy(F.struct("doc_id", "source", "size").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    plan = materialise(plan, "mix_plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    if plan.where("_rows > 1").isEmpty():
        rows = rows.join(plan.where("_copies > 0"), "_key").withColumn("_n", F.col("_copies"))
    else:  # rows that look alike share their copies evenly
        place = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_row")))
        upto = lambda i: F.floor(i * F.col("_copies") / F.col("_rows"))
        rows = rows.join(plan, "_key").withColumn("_place", place).withColumn(
            "_n", upto(F.col("_place")) - upto(F.col("_place") - 1)).where("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")


runs_on_workers(__name__)
