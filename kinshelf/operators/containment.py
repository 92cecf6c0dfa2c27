"""Substring joins without comparing every pair.

A needle that lies in a haystack shares its grams with it, so the two meet in an equi-join
on a gram and the pair is then verified. The request side is broadcast, in passes of a
bounded number of rows; the catalogue side is streamed and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinshelf.params import BROADCAST_ROWS
from kinshelf.session import in_pass, pass_count, small, union_all

# (shortest needle, gram length, step). Haystacks give their grams at every ``step``-th
# position; a needle gives ``step`` neighbouring grams, one of which must fall on such a
# position. A class is exact for needles of at least gram + step - 1 characters.
SAMPLED = [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (7, 4, 4), (15, 8, 8)]
DENSE = [(m, m, 1) for m in range(1, 9)]
# For two large sides: short needles by one gram, which few needles have; long ones by long grams, of which
# haystacks give few.
SPREAD = [*DENSE, (15, 8, 8), (31, 16, 16)]
FEW = 50_000  # rows of short needles that are broadcast


def _class_of(length: Column, classes) -> Column:
    label = F.lit(-1)
    for i, (shortest, _, _) in enumerate(classes):
        label = F.when(length >= shortest, i).otherwise(label)
    return label


def _needle_grams(text: Column, classes) -> Column:
    """Grams of a needle, tagged with their class; the empty needle has the empty gram."""
    length = F.length(text)
    grams = F.array(F.struct(F.lit(-1).alias("cls"), F.lit("").alias("gram")))
    for i, (shortest, gram, step) in enumerate(classes):
        # From the middle of the text: starts and ends of titles are the least telling parts.
        start = F.floor((length - gram - step + 1) / 2)
        grams = F.when(length >= shortest, F.array(*[
            F.struct(F.lit(i).alias("cls"), F.substring(text, start + 1 + o, F.lit(gram)).alias("gram"))
            for o in range(step)
        ])).otherwise(grams)
    return F.array_distinct(grams)


def _haystack_grams(text: Column, classes, wanted: list[int]) -> Column:
    """Distinct tagged grams of a haystack for the wanted classes.

    Cutting a text into pieces of equal length is linear in the text, unlike taking one
    substring per position. Duplicates go while the grams are plain strings.
    """
    parts = []
    for i in wanted:
        if i < 0:
            parts.append(F.array(F.struct(F.lit(-1).alias("cls"), F.lit("").alias("gram"))))
            continue
        _, gram, step = classes[i]
        cuts = [
            F.regexp_extract_all(F.substring(text, 1 + o, 1 << 30), F.lit("(?s)(.{%d})" % gram), F.lit(1))
            for o in range(gram if step == 1 else 1)
        ]
        parts.append(F.transform(F.array_distinct(F.concat(*cuts)), _tagged(i)))
    return F.concat(*parts)


def _tagged(cls: int) -> Callable[[Column], Column]:
    return lambda gram: F.struct(F.lit(cls).alias("cls"), gram.alias("gram"))


def _rows(df: DataFrame, text: str, grams: Column) -> DataFrame:
    """One row per gram; the outer form keeps the grams from being computed twice."""
    with_grams = df.select("*", grams.alias("_grams"))
    keep = [c for c in df.columns]
    return with_grams.select(*keep, F.inline_outer("_grams")).where(F.col("gram").isNotNull())


def needles_in_haystacks(needles: DataFrame, needle: str, key: str, haystacks: DataFrame, haystack: str,
                         verify: Callable[[], Column] | None = None, by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """Pairs with ``needle`` inside ``haystack`` and equal columns ``by``; the needles are the request side.

    ``needles`` is read once per pass and should be cheap to recompute. Yields one frame per pass; a pair can occur more
    than once in it. ``verify`` replaces the plain containment test.
    """
    classed = needles.groupBy(_class_of(F.length(needle), SAMPLED).alias("cls")).count().collect()
    steps = {-1: 1, **{i: step for i, (_, _, step) in enumerate(SAMPLED)}}
    rows = sum(r["count"] * steps[r["cls"]] for r in classed)
    test = verify or (lambda: F.contains(F.col(haystack), F.col(needle)))
    n_passes = pass_count(rows)
    wanted = sorted(r["cls"] for r in classed)
    if not wanted:
        return
    stream = _rows(haystacks, haystack, _haystack_grams(F.col(haystack), SAMPLED, wanted))
    for k in range(n_passes):
        asked = _rows(in_pass(needles, key, n_passes, k), needle, _needle_grams(F.col(needle), SAMPLED))
        pairs = stream.join(F.broadcast(asked), [*by, "cls", "gram"]).where(test())
        yield pairs.drop("cls", "gram")


def haystacks_around_needles(haystacks: DataFrame, haystack: str, key: str, needles: DataFrame,
                             needle: str, by: Sequence[str] = ()) -> Iterator[DataFrame]:
    """The same pairs with the haystacks as the request side and many needles.

    A needle gives a single gram here, so the needle side keeps its number of rows.
    """
    length = F.length(haystack)
    rows = haystacks.agg(F.sum(length * len(DENSE) + 1)).first()[0] or 0
    if not rows:
        return
    wanted = list(range(-1, len(DENSE)))
    stream = _rows(needles, needle, _needle_grams(F.col(needle), DENSE))
    n_passes = pass_count(rows, BROADCAST_ROWS)
    for k in range(n_passes):
        part = in_pass(haystacks, key, n_passes, k)
        asked = _rows(part, haystack, _haystack_grams(F.col(haystack), DENSE, wanted))
        pairs = stream.join(F.broadcast(asked), [*by, "cls", "gram"])
        yield pairs.where(F.contains(F.col(haystack), F.col(needle))).drop("cls", "gram")


def contained(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str, by: Sequence[str]) -> DataFrame:
    """Pairs with ``needle`` inside ``haystack`` and equal columns ``by``, each once, where both sides are large.

    Every side is read a fixed number of times, whatever the number of rows; only needles of few
    characters are broadcast, if they are few.
    """
    kind = _class_of(F.length(needle), SPREAD)
    made = _rows(needles.withColumn("_kind", kind), needle, _needle_grams(F.col(needle), SPREAD))
    key, keep = [*by, "cls", "gram"], [*needles.columns, *(c for c in haystacks.columns if c not in by)]

    def met(wanted: list[int], asked: DataFrame) -> DataFrame:
        stream = _rows(haystacks, haystack, _haystack_grams(F.col(haystack), SPREAD, wanted))
        return stream.join(asked.drop("_kind"), key).where(F.contains(F.col(haystack), F.col(needle))).select(keep)

    kinds = [r["_kind"] for r in needles.select(kind.alias("_kind")).distinct().collect()]
    long = [i for i in kinds if i >= 0 and SPREAD[i][2] > 1]
    short = [i for i in kinds if i not in long]
    parts = []
    if short:  # one gram a needle: no pair twice
        parts.append(met(short, small(made.where(F.col("_kind").isin(short)), FEW)))
    if long:
        parts.append(met(long, made.where(F.col("_kind").isin(long))).distinct())
    return union_all(parts) if parts else needles.join(haystacks, list(by)).select(keep).limit(0)
