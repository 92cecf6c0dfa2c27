"""N-gram Jaccard join: linked groups of near duplicates, exactly.

The Jaccard distance is a metric, and distance 0.25 links two sets. Random pivots do not
divide a corpus, since almost all distances are 1, so the work is narrowed to where
distances carry information before regions are built.

1. Sets. One map over the whole texts gives each document's set size, a 128-bit digest of the
   set, and the shingle ids packed in blocks by hash range. Equal sets become one class.
2. Shared shingles. Blocks of one hash range meet in one task, which tells how many ids of
   each document occur in another document. A class with less than the linking share of
   its ids elsewhere can have no neighbour: its distance to every other set is too large.
   This test is exact in one direction only, so it loses nothing.
3. Regions. For the classes left, ids are ordered rare first; two linked sets have to share
   one of their first ``n - ceil(0.75 n) + 1`` ids (anchors). Each anchor has a pivot, the
   smallest class that holds it, and a class belongs to the regions of its anchors' pivots:
   its home is the pivot of the most crowded one, the others replicate it where it may have
   neighbours. The distance to the home pivot is computed; what is near it is linked to it.
4. Recursion. A region whose members are one component is done. In the others the members
   outside the largest component are measured against new pivots from it, round by round.
5. Boundaries. Pairs of one region that are still in different components are compared, if
   the triangle inequality allows: their distances to a common pivot may differ by 0.25.

Links between sets are found once per pair of components, not once per pair of documents,
and components are joined by contraction. Bounded memory: a task holds one block, one hash
range, or two sets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinshelf.session import small
from llm.common import lean, materialise, runs_on_workers, text_or_empty
from llm.components import components
from llm.shingles import ROW_BITS, ROWS, SIZE, shingle_sets
from llm.words import chunks

SHARE = 75  # per cent of the union
IDS_PER_RANGE = 1_500_000
CHARS_PER_ID = 6
PIVOT_ROUNDS = 4
PIVOTS, PROBES = 4, 12  # of a region, and of a class, in the rounds after the first
ID_BITS = 64 - ROW_BITS


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest whole numbers that hold all of them, after a byte with their width."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _blocks(range_bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1), most_rows=ROWS):
                sets = shingle_sets(data, offsets, size)
                n = last - first
                none, empty = pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sets.sizes, pa.int64()), pa.array(sets.digests, pa.binary()),
                     pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int64()), none, empty, empty],
                    names=NAMES)
                of_range = (sets.ids >> np.uint64(ID_BITS - range_bits)).astype(np.int64) if range_bits else np.zeros(len(sets.ids), np.int64)
                order = np.argsort(of_range, kind="stable")
                low = (sets.ids[order] >> np.uint64(max(ID_BITS - range_bits - 32, 0))).astype(np.uint32)
                rows, found = sets.row[order], np.flatnonzero(np.bincount(of_range))
                ends = np.searchsorted(of_range[order], found, side="right")
                begins = np.concatenate([[0], ends[:-1]])
                k = len(found)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, batch.column(0).type), none, pa.nulls(k, pa.binary()), pa.array(np.full(k, block), pa.int64()), none,
                     pa.array(found, pa.int64()), pa.array([low[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                     pa.array([_packed(np.bincount(rows[a:b], minlength=n)) for a, b in zip(begins, ends)], pa.binary())],
                    names=NAMES)
                block += 1

    return run


NAMES = ["key", "n", "digest", "block", "pos", "range", "ids", "counts"]


def _shared(group: pa.Table) -> pa.Table:
    """Of the blocks of one hash range: ids of each row that another row has as well."""
    ids = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["ids"]])
    counts = [_unpacked(x.as_py()) for x in group["counts"]]
    order = np.argsort(ids)
    same = ids[order][1:] == ids[order][:-1]
    seen = np.zeros(len(ids), bool)
    seen[order[1:][same]] = True
    seen[order[:-1][same]] = True
    total = np.concatenate([[0], np.cumsum(seen)])
    held = np.concatenate(counts)
    ends = np.cumsum(held)
    if ends[-1] != len(ids):
        raise ValueError(f"{len(ids)} ids of a range, but their counts make {ends[-1]}")
    shared = total[ends] - total[ends - held]
    parts = np.split(shared, np.cumsum([len(c) for c in counts])[:-1])
    return pa.table({"block": group["block"], "shared": pa.array([_packed(p) for p in parts], pa.binary())})


def _summed(group: pa.Table) -> pa.Table:
    total = sum(_unpacked(x.as_py()) for x in group["shared"])
    return pa.table({"block": pa.array(np.full(len(total), group["block"][0].as_py()), pa.int64()),
                     "pos": pa.array(np.arange(len(total)), pa.int64()), "shared": pa.array(total, pa.int64())})


def _id_lists(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), most_rows=ROWS):
                sets = shingle_sets(data, offsets, size)
                lists = pa.ListArray.from_arrays(pa.array(sets.starts, pa.int32()), pa.array(sets.ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.digests, pa.binary()), pa.array(sets.sizes, pa.int64()), lists], names=["cls", "n", "ids"])

    return run


def _linked(inter: Column, a: Column, b: Column, share: int) -> Column:
    return inter * 100 >= (a + b - inter) * share


def _near(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``pairs (a, b, ...)`` of fitting sizes with their ``distance`` and ``linked``."""
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("_na"), F.col("ids").alias("_ia"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("_nb"), F.col("ids").alias("_ib"))
    met = pairs.join(one, "a").join(two, "b").withColumn(
        "_inter", F.size(F.array_intersect("_ia", "_ib")).cast("bigint"))
    return met.withColumn("distance", 1 - F.col("_inter") / (F.col("_na") + F.col("_nb") - F.col("_inter"))).withColumn(
        "linked", _linked(F.col("_inter"), F.col("_na"), F.col("_nb"), share)).drop("_na", "_nb", "_ia", "_ib", "_inter")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows known by id and text, since an id may be repeated with another text."""
    return docs.select(F.struct("doc_id", F.xxhash64(text_or_empty()).alias("text_key")).alias("key"), "text")


def set_classes(docs: DataFrame, share: int = SHARE, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """``(key, n, digest)`` of every row of ``docs (key, text)``, and the live classes
    ``(cls, rep)``: those with enough ids shared to have a neighbour."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, chars / CHARS_PER_ID / IDS_PER_RANGE)))))
    key_type = docs.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, n bigint, digest binary, block bigint, pos bigint, range bigint, ids binary, counts binary"
    made = materialise(docs.mapInArrow(lean(_blocks(bits, size)), schema), "shingle_blocks")
    rows = made.where("pos is not null").select("key", "n", "digest", "block", "pos")
    shared = made.where("range is not null").select("range", "block", "ids", "counts").groupBy("range").applyInArrow(
        _shared, "block bigint, shared binary")
    totals = shared.groupBy("block").applyInArrow(_summed, "block bigint, pos bigint, shared bigint")
    marked = rows.join(totals, ["block", "pos"], "left").select(
        "key", "digest", ((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * share)).alias("live"))
    live = marked.where("digest is not null").groupBy("digest").agg(
        F.min("key").alias("rep"), F.max("live").alias("live")).where("live")
    return rows.drop("block", "pos"), materialise(live.select(F.col("digest").alias("cls"), "rep"), "live_classes")


def regions_of(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """``(region, pivot, cls, n, at, k)``: the classes that share an anchor whose pivot names
    the region, with the first place of such an anchor in their order and its members.

    Anchors with the same members (by two sums of hashes and their number) would give the
    same pairs, so of those the first in the common order stays: its places are the smallest.
    """
    spread = sets.select("cls", "n", F.explode("ids").alias("id"))
    counts = spread.groupBy("id").agg(F.count("*").alias("df")).where("df > 1")
    common = spread.join(counts, "id").groupBy("cls", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "id"))).alias("common"))
    alone = F.col("n") - F.size("common")  # ids of this class only come first in the order
    window = F.col("n") - F.ceil(F.col("n") * share / 100) + 1 - alone
    anchors = common.where(window > 0).select(
        "cls", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), window.cast("int"))).alias("place", "anchor"))
    anchors = materialise(anchors.select("cls", "n", "anchor", (F.col("alone") + F.col("place")).alias("at")), "anchors")
    crowded = anchors.groupBy("anchor").agg(
        F.count("*").alias("k"), F.min("cls").alias("pivot"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x")).where("k > 1")
    first = crowded.groupBy("k", "s", "x", "pivot").agg(F.min("anchor").alias("anchor"))
    # Anchors with one pivot are one region; the first place a class has in it is the bound.
    members = anchors.join(first.select("anchor", "k", "pivot"), "anchor").groupBy("pivot", "cls", "n").agg(
        F.min("at").alias("at"), F.max("k").alias("k"))
    return materialise(members.withColumn("region", F.col("pivot")), "regions")


def class_links(sets: DataFrame, share: int = SHARE, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """``(a, b)``: links between classes ``sets (cls, n, ids)``, enough of them to join what
    any links join."""
    regions = regions_of(sets, share)
    size_of = sets.select(F.col("cls").alias("pivot"), F.col("n").alias("pn"))
    links = home = None
    # Every class is measured against one pivot a round, that of its most crowded region.
    nearest = F.max(F.struct("k", "pivot"))["pivot"].alias("pivot")
    wanted = regions.where("pivot <> cls").groupBy("cls", "n").agg(nearest)
    for step in range(rounds):
        pairs = wanted.join(size_of, "pivot").where(_fits(F.col("n"), F.col("pn"), share)).select(
            F.col("pivot").alias("a"), F.col("cls").alias("b"))
        measured = materialise(_near(pairs, sets, share), "measured")
        home = measured if home is None else home
        found = measured.where("linked").select("a", "b")
        links = found if links is None else links.union(found)
        named = regions.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "comp", F.coalesce("component", "cls")).drop("component")
        mixed = named.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        open_regions = materialise(named.join(mixed.drop("low"), "region"), "open_regions")
        if step == rounds - 1 or open_regions.isEmpty():
            break
        wanted = _probes(open_regions, step)
    return links.union(_boundary(open_regions, home, sets, share))


def _main(regions: DataFrame) -> DataFrame:
    """``(region, main)``: the largest component of each region."""
    per = regions.groupBy("region", "comp").agg(F.count("*").alias("m"))
    return per.groupBy("region").agg(F.max(F.struct("m", "comp")).alias("top")).select("region", F.col("top.comp").alias("main"))


def _probes(regions: DataFrame, step: int) -> DataFrame:
    """``(cls, n, pivot)``: for the members outside a region's largest component, pivots in
    it, other ones in every round: ``PIVOTS`` a region and ``PROBES`` a class."""
    placed = regions.drop("pivot").join(_main(regions), "region")
    drawn = [F.min_by("cls", F.xxhash64("cls", F.lit(step * PIVOTS + j))) for j in range(PIVOTS)]
    pivots = placed.where("comp = main").groupBy("region").agg(F.array_distinct(F.array(*drawn)).alias("pivots"))
    asked = placed.where("comp <> main").join(pivots, "region").select(
        "cls", "n", "k", F.explode("pivots").alias("pivot")).groupBy("cls", "n", "pivot").agg(F.max("k").alias("k"))
    order = Window.partitionBy("cls").orderBy(F.desc("k"), "pivot")
    return asked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROBES).select("cls", "n", "pivot")


def _fits(a: Column, b: Column, share: int) -> Column:
    """Sizes of two sets that may be linked."""
    return (a * 100 >= b * share) & (b * 100 >= a * share)


def _boundary(regions: DataFrame, home: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between members of different components of a region: those outside its largest
    component against all its members.

    Two sets share no more ids than follow the first anchor they share, in either order; if
    it lies in this region, its place is not before ``at``. Pairs whose sizes ask for more are
    left to another region or to none.
    Sets measured against one pivot are compared only within the triangle inequality.
    """
    distance = home.select(F.col("b").alias("cls"), F.col("a").alias("home"), "distance")
    placed = materialise(regions.select("region", "cls", "n", "at", "comp").join(_main(regions), "region").join(
        distance, "cls", "left"), "placed")
    few = placed.where("comp <> main").select("region", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "at", "comp", "home", "distance")])
    every = placed.select("region", "main", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "at", "comp", "home", "distance")])
    reach = (100 - share) / 100 + 1e-9
    apart = (F.col("home_a") == F.col("home_b")) & (F.abs(F.col("distance_a") - F.col("distance_b")) > reach)
    follow = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    pairs = few.join(every, "region").where(
        (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("main")) | (F.col("cls_a") < F.col("cls_b")))
        & _fits(F.col("n_a"), F.col("n_b"), share) & ~F.coalesce(apart, F.lit(False))
        & (follow * (100 + share) >= (F.col("n_a") + F.col("n_b")) * share)
    ).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    return _near(pairs, sets, share).where("linked").select("a", "b")


def near_duplicates(docs: DataFrame, share: int = SHARE, size: int = SIZE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_key)``, one row per row of ``docs``.

    Words are folded to lower case (A-Z only) and split at ASCII blanks. Texts with fewer
    than ``size`` words have the whole sequence as one shingle; null and blank texts have the
    empty set and are linked with nothing, not even each other. Equal sets are linked.
    ``component_id`` is the smallest doc_id reachable (null only if all are null). Repeated
    rows are linked like any equal texts. Texts of any length are used whole; other columns
    are ignored, and an empty table gives no rows.
    """
    docs = _keyed(docs)
    rows, live = set_classes(docs, share, size)
    kept = live.select(F.col("rep").alias("key"))
    lists = docs.join(small(kept), "key", "left_semi").select("text").mapInArrow(
        lean(_id_lists(size)), "cls binary, n bigint, ids array<bigint>")
    sets = materialise(lists.join(small(live.select("cls")), "cls", "left_semi"), "sets")
    labels = components(materialise(class_links(sets, share), "class_links"))
    reps = rows.where("digest is not null").groupBy("digest").agg(F.min("key.doc_id").alias("rep"), F.count("*").alias("k"))
    joined = reps.join(labels, F.col("digest") == F.col("node"), "left").where("k > 1 or component is not null").select(
        "digest", "rep", F.coalesce("component", "digest").alias("component"))
    joined = materialise(joined, "grouped_classes")
    first = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = joined.join(first, "component").select("digest", "component_id", F.lit(True).alias("grouped"))
    return rows.join(of_class, "digest", "left").select(
        "key.doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("key.doc_id")).alias("component_id"), "key.text_key")


def drop_near_duplicates(docs: DataFrame, share: int = SHARE, size: int = SIZE) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id. Rows without
    words are in no group and stay."""
    labels = materialise(near_duplicates(docs, share, size), "near_labels")
    key = F.struct("doc_id", F.xxhash64(text_or_empty()).alias("text_key"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = labels.where(~first).select("doc_id", "text_key")
    # An id may stand for several rows: of those that name their group, one text stays, once.
    named = labels.where(first & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(
        F.count("*").alias("k"), F.min("text_key").alias("least")).where("k > 1")
    repeated = not named.isEmpty()
    if repeated:
        other = labels.where(first & (F.col("n_shingles") > 0)).join(named, "doc_id").where("text_key <> least")
        gone = gone.union(other.select("doc_id", "text_key"))
    gone = gone.select(F.struct("doc_id", "text_key").alias("_gone")).distinct()
    stay = docs.join(small(gone), key == F.col("_gone"), "left_anti")
    return stay.dropDuplicates(["doc_id", "text"]) if repeated else stay


runs_on_workers(__name__)
