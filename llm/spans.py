"""Marked spans of a text: ``array<struct<kind, start, end, base>>``, ordered by start and kind."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from llm.common import runs_on_workers

SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
Span = tuple[str, int, int, bool]


def span_lists(rows: list[list[Span]], kinds: list[str]) -> pa.ListArray:
    place = {k: i for i, k in enumerate(kinds)}
    flat = [s for row in rows for s in sorted(row, key=lambda s: (s[1], place[s[0]], s[2]))]
    kind, start, end, base = zip(*flat) if flat else ((), (), (), ())
    values = pa.StructArray.from_arrays(
        [pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(base, pa.bool_())],
        names=["kind", "start", "end", "base"])
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def digest_columns(spans: str, kinds: list[str]) -> list[Column]:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    s = F.col(spans)
    return [*[count_of(s, k).alias(f"n_{k}") for k in kinds],
            F.sha2(F.encode(span_text(base_only(s)), "UTF-8"), 256).alias("base_sha256"), span_text(s).alias("spans")]


runs_on_workers(__name__)
