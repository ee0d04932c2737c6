"""Regions put together, or cut, into chunks of bounded size."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grouped(regions: DataFrame, most_chars: int = 18_000, most_rows: int | None = None, by: str = "source_version_id", order: str = "ord", text: str = "text") -> DataFrame:
    """``regions`` with ``chunk`` (from 0 per source): in order, whole, until the next would exceed a limit.

    A region longer than the limit stands alone; a null text is one without characters.  Regions of a
    source with the same ``order`` count as one.  Only lengths are put in order, one source after the
    other; chunk ends are found by search in their running sums, so a task holds two numbers a region
    of the source at hand, and the texts are joined to the result wherever they are.
    """
    sizes = regions.groupBy(by, order).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n"))
    kinds = {f.name: f.dataType for f in regions.schema.fields}
    schema = T.StructType([T.StructField("_by", kinds[by]), T.StructField("_order", kinds[order]), T.StructField("chunk", T.LongType())])

    def numbered(batches):
        source, state = None, (0, 0, 0)
        for b in batches:
            for s, g in b.groupby("_by", sort=False, dropna=False):
                s = None if pd.isna(s) else s
                if s != source:
                    source, state = s, (0, 0, 0)
                chunk, state = numbers(g["n"].to_numpy(), most_chars, most_rows, state)
                yield pd.DataFrame({"_by": [s] * len(g), "_order": g["_order"].to_numpy(), "chunk": chunk})

    ordered = sizes.select(F.col(by).alias("_by"), F.col(order).alias("_order"), "n").repartition("_by").sortWithinPartitions("_by", "_order")
    chunk = ordered.mapInPandas(numbered, schema)
    return regions.hint("merge").join(chunk, F.col(by).eqNullSafe(F.col("_by")) & F.col(order).eqNullSafe(F.col("_order"))).drop("_by", "_order")


def numbers(sizes: np.ndarray, most: int, most_rows: int | None, state: tuple[int, int, int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """The chunk of each size, and (chunk, its characters, its regions) to go on with.

    Each chunk reaches as far as the running sum of sizes allows, but over one region at least.
    """
    ends, out, at = np.cumsum(sizes), np.empty(len(sizes), dtype=np.int64), 0
    chunk, chars, rows = state
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = int(np.searchsorted(ends, before + most - chars, side="right"))
        to = to if most_rows is None else min(to, at + most_rows - rows)
        if to > at or not rows:
            to = max(to, at + 1)
            out[at:to] = chunk
            chars, rows, at = chars + int(ends[to - 1]) - before, rows + to - at, to
        else:
            chunk, chars, rows = chunk + 1, 0, 0
    return out, (chunk, chars, rows)


def cut_rows(docs: DataFrame, id: str, text: str = "text", most: int = 1400, least: float = 0.55) -> DataFrame:
    """(id, part, start, end, text): chunks of at most ``most`` characters within paragraphs, which blank lines part.

    A chunk ends before the last space that leaves it more than ``least`` of the limit, else at the
    limit.  The whole text is read, nothing dropped but white space at the ends of chunks; null and
    blank texts have none.  Pieces are the matches of one pattern, which follow each other.
    """
    low = int(most * least) + 1
    blank = re.compile(r"\n\s*\n")
    piece = re.compile(rf"(?s).{{1,{most}}}\Z|.{{{low},{most}}}(?= )|.{{{most}}}")
    schema = f"id {docs.schema[id].dataType.simpleString()}, part long, start long, end long, text string"

    def spans(t: str):
        begin = 0
        for gap in [*blank.finditer(t), None]:
            whole = t[begin : gap.start() if gap else len(t)]
            own = whole.strip()
            base = begin + len(whole) - len(whole.lstrip())
            for c in piece.finditer(own):
                cut = c.group().strip()
                if cut:
                    at = base + c.start() + len(c.group()) - len(c.group().lstrip())
                    yield at, at + len(cut), cut
            begin = gap.end() if gap else len(t)

    def each(batches):
        for b in batches:
            yield pd.DataFrame([(i, n, *s) for i, t in zip(b["id"], b["text"]) if t for n, s in enumerate(spans(t))], columns=["id", "part", "start", "end", "text"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(each, schema)
