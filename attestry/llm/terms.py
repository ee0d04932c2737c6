"""Frequency of every distinct value or term (problem 5).

All n-grams are counted over a distributed suffix array.  Equal records are combined first.  Within
each distinct record the suffixes are sorted and each keeps the common prefix it shares with its
predecessor: those adjacencies are within-record duplicates, which record counts leave out.  Suffixes
are then combined, sorted across the cluster by range, and one pass over each range turns the common
prefixes of neighbours into intervals, whose sums are the counts of the n-grams.  n-grams that cross
a range boundary are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.scratch import Scratch

#: Stands between tokens in sort keys; below every letter, and in no token.
SEP = "\x01"
#: Suffixes leave a task in batches of so many characters.
BATCH = 8_000_000


def common(a: list[str], b: list[str]) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))


def own_suffixes(toks: list[str], max_n: int | None) -> Iterator[tuple[list[str], int]]:
    """The suffixes of one record in order, cut to ``max_n`` tokens, each with the length of what it shares with the one sorted before it.

    Only one suffix at a time is in memory, whatever the length of the record.
    """
    order, shared = suffix_array(toks)
    for i, n in zip(order, shared):
        yield toks[i:] if max_n is None else toks[i : i + max_n], n if max_n is None else min(n, max_n)


def suffix_array(toks: list[str]) -> tuple[list[int], list[int]]:
    """Starts of the sorted suffixes, and how many tokens each shares with the one before it."""
    m = len(toks)
    if m <= 64:
        order = sorted(range(m), key=lambda i: toks[i:])
        return order, [common(toks[order[k - 1] :], toks[i:]) if k else 0 for k, i in enumerate(order)]
    # Ranks by the first k tokens, k doubling; then shared lengths in text order, each at most one less than the one before.
    rank = np.unique(np.array(toks, dtype=object), return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(m, -1, dtype=np.int64)
        after[: m - k] = rank[k:] if k < m else after[: m - k]
        at = np.lexsort((after, rank))
        step = (rank[at][1:] != rank[at][:-1]) | (after[at][1:] != after[at][:-1])
        rank = np.empty(m, dtype=np.int64)
        rank[at] = np.concatenate(([0], np.cumsum(step)))
        if rank[at[-1]] == m - 1:
            break
        k *= 2
    order, place = at.tolist(), rank.tolist()
    shared, h = [0] * m, 0
    for i in range(m):
        if not place[i]:
            h = 0
            continue
        j = order[place[i] - 1]
        while i + h < m and j + h < m and toks[i + h] == toks[j + h]:
            h += 1
        shared[place[i]] = h
        h = max(h - 1, 0)
    return order, shared


def intervals(rows, deep: int | None = None):
    """(ngram, tf, df) from sorted (suffix, dup, w): a stack of the prefixes that are still open, of up to ``deep`` tokens."""
    path: list[str] = []
    tf: list[int] = []
    df: list[int] = []
    for s, dup, w in rows:
        s = s[:deep]
        keep = common(path, s)
        for n in range(len(path), keep, -1):
            yield SEP.join(path[:n]), tf[n - 1], df[n - 1]
        del path[keep:], tf[keep:], df[keep:]
        for t in s[keep:]:
            path.append(t)
            tf.append(0)
            df.append(0)
        for n in range(len(s)):
            tf[n] += w
            if n >= dup:
                df[n] += w
    for n in range(len(path), 0, -1):
        yield SEP.join(path[:n]), tf[n - 1], df[n - 1]


def ngrams(records: DataFrame, field: str = "field", toks: str = "tokens", max_n: int | None = 3, report_n: int | None = None) -> DataFrame:
    """(field, ngram, n, occurrences, records): counts of every n-gram of up to ``max_n`` tokens (null: of any length).

    ``max_n`` cuts the suffixes, ``report_n`` only the intervals that are reported: with the latter the array stays
    whole.  The array of a record grows with the square of its length unless ``max_n`` is given, but is streamed.

    ``records`` has one row per record and field; records with null or no tokens have no terms, and
    null or empty tokens are left out.  Token order within a record matters, order of records doesn't.
    Repeated rows are records of their own.  Nothing is cut off: a long text has all its suffixes.
    """
    scratch = Scratch(records.sparkSession, "terms")
    clean = F.filter(F.col(toks), lambda t: t.isNotNull() & (t != ""))
    texts = records.select(F.col(field).alias("field"), F.array_join(clean, SEP).alias("text")).where("text != ''").groupBy("field", "text").agg(F.count(F.lit(1)).alias("w"))

    def suffixes(batches):
        for b in batches:
            sums: dict[tuple, int] = {}
            held = 0
            for f, t, w in zip(b["field"], b["text"], b["w"]):
                for s, dup in own_suffixes(t.split(SEP), max_n):
                    k = (f, SEP.join(s), dup)
                    if k not in sums:
                        held += len(k[1])
                    sums[k] = sums.get(k, 0) + w
                    if held > BATCH:
                        yield frame(sums)
                        sums, held = {}, 0
            if sums:
                yield frame(sums)

    def frame(sums):
        f, s, d = zip(*sums)
        return pd.DataFrame({"field": f, "suffix": s, "dup": d, "w": list(sums.values())})

    each = texts.mapInPandas(suffixes, "field string, suffix string, dup int, w long")
    array = scratch.write(each.groupBy("field", "suffix", "dup").agg(F.sum("w").alias("w")), "suffixes")
    spread = array.repartitionByRange("field", "suffix").sortWithinPartitions("field", "suffix", "dup")

    def sweep(batches):
        def rows():
            for b in batches:
                yield from zip(b["field"], b["suffix"], b["dup"], b["w"])

        # The field is made the first token, so no interval spans two fields.
        out: list[tuple] = []
        for g, tf, df in intervals((([f, *s.split(SEP)], dup + 1 if dup else 0, w) for f, s, dup, w in rows()), None if report_n is None else report_n + 1):
            f, _, g = g.partition(SEP)
            if g:
                out.append((f, g, tf, df))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["field", "g", "tf", "df"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["field", "g", "tf", "df"])

    counts = spread.mapInPandas(sweep, "field string, g string, tf long, df long").groupBy("field", "g").agg(F.sum("tf").alias("occurrences"), F.sum("df").alias("records"))
    return counts.select("field", F.replace("g", F.lit(SEP), F.lit(" ")).alias("ngram"), F.size(F.split("g", SEP)).cast("long").alias("n"), "occurrences", "records")


def marked(counts: DataFrame, totals: DataFrame, least: int = 3, most: float = 0.15) -> DataFrame:
    """``counts`` with the number of all records of the field and ``mark``: rare below ``least`` records, common above the share ``most``, else null.

    A term that is both (tiny collections) is rare.
    """
    j = counts.join(F.broadcast(totals), "field")  # one row per field
    return j.withColumn("mark", F.when(F.col("records") < least, "rare").when(F.col("records") > most * F.col("n_records"), "common"))
