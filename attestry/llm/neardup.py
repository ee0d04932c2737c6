"""Near-duplicate records with small edits (problem 3): every pair above a Jaccard threshold on words.

A record is its set of distinct words, so insertions count once and reordering not at all; records with
the same set form a class, and only classes are compared.  Each word is hashed to a position (one of
65,536 slots, whose frequencies are counted over all classes) and a byte string behind it.  A record's
positional bytes are ordered rarest position first.  If two records of n and m words reach the
threshold t they share at least o = ceil(t (n + m) / (1 + t)) positional bytes, so before their first
few shared ones each skips at most n - o and m - o of its own.  The inverted index holds, per record,
the short runs of positional bytes that can be the first shared ones: as many bytes as are needed to be
selective by their slots' frequencies, three at most, and more where a run turns out to be frequent.

Pairs that meet in the index are tallied: first by 64-position sketches, which differ in no more
places than the sets do, then by counting the positional bytes both share.  Pairs below the guaranteed
minimum drop out, the rest is verified on the words.  Nothing is lost: the order, the rules for the
length of a run and both tallies hold for every pair above the threshold.

Long records are cut into groups of words by hash.  Of two records with similarity t some group has
similarity t as well (the whole is a weighted mean of its groups), so groups are indexed like records
and the index grows with the words of a record, not with the number of their runs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import words
from attestry.scratch import Scratch

SLOTS = 1 << 16
#: Records of up to so many words are indexed whole; longer ones in groups of half to three quarters of it.
WHOLE = 32
#: Runs have so many positional bytes at most, and those of frequent runs so many.
USUAL, DEEPEST = 3, 6
#: A run that more than LIMIT records have, by one record in EVERY, is frequent; of those the HOTTEST are made longer or divided.
LIMIT, EVERY, HOTTEST = 16_384, 64, 100_000
#: Rows of the index in one partition.
ROWS = 350_000
_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


def least_shared(n: int, m: int, p: int, q: int) -> int:
    """ceil(t (n + m) / (1 + t)) for t = p / q, in whole numbers."""
    return -(-p * (n + m) // (p + q))


def bands(n: int, p: int, q: int) -> list[tuple[int, int]]:
    """(band, groups) of the bands that a record of ``n`` words has partners in; a pair's band is that of its shorter record."""
    low, out, band, start, stop = -(-p * n // q), [], 0, 1, WHOLE
    while start <= n:
        if low < stop:
            out.append((band, max(1, 2 * start // WHOLE)))
        band, start, stop = band + 1, stop, -(-q * stop // p)
    return out


def _mixed(key: int, value: int) -> int:
    k = ((key ^ value) * _MIX) & _MASK
    return k ^ (k >> 29)


def runs(h: list[int], bits: list[float], p: int, q: int, need: float, seed: int, frequent: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(key, skipped) of the runs of positional bytes that may be the first that the record shares.

    ``h`` is ordered rarest first.  A run ends when its bytes are selective enough (``need`` bits) or
    at USUAL bytes, unless it is ``frequent``, or, marked as ended, where it may already be all that is
    shared.  These rules look at the run alone, so both records of a pair end it at the same byte.
    """
    n = len(h)
    low = -(-p * n // q)
    room = n - low
    out: list[tuple[int, int]] = []
    todo = [(0, 0, 0.0, seed, 1)]
    while todo:
        at, skipped, got, key, depth = todo.pop()
        for i in range(at, min(n, at + room - skipped + 1)):
            k = ((key ^ h[i]) * _MIX) & _MASK
            k ^= k >> 29
            b = got + bits[i]
            s = skipped + i - at
            if (depth >= USUAL or b >= need) and not (frequent and depth < DEEPEST and k >> 16 in frequent):
                out.append((k >> 16, s))
            else:
                if depth >= low:
                    out.append(((~k & _MASK) >> 16, s))
                todo.append((i + 1, s, b, k, depth + 1))
    return out


def _indexer(counts: np.ndarray, total: int, p: int, q: int, postings: float, frequent: dict[int, int], cells: dict[int, int]):
    size = np.maximum(counts, 1)
    info = np.maximum(0.0, np.log2(max(total, 1) / size))
    need = max(1.0, math.log2(max(total, 2) / postings))

    def index(batches):
        for b in batches:
            lens = b["h"].map(len).to_numpy()
            if not len(lens):
                continue
            h = np.concatenate(b["h"].to_list()).astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(len(lens)), lens)
            slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
            order = np.lexsort((h, slot, size[slot], row))
            start = np.concatenate(([0], np.cumsum(lens)))
            sketch = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (h >> np.uint64(16)) & np.uint64(63)), start[:-1])
            hs, bs = h[order].tolist(), info[slot[order]].tolist()
            cids = b["cid"].tolist()
            keys: list[int] = []
            skips: list[int] = []
            owner: list[int] = []
            words: list[int] = []
            for r, n in enumerate(lens.tolist()):
                a = start[r]
                hr, br = hs[a : a + n], bs[a : a + n]
                for band, groups in bands(n, p, q):
                    parts: list[tuple[list[int], list[float]]] = [([], []) for _ in range(groups)]
                    for x, bit in zip(hr, br):
                        hx, bx = parts[(x >> 40) % groups]
                        hx.append(x)
                        bx.append(bit)
                    for g, (hg, bg) in enumerate(parts):
                        found = runs(hg, bg, p, q, need, (band << 32) + g + 1, frequent) if hg else []
                        if found and cells:
                            found = [e for k, s in found for e in (_divided(k, s, cids[r], cells[k]) if k in cells else ((k, s),))]
                        if found:
                            k, s = zip(*found)
                            keys += k
                            skips += s
                            owner += [r] * len(k)
                            words += [len(hg)] * len(k)
            o = np.array(owner, dtype=np.int64)
            # Narrow rows: they are what is shuffled. A key that stands for two runs only costs a look. ``p`` has the words
            # of the record (32 bits), those of the group (16, which are far more than the some twenty of a group) and the skipped ones.
            packed = (lens[o].astype(np.int64) << 32) | (np.array(words, dtype=np.int64) << 16) | np.array(skips, dtype=np.int64)
            yield pd.DataFrame({"key": np.array(keys, dtype=np.int64), "cid": b["cid"].to_numpy()[o], "sketch": sketch.view(np.int64)[o], "p": packed})

    return index


def _divided(key: int, skipped: int, cid: int, parts: int) -> list[tuple[int, int]]:
    """The keys of the cells of a divided posting list: any two of its ``parts`` meet in one cell."""
    mine = _mixed(0, cid) % parts
    return [(_mixed(_mixed(key, min(mine, j) + 1), max(mine, j) + 1) >> 16, skipped) for j in range(parts)]


class NearDuplicates:
    """Classes of equal word sets and the pairs of classes whose similarity is ``p / q`` or more.

    * ``members``: (id, cid), one row per record with any word;
    * ``classes``: (cid, wset), the distinct word sets;
    * ``pairs``: (a, b) with cid a < b, every pair of different classes at or above the threshold.

    Records without words (null, blank, only punctuation) are similar to nothing and left out.  Ids
    that occur with several texts belong to several classes.  Texts are taken whole, of any length;
    extra columns are ignored; empty tables give empty results.

    No side of a join is broadcast.  Frequent runs are found on one record in ``EVERY``, which only
    decides how the work is divided: they are made longer, and those that stay frequent are divided
    into cells, so that no key gathers more than about ``limit`` records.
    """

    def __init__(self, records: DataFrame, id: str = "id", text: str = "text", p: int = 7, q: int = 10, postings: float = 12.0, limit: int = LIMIT, every: int = EVERY):
        s = self.scratch = Scratch(records.sparkSession, "neardup")
        wset = F.array_join(F.array_sort(F.array_distinct(words(text))), " ")
        held = s.write(records.select(F.col(id).cast("string").alias("id"), wset.alias("wset")).where("wset != ''"), "records")
        s.release()
        self.classes = classes = s.write(held.select("wset").distinct().withColumn("cid", F.monotonically_increasing_id()), "classes")
        s.release()
        print_of = F.unhex(F.md5("wset"))
        members = held.select("id", print_of.alias("f")).distinct().hint("merge").join(classes.select("cid", print_of.alias("f")), "f")
        self.members = s.write(members.select("id", "cid"), "members")
        del held, members
        s.drop("records")
        s.release()
        hashes = F.transform(F.split("wset", " "), lambda w: F.xxhash64(w))
        hashed = classes.select("cid", hashes.alias("h"))
        per_slot = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(SLOTS - 1).alias("slot")).count()
        counts = np.zeros(SLOTS)
        for slot, n in per_slot.collect():  # at most SLOTS rows, whatever the input
            counts[slot] = n
        total = classes.count()
        columns = "key long, cid long, sketch long, p long"
        frequent, cells, rows = self._frequent(hashed, lambda f: _indexer(counts, total, p, q, postings, f, {}), columns, limit, every)
        index = hashed.mapInPandas(_indexer(counts, total, p, q, postings, frequent, cells), columns)
        # So many partitions that each stays small at any size of the input.
        index = index.repartition(max(int(s.spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS), "key")
        a = index.select("key", *[F.col(c).alias(f"a_{c}") for c in ("cid", "sketch", "p")])
        b = index.select("key", *[F.col(c).alias(f"b_{c}") for c in ("cid", "sketch", "p")])
        n, g, skips = ([e.format(x) for x in "ab"] for e in ("shiftright({}_p, 32)", "(shiftright({}_p, 16) & 65535)", "({}_p & 65535)"))
        o, og = _least(*n, p, q), _least(*g, p, q)
        tally = F.expr(f"a_cid < b_cid and bit_count(a_sketch ^ b_sketch) <= {n[0]} + {n[1]} - 2 * {o} and {skips[0]} <= {g[0]} - {og} and {skips[1]} <= {g[1]} - {og}")
        met = a.hint("merge").join(b, (a.key == b.key) & tally).select("a_cid", "b_cid").distinct()
        met = s.write(met, "met")
        del index, a, b
        s.release()
        # Positional bytes as whole numbers: 16 bits of the position, 15 of what is behind it. Their sets differ in no more places than the words do.
        bytes_of = lambda w: F.array_distinct(F.transform(F.col(w), lambda x: F.xxhash64(x).bitwiseAND(0x7FFFFFFF).cast("int")))
        left = classes.select(F.col("cid").alias("a_cid"), F.split("wset", " ").alias("a_w"))
        right = classes.select(F.col("cid").alias("b_cid"), F.split("wset", " ").alias("b_w"))
        both = met.hint("merge").join(left, "a_cid").hint("merge").join(right, "b_cid").withColumn("a_h", bytes_of("a_w")).withColumn("b_h", bytes_of("b_w"))
        # Pairs whose tally of shared positional bytes reaches the guaranteed minimum are verified on the words.
        apart = F.size("a_h") + F.size("b_h") - 2 * F.size(F.array_intersect("a_h", "b_h"))
        near = both.where(apart <= F.expr(f"size(a_w) + size(b_w) - 2 * {_least('size(a_w)', 'size(b_w)', p, q)}"))
        exact = near.where(F.size(F.array_intersect("a_w", "b_w")) * (p + q) >= p * (F.size("a_w") + F.size("b_w")))
        self.pairs = s.write(exact.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")), "pairs")
        s.release()

    @staticmethod
    def _frequent(hashed: DataFrame, indexer, columns: str, limit: int, every: int) -> tuple[dict[int, int], dict[int, int], int]:
        """(runs to make longer, posting lists to divide with their number of parts, estimated rows of the index)."""
        part = hashed.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0)
        longer: dict[int, int] = {}
        while True:
            per = part.mapInPandas(indexer(dict(longer)), columns).groupBy("key").count()
            if not longer:
                rows = (per.agg(F.sum("count")).first()[0] or 0) * every
            hot = {k: n * every for k, n in per.where(F.col("count") > limit / every).orderBy(F.desc("count"), "key").limit(HOTTEST).collect()}
            new = {k: n for k, n in hot.items() if k not in longer}
            if not new:
                return longer, {k: -(-n // limit) for k, n in hot.items()}, rows
            longer |= new

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b): all pairs of different ids, smaller first, expanded from the classes.

        Its size is that of the answer: a class of k equal records alone gives k (k - 1) / 2 rows.
        """
        m = self.members
        one = m.select(F.col("cid").alias("a"), F.col("id").alias("x"))
        two = m.select(F.col("cid").alias("b"), F.col("id").alias("y"))
        cross = self.pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").where("x <> y")
        several = m.groupBy("cid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("cid").alias("a"))
        within = several.hint("merge").join(one, "a").hint("merge").join(two, F.col("a") == F.col("b")).where("x < y")
        every = cross.select("x", "y").unionByName(within.select("x", "y"))
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(id, group_id, group_size, links): the connected groups; links counts similar classes of the record's class.

        group_id is the smallest id of the group.  Records similar to none form groups of their own.
        """
        least = components(self.pairs, self.scratch)
        both = self.pairs.select(F.col("a").alias("cid")).unionAll(self.pairs.select(F.col("b").alias("cid")))
        links = both.groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
        m = self.members.hint("merge").join(least, "cid", "left").hint("merge").join(links, "cid", "left")
        m = self.scratch.write(m.select("id", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "grouped")
        group = m.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
        return m.hint("merge").join(group, "root").select("id", "group_id", "group_size", "links")


def _least(n: str, m: str, p: int, q: int) -> str:
    """SQL of ``least_shared``."""
    return f"((({p} * ({n} + {m})) + {p + q - 1}) div {p + q})"


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, root) for every cid in ``pairs`` (a, b): the smallest cid it is connected with.

    Large-star and small-star steps in turn, each a written table, until nothing changes; the number
    of rounds grows with the logarithm of the size of a group.  Links stay in tables throughout.
    """
    e = scratch.write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links_0")
    n = 0
    while True:
        n += 1
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = scratch.write(small, f"links_{n}")
        if not new.exceptAll(e).limit(1).count() and not e.exceptAll(new).limit(1).count():
            break
        e = new
    return e.groupBy(F.col("u").alias("cid")).agg(F.min("v").alias("root")).unionAll(e.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())
