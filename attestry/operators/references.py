"""References to records that do not exist (problem 4).

Keys may be composite and partly null.  References are grouped by their null mask, and each group is
anti-joined with the targets on its non-null columns under the declared match semantics.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lifetimes(events: DataFrame, keys: list[str], born: str, gone: str) -> DataFrame:
    """(keys, born, gone) per target: when it was first there and when it was first gone, else null.

    ``events`` are all rows ever delivered; ``born`` and ``gone`` are per-row times, null where a row
    says nothing about it.  Targets without any ``born`` were never there.
    """
    return events.groupBy(*keys).agg(F.min(born).alias("born"), F.min(gone).alias("gone")).where("born is not null")


def orphans(refs: DataFrame, targets: DataFrame, on: list[tuple[str, str]], at: str, match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose target isn't there at the time ``at``.

    ``on`` pairs reference columns with target columns; ``targets`` is made by ``lifetimes``.  A target
    is there from ``born`` (inclusive) until before ``gone``.  ``match`` says what null columns mean:

    * ``simple``: a reference with any null column refers to nothing and holds;
    * ``partial``: the non-null columns must agree with some target; all null holds;
    * ``full``: all null holds, partly null never does.

    A null time ``at`` is compared as unknown, so such a reference finds no target.  Repeated
    references stay repeated; extra columns are kept; no targets make every checked reference an orphan.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match: {match}")
    life = targets.select(*[F.col(t).alias(f"_t{i}") for i, (_, t) in enumerate(on)], F.col("born").alias("_born"), F.col("gone").alias("_gone"))
    found = []
    for mask in product([True, False], repeat=len(on)):
        full, empty = all(mask), not any(mask)
        if empty or (not full and match == "simple"):
            continue
        part = refs.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() if m else F.col(r).isNull() for m, (r, _) in zip(mask, on)]))
        if not full and match == "full":
            found.append(part)
            continue
        there: Column = (F.col("_born") <= F.col(at)) & (F.col("_gone").isNull() | (F.col("_gone") > F.col(at)))
        for i, (m, (r, _)) in enumerate(zip(mask, on)):
            if m:
                there = (F.col(r) == F.col(f"_t{i}")) & there
        found.append(part.join(life, there, "left_anti"))
    return reduce(DataFrame.unionByName, found)


def by_period(found: DataFrame, holder: str, field: str, at: str) -> DataFrame:
    """Counts of orphan references and of their holders per table, field and month."""
    return (found.groupBy(F.col(holder).alias("holder"), F.col(field).alias("field"), F.date_format(at, "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("holder_id").alias("n_holders")))
