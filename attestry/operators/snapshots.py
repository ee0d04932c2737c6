"""Immutable, forkable, rebasable snapshots of keyed tables.

A snapshot stores its own rows only (``put`` rows and ``drop`` keys per table) and names its parent; a
read folds the chain of deltas, newest first, with one shuffle on the key.  A fork is a header, no
copy.  Headers and head pointers are small JSON files on the file system of the root, any that Spark can
reach; heads change by compare-and-swap under a lock.  ``compact`` writes the folded rows once, where chains grow long.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import closure
from attestry.storage import Files

KEYS = {"sources": ["source_id"], "regions": ["source_version_id", "region_id"], "records": ["id"], "procedures": ["procedure_id", "version"], "coverage": ["id"], "reconciliations": ["event_id"]}


class Conflict(RuntimeError):
    """The head has moved, or a rebase meets changes that exclude each other."""


@dataclass(frozen=True)
class Header:
    id: str
    project: str
    parent: str | None
    tables: tuple[str, ...]
    base: bool = False  # whether it holds whole tables, so that reading ends here


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.data = f"{self.files.root}/snapshots"
        self.files.mkdirs("projects")
        self.files.mkdirs("snapshots")

    # Headers and pointers

    def _write(self, name: str, value: dict) -> None:
        self.files.write(name, json.dumps(value))

    def project(self, project: str) -> dict:
        return json.loads(self.files.read(f"projects/{project}.json"))

    def header(self, snapshot: str) -> Header:
        h = json.loads(self.files.read(f"snapshots/{snapshot}.json"))
        return Header(h["id"], h["project"], h["parent"], tuple(h["tables"]), h.get("base", False))

    def _locked(self, project: str):
        return self.files.locked(f"projects/{project}.lock")

    def _add(self, project: str, parent: str | None, tables: dict[str, DataFrame], base: bool = False) -> str:
        sid = f"snap_{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.data}/{sid}/{name}")
        self._write(f"snapshots/{sid}.json", {"id": sid, "project": project, "parent": parent, "tables": sorted(tables), "base": base})
        return sid

    def create(self, name: str) -> str:
        project = f"proj_{uuid.uuid4().hex}"
        head = self._add(project, None, {}, base=True)
        self._write(f"projects/{project}.json", {"id": project, "name": name, "head": head, "parent_project": None, "pinned": None})
        return project

    def fork(self, parent: str, name: str, snapshot: str | None = None) -> str:
        pinned = snapshot or self.project(parent)["head"]
        if self.header(pinned).project != parent:
            raise ValueError("a fork is pinned to a snapshot of its parent")
        project = f"proj_{uuid.uuid4().hex}"
        head = self._add(project, pinned, {})
        self._write(f"projects/{project}.json", {"id": project, "name": name, "head": head, "parent_project": parent, "pinned": pinned})
        return project

    def projects(self) -> list[dict]:
        names = [n for n in self.files.names("projects") if n.endswith(".json")]
        return [self.project(n[:-5]) for n in names]

    def chain(self, snapshot: str) -> list[Header]:
        """The snapshot and those before it, newest first, to the one that holds whole tables."""
        found, at = [], snapshot
        while at is not None:
            found.append(self.header(at))
            at = None if found[-1].base else found[-1].parent
        return found

    def ancestry(self, project: str) -> list[str]:
        """The project and those it was forked from, in order."""
        found, at = [], project
        while at is not None and at not in found:
            found.append(at)
            at = self.project(at)["parent_project"]
        return found

    # Tables

    def _deltas(self, headers: list[Header], table: str) -> DataFrame | None:
        out = None
        for age, h in enumerate(headers):
            if table in h.tables:
                d = self.spark.read.parquet(f"{self.data}/{h.id}/{table}").withColumn("_age", F.lit(age))
                out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        return out

    @staticmethod
    def _fold(deltas: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in deltas.columns if c not in (*keys, "_age")]
        newest = deltas.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_age").alias("_r"))
        return newest.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])

    def read(self, snapshot: str, table: str) -> DataFrame | None:
        """The rows of a table as of a snapshot; None if it never had any."""
        d = self._deltas(self.chain(snapshot), table)
        return None if d is None else self._fold(d, KEYS[table]).where("not _gone").drop("_gone")

    def delta(self, project: str, table: str) -> DataFrame | None:
        """What the project changed against the snapshot it is pinned to."""
        own = []
        for h in self.chain(self.project(project)["head"]):
            if h.project != project:
                break
            own.append(h)
        d = self._deltas(own, table)
        return None if d is None else self._fold(d, KEYS[table])

    def compact(self, project: str) -> str:
        with self._locked(project):
            p = self.project(project)
            tables = {t: self.read(p["head"], t).withColumn("_gone", F.lit(False)) for t in {t for h in self.chain(p["head"]) for t in h.tables}}
            p["head"] = self._add(project, p["head"], tables, base=True)
            self._write(f"projects/{project}.json", p)
            return p["head"]

    # Changes

    def commit(self, project: str, expected: str, put: dict[str, DataFrame] | None = None, drop: dict[str, DataFrame] | None = None, invalidate: bool = True) -> str:
        """The new head with ``put`` rows (by key, newest wins) and without ``drop`` keys; Conflict if the head isn't ``expected``.

        Records that rest on what changed become stale with the reason in ``stale_reason``.
        """
        with self._locked(project):
            p = self.project(project)
            if p["head"] != expected:
                raise Conflict(f"the head is {p['head']}")
            tables = {t: df.withColumn("_gone", F.lit(False)) for t, df in (put or {}).items()}
            for t, df in (drop or {}).items():
                gone = df.select(*KEYS[t]).withColumn("_gone", F.lit(True))
                tables[t] = tables[t].unionByName(gone, allowMissingColumns=True) if t in tables else gone
            if "procedures" in tables:
                self._check_procedures(expected, put["procedures"])
            if invalidate:
                marks = self._stale(expected, put or {})
                if marks is not None:
                    fresh = (put or {}).get("records")
                    marks = marks.withColumn("_gone", F.lit(False))
                    tables["records"] = marks.unionByName(tables["records"], allowMissingColumns=True) if fresh is not None else marks
            head = self._add(project, expected, tables)
            p["head"] = head
            self._write(f"projects/{project}.json", p)
            return head

    def _stale(self, before: str, put: dict[str, DataFrame]) -> DataFrame | None:
        records = self.read(before, "records")
        if records is None or not {"sources", "records", "procedures"} & set(put):
            return None
        none = self.spark.createDataFrame([], "id string")
        versions = changed = none
        old_sources = self.read(before, "sources")
        if "sources" in put and old_sources is not None:
            new = put["sources"].select("source_id", F.col("source_version_id").alias("_v"))
            versions = old_sources.join(new, "source_id").where("source_version_id <> _v").select(F.col("source_version_id").alias("id"))
        fresh = put.get("records")
        if fresh is not None:
            shared = [c for c in fresh.columns if c in records.columns]
            changed = fresh.select(shared).exceptAll(records.select(shared)).select("id").join(records.select("id"), "id", "left_semi")
        procedures = None
        if "procedures" in put:
            procedures = put["procedures"].where("active").select("procedure_id", F.col("version").alias("active_version"))
            if not {"procedure_id", "procedure_version"} <= set(records.columns):
                procedures = None
        marks = closure.stale(records, versions, changed, procedures)
        if fresh is not None:
            marks = marks.join(fresh.select("id"), "id", "left_anti")
        kept = records.drop("stale_reason") if "stale_reason" in records.columns else records
        return kept.join(marks.withColumnRenamed("reason", "stale_reason"), "id").withColumn("lifecycle", F.lit("stale"))

    def _check_procedures(self, before: str, new: DataFrame) -> None:
        old = self.read(before, "procedures")
        if old is not None:
            same = old.select("procedure_id", "version", F.col("definition").alias("d")).join(new, ["procedure_id", "version"])
            if same.where("not (d <=> definition)").limit(1).count():
                raise Conflict("a procedure's version can't be defined anew")
            off = old.where("active").select("procedure_id", "version").join(new.where("not active"), ["procedure_id", "version"], "left_semi")
            if off.limit(1).count():
                raise Conflict("an active procedure is only replaced by another version")
        if new.where("active").groupBy("procedure_id").count().where("count > 1").limit(1).count():
            raise Conflict("one version of a procedure is active")

    def diff(self, project: str) -> dict[str, DataFrame]:
        return {t: d for t in KEYS if (d := self.delta(project, t)) is not None}

    def rebase(self, project: str, onto: str) -> str:
        """Moves a fork onto another snapshot of its parent project; its own changes stay on top.

        Conflict if both sides defined one procedure version differently, or the parent's active version
        of a procedure changed while the fork has another one active.  Own records that rest on what
        the parent changed become stale (``rebase-parent-version-changed``).
        """
        with self._locked(project):
            p = self.project(project)
            if p["parent_project"] is None or self.header(onto).project != p["parent_project"]:
                raise ValueError("a fork is rebased onto a snapshot of its parent project")
            own = self.diff(project)
            self._check_rebase(p["pinned"], onto, own.get("procedures"))
            tables = dict(own)
            head = self._add(project, onto, tables)
            records = self.read(head, "records")
            marks = self._rebase_stale(p["pinned"], onto, records) if records is not None else None
            if marks is not None:
                kept = records.drop("stale_reason") if "stale_reason" in records.columns else records
                hit = kept.join(marks, "id", "left_semi").withColumn("lifecycle", F.lit("stale")).withColumn("stale_reason", F.lit("rebase-parent-version-changed")).withColumn("_gone", F.lit(False))
                head = self._add(project, head, {"records": hit})
            p |= {"head": head, "pinned": onto}
            self._write(f"projects/{project}.json", p)
            return head

    def _check_rebase(self, old: str, new: str, own: DataFrame | None) -> None:
        a, b = self.read(old, "procedures"), self.read(new, "procedures")
        if own is None or b is None:
            return
        both = own.where("not _gone").select("procedure_id", "version", F.col("definition").alias("d")).join(b, ["procedure_id", "version"])
        if both.where("not (d <=> definition)").limit(1).count():
            raise Conflict("one procedure version is defined on both sides")
        act = lambda d, n: d.where("active").select("procedure_id", F.col("version").alias(n))
        was = act(a, "was") if a is not None else act(b, "was").where("false")
        moved = act(b, "now").join(was, "procedure_id", "left").where("not (was <=> now)")
        if act(own.where("not _gone"), "mine").join(moved, "procedure_id").where("mine <> now").limit(1).count():
            raise Conflict("the parent activated another version of a procedure that is active here")

    def _rebase_stale(self, old: str, new: str, records: DataFrame) -> DataFrame | None:
        a, b = self.read(old, "sources"), self.read(new, "sources")
        changed = self.spark.createDataFrame([], "id string")
        if a is not None and b is not None:
            changed = a.join(b.select("source_id", F.col("source_version_id").alias("_v")), "source_id").where("source_version_id <> _v").select(F.col("source_version_id").alias("id"))
        ra, rb = self.read(old, "records"), self.read(new, "records")
        if ra is not None and rb is not None:
            shared = [c for c in ra.columns if c in rb.columns]
            changed = changed.unionByName(ra.select(shared).exceptAll(rb.select(shared)).select("id"))
        marks = closure.stale(records, changed, changed)
        # What the parent itself brought in anew is not stale by its own arrival.
        return marks.join(rb.select("id"), "id", "left_anti").select("id") if rb is not None else marks.select("id")
