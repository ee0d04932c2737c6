from __future__ import annotations

import pytest

from attestry.operators.snapshots import Conflict, Store
from tests.conftest import rows

R = "id string, source_version_id string, dependencies array<string>, lifecycle string, text string"
S = "source_id string, source_version_id string"
P = "procedure_id string, version string, definition string, active boolean"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def base(spark, store):
    p = store.create("p")
    recs = spark.createDataFrame([("a", "s1", [], "current", "1"), ("b", "s1", ["a"], "current", "2"), ("c", "s2", ["b"], "current", "3"), ("d", "s2", [], "current", "4")], R)
    return p, store.commit(p, store.project(p)["head"], {"records": recs, "sources": spark.createDataFrame([("x", "s1"), ("y", "s2")], S)})


def test_commit_conflict_and_immutability(spark, store):
    p, head = base(spark, store)
    new = spark.createDataFrame([("e", "s2", [], "current", "5")], R)
    later = store.commit(p, head, {"records": new})
    with pytest.raises(Conflict):
        store.commit(p, head, {"records": new})
    assert store.read(head, "records").count() == 4 and store.read(later, "records").count() == 5
    last = store.commit(p, later, drop={"records": new.select("id")})
    assert store.read(last, "records").count() == 4
    flat = store.compact(p)
    assert rows(store.read(flat, "records"), "id") == rows(store.read(last, "records"), "id") and len(store.chain(flat)) == 1


def test_staleness_spreads(spark, store):
    p, head = base(spark, store)
    after = store.commit(p, head, {"sources": spark.createDataFrame([("x", "s1b")], S)})
    r = dict((x.id, (x.lifecycle, x.stale_reason)) for x in store.read(after, "records").collect())
    assert r["a"] == ("stale", "source-version-updated") and r["b"][0] == "stale" and r["c"] == ("stale", "dependency-invalidated") and r["d"] == ("current", None)
    changed = store.commit(p, head if False else after, {"records": spark.createDataFrame([("d", "s2", [], "current", "new")], R)})
    assert {x.text for x in store.read(changed, "records").where("id = 'd'").collect()} == {"new"}


def test_fork_is_isolated_and_rebases(spark, store):
    p, head = base(spark, store)
    f = store.fork(p, "f")
    own = store.commit(f, store.project(f)["head"], {"records": spark.createDataFrame([("mine", "s2", ["a"], "current", "x"), ("d", "s2", [], "current", "local")], R)})
    parent = store.commit(p, head, {"records": spark.createDataFrame([("a", "s1", [], "current", "changed"), ("n", "s2", [], "current", "n")], R)})
    assert store.read(own, "records").where("id = 'n'").count() == 0 and store.read(parent, "records").where("id = 'mine'").count() == 0
    now = store.rebase(f, parent)
    r = {x.id: x for x in store.read(now, "records").collect()}
    assert r["d"].text == "local" and r["a"].text == "changed" and "n" in r and r["mine"].lifecycle == "stale" and r["mine"].stale_reason == "rebase-parent-version-changed"
    assert store.ancestry(f) == [f, p] and store.project(f)["pinned"] == parent and set(store.diff(f)) == {"records"}
    with pytest.raises(ValueError):
        store.rebase(p, parent)


def test_procedures_are_fixed_and_activated(spark, store):
    p, head = base(spark, store)
    proc = lambda *r: spark.createDataFrame(list(r), P)
    h1 = store.commit(p, head, {"procedures": proc(("k", "1", "def", True))})
    f = store.fork(p, "f")
    with pytest.raises(Conflict):
        store.commit(p, h1, {"procedures": proc(("k", "1", "other", True))})
    with pytest.raises(Conflict):
        store.commit(p, h1, {"procedures": proc(("k", "1", "def", False))})
    with pytest.raises(Conflict):
        store.commit(p, h1, {"procedures": proc(("k", "2", "x", True), ("k", "3", "y", True))})
    h2 = store.commit(p, h1, {"procedures": proc(("k", "2", "def2", True))})
    store.commit(f, store.project(f)["head"], {"procedures": proc(("k", "2", "another", False))})
    with pytest.raises(Conflict):
        store.rebase(f, h2)


def test_files_without_a_kernel_lock(spark, tmp_path):
    """As on a remote file system: texts are replaced whole, locks are files that only one can create."""
    from attestry.storage import Files

    f = Files(spark, str(tmp_path))
    f.local = None
    f.write("a.json", "one")
    f.write("a.json", "twö")
    assert f.read("a.json") == "twö" and f.names("") == ["a.json"] and f.names("none") == []
    with f.locked("x.lock"):
        with pytest.raises(TimeoutError):
            with f.locked("x.lock", wait=0.3):
                pass
        with f.locked("x.lock", wait=0.3, lease=-1.0):  # left behind by a driver that is gone
            pass
    with pytest.raises(FileNotFoundError):
        f.read("b.json")
