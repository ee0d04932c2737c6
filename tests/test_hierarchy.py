from __future__ import annotations

import random

from attestry.operators.hierarchy import Forest
from tests.conftest import rows

SCHEMA = "id string, parentProjectId string"


def plain(pairs):
    """Path to the top and ring of each node, followed step by step."""
    norm = lambda x: x.strip().lower() if x and x.strip() else None
    names = {norm(i): i for i, _ in pairs if norm(i)}
    up = {norm(i): (norm(p) if norm(p) in names else None) for i, p in pairs if norm(i)}
    paths, rings = {}, {}
    for k in up:
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is None:
            paths[names[k]] = [names[x] for x in reversed(seen)]
        else:
            ring = seen[seen.index(at) :]
            rings[names[k]] = (min(names[x] for x in ring), k in ring)
    return paths, rings


def check(spark, pairs):
    f = Forest(spark.createDataFrame(pairs, SCHEMA))
    paths, rings = plain(pairs)
    assert {r.id: list(r.path) for r in f.nodes.collect()} == paths
    assert all(r.depth == len(r.path) - 1 and r.root == r.path[0] for r in f.nodes.collect())
    assert {r.id: (r.cycle_id, r.on_ring) for r in f.rings.collect()} == rings
    want = sorted((p[i], n, len(p) - 1 - i) for n, p in paths.items() for i in range(len(p) - 1))
    assert rows(f.descendants()) == sorted(want, key=repr)


def test_rounds_shuffle_no_paths_and_broadcast_nothing(spark):
    chain = [("a0", None)] + [(f"a{i}", f"a{i - 1}") for i in range(1, 40)] + [(f"leaf{i}", "a39") for i in range(50)] + [("x", "y"), ("y", "x"), ("z", "x")]
    d = spark.createDataFrame(chain, SCHEMA)
    f = Forest(d)
    assert f.nodes.count() == 90 and f.rings.count() == 3
    for df in (f.nodes, f.rings, f.descendants(rings=True)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert "path" not in Forest(d, paths=False).nodes.columns


def test_chains_rings_and_dirt(spark):
    check(spark, [("a", None), ("b", "a"), ("c", " B "), ("d", ""), ("e", "nowhere"), ("f", "f"), ("g", "f"), ("h", "j"), ("i", "h"), ("j", "i"), ("k", "i"), ("l", "k"), (None, "a"), ("  ", "a")])


def test_long_chain_and_random_forest(spark):
    rng = random.Random(3)
    chain = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(70)]
    rng.shuffle(chain)
    check(spark, chain)
    nodes = [f"x{i}" for i in range(60)]
    check(spark, [(n, rng.choice([*nodes, None, "gone"])) for n in nodes])


def test_long_ring_with_tail(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 13}") for i in range(13)]
    tail = [(f"t{i}", f"t{i + 1}" if i < 20 else "r5") for i in range(21)]
    check(spark, ring + tail)


def test_empty_and_repeated_and_clashing_columns(spark):
    check(spark, [])
    d = spark.createDataFrame([("a", None, "x", 1), ("b", "a", "y", 2), ("b", "a", "y", 2), ("B ", "a", None, None)], "id string, parentProjectId string, k string, depth int")
    assert rows(Forest(d).nodes, "k", "depth") == [("a", 0), ("b", 1)]


def test_written_tables_go_to_the_shared_folder_and_can_be_cleared(spark, tmp_path, monkeypatch):
    from attestry import scratch

    monkeypatch.setattr(scratch, "shared_root", lambda s: f"file://{tmp_path}/shared")
    monkeypatch.setattr(scratch, "_WRITTEN", [])
    check(spark, [("a", None), ("b", "a")])
    assert list((tmp_path / "shared").glob("attestry-forest-*/edges"))
    scratch.clear(spark)
    assert not list((tmp_path / "shared").glob("attestry-*"))


def test_descendants_on_and_below_rings(spark):
    rng = random.Random(8)
    nodes = [f"x{i}" for i in range(40)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("t0", "r3"), ("t1", "t0"), ("t2", "t0"), ("u0", "r6"), ("a", None), ("b", "a"), ("s", "s"), ("v", "s")]
    for pairs in (ring, [(n, rng.choice(nodes)) for n in nodes], [("a", None), ("b", "a")], []):
        up, want = dict(pairs), []
        for n in up:
            at, seen = up[n], []
            while at is not None and at != n and at not in seen:
                seen.append(at)
                at = up[at]
            want += [(a, n, i + 1) for i, a in enumerate(seen)]
        assert rows(Forest(spark.createDataFrame(pairs, SCHEMA)).descendants(rings=True)) == sorted(want, key=repr)
