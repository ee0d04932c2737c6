from __future__ import annotations

from attestry import facts as fx
from attestry.operators import entities
from attestry.streaming import ingest
from tests.conftest import rows


def test_slug_keys_links(spark):
    d = spark.createDataFrame([("ﬁne  Café!",), ("a--B",), (None,)], "n string").select(entities.slug("n").alias("s"))
    assert rows(d) == [("a_b",), ("fine_café",), (None,)]
    m = "array<struct<surface string, canonicalName string, entityId string, decision string>>"
    r = spark.createDataFrame([("r1", 1, [("A", "Ann", "e1", "new")]), ("r2", 2, [("Annie", "Ann", "e1", "same-as"), ("B", "Bo", None, "ambiguous")]), ("r3", 3, None)], f"id string, ord int, entity_mentions {m}")
    assert rows(entities.known(r)) == [("e1", "Annie", "Ann")]
    assert rows(entities.keys(r)) == [("r1", "id:e1"), ("r1", "name:ann"), ("r2", "id:e1"), ("r2", "name:ann"), ("r2", "name:bo")]
    rows_ = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k"), ("c", 1, "k"), ("b", 2, "l"), ("a", 1, "l"), ("d", 3, None)], "id string, batch int, key string")
    assert rows(entities.linked(rows_, None)) == [("a", "b", ["k", "l"]), ("b", "c", ["k"])]


def test_merge_and_undo(spark):
    f = fx.facts(fx.parsed(spark.createDataFrame([("1", "(p old x)"), ("2", '(p "old" x)'), ("3", "(p (f old) old)")], "id string, ske string"), "ske"))
    new, journal = entities.merged(f, "old", "new")
    assert rows(new, "id", "expr_key") == [("1", "(p new x)"), ("2", '(p "old" x)'), ("3", "(p (f old) new)")]
    assert rows(entities.restored(new, journal), "id", "expr_key", "args") == rows(f, "id", "expr_key", "args")


def test_stream_processes_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    seen = []
    run = lambda: ingest.ingest(ingest.parquet_stream(spark, src, "chunk_id string, text string"), out, ck, ["chunk_id"], lambda b, n: seen.append((n, b.count()))).awaitTermination()
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "chunk_id string, text string").coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([("c", "z")], "chunk_id string, text string").coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert seen == [(0, 2), (1, 1)] and rows(spark.read.parquet(out), "chunk_id") == [("a",), ("b",), ("c",)]
    spark.createDataFrame([("a", "again"), ("d", "w")], "chunk_id string, text string").coalesce(1).write.mode("append").parquet(src)
    run()
    assert seen[2:] == [(2, 1)] and rows(spark.read.parquet(out), "chunk_id") == [("a",), ("b",), ("c",), ("d",)]
    ledger = spark.createDataFrame([("a", "processed"), ("b", "failed")], "chunk_id string, state string")
    assert rows(ingest.pending(spark.read.parquet(out), ledger), "chunk_id") == [("b",), ("c",), ("d",)]
