"""Parent-child rows to full hierarchies by pointer doubling (problem 2).

Every unresolved node holds a pointer to an ancestor and its distance.  A round joins each pointer with
the pointed-at node's own pointer, which doubles the distance, so a chain of depth d is resolved after
about log2(d) rounds.  If a round resolves no node, no node lies that deep or deeper, so what remains
never reaches a top: it is on a ring or leads into one.  These rounds shuffle three numbers a node.
Path segments are concatenated in a second doubling over the resolved nodes alone, where it is known
which nodes are pointed at in which round: only their segments are shuffled.  No driver-side data but
row counts; each round is a written table; no side of a join is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import label
from attestry.scratch import Scratch


def edges(rows: DataFrame, node: str, parent: str, scratch: Scratch) -> DataFrame:
    """(n, k, id, pn, pk): a number for each node, its compared form, and those of its parent, null where there is no such parent.

    Nodes whose ids differ only in case or surrounding white space are one node, named by its
    smallest spelling.  Rows with a null or blank id are no nodes.
    """
    own = rows.select(label(node).alias("k"), F.col(node).cast("string").alias("id"), label(parent).alias("pk"))
    own = own.where("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.min("pk").alias("pk"))
    own = scratch.write(own.withColumn("n", F.monotonically_increasing_id()), "own")
    known = own.select(F.col("k").alias("_p"), F.col("n").alias("pn"))
    held = own.where("pk is not null").hint("merge").join(known, F.col("pk") == F.col("_p"), "left").select("n", "k", "id", "pn", F.col("_p").alias("pk"))
    top = own.where("pk is null").select("n", "k", "id", F.lit(None).cast("long").alias("pn"), "pk")
    return scratch.write(held.unionByName(top), "edges")


class Forest:
    """The hierarchies in ``rows``: ``nodes`` (resolved) and ``rings`` (what never ends).

    ``nodes``: id, k, root, depth and, with ``paths``, path (array of ids from the top to the node).
    ``rings``: id, k, cycle_id (smallest id on the ring), on_ring.

    Null, blank and dangling parents end a chain; a node that is its own parent is a ring of one.
    Repeated rows of a node count once (the smallest parent; choose the row that holds beforehand).
    An empty table gives two empty results.  Further columns of ``rows`` are ignored.
    """

    def __init__(self, rows: DataFrame, node: str = "id", parent: str = "parentProjectId", paths: bool = True):
        self.scratch = Scratch(rows.sparkSession, "forest")
        self.paths = paths
        self.edges = own = edges(rows, node, parent, self.scratch)
        todo = own.where("pn is not null").select("n", F.col("pn").alias("anc"), F.lit(1).alias("depth"))
        parts = [own.where("pn is null").select("n", F.col("n").alias("root"), F.lit(0).alias("depth"))]
        jumps, left, n = [], todo.count(), 0
        while left:
            n += 1
            jumps.append(todo)
            ahead = [todo.select(F.col("n").alias("h"), F.col("anc").alias("to"), F.col("depth").alias("more"), F.lit(None).cast("long").alias("root"))]
            ahead += [d.select(F.col("n").alias("h"), F.lit(None).cast("long").alias("to"), F.col("depth").alias("more"), "root") for d in parts]
            step = todo.hint("merge").join(reduce(DataFrame.unionByName, ahead), F.col("anc") == F.col("h"))
            step = self.scratch.write(step.select("n", F.col("to").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"), "root", F.col("to").isNotNull().alias("open")), f"state_{n}", by=["open"])
            todo, done = step.where("open").select("n", "anc", "depth"), step.where(~F.col("open")).select("n", "root", "depth")
            now = todo.count()
            if now == left:
                break
            parts.append(done)
            left = now
        self.rounds, self._todo = n, todo if left else None
        done = reduce(DataFrame.unionByName, parts)
        named = own.select("n", "k", "id")
        whole = done.hint("merge").join(named, "n")
        if paths:
            whole = whole.hint("merge").join(self._paths(done, jumps[: len(parts) - 1]), "n")
        top = named.select(F.col("n").alias("root"), F.col("id").alias("root_id"))
        self.nodes = whole.hint("merge").join(top, "root").select("id", "k", F.col("root_id").alias("root"), "depth", *(["path"] if paths else []))
        self.rings = self._rings()

    def _paths(self, done: DataFrame, jumps: list[DataFrame]) -> DataFrame:
        """(n, path) of the resolved nodes: in round j a node at depth 2^j or more puts what lies 2^j above it before its own segment."""
        state = done.select("n", "depth").hint("merge").join(self.edges.select("n", F.col("pn").alias("anc"), F.array("id").alias("path")), "n")
        if jumps:
            # The last round in which a node is pointed at; in later ones its segment stays where it is.
            met = reduce(DataFrame.unionByName, [t.select(F.col("anc").alias("n"), F.lit(j).alias("last")) for j, t in enumerate(jumps)])
            state = state.hint("merge").join(met.groupBy("n").agg(F.max("last").alias("last")), "n", "left")
        else:
            state = state.withColumn("last", F.lit(None).cast("int"))
        state = self.scratch.write(state.withColumn("open", F.col("anc").isNotNull()), "segments", by=["open"])
        todo, parts, j = state.where("open").drop("open"), [state.where(~F.col("open")).drop("open")], 0
        for j in range(len(jumps)):
            ahead = reduce(DataFrame.unionByName, [todo, *parts]).where(F.col("last") >= j).select(F.col("n").alias("h"), F.col("anc").alias("to"), F.col("path").alias("before"))
            step = todo.hint("merge").join(ahead, F.col("anc") == F.col("h")).select("n", "depth", F.col("to").alias("anc"), F.concat("before", "path").alias("path"), "last")
            step = self.scratch.write(step.withColumn("open", F.col("anc").isNotNull()), f"segments_{j}", by=["open"])
            todo = step.where("open").drop("open")
            parts.append(step.where(~F.col("open")).drop("open"))
        return reduce(DataFrame.unionByName, parts).select("n", "path")

    def _rings(self) -> DataFrame:
        if self._todo is None:
            empty = self.edges.where("false")
            return empty.select("id", "k", F.col("id").alias("cycle_id"), F.lit(False).alias("on_ring"))
        # Jumping on until the set of targets stops shrinking leaves exactly the nodes on rings:
        # there a jump of any length is a permutation, and everything else has been left behind.
        lost, n = self._todo.select("n", "anc"), 0
        size = lost.select("anc").distinct().count()
        while True:
            n += 1
            hop = lost.select(F.col("n").alias("h"), F.col("anc").alias("to"))
            lost = self.scratch.write(lost.hint("merge").join(hop, F.col("anc") == F.col("h")).select("n", F.col("to").alias("anc")), f"lost_{n}")
            now = lost.select("anc").distinct().count()
            if now == size:
                break
            size = now
        ring = lost.select(F.col("anc").alias("n")).distinct().hint("merge").join(self.edges, "n").select("n", F.col("pn").alias("to"), F.col("id").alias("least"))
        ring, n = self.scratch.write(ring, "ring_0"), 0
        while True:
            n += 1
            ahead = ring.select(F.col("n").alias("h"), F.col("to").alias("to2"), F.col("least").alias("least2"))
            step = ring.hint("merge").join(ahead, F.col("to") == F.col("h")).select(
                "n", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("fell"))
            step = self.scratch.write(step, f"ring_{n}")
            ring = step.drop("fell")
            if not step.where("fell").limit(1).count():
                break
        on = ring.select(F.col("n").alias("h"), F.col("least").alias("cycle_id"))
        member = ring.select(F.col("n").alias("m"))
        named = self.edges.select("n", "k", "id")
        return (lost.hint("merge").join(on, F.col("anc") == F.col("h")).hint("merge").join(member, F.col("n") == F.col("m"), "left").hint("merge").join(named, "n")
                .select("id", "k", "cycle_id", F.col("m").isNotNull().alias("on_ring")))

    def descendants(self, rings: bool = False) -> DataFrame:
        """(ancestor, descendant, distance) for every pair of resolved nodes and, with ``rings``, of all nodes.

        Each node's path already names its ancestors.  A node on or below a ring has every member of it as
        ancestor, at the distance at which it is first reached; no node is its own descendant.
        """
        if not self.paths:
            raise ValueError("descendants need paths")
        up = self._up(self.nodes)
        return up.unionByName(self._ring_descendants()) if rings and self._todo is not None else up

    @staticmethod
    def _up(nodes: DataFrame) -> DataFrame:
        up = nodes.select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
        return up.where("pos < depth").select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))

    def _ring_descendants(self) -> DataFrame:
        # Without the parent link of its smallest member a ring is a chain and all that hangs below it a tree.
        rings = self.rings.select("k", "cycle_id", "on_ring")
        open_ = self.edges.hint("merge").join(rings.select("k", "cycle_id"), "k").select("id", F.when(F.col("id") != F.col("cycle_id"), F.col("pk")).alias("pk"))
        cut = Forest(open_, "id", "pk")
        held = self.scratch.write(cut.nodes.hint("merge").join(rings, "k").select("id", "depth", "path", "cycle_id", "on_ring"), "cut")
        member = held.where("on_ring").select(F.col("id").alias("ancestor"), F.col("depth").alias("place"), F.col("cycle_id").alias("c"))
        # The members behind the one where a node's path enters the ring are reached through the removed link.
        enters = held.select("id", F.explode("path").alias("ancestor")).hint("merge").join(member, "ancestor").groupBy("id").agg(F.max("place").alias("enters"))
        size = member.groupBy("c").agg(F.count(F.lit(1)).cast("int").alias("size"))
        behind = held.select("id", "depth", "cycle_id").hint("merge").join(enters, "id").hint("merge").join(member.hint("merge").join(size, "c"), (F.col("cycle_id") == F.col("c")) & (F.col("place") > F.col("enters")))
        behind = behind.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") + F.col("size") - F.col("place")).alias("distance"))
        return self._up(held).unionByName(behind)
