"""Parent-child rows to whole hierarchies, by tree contraction.

Leaf raking and unary-chain compression alternate until only roots and self-loops are left; what each round removed is
written down and put back in reverse order, which gives every node its root, depth and path. A core that does not
vanish is a loop, contracted to a node that is its own parent. The number of rounds grows with the logarithm of the
longest chain, not with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarrylight.operators.skew import heavy_keys, split_join
from quarrylight.scratch import Growing, write_out

TREE, LOOP, BELOW_LOOP = "tree", "loop", "below_loop"
_RAKED, _SPLICED, _STAYS, _CORE = 0, 1, 2, 3


def _coin(node: str, turn: int):
    return F.pmod(F.xxhash64(F.col(node), F.lit(turn)), F.lit(2))


def _linked(nodes: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Parents that name no node become null."""
    named = nodes.where(F.col("parent").isNotNull()).select("parent").distinct()
    there = named.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").withColumn("there", F.lit(True))
    return split_join(nodes, there, "parent", hot=hot).withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")


def _turn(active: DataFrame, turn: int) -> DataFrame:
    """``active`` with the fate of each node in this round, and of a spliced node its only child."""
    kids = active.where(F.col("parent") != F.col("node")).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"), F.min("node").alias("child"))
    fate = (
        F.when(F.col("parent") == F.col("node"), _CORE)
        .when(F.col("kids").isNull(), _RAKED)
        .when((F.col("kids") == 1) & (_coin("node", turn) == 1) & (_coin("parent", turn) == 0), _SPLICED)
        .otherwise(_STAYS)
    )
    # a loop's node that also carries a tree has two children or more and waits until the tree is raked
    return active.join(kids, "node", "left").withColumn("fate", fate).drop("kids")


def _shrunk(marked: DataFrame) -> DataFrame:
    """What stays after a round, each node below a spliced one now hanging on that one's parent."""
    gone = marked.where(F.col("fate") == _SPLICED).select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("seg").alias("up_seg"), F.col("low").alias("up_low"))
    left = marked.where(F.col("fate") >= _STAYS).drop("child", "fate").join(gone, "node", "left")
    over = F.col("up").isNotNull()
    return left.select(
        "node",
        F.coalesce("up", "parent").alias("parent"),
        F.when(over, F.concat("up_seg", "seg")).otherwise(F.col("seg")).alias("seg"),
        F.when(over, F.least("up_low", "low")).otherwise(F.col("low")).alias("low"),
    )


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Root, depth and path of each node.

    ``nodes`` has ``node``, ``parent`` (null for a root; a parent that names no node counts as null), ``label`` (what the
    node is called in paths; itself if null) and ``rank`` (orders the nodes of a loop). Rows without a node are left out; of
    rows that repeat a node the one with the smallest parent counts. Further columns are ignored; an empty table gives an
    empty result. Result: ``node``, ``kind`` (tree, loop, below_loop), ``root`` (in and below a loop its node of lowest
    rank), ``depth`` (root 0; -1 in and below loops), ``path`` (labels from the root; null in and below loops) and ``chain``
    (the path; below a loop the labels from the loop's node on; in a loop the node's own).
    """
    label = F.coalesce(F.col("label").cast("string"), F.col("node").cast("string"))
    one = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("parent", label.alias("label"), "rank")).alias("x"))
    one = write_out(one.select("node", "x.parent", "x.label", "x.rank"))
    # a spliced node leaves its child to its parent, so no node ever has more children than at first: heavy ones are counted once
    hot = heavy_keys(one, "parent")
    base = write_out(_linked(one, hot))
    active = base.where(F.col("parent").isNotNull()).select("node", "parent", F.array("label").alias("seg"), F.struct("rank", "node").alias("low"))
    roots = base.where(F.col("parent").isNull()).select("node", F.lit(TREE).alias("kind"), F.col("node").alias("root"), F.array("label").cast("array<string>").alias("chain"))
    rounds: list[tuple[DataFrame, set[int]]] = []
    while True:
        seen = Observation()
        counts = [F.count_if(F.col("fate") == f).alias(str(f)) for f in (_RAKED, _SPLICED, _STAYS, _CORE)]
        marked = write_out(_turn(active, len(rounds)).observe(seen, *counts))
        left = {int(k) for k, n in seen.get.items() if n}
        rounds.append((marked, left))
        if _STAYS not in left:
            break
        active = _shrunk(marked)
    loops = rounds[-1][0].where(F.col("fate") == _CORE).select("node", F.lit(LOOP).alias("kind"), F.col("low.node").alias("root"), F.slice("seg", -1, 1).alias("chain"))
    known = Growing(roots.unionByName(loops))
    for marked, fates in reversed(rounds):
        for fate in (f for f in (_SPLICED, _RAKED) if f in fates):
            known.add(_put_back(marked.where(F.col("fate") == fate), known.df, hot, _CORE in left and fate == _SPLICED))
    tree = F.col("kind") == TREE
    depth = F.when(tree, F.size("chain") - 1).otherwise(F.lit(-1)).cast("bigint").alias("depth")
    return known.df.select("node", "kind", "root", depth, F.when(tree, F.col("chain")).alias("path"), "chain")


def _put_back(gone: DataFrame, known: DataFrame, hot: DataFrame | None, may_loop: bool) -> DataFrame:
    """What is known of nodes that a round removed, from what is known of their parents then."""
    up = known.select(F.col("node").alias("parent"), "kind", "root", F.col("chain").alias("up"))
    found = split_join(gone.select("node", "parent", "child", "seg"), up, "parent", "inner", hot=hot)
    looped = F.lit(False)
    if may_loop:  # a spliced node lies on a loop if its child does
        on = known.where(F.col("kind") == LOOP).select(F.col("node").alias("child"), F.lit(True).alias("on"))
        found = found.join(on, "child", "left")
        looped = F.coalesce("on", F.lit(False))
    kind = F.when(looped, LOOP).when(F.col("kind") == TREE, TREE).otherwise(BELOW_LOOP)
    chain = F.when(looped, F.slice("seg", -1, 1)).otherwise(F.concat("up", "seg"))
    return found.select("node", kind.alias("kind"), "root", chain.alias("chain"))


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs of a node and a node below it, with their distance, from the result of ``hierarchy``.

    Nodes are given by the labels that ``chain`` holds. As many rows as the depths of all nodes add up to; below a loop the
    ancestors end with the loop's node, as all of a loop lie above each other.
    """
    own, depth = F.element_at("chain", -1), F.size("chain") - 1
    at = tree.where(depth > 0).select(own.alias("descendant"), depth.alias("depth"), F.posexplode(F.slice(F.col("chain"), F.lit(1), depth)).alias("pos", "ancestor"))
    return at.select("ancestor", "descendant", (F.col("depth") - F.col("pos")).cast("bigint").alias("distance"))
