"""Merkle manifest of a table: one leaf a row, one tree a group, one tree over the groups' roots.

A node is the lower-case hex SHA-256 of its children's hex texts; three consecutive nodes of a level
make one of the next. Rows are numbered inside their group by a distributed sort. Each group is cut
into blocks of 3**LEVELS rows, so that a group with a third of all rows is many window partitions,
and every block climbs LEVELS levels in one shuffle. Their tops are the rows of the next round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.scale import rank_rows
from ..session import materialise

#: Children of a node, and levels that one round of windows climbs (blocks of 729 rows).
FANOUT = 3
LEVELS = 6


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value, joined."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to over the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), "")


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(_g, _pos, _node, ...) -> adds _block, _path inside the block, and _top on its first row.

    At level l every row at a multiple of 3**l stands for the node above it; lag and lead by that
    many rows read its neighbours, masked by its slot in the run and the run's length. The rest of the
    rows take the siblings of the last such row. A group of one block stops where one node is left.
    """
    size = FANOUT ** levels
    pos = F.col("_pos") % size
    rows = W.partitionBy("_g", "_block")
    order = rows.orderBy("_pos")
    at = nodes.withColumn("_block", F.floor(F.col("_pos") / size).cast("long"))
    at = at.withColumns({"_rows": F.count(F.lit(1)).over(rows), "_h0": F.col("_node")})
    for level in range(levels):
        step = FANOUT ** level
        node, held = F.floor(pos / step), F.ceil(F.col("_rows") / step)
        slot = node % FANOUT
        run = F.least(F.lit(FANOUT), held - node + slot)
        active = (F.col("_block") > 0) | (held > 1)
        h = F.col(f"_h{level}")
        beside = {f"_{name}{by}": move(h, by * step).over(order) for name, move in (("lag", F.lag), ("lead", F.lead)) for by in range(1, FANOUT)}
        at = at.withColumns(beside)
        left = F.concat(*[F.when(slot >= by, F.col(f"_lag{by}")).otherwise("") for by in range(FANOUT - 1, 0, -1)])
        right = F.concat(*[F.when(slot + by < run, F.col(f"_lead{by}")).otherwise("") for by in range(1, FANOUT)])
        at = at.withColumn(f"_s{level}", F.when(active & (pos % step == 0), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(active, F.sha2(F.concat(h, F.col(f"_s{level}.right")), 256)).otherwise(h)
        at = at.withColumn(f"_h{level + 1}", F.when(pos % (step * FANOUT) == 0, parent)).drop(*beside, f"_h{level}")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = [f"_s{level}" for level in range(levels)]
    at = at.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in steps})
    return at.withColumn("_path", F.array_compact(F.array(*steps))).withColumnRenamed(f"_h{levels}", "_top").drop("_rows", *steps)


def _trees(nodes: DataFrame, levels: int, above=None) -> tuple[DataFrame, DataFrame]:
    """Paths of all nodes to the root of their group, and the roots (_g, _root).

    ``above`` maps the roots to (_g, _root, _upper, ...) of a tree over them; its path is put behind.
    """
    rounds, level = [], nodes
    while True:
        climbed = _climb(level, levels)
        tops = materialise(climbed.where(F.col("_top").isNotNull()).select("_g", F.col("_block").alias("_pos"), F.col("_top").alias("_node")), "tops")
        rounds.append(climbed.drop("_top"))
        if tops.where("_pos > 0").isEmpty():
            break
        level = tops
    roots = tops.select("_g", F.col("_node").alias("_root"))
    upper = above(roots) if above else roots.withColumn("_upper", F.array().cast("array<struct<left:string,right:string>>"))
    upper = upper.withColumn("_block", F.lit(0).cast("long"))
    for i, climbed in enumerate(reversed(rounds)):
        joined = climbed.drop("_node").join(upper, ["_g", "_block"]).withColumn("_upper", F.concat("_path", "_upper")).drop("_path", "_block")
        upper = joined if i == len(rounds) - 1 else joined.withColumnRenamed("_pos", "_block")
    return upper.drop("_pos"), roots


def manifest(rows: DataFrame, leaf: str = "leaf", group: str = "source", order: str = "doc_id",
             keep: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """One row per row of ``rows``: the order column, ``keep``, leaf, subroot, root and the path of siblings.

    ``path`` is an array of (left, right) texts from the leaf's level up to the root. Leaves ascend by the
    order column (null first), rows equal in it by leaf hash. Groups ascend by their text, null first; null
    is a group of its own. A group of one row has its leaf as subroot, a single group its subroot as root.
    A leaf must not be null. An empty table gives no rows. Other columns are not read, so their names may
    be any.
    """
    taken = [order, *[k for k in keep if k != order]]
    narrow = rows.select(F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("_g"), F.col(leaf).alias("_node"),
                         *[F.col(c).alias(f"_k{i}") for i, c in enumerate(taken)])
    ranked = rank_rows(narrow, [F.col("_k0").asc_nulls_first(), F.col("_node")], ["_g"], out="_nr")
    ranked = ranked.select("_g", (F.col("_nr") - 1).alias("_pos"), "_node", F.col("_node").alias("_leaf"), *[f"_k{i}" for i in range(len(taken))])

    def over_groups(roots: DataFrame) -> DataFrame:
        placed = rank_rows(roots, [F.col("_g")], out="_nr")
        nodes = placed.select(F.lit("").alias("_g"), (F.col("_nr") - 1).alias("_pos"), F.col("_root").alias("_node"),
                              F.col("_g").alias("_group"), F.col("_root").alias("_subroot"))
        return _trees(nodes, levels)[0].drop("_g").withColumnRenamed("_group", "_g")

    found = _trees(ranked, levels, over_groups)[0]
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(taken)], F.col("_leaf").alias("leaf"),
                        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_upper").alias("path"))
