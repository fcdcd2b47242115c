"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks and racks have shards; each level is decided by weighted
hash draws (the child with the least -ln(u)/weight, u drawn from the key and the child's name).
A child that gains weight only takes keys, one that loses weight only gives keys away, and a
change of weights in one subtree leaves the draws inside all others as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import fresh, in_order, task_count


@dataclass(frozen=True)
class Node:
    """A subtree, or with ``shard`` set a leaf. Its weight is the sum of its leaves' weights."""

    name: str
    children: tuple["Node", ...] = field(default=())
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def balanced_tree(shards: int = 8, regions: int = 2, racks: int = 2) -> Node:
    """Regions of racks of equally weighted shards, dealt as evenly as the numbers allow."""
    split = lambda items, n: [p for i in range(n) if (p := items[i * len(items) // n : (i + 1) * len(items) // n])]
    return Node(
        "root",
        tuple(
            Node(f"region{r}", tuple(Node(f"region{r}/rack{k}", tuple(Node(f"shard{s}", shard=s) for s in part)) for k, part in enumerate(split(own, racks))))
            for r, own in enumerate(split(list(range(shards)), regions))
        ),
    )


def grown_tree(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own: only the draw between regions has a
    new child, so rows move to the new shard and nowhere else."""
    new = Node(f"region-of-{shard}", (Node(f"rack-of-{shard}", (Node(f"shard{shard}", shard=shard, leaf_weight=weight),)),))
    return Node(tree.name, (*tree.children, new))


def _draw(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(float(node.weight))


def place(key: Column, node: Node) -> Column:
    """The shard of ``key``: one draw a level, from the root down."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = [_draw(key, c) for c in node.children]
    least = F.least(*draws)
    out = place(key, node.children[-1])
    for child, draw in list(zip(node.children, draws, strict=True))[-2::-1]:
        out = F.when(draw == least, place(key, child)).otherwise(out)
    return out


ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_documents(df: DataFrame, tree: Node | None = None, id_col: str = "doc_id", text_col: str = "text", keep_order: bool = False) -> DataFrame:
    """``df`` with ``size`` (UTF-8 bytes of the text plus 1; null: none), ``text_crc32``, ``law``
    ('key'), ``shard``, ``slot`` (0, 1, ... within a shard, by a hash, then id, CRC and size)
    and ``grown_shard`` (with one more shard). Columns of these names are replaced, all others
    keep their values.

    The id and the tree decide the shard. Rows without an id go by their text's CRC. Repeated rows
    share a shard and have slots of their own, in any order; texts may be of any length; an empty
    table gives an empty one.

    The hash's first bits deal a shard's rows into buckets, numbered each by itself; their number
    goes by the shuffle partitions and doesn't change the slots. The buckets' offsets (shards x
    buckets rows, whatever the input) are broadcast.

    With ``keep_order`` a shard's slots go by the rows' order in ``df`` instead of the hash, so a
    shard of a mixture is one too. Buckets are stretches of files then (``in_order``); as more of
    them come with more rows, the join with their offsets is left to the planner.
    """
    tree = tree or balanced_tree()
    bucket, rank, rows, offset, at = fresh(df, "bucket0", "rank0", "rows0", "offset0", "at0")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.crc32(text).cast("string")))
    leaves = _leaves(tree)
    bits = max(3, (task_count(df.sparkSession) - 1).bit_length())
    # the text has its part: copies of an id are dealt, unless their texts are equal too
    ranked = {} if keep_order else {rank: F.shiftrightunsigned(F.xxhash64(key, F.crc32(text), F.lit("slot")), 1)}
    keyed = (in_order(df, bucket, rank) if keep_order else df).withColumns(
        {
            "size": F.octet_length(text).cast("long") + F.lit(1),
            "text_crc32": F.crc32(text),
            "law": F.lit("key"),
            "shard": place(key, tree).cast("int"),
            "grown_shard": place(key, grown_tree(tree, max(leaves) + 1)).cast("int"),
        }
        | ranked
    )
    if not keep_order:
        keyed = keyed.withColumn(bucket, F.shiftrightunsigned(rank, 63 - bits).cast("int"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(rows)).select("shard", bucket, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(offset))
    within = Window.partitionBy("shard", bucket).orderBy(rank, id_col, "text_crc32", "size")
    offsets = offsets if keep_order else F.broadcast(offsets)
    numbered = keyed.withColumn(at, F.row_number().over(within))
    return numbered.join(offsets, ["shard", bucket]).withColumn("slot", (F.col(offset) + F.col(at) - 1).cast("long")).select(*(c for c in df.columns if c not in ADDED), *ADDED)


def _leaves(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [s for c in node.children for s in _leaves(c)]
