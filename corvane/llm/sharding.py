"""Sharding by a hierarchical weighted hash tree, in DataFrame functions.

A document descends from the root through region and rack to a shard.  At each level every child draws an exponential
waiting time from the hash of (doc_id, child), divided by the child's weight, and the least wins.  A child of greater
weight wins more often by just that ratio, and when a weight grows, documents move only into the subtree that it heads;
all other draws stand.  The weight of a node is the number of its shards (or their summed weights), so shards get equal
shares.

Shards are numbered in order; four make a region and two a rack.  A shard added after the last full region starts a
region of its own, so that it takes documents only into itself (the ``key`` law; :func:`assign` refuses counts that leave a region open); growth within a region confines movement to that region.

Defined cases: a null text has size 1 and the checksum of the empty string; a null doc_id is placed like an id of its own;
repeated rows go to one shard and get slots of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import gapless, saved

SHARDS, PER_RACK, PER_REGION = 8, 2, 4


@dataclass(frozen=True)
class Node:
    """A region, rack or shard.  ``name`` is what its draws are hashed with; a shard has a number and no children."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``shards`` shards, each of weight 1 unless ``weights`` says otherwise."""

    def level(name: str, of: list[int], sizes: tuple[int, ...]) -> Node:
        if not sizes:
            return Node(name, (weights or {}).get(of[0], 1.0), (), of[0])
        size = sizes[0]
        kids = tuple(level(f"{name}/{k}", [s for s in of if s // size == k], sizes[1:]) for k in sorted({s // size for s in of}))
        return Node(name, sum(k.weight for k in kids), kids)

    return level("", list(range(shards)), (PER_REGION, PER_RACK, 1))


def draw(key: Column, child: Node) -> Column:
    """An exponential waiting time of rate ``child.weight``, from 53 bits of hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(child.name), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(child.weight)


def place(key: Column, node: Node) -> Column:
    """The shard of ``key`` under ``node``.  Children of no weight get nothing; equal draws go to the first child."""
    if node.shard is not None:
        return F.lit(node.shard)
    kids = [c for c in node.children if c.weight > 0]
    if len(kids) == 1:
        return place(key, kids[0])
    best = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(kids)]))["k"]
    out = place(key, kids[-1])
    for k in range(len(kids) - 2, -1, -1):
        out = F.when(best == k, place(key, kids[k])).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of ``docs``.

    ``shards`` must fill its regions: within a region that is not full, one more shard would also draw documents to the
    shards beside it, and the ``key`` law would not hold.
    """
    if shards < 1 or shards % PER_REGION:
        raise ValueError(f"the key law holds for multiples of {PER_REGION} shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.lit("key").alias("law"),
            place(key, tree(shards)).cast("int").alias("shard"),
            place(key, tree(shards + 1)).cast("int").alias("grown_shard"),
        ),
        "shards",
    )
    return gapless(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
