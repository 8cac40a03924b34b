"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Groups of at least 1 / PARTS of a mean shard are packed one by one: there are fewer than shards * PARTS.
PARTS = 4096
#: Smaller groups first join by hash into so many lots, which are packed like groups.
LOTS = 32768


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key: tuple[int, int], rank: int) -> None:
        self.key, self.rank, self.left, self.right = key, rank, None, None


class CapacityTree:
    """Open bins as a balanced tree (a treap with hashed ranks) by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    def add(self, free: int, bin_no: int) -> None:
        key = (free, bin_no)
        rank = int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big")
        low, high = self._split(self._root, key)
        self._root = self._join(self._join(low, _Node(key, rank)), high)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity of at least need."""
        low, high = self._split(self._root, (need, -1))
        if high is None:
            self._root = low
            return None
        parent, node = None, high
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            high = node.right
        else:
            parent.left = node.right
        self._root = self._join(low, high)
        return node.key

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _join(self, low: _Node | None, high: _Node | None) -> _Node | None:
        if low is None or high is None:
            return low or high
        if low.rank > high.rank:
            low.right = self._join(low.right, high)
            return low
        high.left = self._join(low, high.left)
        return high


def pack(items: Iterable[tuple[str, int]], capacity: int) -> dict[str, int]:
    """Best-fit decreasing: item to bin, opening as few bins of the capacity as the rule gives.

    Ties go by name. An item above the capacity gets a bin of its own.
    """
    tree, placed, bins = CapacityTree(), {}, 0
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        found = tree.take_tightest(size) if size <= capacity else None
        free, at = found if found else (max(capacity, size), bins)
        bins += found is None
        placed[name] = at
        tree.add(free - size, at)
    return placed


def pack_into(items: Sequence[tuple[str, int]], shards: int) -> dict[str, int]:
    """Packs into exactly so many shards of near equal size: the least capacity that best fit can keep.

    Items of a mean shard or more get shards of their own first, and the mean is taken anew. If the
    capacities tried do not suffice (few, large items), each goes to the emptiest shard, largest first.
    """
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    placed: dict[str, int] = {}
    left, used = sum(s for _, s in items), 0
    while items and used < shards - 1 and items[0][1] * (shards - used) >= left:
        placed[items[0][0]] = used
        left -= items[0][1]
        used += 1
        items = items[1:]
    bins = shards - used
    mean = -(-left // bins)
    for tried in range(40):
        capacity = mean + (mean * ((1 << tried) - 1) >> 20)
        if capacity > mean * 1.02:
            break
        rest = pack(items, capacity)
        if max(rest.values(), default=0) < bins:
            return placed | {k: v + used for k, v in rest.items()}
    loads = CapacityTree()
    for b in range(bins):
        loads.add(0, b)
    for name, size in items:
        load, b = loads.take_tightest(0)
        placed[name] = b + used
        loads.add(load + size, b)
    return placed


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(rows: DataFrame, key: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Adds `shard`; rows of one key stay together. Give a number of shards or a fixed capacity.

    Group sizes come from one partially combined aggregation, so a hot key is never gathered. Groups of at
    least 1 / PARTS of a mean shard are packed singly; smaller ones join by hash into LOTS lots, packed
    alike. The driver thus sees, and executors are sent, at most shards * PARTS + LOTS items, however
    many groups there are. Empty table: no rows. Null keys form one group.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = rows.sparkSession
    sizes = rows.groupBy(key).agg(F.sum(size).alias("_size"))
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    count = shards or max(1, -(-total // capacity))
    least = max(1, total // (count * PARTS))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    lot = F.pmod(F.xxhash64(name), F.lit(LOTS)).cast("string")
    own = sizes.filter(F.col("_size") >= least).select(F.concat(F.lit("g"), name).alias("_item"), "_size")
    lots = sizes.filter(F.col("_size") < least).groupBy(F.concat(F.lit("l"), lot).alias("_item")).agg(F.sum("_size").alias("_size"))
    items = [(r[0], r[1]) for r in own.unionAll(lots).collect()]
    placed = pack_into(items, shards) if shards else pack(items, capacity)
    names = sorted(placed)
    # As a table, which stays in the driver's plan; a list of rows would be read by Python workers of its own on the executors.
    made = spark.createDataFrame(pa.table({"_item": pa.array(names, pa.string()), "_shard": pa.array([placed[n] for n in names], pa.int32())}))
    x = common.free_prefix(rows)
    single = made.filter(F.col("_item").startswith("g")).select(F.col("_item").alias(x + "g"), F.col("_shard").alias(x + "gs"))
    mixed = made.filter(F.col("_item").startswith("l")).select(F.col("_item").alias(x + "l"), F.col("_shard").alias(x + "ls"))
    out = rows.drop("shard").join(F.broadcast(single), F.concat(F.lit("g"), name) == F.col(x + "g"), "left")
    out = out.join(F.broadcast(mixed), F.concat(F.lit("l"), lot) == F.col(x + "l"), "left")
    return out.withColumn("shard", F.coalesce(x + "gs", x + "ls")).drop(x + "g", x + "gs", x + "l", x + "ls")


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in shards of near equal bytes, equal texts together, with gapless slots.

    Size: UTF-8 bytes plus 1. Null text counts as empty and groups with empty texts. Equal rows get
    slots of their own. Extra columns are not carried.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = common.saved(
        docs.select(F.col(doc_id).alias("doc_id"), text_size(F.col(text)).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.md5(whole.cast("binary")).alias("_key")),
        "sizes",
    )
    put = shard(rows, "_key", "size", shards=shards).drop("_key").withColumn("law", F.lit("bytes"))
    out = common.ranked(put, ["shard"], ["doc_id", "text_crc32"], "slot").withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
