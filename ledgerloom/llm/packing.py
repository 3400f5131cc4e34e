"""Filling fixed-capacity containers with texts, each container holding the sources in target proportions.

The texts are hashed into partitions of bounded token count, so no group grows with the data. Within a partition
a deficit round-robin runs over one queue per source: every container grants each source its share of the
capacity, the source most in arrears places its largest text that fits, and arrears or advances are
carried to the next container. What a partition must still owe at its start follows from the shares and
the token totals of the partitions before it, so deficits pass from partition to partition although
all are packed at once. Containers that stay underfull at a partition's end are packed once more together.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import durable

#: Tokens a partition holds at most on average; bounds the group one task packs.
PARTITION_TOKENS = 2_000_000
#: Containers filled less than this are packed again with those of other partitions.
UNDERFULL = 0.97
MERGE = 64
#: Partitions per step of the running sums of deficits.
BLOCK = 1024

PACKED = "pack_id bigint, capacity_tokens bigint, container_id string, doc_id bigint, piece_no bigint, source string, n_tokens bigint, filled bigint"


class Queue:
    """A source's waiting texts by size: the largest that fits is found by bisection."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: dict[int, list] = {}

    def put(self, size: int, item: Any) -> None:
        if size not in self.items:
            insort(self.sizes, size)
            self.items[size] = []
        self.items[size].append(item)

    def fits(self, room: int) -> int:
        k = bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> Any:
        item = self.items[size].pop()
        if not self.items[size]:
            del self.items[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return item


def pack(items: list[tuple[str, int, Any]], capacity: int, shares: dict[str, float], owed: dict[str, float] | None = None) -> list[list[tuple[str, int, Any]]]:
    """Containers of (source, size, item), each of at most capacity, that hold every item once."""
    queues: dict[str, Queue] = {}
    for source, size, item in sorted(items, key=lambda x: (x[1], str(x[2])), reverse=True):
        queues.setdefault(source, Queue()).put(size, item)
    names = sorted(queues)
    deficit = {s: (owed or {}).get(s, 0.0) for s in names}
    left, out = len(items), []
    while left:
        room, box = capacity, []
        for s in names:
            deficit[s] += shares.get(s, 0.0) * capacity
        while room:
            best = None
            for s in names:
                size = queues[s].fits(room)
                if size:
                    # a source in arrears goes first; among those in advance, what leaves least room
                    rank = (1, deficit[s], size) if deficit[s] > 0 else (0, size, deficit[s])
                    if best is None or rank > best[0]:
                        best = (rank, s, size)
            if best is None:
                break
            _, s, size = best
            box.append((s, size, queues[s].take(size)))
            deficit[s] -= size
            room -= size
            left -= 1
        out.append(box)
    return out


def _items(docs: DataFrame, sizes: DataFrame, partition_tokens: int) -> DataFrame:
    """Every text, or every piece of a text that alone exceeds the capacity, for each container size."""
    total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // partition_tokens))
    few = sizes.select("pack_id", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()  # a fixed few
    boxes = F.array(*[F.struct(F.lit(r[0]).cast("bigint").alias("pack_id"), F.lit(r[1]).cast("bigint").alias("capacity_tokens")) for r in few]).cast("array<struct<pack_id:bigint,capacity_tokens:bigint>>")
    return (
        docs.where("n_tokens > 0").select("*", F.explode(boxes).alias("size")).select("*", "size.*")
        .withColumn("pieces", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece_no"))
        .withColumn("n_tokens", F.least("capacity_tokens", F.col("n_tokens") - F.col("piece_no") * F.col("capacity_tokens")).cast("bigint"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(int(parts))))
        .select("pack_id", "capacity_tokens", "part", "doc_id", "piece_no", F.coalesce("source", F.lit("")).alias("source"), "n_tokens")
    )


def _part_of(container_id: str):
    return F.split(container_id, "-")[1].cast("bigint")


def _merged(part):
    """The number under which the underfull containers of MERGE partitions are packed again."""
    return F.lit(-1) - F.floor(part / MERGE)


def owed_after(filled: DataFrame, owed: DataFrame) -> DataFrame:
    """(pack_id, part, source, share, owed) at the start of each second packing: what its first partition had to owe,
    and what the containers that stay have added to it."""
    at = owed.groupBy("pack_id", _merged(F.col("part")).alias("part"), "source").agg(F.first("share").alias("share"), F.min_by("owed", "part").alias("start"))
    placed = filled.groupBy("pack_id", _merged(_part_of("container_id")).alias("part"), "source").agg(F.sum("n_tokens").alias("t"))
    both = placed.groupBy("pack_id", "part").agg(F.sum("t").alias("all_t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return at.join(placed, ["pack_id", "part", "source"], "left").join(both, ["pack_id", "part"], "left").select(
        "pack_id", "part", "source", "share", (F.col("start") + F.col("share") * zero("all_t") - zero("t")).alias("owed"))


def pack_documents(docs: DataFrame, sizes: DataFrame, targets: DataFrame | None = None, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """(pack_id, capacity_tokens, container_id, doc_id, piece_no, source, n_tokens, filled) for docs with
    doc_id, source and n_tokens.

    A text is cut only if it alone exceeds the capacity: into full pieces and a rest, numbered from 0.
    Texts without tokens need no room and give no row. targets (source, target_share) are the proportions
    each container aims at; by default each source's share of all tokens, which lets all texts be placed
    evenly. Once a source runs out the others fill its room. Null sources count as ''.
    """
    items = durable(_items(docs.select("doc_id", "source", "n_tokens"), sizes, partition_tokens))
    by_source = durable(items.groupBy("pack_id", "capacity_tokens", "part", "source").agg(F.sum("n_tokens").alias("t")))
    whole = by_source.groupBy("pack_id", "source").agg(F.sum("t").alias("all_t"))
    if targets is None:
        share = whole.withColumn("share", F.col("all_t") / F.sum("all_t").over(Window.partitionBy("pack_id"))).select("pack_id", "source", "share")
    else:
        share = whole.join(F.broadcast(targets.select("source", F.col("target_share").alias("share"))), "source", "left").select("pack_id", "source", F.coalesce("share", F.lit(0.0)).alias("share"))
    in_part = by_source.groupBy("pack_id", "part").agg(F.sum("t").alias("part_t"))
    gaps = (
        in_part.join(share, "pack_id").join(by_source.select("pack_id", "part", "source", "t"), ["pack_id", "part", "source"], "left")
        .withColumn("gap", F.col("share") * F.col("part_t") - F.coalesce("t", F.lit(0))).withColumn("block", F.floor(F.col("part") / BLOCK))
    )
    # running sums in two steps, so that no window holds more than BLOCK partitions, or a BLOCKth of all
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = gaps.groupBy("pack_id", "source", "block").agg(F.sum("gap").alias("gap")).select(
        "pack_id", "source", "block", F.coalesce(F.sum("gap").over(before(["pack_id", "source"], "block")), F.lit(0.0)).alias("base"))
    owed = (
        gaps.withColumn("inner", F.coalesce(F.sum("gap").over(before(["pack_id", "source", "block"], "part")), F.lit(0.0)))
        .join(blocks, ["pack_id", "source", "block"]).select("pack_id", "part", "source", "share", (F.col("inner") + F.col("base")).alias("owed"))
    )

    def run(key: tuple[Any, ...], part: pd.DataFrame, debts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(part):
            cap = int(part.capacity_tokens.iloc[0])
            boxes = pack(
                list(zip(part.source, map(int, part.n_tokens), zip(part.doc_id, part.piece_no))), cap,
                dict(zip(debts.source, debts.share)), dict(zip(debts.source, debts.owed)),
            )
            for n, box in enumerate(boxes):
                filled = sum(size for _, size, _ in box)
                rows += [(key[0], cap, f"{key[0]}-{key[1]}-{n}", doc, piece, s, size, filled) for s, size, (doc, piece) in box]
        return pd.DataFrame(rows, columns=["pack_id", "capacity_tokens", "container_id", "doc_id", "piece_no", "source", "n_tokens", "filled"])

    def packed(xs: DataFrame, debts: DataFrame) -> DataFrame:
        debts = debts.select(*[F.col(c).alias(c) for c in debts.columns])  # own column ids beside those of xs
        return xs.groupBy("pack_id", "part").cogroup(debts.groupBy("pack_id", "part")).applyInPandas(run, PACKED)

    first = durable(packed(items, owed))
    full = F.col("filled") >= F.col("capacity_tokens") * UNDERFULL
    rest = durable(first.where(~full)).withColumn("part", _merged(_part_of("container_id")))
    again = packed(
        rest.select("pack_id", "capacity_tokens", "part", "doc_id", "piece_no", "source", "n_tokens"),
        owed_after(first.where(full), owed),
    )
    return first.where(full).unionByName(again)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container size: containers, tokens, and the share of room left unused; and how far a container's
    mix is off the overall mix, as half the summed difference of shares, averaged over tokens."""
    parts = durable(packed.groupBy("pack_id", "capacity_tokens", "container_id", "source").agg(F.sum("n_tokens").alias("s")))
    overall = parts.groupBy("pack_id", "source").agg(F.sum("s").alias("all_s"))
    total = parts.groupBy("pack_id").agg(F.sum("s").alias("all_t"))
    share = overall.join(F.broadcast(total), "pack_id").select("pack_id", "source", (F.col("all_s") / F.col("all_t")).alias("share"))
    size = parts.groupBy("pack_id", "container_id").agg(F.sum("s").alias("t"))
    boxes = (
        parts.join(size, ["pack_id", "container_id"]).join(F.broadcast(share), ["pack_id", "source"]).groupBy("pack_id", "capacity_tokens", "container_id")
        # a source that the container lacks is off by its whole share
        .agg(F.first("t").alias("t"), (F.sum(F.abs(F.col("s") / F.col("t") - F.col("share")) - F.col("share")) + 1).alias("off"))
    )
    return boxes.groupBy("pack_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"),
        (F.lit(1.0) - F.sum("t") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("unused_share"),
        (F.sum(F.col("off") * F.col("t")) / F.sum("t") / 2).alias("mix_off"),
    )
