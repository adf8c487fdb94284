"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from (key, child), and the
smallest draw wins, so that a child wins with probability proportional to its weight. A draw depends
on nothing but the key, the child and its weight. A change of weights therefore moves keys only into
or out of the subtrees whose weights change.

``HashTree.grow`` opens a region of its own for the added shard. No other weight changes, so the added
shard takes keys and no key moves between the others (the ``key`` law).

Slots are gapless in each shard. Rows are numbered within hash buckets of a shard, which many tasks do
side by side, and the counts of the buckets before are added: a table of shards x buckets rows.

Defined cases: a null text has no bytes (size 16, crc32 0); rows with a null id share the key "null";
repeated rows go to one shard and get slots of their own; an empty table gives an empty table. Only
the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HashTree:
    """Regions of racks of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> HashTree:
        """Equal weights; shards are numbered through."""
        number = iter(range(regions * racks * shards))
        return HashTree(
            tuple(
                tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks))
                for _ in range(regions)
            )
        )

    def grow(self, weight: float = 1.0) -> HashTree:
        """One more shard, alone in a new region."""
        shards = [shard for region in self.regions for rack in region for shard, _ in rack]
        return HashTree((*self.regions, (((max(shards, default=-1) + 1, weight),),)))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Child names and weights by node name; a weight is the sum of those below."""
        out: dict[str, list[tuple[str, float]]] = {"root": []}
        for i, region in enumerate(self.regions):
            racks = []
            for j, rack in enumerate(region):
                name = f"rack{i}.{j}"
                out[name] = [(f"shard{shard}", weight) for shard, weight in rack]
                racks.append((name, sum(weight for _, weight in rack)))
            out[f"region{i}"] = racks
            out["root"].append((f"region{i}", sum(weight for _, weight in racks)))
        return out


def _draw(key: Column, child: Column, weight: Column) -> Column:
    """-ln(u) / weight; u is in (0, 1), from the first 52 bits of an MD5 sum."""
    digest = F.md5(F.concat(key, F.lit("/"), child).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def place(key: Column, tree: HashTree) -> Column:
    """Shard of a string key: three weighted draws from the root down."""
    nodes = tree.children()
    table = F.create_map(
        *(
            part
            for name, children in nodes.items()
            for part in (
                F.lit(name),
                F.array(*(F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in children)),
            )
        )
    )

    def pick(node: Column) -> Column:
        draws = F.transform(
            F.element_at(table, node),
            lambda c: F.struct(_draw(key, c["child"], c["weight"]).alias("d"), c["child"].alias("c")),
        )
        return F.array_min(draws)["c"]

    leaf = pick(pick(pick(F.lit("root"))))
    return F.substring(leaf, len("shard") + 1, 12).cast("int")


def assign(
    docs: DataFrame,
    tree: HashTree,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = 64,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    placed = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        place(key, tree).alias("shard"),
        place(key, tree.grow()).alias("grown_shard"),
    ).withColumns(
        {"bucket": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")}
    )
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumns({"nth": F.row_number().over(inside)})
    # At most shards x buckets rows, whatever the size of the table.
    return numbered.join(F.broadcast(before), ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
