"""Hierarchical weighted hash tree: documents descend regions, racks and shards.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the document's id
and the child's name, and the least draw wins. A child's chance is its share of the weight, a
draw changes only where a weight does, and so only subtrees with changed weights gain or lose.

Edge cases: a null ``doc_id`` is hashed like any value (all such rows share a shard); rows of equal
id share a shard and get slots of their own, by checksum and size; null text has size 0 + overhead;
texts of any length only add to size; extra columns are not read by ``shard_documents``, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rank_within, text_of

#: Parts a shard's rows are ranked in; a part holds 1/64 of a shard.
RANK_PARTS = 64
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    """A shard, where it stands, and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    """The tree, by its leaves."""

    leaves: tuple[Leaf, ...]

    @staticmethod
    def balanced(shards: int, shards_per_rack: int = 2, racks_per_region: int = 4) -> Topology:
        """Equal weights: shard s stands in rack s // 2, and four racks make a region."""
        return Topology(tuple(Leaf(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s) for s in range(shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own: no other subtree's weight changes, so rows move only into it."""
        last = self.leaves
        return Topology((*last, Leaf(max((x.region for x in last), default=-1) + 1, max((x.rack for x in last), default=-1) + 1, max((x.shard for x in last), default=-1) + 1, weight)))

    def children(self) -> tuple[dict[int, float], dict[int, dict[int, float]], dict[int, dict[int, float]]]:
        regions: dict[int, float] = {}
        racks: dict[int, dict[int, float]] = {}
        shards: dict[int, dict[int, float]] = {}
        for x in self.leaves:
            regions[x.region] = regions.get(x.region, 0.0) + x.weight
            of = racks.setdefault(x.region, {})
            of[x.rack] = of.get(x.rack, 0.0) + x.weight
            shards.setdefault(x.rack, {})[x.shard] = x.weight
        return regions, racks, shards


def _struct_array(nodes: Iterable[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(int(i)).alias("id"), F.lit(float(w)).alias("w")) for i, w in sorted(nodes)])


def _draw(key: Column, level: str, children: Column) -> Column:
    """The child of least draw; ties go to the lower id."""

    def one(child: Column) -> Column:
        bits = F.xxhash64(key, F.lit(level), child["id"]).bitwiseAND(F.lit((1 << 53) - 1))
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["w"]).alias("d"), child["id"].alias("id"))

    return F.array_min(F.transform(F.filter(children, lambda c: c["w"] > 0), one))["id"]


def place(key: Column, topology: Topology) -> Column:
    """A struct of region, rack and shard for the key."""
    regions, racks, shards = topology.children()
    by_region = F.create_map(*[x for r, of in sorted(racks.items()) for x in (F.lit(r), _struct_array(of.items()))])
    by_rack = F.create_map(*[x for r, of in sorted(shards.items()) for x in (F.lit(r), _struct_array(of.items()))])
    region = _draw(key, "region", _struct_array(regions.items()))
    rack = lambda r: _draw(key, "rack", F.element_at(by_region, r))
    # one-element transforms bind each level's winner once
    return F.transform(
        F.transform(F.transform(F.array(region), lambda r: F.struct(r.alias("region"), rack(r).alias("rack"))), lambda x: F.struct(x["region"].alias("region"), x["rack"].alias("rack"))),
        lambda x: F.struct(x["region"].alias("region"), x["rack"].alias("rack"), _draw(key, "shard", F.element_at(by_rack, x["rack"])).alias("shard")),
    )[0]


def assign(docs: DataFrame, topology: Topology, key: str = "doc_id") -> DataFrame:
    """``docs`` with region, rack, shard and grown_shard (the shard if the topology had one more)."""
    return docs.withColumn("_at", place(F.col(key), topology)).withColumn("grown_shard", place(F.col(key), topology.grown())["shard"]).select("*", F.col("_at.region").alias("region"), F.col("_at.rack").alias("rack"), F.col("_at.shard").alias("shard")).drop("_at")


def with_slots(assigned: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """A gapless slot from 0 in each shard, ranked in parts so that no task holds a shard. ``ties`` order and part rows of equal key."""
    salt = F.pmod(F.xxhash64(F.col(key), *ties, F.lit("slot")), F.lit(RANK_PARTS))
    return rank_within(assigned, ["shard"], [key, *ties], salt, "slot")


def write_shards(assigned: DataFrame, path: str) -> None:
    """The documents as one Parquet folder a shard; rows go straight from their tasks, without a shuffle."""
    assigned.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The digest of the contract: sizes, checksums, shard, slot and the shard after growth."""
    text = text_of(docs)
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    out = with_slots(assign(rows, Topology.balanced(shards)), ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
