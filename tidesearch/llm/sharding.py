"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, each by a weighted hash draw.

At every node the children race: child ``c`` of weight ``w`` arrives at ``-ln(u) / w`` where ``u`` is a hash of the key and
the child, and the first to arrive gets the row.  A child wins in proportion to its weight, and changing one weight
only moves rows into or out of that child, so movement stays in the subtrees whose weights change.

A shard that joins later comes as a region of its own (``layout``): the draw at the root then takes rows from every
region in proportion and gives them to nobody else.  Rows that keep their region keep rack and shard.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesearch.llm.shared import gapless_rank, unit_hash

#: region -> rack -> shard -> weight
Tree = Mapping[int, Mapping[int, Mapping[int, float]]]


def layout(shards: int, base: int = 24, per_rack: int = 4, racks: int = 2) -> Tree:
    """The tree over shards 0 to ``shards - 1`` of weight 1.

    The first ``base`` shards fill regions of ``racks`` racks of ``per_rack`` shards; each further shard is a region with
    one rack.  The place of a shard depends on its number alone, so a longer layout extends a shorter one.
    """
    tree: dict[int, dict[int, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // per_rack if s < base else -(-base // per_rack) + s - base
        region = s // (per_rack * racks) if s < base else -(-base // (per_rack * racks)) + s - base
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, level: str, weights: Mapping[int, float]) -> Column:
    """The child that wins the weighted race; ties go to the smaller number."""
    live = {c: w for c, w in weights.items() if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    arrivals = [F.struct((-F.log(unit_hash(key, F.lit(level), F.lit(c))) / F.lit(float(w))).alias("at"), F.lit(c).alias("child")) for c, w in sorted(live.items())]
    return F.array_min(F.array(*arrivals))["child"]


def _case(on: Column, branches: Mapping[int, Column]) -> Column:
    if len(branches) == 1:
        return next(iter(branches.values()))
    first, *rest = branches.items()
    return reduce(lambda c, x: c.when(on == x[0], x[1]), rest, F.when(on == first[0], first[1]))


def place(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Adds ``name``, the shard of each row.  The key and the tree decide alone; a null key is a key like any other."""
    k = F.col(key)
    shard_weight = {g: {r: sum(s.values()) for r, s in racks.items()} for g, racks in tree.items()}
    region = _draw(k, "region", {g: sum(r.values()) for g, r in shard_weight.items()})
    df = df.withColumn("_region", region)
    df = df.withColumn("_rack", _case(F.col("_region"), {g: _draw(k, "rack", w) for g, w in shard_weight.items()}))
    shards = {r: s for racks in tree.values() for r, s in racks.items()}
    return df.withColumn(name, _case(F.col("_rack"), {r: _draw(k, "shard", s) for r, s in shards.items()}).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard, its slot there and the shard it would have with one more shard.

    Columns: key, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32, law (``key``), shard, slot (gapless
    from 0 in each shard), grown_shard.  Repeated rows go to one shard and get a slot each.  An empty table gives an empty
    result.  Other columns are dropped first, so clashing names do no harm.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    placed = place(place(rows, key, layout(shards), "shard"), key, layout(shards + 1), "grown_shard")
    # Rows with one key (or none) but different texts are ranked in different tasks.
    ranked = gapless_rank(placed, ["shard"], [key, "size", "text_crc32"], "slot")
    return ranked.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
