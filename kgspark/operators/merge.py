"""Keyed upserts as aggregations.

A node write sets some properties of one key. The merged node holds, per property, the value
of the last write that mentions it; a null in that write removes the property, and a property
no later write mentions survives. ``max_by`` says exactly this: it takes the value of the
greatest order, null included, and skips rows whose order is null. It aggregates map-side,
so a key that a third of all rows write to leaves every task as one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EDGE_COLUMNS

ORDER = "_order"


def mentions_of(names: list[str], all_names: list[str]) -> int:
    """Which of the properties are mentioned, as a number with one bit for each."""
    return sum(1 << i for i, name in enumerate(all_names) if name in names)


def merge_writers(
    writers: list[DataFrame], key: str, order: str = ORDER, mentioned: str | None = None, all_names: list[str] | None = None
) -> DataFrame:
    """Merge node writes into one row per key.

    Each writer is a frame of writes that mention the same properties: its columns are the
    key, the order and those properties. Writers may differ in what they mention. With
    ``mentioned`` a column of that name says which of ``all_names`` any write of the key mentions.
    """
    for writer in writers:
        if key not in writer.columns:
            raise ValueError(f"the key {key!r} is not among the written columns {writer.columns}")
    mentions: dict[str, tuple[int, ...]] = {}
    for number, writer in enumerate(writers):
        for name in writer.columns:
            if name not in (key, order):
                mentions[name] = (*mentions.get(name, ()), number)
    if not mentions:
        # nothing but the key is written: no order to respect
        keys = [writer.select(key) for writer in writers]
        found = reduce(DataFrame.union, keys).filter(F.col(key).isNotNull()).distinct()
        return found.withColumn(mentioned, F.lit(0).cast("long")) if mentioned else found

    # properties mentioned by the same writers share one max_by
    groups: dict[tuple[int, ...], list[str]] = {}
    for name, numbers in mentions.items():
        groups.setdefault(numbers, []).append(name)
    tagged = [writer.withColumn("_writer", F.lit(number)) for number, writer in enumerate(writers)]
    writes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

    def last(numbers: tuple[int, ...], names: list[str]) -> Column:
        at = F.col(order)
        if len(numbers) < len(writers):
            at = F.when(F.col("_writer").isin(*numbers), at)
        return F.max_by(F.struct(*names), at)

    said = []
    if mentioned:
        bits = F.array(*[F.lit(mentions_of(writer.columns, all_names)).cast("long") for writer in writers])
        said = [F.bit_or(F.get(bits, F.col("_writer"))).alias(mentioned)]
    merged = (
        writes.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[last(*group).alias(f"_g{i}") for i, group in enumerate(groups.items())], *said)
    )
    place = {name: i for i, names in enumerate(groups.values()) for name in names}
    return merged.select(key, *[F.col(f"_g{place[name]}")[name].alias(name) for name in mentions], *([mentioned] if mentioned else []))


def merge_property_maps(writes: DataFrame, keys: list[str], order: str = ORDER, props: str = "props") -> DataFrame:
    """The same merge for writes whose properties are a map and may mention any set of names.

    Writes are first cut to the last one per key and set of names, which is all that can
    still matter; what remains is merged property by property.
    """
    shape = F.array_join(F.array_sort(F.map_keys(props)), "\x1f")
    latest = (
        writes.withColumn("_shape", F.coalesce(shape, F.lit("")))
        .groupBy(*keys, "_shape")
        .agg(F.max_by(F.struct(order, props), F.col(order)).alias("_last"))
    )
    named = latest.select(*keys, f"_last.{order}", F.explode_outer(f"_last.{props}").alias("_name", "_value"))
    values = named.groupBy(*keys, "_name").agg(F.max_by("_value", order).alias("_value"))
    # one entry per property name: as large as the merged node itself
    entries = F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_name", "_value")))
    return values.groupBy(*keys).agg(F.map_from_entries(entries).alias(props))


def distinct_edges(edges: list[DataFrame]) -> DataFrame:
    """One edge per (source, type, target)."""
    return reduce(DataFrame.union, [frame.select(*EDGE_COLUMNS) for frame in edges]).distinct()


def merge_edges(writes: DataFrame, order: str = ORDER, props: str = "props") -> DataFrame:
    """Edge writes with a map of properties, merged per (source, type, target) and property like those of nodes."""
    return merge_property_maps(writes, EDGE_COLUMNS, order, props)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source and target exist; the others are silently left out.

    ``nodes`` needs the columns label and pk. Edges are made distinct first. A hub that most
    edges point at makes one join partition large; adaptive skew handling splits it, as the
    node side holds one row per key.
    """
    known = nodes.select("label", "pk")
    kept = edges
    for side in ("src", "dst"):
        ends = known.select(F.col("label").alias(f"{side}_label"), F.col("pk").alias(f"{side}_key"))
        kept = kept.join(ends, [f"{side}_label", f"{side}_key"], "left_semi")
    return kept


def update_matching(nodes: DataFrame, updates: DataFrame, key: str, order: str = ORDER) -> DataFrame:
    """Set columns on nodes that exist; an update for an unknown key does nothing.

    The last update per key wins, and a null in it removes the value.
    """
    names = [name for name in updates.columns if name not in (key, order)]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_set"))
    joined = nodes.join(last, key, "left")
    columns = [
        F.when(F.col("_set").isNotNull(), F.col("_set")[name])
        .otherwise(F.col(name) if name in nodes.columns else F.lit(None))
        .alias(name)
        for name in names
    ]
    rest = [name for name in nodes.columns if name not in names]
    return joined.select(*rest, *columns)


def not_loaded(records: DataFrame, existing: DataFrame, key: str, existing_key: str | None = None) -> DataFrame:
    """Records whose key no existing node has."""
    known = existing.select(F.col(existing_key or key).alias(key))
    return records.join(known, key, "left_anti")
