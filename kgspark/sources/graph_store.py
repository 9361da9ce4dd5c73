"""Graph tables on a shared file system.

A load writes only what it changes: its merged writes, as a partition ``load=<number>-<id>`` of the table of each
label and of the edges. It counts once the empty file ``<root>/finished/<number>-<id>`` is there; a load that dies
leaves partitions that no such name vouches for, and nothing is ever replaced or half written. A node is read as
the merge of its rows in the finished loads, property by property: the last load that mentions one wins. Tables are
bucketed by key, so neither this merge nor a join with new records shuffles what is stored. A reset is a name too:
loads before it count no more.

Each load also leaves a small profile of what it wrote, so the catalog of a graph never scans the graph.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import limited, result_within_budget
from ..operators.merge import distinct_edges, mentions_of, merge_edges
from ..schemas import EDGE_COLUMNS, EDGE_SCHEMA, LABELS, label_schema

NODE_COLUMNS = ["label", "pk", "props"]
MENTIONED = "_mentioned"
BUCKETS = 8  # at least
BYTES_PER_BUCKET = 128 * 1024 * 1024
_PROFILE = "label string, key string, type string, n long, least string, sample string"
_MAPPING = "src_label string, rel_type string, dst_label string, n long"
_EDGE_TABLE = f"{EDGE_SCHEMA}, props map<string,string>"


@dataclass
class Load:
    """A load under way: its number once published and the name its partitions carry."""

    number: int
    name: str


def buckets_for(size: int) -> int:
    """The buckets of a graph whose first load reads so many bytes of text."""
    return max(BUCKETS, math.ceil(size / BYTES_PER_BUCKET))


def folder_names(store: GraphStore, part: str) -> list[str]:
    """Names of what lies in a folder below the store's root."""
    found = store.files().globStatus(store.path(f"{store.root}/{part}/*")) or []
    return [f.getPath().getName() for f in found]


class GraphStore:
    """``buckets`` is for a graph that is made now: how many files each load writes of a table, and how many
    tasks read a table. Without it the first load from files decides by their size (``expect``). A graph that exists
    keeps the number it was made with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._asked = buckets
        self.buckets = self._made() or buckets or BUCKETS
        self._known: dict[str, set[str]] = {}

    def path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def files(self):
        return self.path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _made(self) -> int | None:
        """The number of buckets the graph was made with; of several that loads tried, the one of a finished load."""
        found = self.files().globStatus(self.path(f"{self.root}/buckets-*")) or []
        tried = sorted(int(f.getPath().getName().removeprefix("buckets-")) for f in found)
        if len(tried) < 2:
            return tried[0] if tried else None
        done = {f"load={name}" for name in self._names()}
        lying = lambda n: {*folder_names(self, f"buckets-{n}/edges"), *folder_names(self, f"buckets-{n}/nodes/*")}
        return next((n for n in tried if done & lying(n)), tried[0])

    def expect(self, path) -> None:
        """Before a graph is loaded from files: if it is new, their size decides how many buckets it gets.

        A task that writes or reads a bucket then holds about as much of a large graph as of a small one.
        """
        if self._asked is None and self._made() is None:
            size = 0
            for place in [path] if isinstance(path, str) else path:
                files = self.path(place).getFileSystem(self.spark._jsc.hadoopConfiguration())
                size += sum(files.getContentSummary(f.getPath()).getLength() for f in files.globStatus(self.path(place)) or [])
            self.buckets = buckets_for(size)
            self.files().mkdirs(self.path(f"{self.root}/buckets-{self.buckets}"))
        self.buckets = self._made() or self.buckets

    # --- loads ---------------------------------------------------------------------------------------

    def _names(self) -> list[str]:
        """Names of finished loads and resets, in order."""
        return sorted(folder_names(self, "finished"))

    def snapshot(self) -> int:
        """Number of the newest finished load, 0 if there is none."""
        return max((int(name.split("-")[0]) for name in self._names()), default=0)

    def finished(self) -> list[str]:
        """The loads that count: those after the last reset."""
        names = self._names()
        resets = [i for i, name in enumerate(names) if name.endswith("-reset")]
        return names[resets[-1] + 1 :] if resets else names

    def begin(self) -> Load:
        """A load on top of the newest finished one."""
        number = self.snapshot() + 1
        self.buckets = self._made() or self.buckets
        return Load(number, f"{number:012d}-{uuid.uuid4().hex[:16]}")

    def _finish(self, number: int, name: str) -> None:
        if any(int(other.split("-")[0]) == number for other in self._names()):
            raise RuntimeError(f"another load was published as number {number}; run this one again")
        self.files().create(self.path(f"{self.root}/finished/{name}"), True).close()

    def publish(self, load: Load) -> None:
        """Make a load count. One that began from an older graph is refused.

        Should two slip through at the same moment both count, in the order of their names: each is
        whole, and neither replaces the other's rows.
        """
        if self._made() not in (None, self.buckets):
            raise RuntimeError("another load made this graph with other buckets; run this one again")
        self._finish(load.number, load.name)

    def reset(self) -> None:
        """Empty the graph: no earlier load counts any more."""
        number = self.snapshot() + 1
        self._finish(number, f"{number:012d}-reset")

    # --- tables --------------------------------------------------------------------------------------

    def _folder(self, part: str) -> str:
        return f"{self.root}/buckets-{self.buckets}/{part}"

    def _bucketed(self, by: list[str]) -> str:
        keys = ", ".join(f"`{c}`" for c in by)
        return f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS"

    def _write(self, part: str, rows: DataFrame, schema: str, by: list[str], load: Load) -> None:
        """One partition of a table. A table of its own takes the rows, so that loads at the same time never meet."""
        name = f"kgspark_write_{uuid.uuid4().hex}"
        place = f"{self._folder(part)}/load={load.name}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet {self._bucketed(by)} LOCATION '{place}'")
        try:
            rows.write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _read(self, part: str, schema: str, by: list[str]) -> tuple[DataFrame, int]:
        """The rows of all finished loads, with ``load``, and how many loads have any."""
        there = {name.removeprefix("load=") for name in folder_names(self, f"buckets-{self.buckets}/{part}")}
        loads = [name for name in self.finished() if name in there]
        if not loads:
            return self.spark.createDataFrame([], f"{schema}, load string"), 0
        name = f"kgspark_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_{part.replace('/', '_').lower()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}, load STRING) USING parquet PARTITIONED BY (load) "
            f"{self._bucketed(by)} LOCATION '{self._folder(part)}'"
        )
        fresh = [x for x in loads if x not in self._known.get(part, set())]
        if fresh:
            partitions = " ".join(f"PARTITION (load='{x}')" for x in fresh)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {partitions}")
            self._known.setdefault(part, set()).update(fresh)
        return self.spark.table(name).where(F.col("load").isin(loads)), len(loads)

    def _node_schema(self, label: str) -> str:
        return f"{label_schema(label)}, {MENTIONED} long"

    def nodes(self, label: str) -> DataFrame:
        """The nodes of one label: its key and its properties as columns."""
        key, props = LABELS[label]
        rows, loads = self._read(f"nodes/{label}", self._node_schema(label), [key])
        if loads < 2:
            return rows.select(key, *props)
        if not props:
            return rows.select(key).distinct()

        def last(i: int, name: str) -> Column:
            said = F.col(MENTIONED).bitwiseAND(F.lit(1 << i)) != 0
            return F.max_by(name, F.when(said, F.col("load"))).alias(name)

        return rows.groupBy(key).agg(*[last(i, name) for i, name in enumerate(props)])

    def _edge_rows(self) -> tuple[DataFrame, int]:
        return self._read("edges", _EDGE_TABLE, ["src_key", "dst_key"])

    def edges(self) -> DataFrame:
        rows, loads = self._edge_rows()
        return rows.select(*EDGE_COLUMNS) if loads < 2 else distinct_edges([rows])

    def edges_with_props(self) -> DataFrame:
        """Edges with the map of their properties, merged over loads like those of nodes."""
        rows, loads = self._edge_rows()
        filled = rows.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
        return filled.select(*EDGE_COLUMNS, "props") if loads < 2 else merge_edges(filled, order="load")

    def all_nodes(self) -> DataFrame:
        """All nodes in one form: label, pk and a map of the properties that are set."""
        return reduce(DataFrame.union, [as_property_maps(self.nodes(label), label, LABELS[label][0]) for label in LABELS])

    def write_edges(self, edges: DataFrame, load: Load) -> None:
        """The edges of a load, distinct; ``props`` (a map) if there are any properties."""
        props = F.col("props") if "props" in edges.columns else F.lit(None)
        rows = edges.select(*EDGE_COLUMNS, props.cast("map<string,string>").alias("props"))
        self._write("edges", rows.repartition(self.buckets, "src_key", "dst_key"), _EDGE_TABLE, ["src_key", "dst_key"], load)
        # the edges of this load alone are read again: as many rows as there are kinds of edges come out
        own = self.spark.read.schema(_EDGE_TABLE).parquet(f"{self._folder('edges')}/load={load.name}")
        mappings = own.groupBy("src_label", "rel_type", "dst_label").agg(F.count(F.lit(1)).alias("n"))
        mappings.coalesce(1).write.parquet(f"{self.root}/mappings/load={load.name}")
        named = own.select("rel_type", F.struct(*EDGE_COLUMNS).alias("at"), F.explode("props").alias("key", "value")).where("value IS NOT NULL")
        least = F.min(F.struct(F.to_json("at").alias("at"), "value")).alias("l")
        counted = named.groupBy("rel_type", "key").agg(F.count(F.lit(1)).alias("n"), least)
        profile = counted.select(F.col("rel_type").alias("label"), "key", F.lit("STRING").alias("type"), "n", F.col("l.at").alias("least"), F.col("l.value").alias("sample"))
        profile.coalesce(1).write.parquet(f"{self.root}/edge-profiles/load={load.name}")

    def write_nodes(self, label: str, nodes: DataFrame, load: Load) -> None:
        """The merged writes of one label, a row for each key.

        Properties that are no column stay as they are in the graph; a column ``_mentioned`` says
        which of the others each row mentions, all if there is none.
        """
        key, props = LABELS[label]
        missing = [F.lit(None).cast("string").alias(p) for p in props if p not in nodes.columns]
        said = F.col(MENTIONED) if MENTIONED in nodes.columns else F.lit(mentions_of(nodes.columns, props)).cast("long")
        whole = nodes.select("*", *missing).select(key, *props, said.alias(MENTIONED)).repartition(self.buckets, key)
        # counts and samples are taken as the rows pass by
        seen = Observation()
        metrics = []
        for i, name in enumerate([key, *props]):
            at = F.when(F.col(name).isNotNull(), F.col(key))
            metrics += [F.count(name).alias(f"n{i}"), F.min(at).alias(f"l{i}"), F.min_by(name, at).alias(f"s{i}")]
        self._write(f"nodes/{label}", whole.observe(seen, *metrics), self._node_schema(label), [key], load)
        found = seen.get
        rows = [(label, name, "STRING", found[f"n{i}"], found[f"l{i}"], found[f"s{i}"]) for i, name in enumerate([key, *props]) if found.get(f"n{i}")]
        self.spark.createDataFrame(rows, _PROFILE).coalesce(1).write.parquet(f"{self.root}/profiles/load={load.name}/{label}")

    # --- catalog -------------------------------------------------------------------------------------

    def _small(self, part: str, schema: str, below: str = "") -> DataFrame:
        """A table of profiles: a few rows for each finished load, with ``load``."""
        there = {name.removeprefix("load=") for name in folder_names(self, part)}
        frames = [
            self.spark.read.schema(schema).parquet(f"{self.root}/{part}/load={name}{below}").withColumn("load", F.lit(name))
            for name in self.finished()
            if name in there
        ]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{schema}, load string")

    def load_report(self) -> DataFrame:
        """What each load wrote: (load, label, n) with the rows of each label that it touched."""
        keys = self.spark.createDataFrame([(label, key) for label, (key, _) in LABELS.items()], "label string, key string")
        return self._small("profiles", _PROFILE, "/*").join(keys, ["label", "key"]).select("load", "label", "n")

    def node_properties(self) -> DataFrame:
        """(label, key, type, sample) of all properties that nodes have been given.

        The sample is what the last load wrote for the smallest node key that has been given one.
        """
        return _merged_profiles(self._small("profiles", _PROFILE, "/*"))

    def edge_properties(self) -> DataFrame:
        """The same for edges: (rel_type, key, type, sample)."""
        return _merged_profiles(self._small("edge-profiles", _PROFILE)).withColumnRenamed("label", "rel_type")

    def edge_mappings(self) -> DataFrame:
        """Distinct (src_label, rel_type, dst_label) of all edges."""
        return self._small("mappings", _MAPPING).select("src_label", "rel_type", "dst_label").distinct()

    def register_views(self) -> None:
        """Every label as a view of its name, and ``edges``, for use in SQL text."""
        for label in LABELS:
            self.nodes(label).createOrReplaceTempView(label)
        self.edges().createOrReplaceTempView("edges")


def _merged_profiles(rows: DataFrame) -> DataFrame:
    """States of loads combined: counts, and the sample at the least key (of the last load that has it)."""
    least = rows.groupBy("label", "key", "type", "least").agg(F.max_by("sample", "load").alias("sample"))
    return least.groupBy("label", "key", "type").agg(F.min_by("sample", "least").alias("sample"))


def as_property_maps(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """A typed node table as (label, pk, props); unset properties are not in the map."""
    entries = [F.struct(F.lit(name), F.col(name).cast("string")) for name in nodes.columns]
    props = F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, value: value.isNotNull())
    return nodes.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("pk"), props.alias("props"))


def run_query(
    spark: SparkSession, text: str, parameters: dict | None = None, limit: int | None = None, budget: int | None = None
) -> DataFrame:
    """SQL text with named parameters (``:name``).

    A positive int ``limit`` applies unless the text has a limit of its own. With ``budget``
    the result is cut where its JSON passes so many characters.
    """
    try:
        rows = spark.sql(text.rstrip().rstrip(";"), args=parameters or {})
    except Exception as error:
        raise RuntimeError(f"query failed: {error}") from error
    if " LIMIT " not in text.upper():
        rows = limited(rows, limit)
    return rows if budget is None else result_within_budget(rows, budget)


def fetch(spark: SparkSession, text: str, parameters: dict | None = None, limit: int = 1000, budget: int | None = None) -> list[dict]:
    """The rows of ``run_query`` themselves, at most ``limit`` of them.

    An error while the query runs is raised like one in its text.
    """
    rows = run_query(spark, text, parameters, None, budget).limit(limit)
    try:
        return [row.asDict(recursive=True) for row in rows.collect()]
    except Exception as error:
        raise RuntimeError(f"query failed: {error}") from error
