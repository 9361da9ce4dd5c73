"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the fewest moved bytes.

The shards form a small network (old shards, new shards and one hub that every move passes), so the
flow is solved on shard totals alone. The rows follow it: an old shard is laid out in a repeatable
pseudorandom order, and the flow cuts that line of bytes into blocks, one for each target. Rows that
lie across a cut, at most one for each block, are dealt out afterwards, largest first, to the shard
that lacks most bytes.

Defined results: a null text counts as no bytes (a row still costs ROW_BYTES); repeated rows are rows of
their own; an empty table gives no rows; a null old shard is a shard like others; further columns are
not read. A shard's bytes differ from its capacity by no more than about one row.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import stored

from .common import numbered, text_bytes

ROW_BYTES = 8


@dataclass
class Network:
    """Arcs with capacity and cost; ``send`` finds a minimum-cost flow by successive cheapest paths."""

    n: int
    head: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.out = [[] for _ in range(self.n)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for tail, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[tail].append(len(self.head))
            self.head.append(to)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def send(self, source: int, sink: int) -> None:
        while True:
            best, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.head[e]
                    if self.room[e] and best[a] + self.cost[e] < best.get(b, 1 << 62):
                        best[b], via[b] = best[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if sink not in via:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.head[via[at] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def transfers(old: list[int], new: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of a flow that moves the fewest bytes; staying costs nothing.

    Shard i of the old layout and shard i of the new one are the same place. Capacities must add up to
    the sizes at least.
    """
    if sum(new) < sum(old):
        raise ValueError("the new shards hold less than the old ones have")
    n, m = len(old), len(new)
    source, hub, sink = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    for i, size in enumerate(old):
        net.arc(source, i, size, 0)
    stay = {i: net.arc(i, n + i, old[i], 0) for i in range(min(n, m))}
    leave = [net.arc(i, hub, old[i], 1) for i in range(n)]
    enter = [net.arc(hub, n + j, new[j], 0) for j in range(m)]
    for j, size in enumerate(new):
        net.arc(n + j, sink, size, 0)
    net.send(source, sink)
    sent = lambda e: net.room[e ^ 1]
    found = [(i, i, sent(e)) for i, e in stay.items() if sent(e)]
    gaps = deque((j, sent(e)) for j, e in enumerate(enter) if sent(e))
    for i, e in enumerate(leave):
        left = sent(e)
        while left:  # what passes the hub is handed on in order
            j, room = gaps.popleft()
            amount = min(left, room)
            found.append((i, j, amount))
            left -= amount
            if room > amount:
                gaps.appendleft((j, room - amount))
    return found


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class Plan:
    """``rows``: the input's rows with ``shard`` and ``slot``; ``moves``: the flow; ``affected``: shards to rewrite."""

    rows: DataFrame
    moves: list[tuple[int, int, int]]
    affected: list[int]


def reshard(rows: DataFrame, shards: int, capacities: list[int] | None = None) -> Plan:
    """Deals rows (with ``size`` bytes and ``old``, the name of their shard) to ``shards`` new shards.

    Old shards are numbered by name. What the driver holds is one number per shard and one row per block
    of the flow: at most old plus new shards. The rows themselves are read narrow, never collected.
    """
    spark = rows.sparkSession
    names = rows.columns
    staged = stored(rows, "reshard-rows")
    totals = {r["old"]: r["n"] for r in staged.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    old = sorted(totals, key=lambda x: (x is None, x or ""))
    sizes = [totals[x] for x in old]
    room = capacities or even(sum(sizes), shards)
    moves = transfers(sizes, room)
    blocks: dict[int, list[tuple[int, int]]] = {}
    for i, j, amount in sorted(moves, key=lambda x: (x[0], x[0] != x[1], x[1])):  # what stays comes first
        line = blocks.setdefault(i, [])
        line.append(((line[-1][0] if line else 0) + amount, j))
    cuts = spark.createDataFrame(
        [(old[i], line) for i, line in blocks.items()], f"cut_old {dict(staged.dtypes)['old']}, cuts array<struct<till: long, shard: int>>"
    )
    # at most one cut per block of the flow, that is old plus new shards
    placed = numbered(staged, ["old"], "size").drop("pos")
    cut = placed.join(F.broadcast(cuts), placed["old"].eqNullSafe(cuts["cut_old"])).withColumn("cut", F.expr("filter(cuts, x -> x.till > start)[0]"))
    dealt = stored(
        cut.select(*names, "start", F.col("cut.shard").alias("shard"), (F.col("start") + F.col("size") > F.col("cut.till")).alias("across")), "reshard-dealt"
    )
    full = {r["shard"]: r["n"] for r in dealt.where("not across").groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    lacks = [room[j] - full.get(j, 0) for j in range(len(room))]
    late = []
    for r in sorted(dealt.where("across").select("old", "start", "size").collect(), key=lambda r: (-r["size"], r["old"] or "", r["start"])):
        j = max(range(len(room)), key=lambda j: (lacks[j], -j))  # at most one row per block
        lacks[j] -= r["size"]
        late.append((r["old"], r["start"], j))
    placed_late = spark.createDataFrame(late, f"late_old {dict(staged.dtypes)['old']}, late_start long, late_shard int")
    at = dealt["old"].eqNullSafe(placed_late["late_old"]) & (dealt["start"] == placed_late["late_start"]) & dealt["across"]
    final = dealt.join(F.broadcast(placed_late), at, "left").select(*names, F.coalesce("late_shard", "shard").alias("shard"))
    final = numbered(stored(final, "reshard-final"), ["shard"]).drop("start").withColumnRenamed("pos", "slot")
    changed = {x for i, j, _ in moves if i != j for x in (i, j) if x < shards} | {j for _, _, j in late}
    return Plan(final, moves, sorted(changed))


def shard_rows(docs: DataFrame, old: str) -> DataFrame:
    """The narrow rows that ``reshard`` deals: id, bytes, checksum of the text, old shard."""
    text = text_bytes()
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(old).alias("old"))


def rewrite(docs: DataFrame, plan: Plan, path: str, per_file: int = 64) -> None:
    """Writes the affected shards with whole rows under ``path``/shard=N; the other shards' files stay as they are.

    Rows meet their shard by id and checksum; equal rows are told apart by their number. Columns named shard and
    slot are replaced.
    """
    text = text_bytes()
    order = ["doc_id", "text_crc32"]
    nth = lambda by: F.row_number().over(W.partitionBy(*order).orderBy(by))
    held = [c for c in docs.columns if c not in ("shard", "slot")]
    full = docs.select(F.struct(*held).alias("row"), "doc_id", F.crc32(text).alias("text_crc32"))
    full = full.withColumn("nth", nth(F.col("text_crc32")))
    narrow = plan.rows.select(*order, "shard", "slot").withColumn("nth", nth(F.struct("shard", "slot")))
    narrow = narrow.where(F.col("shard").isin(plan.affected)) if plan.affected else narrow.limit(0)
    meet = [full[k].eqNullSafe(narrow[k]) for k in [*order, "nth"]]
    out = full.join(narrow, meet).select("row.*", "shard", "slot")
    part = F.pmod(F.xxhash64("shard", "slot"), F.lit(per_file))
    out.repartition("shard", part).sortWithinPartitions("shard", "slot").write.mode("append").partitionBy("shard").parquet(path)
