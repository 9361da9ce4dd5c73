"""Similarity join of shingle sets by Jaccard with set-relation skipping.

Index lists. Sets of a size class are cut into parts by a hash of the shingle, a few more parts than
linked sets can have differences; hence two linked sets agree in one of their first parts. Each set is
listed under those parts alone: list entries at later positions cannot hold a link that an earlier one does
not, and are skipped for its size. A list is keyed by size class, position and content of a part, so a
passage that many documents share makes no list by itself. Long lists are cut into blocks: in the steps below
each set meets a block dealt at random and the list's first set, and at the end blocks meet block against block,
but for those whose sets are connected already.

Answers from answers. Equal sets fold to one. In STEPS steps every set is compared with one other, the one
with the closest bit sketch in its lists that it is not connected with yet; the first of these is its pivot.
For components, sets that are connected need no comparison, and of two sets with the same pivot, distances to
it that lie too far apart rule a link out. The last step compares all pairs that are left open by that and by
their sketches, so no link between different components is lost. All links then lie inside components, which
are cut into blocks that meet block against block: a block's distances to one of its sets settle those links
that the triangle inequality settles, and shared shingles are counted for the rest (``answers``).

Sizes and distances: a pair with sizes a and b links at similarity t if and only if the number of
shingles in one of them alone is at most (1 - t) / (1 + t) of a + b.

Defined results: a null or empty text has no shingles and no link, and is its own component; a document of
fewer words than a shingle has one; rows with a null doc_id take no part and get a null component; repeated
rows have equal results; an empty table gives no rows; further columns are not read. ``n_links`` counts
the other pairs of a document and a text, each once, that link with the row's text, exact copies included; it is
null where doc_id is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.session import Staging, bounded_batches, release_shuffles, stored

from .common import flat, mixed, rows_of
from .components import components

WIDTH = 3
CACHE = 500_000
SKETCH = 256  # bytes; two sets differ in no fewer shingles than their sketches do in bits
STEPS = 2
LIST = 512  # entries of a list that are compared with each other in one task; longer lists are cut into blocks
BLOCK = 256  # sets of a component that meet another such block in one task; bounds a task, loses no pair
PASSES = 2  # over the lists of more than FEW entries: the shuffles of one pass lie on disk at a time
FEW = 1_000_000
SENT = 1.0  # pairs for each set that are measured at a time
WORDS: dict[bytes, int] = {}


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``width`` words link when ``den`` * shared >= ``num`` * united."""

    num: int = 90
    den: int = 100
    width: int = WIDTH

    def apart(self, total):
        """The most shingles that linked sets with ``total`` shingles together can have in one of them alone."""
        return total * (self.den - self.num) // (self.den + self.num)

    def largest(self, size):
        """The most shingles of a set linked with one of ``size``."""
        return size * self.den // self.num


def size_bounds() -> np.ndarray:
    """The least size of each class: half as much again as that of the class before."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, found[-1] * 3 // 2))
    return np.array(found, np.int64)


BOUNDS = size_bounds()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    found, at = list(map(WORDS.get, words)), -1
    for _ in range(found.count(None)):
        at = found.index(None, at + 1)
        if len(WORDS) >= CACHE:
            WORDS.clear()
        found[at] = WORDS[words[at]] = xxhash.xxh3_64_intdigest(words[at])
    return np.array(found, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The text's set as ascending 64-bit hashes."""
    words = word_hashes(text)
    if not len(words):
        return words
    wide = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - wide + 1, np.uint64(wide))
        for k in range(wide):
            out = mixed(out + words[k : k + len(out)])
    out = np.sort(out)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_id(own: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(own ^ np.uint64(0x51D7)).sum(dtype=np.uint64).view(np.int64))


def listed(own: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Keys of the lists that hold the set: of its own class, and of the class below if a partner may be there."""
    n = len(own)
    home = int(np.searchsorted(BOUNDS, n, "right")) - 1
    found = []
    for c in (home, home - 1):
        if c < 0:
            break
        top = int(BOUNDS[c + 1]) - 1
        if c < home and rule.largest(top) < n:
            break
        need = int(rule.apart(n + (rule.largest(n) if c == home else min(n, top)))) + 1
        if need == 1:
            continue  # equal sets alone, which are folded
        most = int(rule.apart(top + rule.largest(top))) + 1
        parts = most + max(2, most // 8)
        with np.errstate(over="ignore"):
            spread = mixed(own + np.uint64(2 * c + 1))
            part = (spread % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, value = part[order], mixed(spread[order] ^ np.uint64(0xA5A5))
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            place, total = part[first], np.add.reduceat(value, first)
            if len(place) < need:  # too few parts have shingles: agreeing on none counts too
                rest = np.setdiff1d(np.arange(parts), place)
                place, total = np.append(place, rest), np.append(total, np.zeros(len(rest), np.uint64))
            place, total = place[:need], total[:need]
            found.append(mixed(total ^ mixed((np.uint64(c) << np.uint64(40)) + place.astype(np.uint64) + np.uint64(1))))
    return found


def list_columns(passes: int) -> list[str]:
    return [f"lists{k}" for k in range(passes)]


def index(rule: Rule, passes: int):
    """doc_id, n, sid (null without shingles), lists of each pass: of a slice's copies the first names the lists."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in rows_of(batch):
                docs, sizes, ids, keys, seen = [], [], [], [], set()
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = shingles(text, rule.width)
                    sid = set_id(own) if len(own) else None
                    fresh = [] if sid is None or doc is None or sid in seen else listed(own, rule)
                    if doc is not None:  # rows without an id are left out later, and their lists with them
                        seen.add(sid)
                    key = flat(fresh, np.uint64).view(np.int64)
                    docs.append(doc), sizes.append(len(own)), ids.append(sid), keys.append(key)
                lists = []
                for k in range(passes):
                    own = [key[key % passes == k] for key in keys]
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(flat(own))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), *lists], names=["doc_id", "n", "sid", *list_columns(passes)]
                )

    return run


def whole_sets(rule: Rule):
    """sid, n, the set's hashes, and a sketch: one bit for each remainder of the hash, flipped by every shingle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows:
            for part in rows_of(batch, 128):
                ids, found, sketches = [], [], []
                for sid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = shingles(text, rule.width)
                    if sid in seen or sid != set_id(own):  # a row that repeats another's id, with the same or another text
                        continue
                    seen.add(sid)
                    ids.append(sid)
                    found.append(own)
                    odd = np.bincount((own % np.uint64(8 * SKETCH)).astype(np.int64), minlength=8 * SKETCH) & 1
                    sketches.append(np.packbits(odd.astype(bool)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(sketches, pa.binary())],
                    names=["sid", "n", "own", "sketch"],
                )

    return run


def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, apart: the number of shingles in one of the two sets alone."""
    for batch in rows:
        for part in rows_of(batch, 256):
            apart = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                apart.append(len(both) - 2 * int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(apart, pa.int64())], names=["a", "b", "apart"])


def open_pairs(rule: Rule, nearest: bool):
    """Pairs within ``met``, a list or two of its blocks, that are not connected and that neither size, pivot nor sketch rules out.

    Of two blocks, sets of different ``side`` alone make pairs; in a list or a single block it is below 0.

    With ``nearest``, for each set the one with the closest sketch, else all. ``far`` is the sketches' distance.
    """

    def run(group: pa.Table) -> pa.Table:
        key, side, sid, n, home, pivot, d = (group.column(c).to_numpy() for c in ("met", "side", "sid", "n", "home", "pivot", "apart"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 8)
        order = np.lexsort((n, key))
        key, side, sid, n, home, pivot, d, sketch = (x[order] for x in (key, side, sid, n, home, pivot, d, sketch))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
        at, found, step = np.arange(len(key)), [], 0
        best, least = np.zeros(len(key), np.int64), np.full(len(key), 1 << 40)
        while len(at):
            step += 1
            at = at[at + step < ends[at]]
            at = at[n[at + step] <= rule.largest(n[at])]  # sizes ascend: what is too large stays so
            i, j = at, at + step
            ok = (home[i] != home[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            limit = rule.apart(n[i] + n[j])
            ok = (pivot[i] != pivot[j]) | (np.abs(d[i] - d[j]) <= limit)
            i, j, limit = i[ok], j[ok], limit[ok]
            far = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
            ok = far <= limit
            i, j, far = i[ok], j[ok], far[ok]
            if nearest:
                for x, y in ((i, j), (j, i)):  # in one step a row stands on a side once
                    closer = far < least[x]
                    best[x[closer]], least[x[closer]] = sid[y[closer]], far[closer]
            elif len(i):
                found.append(np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), far], 1), axis=0))
        if nearest:
            has = np.flatnonzero(least < 1 << 40)
            has = has[np.lexsort((best[has], least[has], sid[has]))]
            has = has[np.concatenate([[True], sid[has][1:] != sid[has][:-1]])[: len(has)]]
            pairs = np.stack([sid[has], best[has], least[has]], 1)
        else:
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "far": pa.array(pairs[:, 2])})

    return run


@dataclass
class Joined:
    """``documents``: doc_id, n_shingles, sid; ``links``: a, b (sids), apart: those that components need; ``members``: sid, component.

    ``whole``: sid, n, own of all sets that can link; its table is ``kept``, for ``answers``.
    """

    documents: DataFrame
    links: DataFrame
    members: DataFrame
    whole: DataFrame
    kept: Staging


def dealt(long: DataFrame, step: int) -> DataFrame:
    """met, side and the set, of lists with ``total`` entries: each in a block dealt at random, anew in every step."""
    block = F.pmod(F.xxhash64("sid", "list", F.lit(step)), F.ceil(F.col("total") / LIST))
    return long.select(F.xxhash64("list", block, F.lit(step)).alias("met"), F.lit(-1).alias("side"), "sid", "n", "home")


def firsts(long: DataFrame) -> DataFrame:
    """a, b: each set of a long list, and the first set of its long lists where that is not connected with it."""
    first = long.groupBy("list").agg(F.min(F.struct("sid", "home")).alias("first"))
    least = long.join(first, "list").groupBy("sid", "home").agg(F.min("first").alias("first"))
    return least.where("home <> first.home").select(F.col("sid").alias("a"), F.col("first.sid").alias("b"))


def shared_lists(sets: DataFrame, passes: list[list[str]]) -> tuple[DataFrame, list[str]]:
    """list, sid, n: the entries of lists that hold two sets at least, and where they lie.

    Most lists hold one set, and their entries are the largest shuffles of all; hence lists are dealt into passes,
    each over columns of its own.
    """
    spark = sets.sparkSession
    known, found = sets.where("doc_id is not null and sid is not null"), Staging(spark)
    for names in passes:
        own = known.select(F.explode(F.concat(*names)).alias("list"), "sid", "n")
        shared = own.groupBy("list").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first <> last").select("list")
        found.stored(own.join(shared, "list").select("list", "sid", "n"), "set-shared-lists")
        del own, shared
        if len(passes) > 1:
            release_shuffles(spark)
    return spark.read.schema("list long, sid long, n long").parquet(*found.paths), found.paths


def against(long: DataFrame, staging: Staging | None = None) -> DataFrame:
    """met, side and the set: blocks of a list against its blocks, but for two with one home. A home with many entries has blocks of its own."""
    staging = staging or Staging(long.sparkSession)
    homes = long.groupBy("list", "home").agg(F.count(F.lit(1)).alias("times"))
    homes = homes.withColumn("own", F.when(F.col("times") > LIST // 2, F.col("home")))
    others = homes.where("own is null").groupBy("list").agg(F.sum("times").alias("rest"))
    cut = long.join(homes, ["list", "home"]).join(others, "list", "left")
    part = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("home"), F.ceil(F.col("rest") / LIST))).otherwise(F.pmod(F.xxhash64("sid"), F.ceil(F.col("times") / LIST)))
    cut = staging.stored(cut.select("list", "sid", "n", "home", "own", F.xxhash64(F.coalesce("own", F.lit(0)), F.col("own").isNull(), part).alias("block")), "set-list-blocks")
    blocks = cut.groupBy("list", "block").agg(F.min("own").alias("own"))
    l, r = blocks.alias("l"), blocks.alias("r")
    several = F.col("l.own").isNull() | F.col("r.own").isNull() | (F.col("l.own") != F.col("r.own"))
    pairs = l.join(r, (F.col("l.list") == F.col("r.list")) & (F.col("l.block") <= F.col("r.block")) & several)
    pairs = pairs.select(F.col("l.list").alias("list"), F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    met = F.xxhash64("list", "i", "j").alias("met")
    one = pairs.where("i = j").select("list", F.col("i").alias("block"), met, F.lit(-1).alias("side"))
    left = pairs.where("i <> j").select("list", F.col("i").alias("block"), met, F.lit(0).alias("side"))
    right = pairs.where("i <> j").select("list", F.col("j").alias("block"), met, F.lit(1).alias("side"))
    return cut.join(one.unionByName(left).unionByName(right), ["list", "block"]).select("met", "side", "sid", "n", "home")


def join_sets(docs: DataFrame, rule: Rule = Rule()) -> Joined:
    """Links between different sets, as far as components need them, and each set's component (its smallest doc_id)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept, run, step_ = Staging(spark), Staging(spark), Staging(spark)  # tables of the result, of this run, of a step
    names = list_columns(PASSES)
    sets = step_.stored(texts.mapInArrow(index(rule, PASSES), ", ".join(["doc_id long, n long, sid long", *(f"{x} array<long>" for x in names)])), "set-lists")
    documents = stored(sets.select("doc_id", F.col("n").alias("n_shingles"), "sid"), "set-documents")
    held_by = documents.where("doc_id is not null and sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    few = (sets.agg(F.sum(sum(F.size(x) for x in names))).first()[0] or 0) <= FEW
    lists, run.paths = shared_lists(sets, [names] if few else [[x] for x in names])

    def ended() -> None:
        """What a step has written and shuffled goes, so that steps do not add up on disk."""
        step_.clear()
        if not few:
            release_shuffles(spark)

    del sets  # the largest table of all
    ended()
    bins = max(8 * parts, lists.count() >> 14)  # of short lists; a long one's blocks are groups of their own
    wanted = lists.select("sid").distinct().join(held_by, "sid")
    whole = texts.join(wanted, "doc_id").select("sid", "text")
    whole = kept.stored(whole.mapInArrow(whole_sets(rule), "sid long, n long, own binary, sketch binary"), "set-whole")
    n_sets = max(1, whole.count())

    def measured(pairs: DataFrame) -> DataFrame:
        left = whole.select(F.col("sid").alias("a"), F.col("own").alias("x"))
        right = whole.select(F.col("sid").alias("b"), F.col("own").alias("y"))
        slices = 1 if few else 1 + int(pairs.count() / (SENT * n_sets))  # what a slice sends does not outgrow the sets
        made = Staging(spark)
        for k in range(slices):
            own = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
            met = own.join(left, "a").join(right, "b").select("a", "b", "x", "y")
            made.stored(met.mapInArrow(measure, "a long, b long, apart long"), "set-measured")
            del own, met
            ended()
        run.paths += made.paths
        return spark.read.schema("a long, b long, apart long").parquet(*made.paths)

    def linked(pairs: DataFrame) -> DataFrame:
        size = lambda name: whole.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"))
        limit = _apart(rule, F.col("n_a") + F.col("n_b"))
        return stored(pairs.join(size("a"), "a").join(size("b"), "b").where(F.col("apart") <= limit).select("a", "b", "apart"), "set-links")

    def open_(homes: DataFrame, pivots: DataFrame, step: int) -> DataFrame:
        nearest = step < STEPS
        placed = lists.join(homes, "sid")
        several = placed.groupBy("list").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count(F.lit(1)).alias("total")).where("lo <> hi").select("list", "total")
        several = step_.stored(placed.join(several, "list").select("list", "sid", "n", "home", "total"), "set-open-lists")
        short = several.where(F.col("total") <= LIST).select(F.col("list").alias("met"), F.lit(-1).alias("side"), "sid", "n", "home", F.pmod(F.col("list"), F.lit(bins)).alias("task"))
        long = several.where(F.col("total") > LIST)
        long_met = (dealt(long, step) if nearest else against(long, step_)).withColumn("task", F.col("met"))
        rest = (
            short.unionByName(long_met)
            .join(pivots, "sid", "left")
            .join(whole.select("sid", "sketch"), "sid")
            .select("met", "side", "task", "sid", "n", "home", F.coalesce("pivot", "sid").alias("pivot"), F.coalesce("apart", F.lit(0)).alias("apart"), "sketch")
        )
        found = rest.groupBy("task").applyInArrow(open_pairs(rule, nearest), "a long, b long, far long")
        if nearest:
            found = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("near")).select("a", "near.b").unionByName(firsts(long))
        return run.stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "set-open-pairs")

    def joined_homes(homes: DataFrame, fresh: DataFrame) -> DataFrame:
        """Homes after some links more: the links tie homes to each other, and only these are gone through."""
        home = lambda name: homes.select(F.col("sid").alias(name), F.col("home").alias(f"home_{name}"))
        tied = fresh.select("a", "b").join(home("a"), "a").join(home("b"), "b").select("home_a", "home_b")
        least = components(tied).select(F.col("node").alias("home"), "least")
        return run.stored(homes.join(least, "home", "left").select("sid", F.coalesce("least", "home").alias("home")), "set-homes")

    homes = run.stored(whole.select("sid").distinct().withColumn("home", F.col("sid")), "set-homes")
    ended()
    pivots = spark.createDataFrame([], "sid long, pivot long, apart long")
    links = None
    for step in range(STEPS + 1):
        pairs = open_(homes, pivots, step)
        ended()
        compared = measured(pairs)
        if not step:
            near = compared.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("near"))
            pivots = run.stored(near.select(F.col("a").alias("sid"), F.col("near.b").alias("pivot"), "near.apart"), "set-pivots")
        fresh = linked(compared)
        links = fresh if links is None else links.unionByName(fresh)
        homes = joined_homes(homes, fresh)
    grown = held_by.join(homes, "sid", "left").select("sid", "doc_id", F.coalesce("home", "sid").alias("home"))
    least = grown.groupBy("home").agg(F.min("doc_id").alias("component"))
    members = stored(grown.join(least, "home").select("sid", "component"), "set-members")
    run.clear()
    return Joined(documents, links, members, whole.select("sid", "n", "own"), kept)


def block_answers(rule: Rule, named: bool = True):
    """sid, found, linked: of each set of two blocks, the sets of the other (or of the same one) that link with it, and their copies' number.

    Without ``named`` the sets that were found are counted and not passed on.
    """

    def run(group: pa.Table) -> pa.Table:
        side, sid, n, copies = (group.column(c).to_numpy() for c in ("side", "sid", "n", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        limit = rule.apart(n[left][:, None] + n[right])
        pivot = sets[left[0]]
        d = np.array([len(x) + len(pivot) - 2 * int(np.isin(x, pivot, assume_unique=True).sum()) for x in sets], np.int64)
        link = d[left][:, None] + d[right] <= limit
        unsure = ~link & (np.abs(d[left][:, None] - d[right]) <= limit)
        rows, columns = np.flatnonzero(unsure.any(1)), np.flatnonzero(unsure.any(0))
        if len(rows):
            both = shared([sets[i] for i in left[rows]], [sets[i] for i in right[columns]])
            at = np.ix_(rows, columns)
            near = n[left[rows]][:, None] + n[right[columns]] - 2 * both <= limit[at]
            link[at] |= near & unsure[at]
        link &= sid[left][:, None] != sid[right]
        found = [(left[i], right[link[i]]) for i in np.flatnonzero(link.any(1))]
        if right is not left:
            found += [(right[j], left[link[:, j]]) for j in np.flatnonzero(link.any(0))]
        linked = pa.array([int(copies[x].sum()) for _, x in found], pa.int64())
        ids = pa.array([int(sid[x]) for x, _ in found], pa.int64())
        if not named:
            return pa.Table.from_arrays([ids, linked], names=["sid", "linked"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for _, x in found)]), pa.int32()), pa.array(sid[flat(x for _, x in found)]))
        return pa.Table.from_arrays([ids, lists, linked], names=["sid", "found", "linked"])

    return run


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(both), 4096):
        words = both[at : at + 4096]

        def held(sets: list[np.ndarray]) -> np.ndarray:
            grid = np.zeros((len(sets), len(words)), np.float32)
            for k, own in enumerate(sets):
                grid[k, np.isin(words, own, assume_unique=True)] = 1
            return grid

        out += (held(left) @ held(right).T).astype(np.int64)
    return out


def answers(joined: Joined, rule: Rule = Rule(), named: bool = True) -> DataFrame:
    """sid, found, linked: every link between different sets, from both ends; a set has one row for each block that it meets links in.

    Without ``named`` only their numbers: a group of k near copies then sends k rows for each block, not k * k ids.

    The sets of a component are ordered by size into ranges of about BLOCK; ranges meet that sizes let link.
    """
    sets = joined.whole.select("sid", "n").join(copies_of(joined), "sid").join(joined.members.withColumnRenamed("component", "home"), "sid")
    of = sets.groupBy("home", "n").agg(F.count(F.lit(1)).alias("times"))
    several = of.groupBy("home").agg(F.sum("times").alias("all")).where("all > 1").select("home")
    before = W.partitionBy("home").orderBy("n").rowsBetween(W.unboundedPreceding, -1)  # one small row per size and component
    sizes = of.join(several, "home").select("home", "n", "times", F.coalesce(F.sum("times").over(before), F.lit(0)).alias("start"))
    place = F.floor((F.col("start") + F.pmod(F.xxhash64("sid"), F.col("times"))) / BLOCK)  # spread over the size's own places
    placed = stored(sets.join(sizes, ["home", "n"]).select("sid", "home", "n", "copies", place.alias("block")), "set-blocks")
    blocks = placed.groupBy("home", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = blocks.alias("l"), blocks.alias("r")
    reach = F.col("r.lo") * rule.num <= F.col("l.hi") * rule.den
    met = left.join(right, (F.col("l.home") == F.col("r.home")) & (F.col("l.block") <= F.col("r.block")) & reach)
    pairs = met.select(F.col("l.home").alias("home"), F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block")))
    ends = pairs.select("home", "i", "j", F.explode(F.filter(ends, lambda x: (x["side"] == 0) | (F.col("i") != F.col("j")))).alias("end"))
    sent = ends.select("home", "i", "j", F.col("end.side").alias("side"), F.col("end.block").alias("block")).join(placed, ["home", "block"])
    sent = sent.join(joined.whole.select("sid", "own"), "sid").select("home", "i", "j", "side", "sid", "n", "copies", "own")
    return sent.groupBy("home", "i", "j").applyInArrow(block_answers(rule, named), f"sid long{', found array<long>' * named}, linked long")


def copies_of(joined: Joined) -> DataFrame:
    """sid, copies: the documents of each set."""
    held = joined.documents.where("doc_id is not null and sid is not null").select("doc_id", "sid").distinct()
    return held.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"))


def document_links(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row."""
    joined = join_sets(docs, rule)
    linked = answers(joined, rule, named=False).groupBy("sid").agg(F.sum("linked").alias("linked"))
    counted = copies_of(joined).join(linked, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    rows = joined.documents.join(joined.members, "sid", "left").join(counted, "sid", "left")
    known = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "n_shingles", F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), F.when(known, F.coalesce("n_links", F.lit(0))).alias("n_links"))


def _apart(rule: Rule, total: Column) -> Column:
    return F.floor(total * (rule.den - rule.num) / (rule.den + rule.num) + F.lit(1e-9))


def document_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    found = join_sets(docs, rule)
    found.kept.clear()  # the sets themselves are read no more
    rows = found.documents.join(found.members, "sid", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, and those without an id.

    A document is its id: rows that repeat the one that stays are kept with it.
    """
    others = document_components(docs, rule).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
