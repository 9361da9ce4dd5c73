"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every text is addressed by its content (SHA-256). The ledger holds one row for each
(blob, rule, rule version) that was ever scanned, with the spans found. A scan reads texts once per
unseen pair: copies and texts of earlier runs cost a hash, a new rule version rescans that rule alone.
Findings then go back to every path that holds the blob.

Copies are folded by a partial aggregate before any text is shuffled; the join back to paths is narrow,
and adaptive execution splits it where one blob has many paths.

Defined results: a null text is scanned as the empty one; repeated rows each get the findings; an empty
table gives no rows; further columns are kept and never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.session import stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters at least; the span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# fixed values: kinds and patterns, in the order in which equal starts are listed
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    # a run long enough is found at the same place as the longest run, so the length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
LEDGER = "blob binary, kind string, version int, spans array<struct<start: int, end: int>>"
MARK = "[secret]"


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows of all (blob, rule version) pairs of ``versions.text`` that ``ledger`` lacks."""
    texts = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    done = F.lit(None).cast("array<string>")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
        texts, done = texts.join(seen, "blob", "left"), F.col("done")
    name = lambda r: f"{r.kind}:{r.version}"
    due = lambda r: ~F.coalesce(F.array_contains(done, name(r)), F.lit(False))
    found = lambda r: F.when(due(r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
    looked = texts.select("blob", "text", *(found(r).alias(f"found_{r.kind}") for r in rules))

    def pair(r: Rule) -> Column:
        matches = F.col(f"found_{r.kind}")
        held = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else matches
        parts = F.arrays_zip(
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gap"),
            F.transform(matches, F.length).alias("size"),
            F.transform(held, lambda x: F.length(x) >= r.least).alias("good"),
        )
        return F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), matches.isNotNull().alias("due"), F.when(F.size(matches) > 0, parts).alias("parts")
        )

    pairs = looked.select("blob", F.explode(F.array(*(pair(r) for r in rules))).alias("p")).where("p.due")
    parts = pairs.select("blob", "p.kind", "p.version", F.posexplode_outer("p.parts").alias("no", "part"))
    line = W.partitionBy("blob", "kind", "version").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.coalesce("part.size", F.lit(0))
    end = F.sum(F.col("part.gap") + size).over(line).cast("int")
    spans = parts.withColumn("span", F.when(F.col("part.good"), F.struct((end - size).alias("start"), end.alias("end"))))
    return spans.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its ``findings`` under the given rule versions, by start and rule; blobs without any are left out."""
    wanted = F.coalesce(*(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)))
    rows = ledger.where(F.size("spans") > 0).withColumn("no", wanted).where("no is not null")
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("no").alias("no"), s["end"].alias("end"), F.col("kind").alias("kind")))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(listed))).alias("findings"))


def scan_paths(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """All rows of ``versions`` with ``findings`` (in place of a column of that name); what is scanned anew is stored (in ``path``, if given) and joined with the ledger."""
    fresh = stored(scan(versions, ledger, rules), "secret-ledger", path)
    whole = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    found = current(whole, rules)
    held = [c for c in versions.columns if c != "findings"]
    met = versions.select(F.struct(*held).alias("row"), blob_of().alias("blob")).join(found, "blob", "left")
    empty = F.array().cast(dict(found.dtypes)["findings"])
    return met.select("row.*", F.coalesce("findings", empty).alias("findings"))


def digest(findings: str = "findings") -> Column:
    """kind:start:end of all findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")


def redact(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every finding in ``text`` replaced by MARK; findings that overlap become one mark. A column ``findings`` goes."""
    rows = scan_paths(versions, ledger, rules)
    shown = lambda a, b: F.substring("text", a + 1, b - a)
    cut = F.aggregate(
        "findings",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, f: F.when(
            f["start"] >= acc["at"], F.struct(F.concat(acc["out"], shown(acc["at"], f["start"]), F.lit(MARK)).alias("out"), f["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], f["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], shown(acc["at"], F.length("text"))),
    )
    clean = rows.withColumn("text", F.when(F.size("findings") > 0, cut).otherwise(F.col("text")))
    return clean.select(*(c for c in versions.columns if c != "findings"))
