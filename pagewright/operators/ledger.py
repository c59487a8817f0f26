"""Roll-ups of a hierarchical ledger: items in subphases in phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolled_status(status: str = "status") -> Column:
    """Of a group: planned if all are planned, complete if all are complete, else in progress."""
    s = F.col(status)
    return F.when(F.bool_and(s == "complete"), "complete").when(F.bool_or(s.isin("complete", "in_progress")), "in_progress").otherwise("planned")


def roll_up(items: DataFrame) -> DataFrame:
    """(phase, subphase, status, n_items, n_complete); the rows of phases have a null subphase."""
    measures = [F.sum("n_items").alias("n_items"), F.sum("n_complete").alias("n_complete")]
    sub = items.groupBy("phase", "subphase").agg(rolled_status().alias("status"), F.count("*").alias("n_items"), F.count(F.when(F.col("status") == "complete", 1)).alias("n_complete"))
    top = sub.groupBy("phase").agg(rolled_status().alias("status"), *measures).withColumn("subphase", F.lit(None).cast("string"))
    return sub.unionByName(top)


def sorted_slice(items: DataFrame, ranks: dict[str, list[str]], names: list[str], limit: int = 10) -> DataFrame:
    """The first items by the ranks of some columns (unknown values last), then by other columns."""
    order = [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, v)), F.col(k)), F.lit(0)), F.lit(len(v) + 1)) for k, v in ranks.items()]
    return items.orderBy(*order, *names).limit(limit)


def unmapped(mapped: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """(key, side): discovered keys that aren't mapped, and mapped ones that aren't there any more."""
    new = discovered.select(key).distinct().join(mapped.select(key), key, "left_anti").withColumn("side", F.lit("unmapped"))
    old = mapped.select(key).distinct().join(discovered.select(key), key, "left_anti").withColumn("side", F.lit("stale"))
    return new.unionByName(old)


def violations(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Items with the names of all rules they break; only those that break any."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return items.withColumn("violations", found).where(F.size("violations") > 0)


#: Columns (fixed names) that a handed-over item has filled (texts) or not empty (lists).
HANDOFF_TEXTS, HANDOFF_LISTS = ("contract", "slice_size", "execution_owner"), ("source_refs", "ready_when", "write_scope", "acceptance", "done_signal")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _any(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def selected(items: DataFrame, which: str) -> DataFrame:
    """Items with a contract that aren't complete, of one view: ``queue`` (no umbrella, not blocked, handed
    over whole, with a test or the reason of none), ``blocked`` or ``umbrella``."""
    if which not in ("queue", "blocked", "umbrella"):
        raise ValueError(f"unknown view {which}")
    open_ = items.where(_filled("contract") & (F.coalesce("status", F.lit("")) != "complete"))
    umbrella, blocked = F.coalesce("slice_size", F.lit("")) == "umbrella", _any("blocked_by")
    if which == "blocked":
        return open_.where(blocked)
    if which == "umbrella":
        return open_.where(umbrella)
    whole = _any("test_commands") | (F.trim(F.coalesce("no_test_required", F.lit(""))) != "")
    for c in HANDOFF_TEXTS:
        whole = whole & _filled(c)
    for c in HANDOFF_LISTS:
        whole = whole & _any(c)
    return open_.where(~umbrella & ~blocked & whole)


def scorecard(items: DataFrame, areas: dict[str, list[str]]) -> DataFrame:
    """(area, status, complete, in_progress, planned): items with a contract by the areas of their owners.
    An area of which nothing is begun is planned, one with anything left is partial, else covered."""
    pairs = [(a, o) for a, owners in areas.items() for o in owners]
    owners = F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(o).alias("owner")) for a, o in pairs])).alias("x")
    own = items.where(_filled("contract")).select("execution_owner", "status", owners).where("x.owner = execution_owner")
    counted = own.groupBy(F.col("x.area").alias("area")).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("complete", "in_progress", "planned")])
    every = items.sparkSession.createDataFrame([(a,) for a in areas], "area string").join(counted, "area", "left").na.fill(0)
    nothing = (F.col("complete") == 0) & (F.col("in_progress") == 0)
    status = F.when(nothing, "planned").when((F.col("planned") > 0) | (F.col("in_progress") > 0), "partial").otherwise("covered")
    return every.select("area", status.alias("status"), "complete", "in_progress", "planned")


#: Coverage statuses in the order they are listed (fixed values).
COVERAGE = ("covered", "partial", "planned", "vague", "owned", "excluded")


def coverage(items: DataFrame, status: str = "coverage_status") -> DataFrame:
    """(place, status, n): items by coverage status in its fixed order; others and empty ones aren't listed."""
    known = F.array(*map(F.lit, COVERAGE))
    place = F.array_position(known, F.col(status)).cast("int")
    return items.where(F.col(status).isin(*COVERAGE)).groupBy(place.alias("place"), F.col(status).alias("status")).agg(F.count("*").alias("n"))


def ledger_rows(documents: DataFrame) -> DataFrame:
    """(phase, subphase, pos, item): the items of ledger documents (text, nested JSON of phases, subphases
    and items) as rows; keys sort as texts. A broken document gives nothing."""
    schema = "struct<phases:map<string,struct<subphases:map<string,struct<items:array<map<string,string>>>>>>>"
    own = documents.select(F.from_json("text", schema).alias("d"))
    phases = own.select(F.explode("d.phases").alias("phase", "p"))
    subs = phases.select("phase", F.explode("p.subphases").alias("subphase", "s"))
    return subs.select("phase", "subphase", F.posexplode("s.items").alias("pos", "item"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(place, line): rows as lines of a Markdown table below its two head lines. Line breaks become
    blanks, bars are escaped, empty cells show a dash."""
    cell = lambda c: F.coalesce(F.nullif(F.replace(F.replace(F.col(c).cast("string"), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    top = rows.sparkSession.createDataFrame([(i - 2, h) for i, h in enumerate(head, 1)], "place long, line string")
    body = rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), line.alias("line"))
    return top.unionByName(body)


def replaced_section(text: Column, name: str, body: Column) -> Column:
    """A text with what stands between the markers ``<!-- name:start -->`` and ``<!-- name:end -->`` replaced;
    null where a marker is missing."""
    a, b = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    start, end = F.instr(text, a), F.instr(text, b)
    new = F.concat(F.substring(text, F.lit(1), start + len(a) - 1), F.lit("\n"), body, F.lit("\n"), F.substring(text, end, F.length(text)))
    return F.when((start > 0) & (end > start), new)
