"""Results of several providers merged into one row per page, with a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_results(results: DataFrame, scope: str = "call_id", order: str = "result_id") -> DataFrame:
    """One row per scope and key: (scope, key, url, title, content, fields, suggestions, providers,
    score, first_position).

    The key is the trimmed final URL, else the URL, else ``#provider:title``. Positions count within
    the scope from 1, in the given order. The first non-empty url, title and content count; fields
    are filled up only if the first row had any; suggestions are distinct in the order they first come;
    the score is the sum of weight / position, a weight that is null or not positive being 1.
    """
    e = results["extraction"]
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"^[\s\x{0085}\x{00A0}]+|[\s\x{0085}\x{00A0}]+$", "")), F.lit(""))
    final, url, title = blank(e["final_url"]), blank(F.col("url")), blank(F.col("title"))
    page = F.when(final != "", final).otherwise(url)
    provider = F.when(blank(e["provider"]) == "", "unknown").otherwise(blank(e["provider"]))
    weight = F.when(e["provider_weight"] > 0, e["provider_weight"]).otherwise(1.0)
    rows = results.select(
        scope,
        F.row_number().over(Window.partitionBy(scope).orderBy(order)).alias("position"),
        page.alias("page"),
        F.when(page != "", page).otherwise(F.concat(F.lit("#"), provider, F.lit(":"), title)).alias("key"),
        title.alias("title"),
        blank(F.col("content")).alias("content"),
        "fields",
        F.coalesce(F.filter(F.transform("suggestions", blank), lambda s: s != ""), F.array().cast("array<string>")).alias("suggestions"),
        provider.alias("provider"),
        weight.alias("weight"),
    )
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("position"))), F.lit(""))
    # the rows of one key in one scope: at most one for each provider's answer in a call
    by_position = lambda a, b: (a["position"] - b["position"]).cast("int")  # noqa: E731 (maps have no order of their own)
    each = F.array_sort(F.collect_list(F.struct("position", "provider", "weight", "suggestions", "fields")), by_position)
    merged = rows.groupBy(scope, "key").agg(
        first("page").alias("url"), first("title").alias("title"), first("content").alias("content"), each.alias("each")
    )
    some = F.element_at("each", 1)["fields"]
    filled = F.aggregate(
        F.slice("each", 2, F.size("each")),
        F.map_filter(some, lambda k, v: F.lit(True)),
        lambda have, x: F.map_concat(have, F.map_filter(F.coalesce(x["fields"], F.map_filter(some, lambda k, v: F.lit(False))), lambda k, v: ~F.map_contains_key(have, k))),
    )
    return merged.select(
        scope,
        "key",
        "url",
        "title",
        "content",
        F.when(F.coalesce(F.size(some), F.lit(0)) > 0, filled).alias("fields"),
        F.array_distinct(F.flatten(F.transform("each", lambda x: x["suggestions"]))).alias("suggestions"),
        F.transform("each", lambda x: F.struct(x["provider"].alias("provider"), x["position"].alias("position"), x["weight"].alias("weight"))).alias("providers"),
        F.aggregate("each", F.lit(0.0), lambda s, x: s + x["weight"] / x["position"]).alias("score"),
        F.element_at("each", 1)["position"].alias("first_position"),
    )


def ranked(merged: DataFrame, scope: str = "call_id") -> DataFrame:
    """With ``rank`` within the scope: by score from the highest, then by first position."""
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), "first_position")))


def suggestions(results: DataFrame, scope: str = "call_id", order: str = "result_id") -> DataFrame:
    """(scope, suggestion, ord): distinct trimmed suggestions of a scope in the order they first come."""
    each = results.select(scope, order, F.posexplode("suggestions").alias("i", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    firsts = each.groupBy(scope, F.col("s").alias("suggestion")).agg(F.min(F.struct(order, "i")).alias("at"))
    return firsts.select(scope, "suggestion", F.row_number().over(Window.partitionBy(scope).orderBy("at")).alias("ord"))
