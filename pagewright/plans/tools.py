"""Queries over sources, recipes, ledgers, schedules and streams, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.dom import nodes as N
from pagewright.functions import urls
from pagewright.operators import adaptive, frontier, ledger, links, recipes
from pagewright.session import fresh_path, table
from pagewright.sources import curl, responses, sitemaps
from pagewright.streaming import frontier as streaming


def q_class(spark: SparkSession, d: str) -> DataFrame:
    """Elements of class card by page."""
    nodes = N.dom_nodes(table(spark, d, "pages"), ["page_id", "attr", "kind"])
    return N.elements(nodes).where(N.has_class(F.col("attr")["class"], "card")).groupBy("page_id").agg(F.count("*").alias("n"))


def q_attribute_search(spark: SparkSession, d: str) -> DataFrame:
    """Attributes whose value holds "checkout"."""
    return N.attributes_with(N.dom_nodes(table(spark, d, "pages"), ["page_id", "node_id", "kind", "attr"], ["a"]), "checkout", partial=True).where("key = 'href'").select("page_id", "value")


def q_recipe(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a recipe over all pages."""
    fields = [recipes.Field("heading", "h1::text"), recipes.Field("sku", "//article/@data-sku", "xpath", multiple=True, prefix="sku-"), recipes.Field("none", "table td")]
    got = recipes.extract(table(spark, d, "pages"), fields)
    return got.select("page_id", "name", "value", F.size("values").cast("long").alias("n_values"), "error")


def q_static_extract(spark: SparkSession, d: str) -> DataFrame:
    """Title and main text of every page."""
    return recipes.static_extract(table(spark, d, "pages"), "main")


def q_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Locations of one sitemap document for each page."""
    xml = F.concat(F.lit('<urlset xmlns="s"><url><loc> '), F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(' </loc><x:image xmlns:x="i"><x:loc>no</x:loc></x:image></url></urlset>'))
    docs = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("origin"), F.encode(xml, "UTF-8").alias("body"), F.lit("text/xml").alias("content_type"))
    return sitemaps.sitemap_urls(docs).select(F.col("origin").cast("long").alias("page_id"), "kind", "url")


def q_curl(spark: SparkSession, d: str) -> DataFrame:
    """Requests written as curl commands and read again."""
    r = table(spark, d, "scheduler_requests").where("url is not null and instr(url, \"'\") = 0")
    commands = r.select(F.concat(F.lit("curl '"), F.trim("url"), F.lit("' -X "), F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("GET")), F.lit(" -H 'X-Id: "), F.col("request_id").cast("string"), F.lit("'")).alias("command"))
    got = curl.curl_requests(commands)
    return got.select(F.col("headers")["X-Id"].cast("long").alias("request_id"), "method", F.size("params").cast("long").alias("n_params"))


def q_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses of the cache by media type, with their bytes."""
    r = responses.responses(table(spark, d, "response_cache_records"))
    return r.groupBy(F.coalesce("media_type", F.lit("")).alias("media_type"), "method").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).cast("long").alias("bytes"))


def q_response_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of cached pages, in whatever encoding."""
    pages = responses.as_pages(responses.responses(table(spark, d, "response_cache_records")))
    return N.first_of(N.select_all(pages, {"title": "title::text"})).select(F.col("page_id").alias("record_id"), F.col("value").alias("title"))


def q_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a ledger: priority, clerk-like key and status rolled up."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("planned")
    items = table(spark, d, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_custkey").cast("string").alias("subphase"), status.alias("status"))
    return ledger.roll_up(items)


def q_ledger_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten first orders by the ranks of priority and status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return ledger.sorted_slice(o, {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["P", "O"]}, ["o_orderkey"])


def q_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Customers without urgent orders, and users of events that are no customers."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    mapped = urgent.unionByName(table(spark, d, "events").select((F.col("user_id") * 3).alias("k")))
    return ledger.unmapped(mapped, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


def q_violations(spark: SparkSession, d: str) -> DataFrame:
    """Documents that break any rule of the corpus."""
    rules = {"language": F.length("lang") == 2, "length": F.col("n_chars") == F.char_length("text"), "text": F.trim("text") != "", "source": F.col("source").isNotNull()}
    found = ledger.violations(table(spark, d, "documents"), rules)
    return found.select("doc_id", F.array_join("violations", ",").alias("violations"))


def q_host_limit(spark: SparkSession, d: str) -> DataFrame:
    """The five first requests of each host."""
    r = table(spark, d, "scheduler_requests").select("request_id", "url", "priority")
    return frontier.limit_per_host(r, 5, "request_id").select("request_id")


def q_clock(spark: SparkSession, d: str) -> DataFrame:
    """When each request would start if every host's requests wait a second per retry plus one."""
    r = table(spark, d, "scheduler_requests").select("request_id", "url", "priority", "retry_count")
    return frontier.start_times(r, "request_id", (F.col("retry_count") + 1).cast("double")).select("request_id", "starts_at")


def q_follow(spark: SparkSession, d: str) -> DataFrame:
    """Follow-up requests for the links of each page's navigation, by priority."""
    pages = table(spark, d, "pages")
    found = links.extract_links(pages, links.LinkExtractor(restrict_css=("nav",))).select("page_id", "url")
    none = F.lit(None)
    origin = pages.select("page_id", F.col("url").alias("request_url"), F.lit("GET").alias("method"), none.cast("string").alias("body"), none.cast("map<string,array<string>>").alias("headers"), F.lit("default").alias("sid"), (F.col("page_id") % 3).cast("int").alias("priority"))
    return frontier.follow_ups(found, origin).groupBy("priority").agg(F.count("*").alias("n"), F.count(F.element_at(F.col("headers")["Referer"], 1)).alias("n_referers"))


def q_route(spark: SparkSession, d: str) -> DataFrame:
    """Requests by the session they go to."""
    sessions = spark.createDataFrame([("default", True), ("browser", False)], "sid string, is_default boolean")
    r = table(spark, d, "scheduler_requests").select("request_id", "sid")
    return frontier.route(r, sessions).groupBy("session", F.col("error").isNotNull().alias("unknown")).agg(F.count("*").alias("n"))


def q_diagnose(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for each page's first article, with all components."""
    fps = adaptive.element_fingerprints(table(spark, d, "pages")).withColumn("domain", urls.adaptive_domain(F.col("url"))).drop("url")
    cards = fps.where("fp.tag = 'article'")
    stored = cards.groupBy("domain").agg(F.min_by("fp", F.struct("page_id", "node_id")).alias("fp")).withColumn("identifier", F.lit("card"))
    return adaptive.diagnose(cards, stored).groupBy("rank", "accepted").agg(F.count("*").alias("n"))


def q_stream_new(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints that a stream of requests lets through, forced ones counted."""
    from pagewright.operators.frontier import with_fingerprint

    path = f"{d}/scheduler_requests.parquet"
    own = table(spark, d, "scheduler_requests").select("request_id", "url", "method", "sid", "body", "dont_filter")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    stream = streaming.request_stream(spark, f"{d}/scheduler_requests.parque[t]" if is_file else path, own.schema)
    root = fresh_path(spark, "stream")
    streaming.run(stream, f"{root}/out", f"{root}/state").awaitTermination()
    out = spark.read.schema(with_fingerprint(own).schema).parquet(f"{root}/out")
    return out.groupBy("dont_filter").agg(F.count("*").alias("n"), F.countDistinct("fp").alias("n_keys"))


def q_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Requests by hour of arrival and host."""
    r = table(spark, d, "scheduler_requests")
    counts = streaming.arrival_counts(r)
    return counts.select(F.col("window.start").alias("hour"), "host", "n")


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

_H1 = r"trim(regexp_replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '<h1>(.*?)</h1>', 1, 's'), '&#x27;', ''''), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g'))"
_SKU = r"""regexp_extract_all(coalesce(html, ''), '<article class="card" data-sku="([^"]*)"', 1)"""
_HOST = r"lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]+)', 1))"
_NONE = "selector matched no values"
SQL = {
    "q_class": f"select page_id, len({_SKU}) n from pages where len({_SKU}) > 0",
    "q_attribute_search": """select page_id, h "value" from (select page_id, unnest(regexp_extract_all(html, '<a[^>]*? href="([^"]*)"', 1)) h from pages) where contains(h, 'checkout')""",
    "q_recipe": f"""select page_id, 'heading' name, {_H1} "value", 0::bigint n_values, case when {_H1} = '' then '{_NONE}' else '' end error from pages
union all select page_id, 'sku', coalesce('sku-' || {_SKU}[1], ''), len({_SKU}), case when len({_SKU}) = 0 then '{_NONE}' else '' end from pages
union all select page_id, 'none', '', 0, '{_NONE}' from pages""",
    "q_sitemap": "select page_id, 'url' kind, trim(url) url from pages where url is not null",
    "q_curl": r"select request_id, upper(coalesce(nullif(trim(method), ''), 'GET')) method, len(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')) n_params from scheduler_requests where url is not null and not contains(url, '''')",
    "q_ledger": """with i as (select o_orderpriority phase, o_custkey::varchar subphase, case o_orderstatus when 'F' then 'complete' when 'P' then 'in_progress' else 'planned' end s from orders),
g as (select phase, subphase, count(*) n, count(*) filter (s = 'complete') c, count(*) filter (s in ('complete', 'in_progress')) b from i group by phase, subphase),
p as (select phase, null::varchar subphase, count(*) k, sum(n)::bigint n, sum(c)::bigint c, count(*) filter (c = n) kc, count(*) filter (b > 0) kb from g group by phase)
select phase, subphase, case when c = n then 'complete' when b > 0 then 'in_progress' else 'planned' end status, n n_items, c n_complete from g
union all select phase, subphase, case when kc = k then 'complete' when kb > 0 then 'in_progress' else 'planned' end, n, c from p""",
    "q_ledger_top": "select o_orderkey, o_orderpriority, o_orderstatus from orders order by case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 else 3 end, case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, o_orderkey limit 10",
    "q_unmapped": "with m as (select o_custkey k from orders where o_orderpriority = '1-URGENT' union select user_id * 3 from events) select c_custkey k, 'unmapped' side from customer where c_custkey not in (select k from m where k is not null) union all select k, 'stale' from m where k not in (select c_custkey from customer)",
    "q_violations": """select doc_id, v violations from (select doc_id, concat_ws(',', case when coalesce(length(lang) = 2, false) then null else 'language' end, case when coalesce(n_chars = length(text), false) then null else 'length' end,
case when coalesce(trim(text, ' ') <> '', false) then null else 'text' end, case when source is not null then null else 'source' end) v from documents) where v <> ''""",
    "q_host_limit": f"select request_id from (select request_id, row_number() over (partition by {_HOST} order by priority desc, request_id) n from scheduler_requests) where n <= 5",
    "q_clock": f"select request_id, coalesce(sum(retry_count + 1) over (partition by {_HOST} order by priority desc, request_id rows between unbounded preceding and 1 preceding), 0)::double starts_at from scheduler_requests",
    "q_route": """select coalesce(nullif(trim(sid), ''), 'default') "session", coalesce(nullif(trim(sid), ''), 'default') not in ('default', 'browser') "unknown", count(*) n from scheduler_requests group by all""",
    "q_arrivals": "select date_trunc('hour', enqueued_at)::timestamp \"hour\", host, count(*) n from scheduler_requests where enqueued_at is not null group by all",
    "q_responses": "select coalesce(lower(trim(split_part(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value[1], ';', 1))), '') media_type, coalesce(nullif(upper(\"method\"), ''), 'GET') \"method\", count(*) n, coalesce(sum(octet_length(from_base64(content))), 0)::bigint bytes from response_cache_records group by all",
}
