"""Queries over requests, options, robots variants, registries, ledgers and functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.dom import nodes as N
from pagewright.functions import json_path, urls
from pagewright.functions import text as T
from pagewright.operators import adaptive, browser, frontier, ledger, links, recipes, requests, robots, views
from pagewright.select import translate
from pagewright.session import fresh_path, table
from pagewright.sources import rendered, responses


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scheduler_requests")


# Sources


def q_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Requests of all verbs answered from stored pages of every other id."""
    p = _pages(spark, d)
    verb = F.element_at(F.array(*map(F.lit, ["GET", "POST", "PUT", "DELETE", "PATCH"])), (F.col("page_id") % 5).cast("int") + 1)
    asked = p.select("page_id", "url", verb.alias("method"))
    stored = asked.where("page_id % 2 = 0").withColumns({"status": F.lit(200), "body": F.col("url"), "stored_at": F.col("page_id")})
    return requests.fetched(asked, stored).select("page_id", "status", F.length("body").cast("long").alias("bytes"), "error")


class _Fixture:
    """An engine whose pages say what they were asked."""

    def page(self):
        return self

    def close(self) -> None:
        pass

    def fetch(self, url, options):
        if url.endswith("0"):
            raise ValueError("ends with 0")
        return 200, f"<title>{url}</title>", [(url + "/xhr", 204, "")]


def q_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched by an engine, with captured requests and errors."""
    asked = _pages(spark, d).select(F.col("page_id").alias("request_id"), "url")
    got = rendered.rendered(asked, _Fixture)
    return got.select("request_id", "status", F.length("html").cast("long").alias("bytes"), F.size("xhr").cast("long").alias("n_xhr"), "error")


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the defaults of their sessions."""
    sessions = [
        requests.Session("default", {"referer": ["http://start.test/"], "Accept": ["text/html"]}),
        requests.Session("stealth", {"X-Mode": ["quiet"]}, proxy="http://quiet.test:1"),
    ]
    r = _requests(spark, d).select("request_id", "sid", "headers", F.lit(None).cast("string").alias("proxy"))
    got = requests.with_session(r, sessions)
    lower = F.transform_keys("headers", lambda k, v: F.lower(k))
    return got.select("request_id", F.size("headers").cast("long").alias("n_headers"), F.try_element_at(F.try_element_at(lower, F.lit("referer")), F.lit(1)).alias("referer"), "proxy")


def q_cookies(spark: SparkSession, d: str) -> DataFrame:
    """The jar of each host: the last value of each cookie that its responses set."""
    c = table(spark, d, "response_cache_records").select(urls.host(F.col("url")).alias("sid"), F.col("record_id").alias("response_id"), "cookies")
    return requests.latest_cookies(c)


def q_cookie_header(spark: SparkSession, d: str) -> DataFrame:
    """Cookie headers of explicit cookies over a map of defaults."""
    c = table(spark, d, "response_cache_records")
    values = F.create_map(F.lit("zz"), F.lit("1"), F.lit("aa"), F.lit("2"))
    own = F.transform("cookies", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return c.select("record_id", requests.cookie_header(own, values).alias("cookie"))


def q_adapted(spark: SparkSession, d: str) -> DataFrame:
    """Proxies and flags of requests by their meta, else in turn."""
    meta = F.when(F.col("request_id") % 3 == 0, F.lit('{"proxies": {"https": "http://secure.test"}, "proxy": "http://any.test", "flags": ["b", "z"]}')).when(F.col("request_id") % 3 == 1, F.lit('{"proxy": "http://any.test"}'))
    r = _requests(spark, d).select("request_id", "url", meta.alias("meta"))
    got = requests.adapted(r, requests.Session("s", rotate=("http://one.test", "http://two.test"), flags=frozenset(["b", "a"])))
    return got.select("request_id", "proxy", F.array_join("flags", ",").alias("flags"))


def q_prepare(spark: SparkSession, d: str) -> DataFrame:
    """Requests made ready: forms, JSON bodies, both at once, and content types."""
    r = _requests(spark, d)
    form = F.when(F.col("request_id") % 2 == 0, F.create_map(F.lit("id"), F.array(F.col("request_id").cast("string"), F.lit("a b"))))
    own = r.select("request_id", "url", "headers", F.lit(None).cast("string").alias("body"), form.alias("data"), F.when(F.col("request_id") % 3 == 0, F.lit("{}")).alias("json"))
    got = requests.prepare(own)
    return got.select("request_id", "body", F.try_element_at(F.try_element_at("headers", F.lit("Content-Type")), F.lit(1)).alias("kind"), "error")


def q_proxies(spark: SparkSession, d: str) -> DataFrame:
    """The proxy that each page goes through, with credentials."""
    p = requests.Proxies(by_scheme={"https": "http://up.test:3128"}, auth=("me", "a:b"))
    return _pages(spark, d).select("page_id", p.selected(F.col("url")).alias("proxy"), p.address(F.col("url")).alias("address"))


def q_errors(spark: SparkSession, d: str) -> DataFrame:
    """Typed errors of blocked responses as messages."""
    c = table(spark, d, "response_cache_records")
    kind = F.when(frontier.is_blocked(F.col("status")), "retry_exhausted")
    text = requests.error_message(kind, F.lit("GET"), F.trim("url"), F.lit(3), F.concat(F.lit("status "), F.col("status").cast("string")))
    return c.select("record_id", text.alias("message"))


def q_safe(spark: SparkSession, d: str) -> DataFrame:
    """Private and blocked addresses among requests to numbered ones."""
    net = F.element_at(F.array(*map(F.lit, ["10.0.0.", "8.8.8.", "192.168.1.", "203.0.113.", "172.32.0."])), (F.col("request_id") % 5).cast("int") + 1)
    r = _requests(spark, d).select("request_id", F.lit("GET").alias("method"), F.concat(F.lit("http://"), net, (F.col("request_id") % 250).cast("string"), F.lit("/x")).alias("url"))
    return requests.safe(r, blocked=("203.0.113.0/24",)).select("request_id", "error_kind", "error_message")


def q_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as JSON lines and read again."""
    n = table(spark, d, "nation")
    path = fresh_path(spark, "lines")
    responses.write_json_lines(n, path)
    return spark.read.schema(n.schema).json(path)


def q_cache(spark: SparkSession, d: str) -> DataFrame:
    """How many requests the keys of the snapshots answer."""
    r = _requests(spark, d).select("request_id", F.lower(F.btrim("fingerprint")).alias("fp"))
    cache = table(spark, d, "scheduler_snapshots").select(F.explode("seen").alias("fp"), "snapshot_id")
    return responses.cache_counters(r, cache)


def q_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the newest snapshot that holds their key."""
    r = _requests(spark, d).select("request_id", F.lower(F.btrim("fingerprint")).alias("fp"))
    cache = table(spark, d, "scheduler_snapshots").select(F.explode("seen").alias("fp"), "snapshot_id", F.col("snapshot_id").alias("stored_at"))
    return responses.cache_lookup(r, cache)[0].select("request_id", "snapshot_id")


def q_merged_meta(spark: SparkSession, d: str) -> DataFrame:
    """OpenGraph maps with defaults under them."""
    s = table(spark, d, "structured_data")
    got = responses.merged_meta(F.create_map(F.lit("type"), F.lit("none"), F.lit("extra"), F.lit("1")), F.coalesce("opengraph", F.create_map().cast("map<string,string>")))
    return s.select("page_id", F.size(got).cast("long").alias("n"), got["type"].alias("type"))


def q_scraped(spark: SparkSession, d: str) -> DataFrame:
    """Titles put through a hook that drops blank ones, counted."""
    w = table(spark, d, "web_extract_results").select(F.col("title").alias("item"))
    return responses.scraped(w, lambda c: F.nullif(T.normalize_space(c), F.lit("")))[1]


# Robots


_ROBOTS = "User-agent: *\nDisallow: /column\nAllow: /column/a\nCrawl-delay: 2\nSitemap: http://maps.test/a.xml\n\nUser-agent: other\nDisallow: /\n sitemap: http://maps.test/b.xml\n"


def _policies(rows: DataFrame) -> DataFrame:
    found = rows.select(robots.origin(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    status = F.when(F.length("origin") % 3 == 0, 404).otherwise(200)
    return found.withColumns({"status": status, "body": F.lit(_ROBOTS)})


def q_robots_literal(spark: SparkSession, d: str) -> DataFrame:
    """Pages that prefix rules allow; a missing file allows all."""
    p = _pages(spark, d).select("page_id", "url")
    return robots.literal_check(p, _policies(p)).select("page_id", "allowed")


def q_robots_strict(spark: SparkSession, d: str) -> DataFrame:
    """Pages that strict rules allow, with reasons; a missing file forbids all."""
    p = _pages(spark, d).select("page_id", "url")
    return robots.strict_check(p, _policies(p), "anybot").select("page_id", "allowed", "reason", "delay")


def q_robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules of all origins as rows."""
    return robots.robots_rules(_policies(_pages(spark, d))).groupBy("grp", "agent", "pattern", "allow").agg(F.count("*").alias("n"))


def q_sitemap_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap lines of all origins."""
    return robots.sitemap_lines(_policies(_pages(spark, d))).groupBy("url").agg(F.count("*").alias("n"))


def q_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Requests to hosts under some domains."""
    ok = links.allowed(F.col("url"), ["example", "invalid."])
    return _requests(spark, d).select("request_id", ok.alias("allowed"))


def q_rules_every(spark: SparkSession, d: str) -> DataFrame:
    """Requests by every rule that takes their URL, with the rules' own priorities."""
    found = _requests(spark, d).select("request_id", "url")
    rules = [links.Rule("paged", links.LinkExtractor(allow=(r"[?&]page=",)), priority=5), links.Rule("example", links.LinkExtractor(allow_domains=("example",)))]
    got = links.dispatch(found, rules, every=True)
    return got.groupBy("rule", "rule_priority").agg(F.count("*").alias("n"))


# Registries and ledgers


PROVIDERS = [
    recipes.Provider("Almanac", "al", ("Docs",)), recipes.Provider("docdive", "dd", ("docs", "code")), recipes.Provider("lanternfind", "x", ("web",)),
    recipes.Provider("quarry", "x", ("web",)), recipes.Provider("tracery", "t", ("web",), enabled=False),
]


def q_providers(spark: SparkSession, d: str) -> DataFrame:
    """Results' providers and shortcuts resolved in a registry."""
    w = table(spark, d, "web_extract_results")
    key = F.element_at(F.array(F.upper("extraction.provider"), F.col("extraction.provider_shortcut"), F.lit("x")), (F.col("result_id") % 3).cast("int") + 1)
    return recipes.resolved(w.select("result_id", key.alias("key")), PROVIDERS).select("result_id", "provider", "error")


def q_no_result(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose status means that there is no result."""
    c = table(spark, d, "response_cache_records")
    return c.groupBy(F.coalesce(recipes.no_result(F.col("status"), [404, 410]), F.lit(False)).alias("no_result")).agg(F.count("*").alias("n"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ledger items."""
    k = F.col("o_orderkey")
    filled = lambda m: F.when(k % m != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("planned")
    return table(spark, d, "orders").select(
        k.alias("id"), status.alias("status"), F.when(k % 11 != 0, "c").alias("contract"), F.when(k % 7 == 0, "umbrella").otherwise("small").alias("slice_size"), F.col("o_orderpriority").alias("execution_owner"),
        filled(2).alias("blocked_by"), *[filled(13).alias(c) for c in ledger.HANDOFF_LISTS], filled(3).alias("test_commands"), F.when(k % 2 == 0, "none needed").alias("no_test_required"),
    )


def q_ledger_views(spark: SparkSession, d: str) -> DataFrame:
    """Items of the queue, the blocked ones and the umbrellas."""
    items = _items(spark, d)
    views_ = [ledger.selected(items, v).select(F.lit(v).alias("view"), "id") for v in ("queue", "blocked", "umbrella")]
    return views_[0].unionByName(views_[1]).unionByName(views_[2])


AREAS = {"front": ["1-URGENT", "2-HIGH"], "back": ["5-LOW"], "none": ["nobody"]}


def q_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Areas of owners with their statuses."""
    return ledger.scorecard(_items(spark, d), AREAS)


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders by a coverage status in its fixed order."""
    s = F.element_at(F.array(*map(F.lit, ["owned", "covered", "odd"])), (F.col("o_orderkey") % 3).cast("int") + 1)
    return ledger.coverage(table(spark, d, "orders").select(s.alias("coverage_status")))


def q_ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """A ledger document made of regions and nations, read as rows."""
    n = table(spark, d, "nation").where("n_regionkey is not null and n_name is not null").dropDuplicates(["n_regionkey", "n_name"])
    subs = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), F.struct(F.array(F.create_map(F.lit("id"), F.col("n_nationkey").cast("string"))).alias("items"))))).alias("subphases"))
    doc = subs.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), F.struct("subphases")))).alias("phases"))).alias("text"))
    return ledger.ledger_rows(doc).select("phase", "subphase", "pos", F.col("item")["id"].alias("id"))


def q_markdown_table(spark: SparkSession, d: str) -> DataFrame:
    """Nations as a Markdown table."""
    return ledger.markdown_table(table(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])


def q_section(spark: SparkSession, d: str) -> DataFrame:
    """Regions' names put between markers of a text."""
    text = F.concat(F.lit("a <!-- t:start -->old<!-- t:end --> b"), F.when(F.col("r_regionkey") == 0, "").otherwise("!"))
    return table(spark, d, "region").select("r_regionkey", ledger.replaced_section(text, "t", F.col("r_name")).alias("text"))


# Pages


def q_static_status(spark: SparkSession, d: str) -> DataFrame:
    """Static extraction where every fifth page came with an error, and of a selector that matches nothing."""
    p = _pages(spark, d).withColumn("status", F.when(F.col("page_id") % 5 == 0, 503).otherwise(200))
    return recipes.static_extract(p, "main h1").select("page_id", "content", "error")


def q_projected(spark: SparkSession, d: str) -> DataFrame:
    """Responses with the text of their headings as content."""
    p = _pages(spark, d).withColumn("status", F.lit(200))
    return recipes.projected(p, "h1").select("page_id", "status", "url", F.array_join("content", "|").alias("content"))


def q_projected_main(spark: SparkSession, d: str) -> DataFrame:
    """Responses with their main content's markup, counted by tags."""
    p = _pages(spark, d).withColumn("status", F.lit(200))
    got = recipes.projected(p, main_only=True, kind="html")
    return got.select("page_id", F.size(F.regexp_extract_all(F.coalesce(F.try_element_at("content", F.lit(1)), F.lit("")), F.lit("<article[ >]"), F.lit(0))).cast("long").alias("n_articles"))


def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all views of each page, from one parse."""
    e = views.evidence_view(_pages(spark, d))
    count = lambda c: F.size(c).cast("long")
    return e.select("page_id", count("links").alias("n_links"), count("opengraph").alias("n_opengraph"), count(F.filter("nodes", lambda x: x["role"] == "heading")).alias("n_headings"), F.substring_index("markdown", "\n\n", 1).alias("first_block"))


def q_accessible(spark: SparkSession, d: str) -> DataFrame:
    """Accessible names of links, in their order."""
    return views.semantic_view(_pages(spark, d)).where("role = 'link'").select("page_id", "name", "href")


def q_translated(spark: SparkSession, d: str) -> DataFrame:
    """Items of the navigation selected by the XPath that a CSS selector translates to."""
    found = N.select_all(_pages(spark, d), {"x": translate.css_to_xpath("nav ul > li > a[href]")})
    return found.groupBy("page_id").agg(F.count("*").alias("n"))


def q_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Element siblings of second-rank headings, by tag."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "parent_id", "kind", "tag"])
    return N.siblings(nodes.where("tag = 'h2'"), nodes).groupBy("tag").agg(F.count("*").alias("n"))


def q_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of prices, by tag and distance."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "last", "depth", "kind", "tag"])
    return N.ancestors(nodes.where("tag = 'span'"), nodes).groupBy("tag", "distance").agg(F.count("*").alias("n"))


def q_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents of prices, by tag."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "parent_id", "kind", "tag"])
    return N.parents(nodes.where("tag = 'span'"), nodes).groupBy("tag").agg(F.count("*").alias("n"))


def q_under_main(spark: SparkSession, d: str) -> DataFrame:
    """Links under each page's main element, by a structural join of two node tables."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "last", "kind", "tag"], ["main", "a"])
    return N.descendants(nodes.where("tag = 'main'"), nodes).where("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("n_links"))


def q_next_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the navigation with a next and with a previous sibling."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "parent_id", "kind", "tag"], ["li"])
    return N.neighbours(nodes).groupBy("page_id").agg(F.count("next_id").alias("n_next"), F.count("previous_id").alias("n_previous"))


def q_paths(spark: SparkSession, d: str) -> DataFrame:
    """Depths and absolute paths of articles' headings."""
    return N.dom_nodes(_pages(spark, d), ["page_id", "depth", "xpath"], ["h2"])


def q_own_text(spark: SparkSession, d: str) -> DataFrame:
    """Own and full texts of articles' headings: what their links say."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "child_ord", "text_direct", "text_full"], ["h2"])
    return nodes.groupBy("page_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("text_direct") == "", 1)).alias("n_empty"), F.count(F.when(F.col("text_full") != "", 1)).alias("n_full"))


def q_first_price(spark: SparkSession, d: str) -> DataFrame:
    """The first price of each page above 50, by a predicate over nodes."""
    spans = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "text_direct"], ["span"])
    price = F.regexp_extract("text_direct", r"^([0-9.]+) EUR$", 1).try_cast("double")
    return spans.withColumn("price", price).where("price > 50").groupBy("page_id").agg(F.min_by("price", "node_id").alias("price"))


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A store of the records of each host and status, the newest in place of older ones."""
    c = table(spark, d, "response_cache_records").where("record_id is not null")
    rows = c.select(urls.adaptive_domain(F.col("url")).alias("domain"), F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("identifier"), F.col("record_id").alias("fp"), F.col("record_id").alias("version"))
    return adaptive.upsert(rows.where("fp % 2 = 0"), rows.where("fp % 2 = 1"))


# Functions


def q_text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Text functions over results' titles."""
    t = F.col("title")
    spaced = F.replace(t, F.lit("e"), F.lit(" , e"))
    return table(spark, d, "web_extract_results").where("title is not null").select(
        "result_id",
        T.tighten_punctuation(spaced).alias("tight"),
        T.strip_zero_width(F.concat(F.lit("​"), t, F.lit("﻿"))).alias("plain"),
        T.html_unescape(F.concat(F.lit("&lt;"), F.replace(t, F.lit("&"), F.lit("+")), F.lit(" &amp; &copy;"))).alias("decoded"),
        T.regex_first(t, r"([A-Z])(\w)", 2, "none").alias("first"),
        T.render_template("http://x.test/find?q={q}{more}", {"more": F.lit("&n=1"), "q": F.regexp_replace(t, r"[^A-Za-z ]", "")}, escape=True).alias("rendered"),
    )


def q_regex_entities(spark: SparkSession, d: str) -> DataFrame:
    """Matches over raw markup come out decoded."""
    found = T.regex_all(F.col("html"), r"<title>([^<]*)</title>", 1)
    return _pages(spark, d).select("page_id", F.array_join(found, "|").alias("title"))


def q_url_functions(spark: SparkSession, d: str) -> DataFrame:
    """URL functions over pages."""
    bare = F.regexp_replace(F.trim("url"), r"[?#].*$", "")
    path = F.regexp_extract(bare, r"^[a-z]+://[^/]+(.*)$", 1)
    return _pages(spark, d).select(
        "page_id",
        urls.canonical_link(F.concat(bare, F.lit("/x/../y//z/?b=2&a=1#f"))).alias("link"),
        urls.canonical_request(F.concat(F.upper(F.lit("https")), F.lit("://HOST.test/p?b=2&a="), F.col("page_id").cast("string"), F.lit("&a=0#f"))).alias("request"),
        urls.resolve(bare, F.lit("/a/b?x=1")).alias("absolute"),
        urls.resolve(bare, F.lit("//other.test/c")).alias("other"),
        urls.append_params(bare, {"q": ["a b", "c"], "p": ["1"]}).alias("params"),
        urls.extension(F.concat(path, F.lit(".Tar.Gz;v=1"))).alias("packed"),
        urls.extension(path).alias("extension"),
    )


def q_blocked_urls(spark: SparkSession, d: str) -> DataFrame:
    """Pages that wouldn't be loaded with a domain and resources blocked."""
    return _pages(spark, d).select("page_id", browser.blocked(F.col("url"), [" Example. "], True, True).alias("blocked"))


def q_json_deep(spark: SparkSession, d: str) -> DataFrame:
    """Paths through lists and objects, values of all kinds."""
    o = table(spark, d, "orders")
    text = F.to_json(F.struct(F.array(F.struct(F.col("o_orderkey").alias("k"), F.array("o_orderstatus", "o_orderpriority").alias("v")), F.struct((-F.col("o_orderkey")).alias("k"), F.lit(None).cast("array<string>").alias("v"))).alias("list")))
    return o.select("o_orderkey", F.array_join(json_path.json_values(text, "list/k"), ",").alias("keys"), F.try_element_at(json_path.json_values(text, "list/0/v/1"), F.lit(1)).alias("second"), F.array_join(json_path.json_values(text, "list/0/v", True), ",").alias("all"))


def q_elapsed(spark: SparkSession, d: str) -> DataFrame:
    """First and last arrival of each crawl, and the seconds between."""
    return frontier.crawl_times(_requests(spark, d), "crawl_id", "enqueued_at").select("crawl_id", F.round("elapsed", 3).alias("elapsed"))


def q_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Seconds that requests wait before their next try."""
    return _requests(spark, d).select("request_id", frontier.backoff(F.col("retry_count") + 1, 0.5).alias("wait"))


def q_resume(spark: SparkSession, d: str) -> DataFrame:
    """A frontier saved and loaded again: pending requests and seen keys."""
    r = _requests(spark, d).select("request_id", "dont_filter", F.nullif(F.lower(F.btrim("fingerprint", F.lit(" \t\n\r"))), F.lit("")).alias("fp"))
    path = fresh_path(spark, "checkpoint")
    frontier.save_checkpoint(r.where("request_id % 2 = 0"), r.where("request_id % 2 = 1 and fp is not null and not dont_filter"), path)
    pending, seen = frontier.load_checkpoint(spark, path)
    return pending.agg(F.count("*").alias("n_pending")).crossJoin(seen.agg(F.count("*").alias("n_seen")))  # two single rows


def q_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Chains of redirects from every supplier to the first, each to half its number; two make a loop."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    hops = s.where("k > 1").select(F.col("k").cast("string").alias("source"), F.when(F.col("k") == 3, "6").otherwise(F.floor(F.col("k") / 2).cast("string")).alias("target"))
    got = frontier.redirect_history(s.select(F.col("k").cast("string").alias("url")), hops)
    return got.where("error is null").select("url", "final_url", F.size("history").cast("long").alias("n_hops"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

from pagewright.plans.web import DECODE, _A, _H1, _HOST, _NAV  # noqa: E402

_BARE = r"regexp_replace(trim(url), '[?#].*$', '')"
_PATH = rf"regexp_extract({_BARE}, '^[a-z]+://[^/]+(.*)$', 1)"
_ORIGIN = r"lower(regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]+)', 1))"
_TITLE = DECODE.format("regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1, 's')")
_ARTICLES = "len(regexp_extract_all(coalesce(html, ''), '<article '))"
_CLEAN = lambda x: f"trim(regexp_replace({DECODE.format(x)}, '\\s+', ' ', 'g'))"
_ITEMS = """(select o_orderkey id, case o_orderstatus when 'F' then 'complete' when 'P' then 'in_progress' else 'planned' end s, o_orderpriority o, o_orderkey % 11 <> 0 c, o_orderkey % 7 = 0 u, o_orderkey % 2 <> 0 b,
o_orderkey % 13 <> 0 and (o_orderkey % 3 <> 0 or o_orderkey % 2 = 0) w from orders)"""
_FP = "nullif(lower(trim(fingerprint, ' ' || chr(9) || chr(10) || chr(13))), '')"
_LINKS = f"""(select page_id, {DECODE.format("m[2]")} href, {_CLEAN("regexp_replace(m[3], '<[^>]*>', ' ', 'g')")} t, i from
(select page_id, unnest(list_transform(regexp_extract_all(coalesce(html, ''), '<a[^>]*? href="[^"]*"[^>]*>.*?</a>', 0, 's'), lambda x: ['', regexp_extract(x, ' href="([^"]*)"', 1), regexp_extract(x, '^<a[^>]*>(.*)</a>$', 1, 's')])) m,
generate_subscripts(regexp_extract_all(coalesce(html, ''), '<a[^>]*? href="[^"]*"[^>]*>.*?</a>', 0, 's'), 1) i from pages))"""
SQL = {
    "q_fetch": "select page_id, case when page_id % 2 = 0 and page_id % 5 <> 4 then 200 end::int status, case when page_id % 2 = 0 and page_id % 5 <> 4 then length(url) end::bigint bytes, case when page_id % 5 = 4 then 'unsupported method' when page_id % 2 = 1 then 'not stored' end error from pages",
    "q_rendered": "select page_id request_id, case when url not like '%0' then 200 end::int status, case when url not like '%0' then length(url) + 15 end::bigint bytes, case when url like '%0' then 0 else 1 end::bigint n_xhr, case when url like '%0' then 'ValueError: ends with 0' end error from pages",
    "q_sessions": """with r as (select *, coalesce(headers, map([]::varchar[], []::varchar[][])) h, list_filter(map_entries(headers), lambda e: lower(e.key) = 'referer') ref from scheduler_requests)
select request_id, (cardinality(h) + case when sid = 'default' then case when len(ref) > 0 then 0 else 1 end + case when len(list_filter(map_keys(h), lambda k: lower(k) = 'accept')) > 0 then 0 else 1 end when sid = 'stealth' then 1 else 0 end)::bigint n_headers,
 case when len(ref) > 0 then ref[1].value[1] when sid = 'default' then 'http://start.test/' end referer, case when sid = 'stealth' then 'http://quiet.test:1' end proxy from r""",
    "q_cookies": f"""with c as (select {_HOST} sid, record_id, unnest(cookies) k, generate_subscripts(cookies, 1) i from response_cache_records)
select sid, k.name "name", arg_max(k.value, record_id * 1000 + i) "value" from c where k.name <> '' group by 1, 2""",
    "q_cookie_header": """with c as (select record_id, list_filter(coalesce(cookies, []), lambda x: coalesce(x.name, '') <> '') k from response_cache_records)
select record_id, array_to_string(list_concat(list_transform(list_filter(['aa', 'zz'], lambda n: not list_contains(list_transform(k, lambda x: x.name), n)), lambda n: n || '=' || case n when 'aa' then '2' else '1' end), list_transform(k, lambda x: x.name || '=' || coalesce(x.value, ''))), '; ') cookie from c""",
    "q_adapted": """with r as (select request_id, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) s, row_number() over (order by request_id) n from scheduler_requests)
select request_id, case when request_id % 3 = 0 then case when s = 'https' then 'http://secure.test' else 'http://any.test' end when request_id % 3 = 1 then 'http://any.test' when n % 2 = 1 then 'http://one.test' else 'http://two.test' end proxy,
 case when request_id % 3 = 0 then 'a,b,z' else 'a,b' end flags from r""",
    "q_prepare": """select request_id, case when request_id % 6 = 0 then null when request_id % 2 = 0 then 'id=' || request_id || '&id=a+b' when request_id % 3 = 0 then '{}' end body,
 case when request_id % 2 = 0 then 'application/x-www-form-urlencoded' when request_id % 3 = 0 then 'application/json' end kind, case when request_id % 6 = 0 then 'body, data and json exclude each other' when url is null then 'broken url' end error from scheduler_requests""",
    "q_proxies": "select page_id, case when lower(url) like 'https:%' then 'http://up.test:3128' end proxy, case when lower(url) like 'https:%' then 'http://me:a%3Ab@up.test:3128' end address from pages",
    "q_errors": "select record_id, case when status in (401, 403, 407, 429, 444, 500, 502, 503, 504) then 'GET ' || coalesce(nullif(trim(url), ''), '<unknown>') || ' failed after 3 attempts: status ' || status end message from response_cache_records",
    "q_safe": """with r as (select request_id, request_id % 5 in (0, 2, 3) b, 'http://' || ['10.0.0.', '8.8.8.', '192.168.1.', '203.0.113.', '172.32.0.'][request_id % 5 + 1] || (request_id % 250) || '/x' u from scheduler_requests)
select request_id, case when b then 'private_address' end error_kind, case when b then 'GET ' || u || ' failed: private address blocked' end error_message from r""",
    "q_json_lines": "select * from nation",
    "q_cache": "with k as (select distinct unnest(seen) k from scheduler_snapshots) select count(k) hits, count(*) - count(k) misses from scheduler_requests left join k on lower(trim(fingerprint, ' ')) = k",
    "q_cache_hits": "with k as (select k, max(snapshot_id) snapshot_id from (select snapshot_id, unnest(seen) k from scheduler_snapshots) group by k) select request_id, snapshot_id from scheduler_requests join k on lower(trim(fingerprint, ' ')) = k",
    "q_merged_meta": "with s as (select page_id, coalesce(opengraph, map([]::varchar[], []::varchar[])) m from structured_data) select page_id, len(list_distinct(list_concat(map_keys(m), ['type', 'extra'])))::bigint n, case when list_contains(map_keys(m), 'type') then m['type'] else 'none' end \"type\" from s",
    "q_scraped": r"select count(*) filter (t <> '') kept, count(*) filter (coalesce(t, '') = '') dropped from (select trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) t from web_extract_results)",
    "q_robots_literal": f"select page_id, length({_ORIGIN}) % 3 = 0 or not starts_with({_PATH}, '/column') or starts_with({_PATH}, '/column/a') allowed from pages",
    "q_robots_strict": f"""with p as (select page_id, {_PATH} p, length({_ORIGIN}) % 3 = 0 gone from pages)
select page_id, not gone and (not starts_with(p, '/column') or starts_with(p, '/column/a')) allowed, case when gone then 'robots.txt unavailable: status 404' when starts_with(p, '/column/a') then 'allowed by robots rule /column/a' when starts_with(p, '/column') then 'disallowed by robots rule /column' else 'wildcard robots group has no matching path rule' end reason,
 case when gone then 0 else 2 end::double delay from p""",
    "q_robots_rules": f"""select r.grp::int grp, r.agent, r.pattern, r.allow, n from (select count(distinct {_ORIGIN}) n from pages), (values (0, '*', '/column', false), (0, '*', '/column/a', true), (1, 'other', '/', false)) r(grp, agent, pattern, allow)""",
    "q_sitemap_lines": f"select u url, n from (select count(distinct {_ORIGIN}) n from pages), (select unnest(['http://maps.test/a.xml', 'http://maps.test/b.xml']) u)",
    "q_allowed": r"""with r as (select request_id, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)', 1)), '\.$', '') h from scheduler_requests) select request_id, h in ('example', 'invalid') or h like '%.example' or h like '%.invalid' allowed from r""",
    "q_providers": """with r as (select result_id, trim(coalesce(case result_id % 3 when 0 then upper(extraction.provider) when 1 then extraction.provider_shortcut else 'x' end, '')) k from web_extract_results)
select result_id, case lower(k) when 'almanac' then 'Almanac' when 'al' then 'Almanac' when 'docdive' then 'docdive' when 'dd' then 'docdive' when 'lanternfind' then 'lanternfind' when 'quarry' then 'quarry' end provider,
 case when k = '' then 'provider is required' when lower(k) in ('tracery', 't') then 'provider tracery is disabled' when lower(k) = 'x' then 'ambiguous provider shortcut x: lanternfind, quarry' when lower(k) not in ('almanac', 'al', 'docdive', 'dd', 'lanternfind', 'quarry') then 'unknown provider ' || k end error from r""",
    "q_no_result": "select coalesce(status in (404, 410), false) no_result, count(*) n from response_cache_records group by 1",
    "q_ledger_views": f"select 'queue' \"view\", id from {_ITEMS} where c and s <> 'complete' and not u and not b and w union all select 'blocked', id from {_ITEMS} where c and s <> 'complete' and b union all select 'umbrella', id from {_ITEMS} where c and s <> 'complete' and u",
    "q_scorecard": f"""with a as (select * from (values ('front', '1-URGENT'), ('front', '2-HIGH'), ('back', '5-LOW'), ('none', 'nobody')) v(area, o)),
n as (select area, count(*) filter (s = 'complete') complete, count(*) filter (s = 'in_progress') in_progress, count(*) filter (s = 'planned') planned from a left join (select * from {_ITEMS} where c) i on i.o = a.o group by area)
select area, case when complete = 0 and in_progress = 0 then 'planned' when planned > 0 or in_progress > 0 then 'partial' else 'covered' end status, complete, in_progress, planned from n""",
    "q_coverage": "select case o_orderkey % 3 when 0 then 5 else 1 end::int place, case o_orderkey % 3 when 0 then 'owned' else 'covered' end status, count(*) n from orders where o_orderkey % 3 <> 2 group by all",
    "q_ledger_rows": "select n_regionkey::varchar phase, n_name subphase, 0::int pos, n_nationkey::varchar id from nation",
    "q_markdown_table": "select * from (values (-1::bigint, '| n_nationkey | n_name |'), (0::bigint, '|---|---|')) v(place, line) union all select row_number() over (order by n_nationkey), '| ' || n_nationkey || ' | ' || n_name || ' |' from nation",
    "q_section": "select r_regionkey, 'a <!-- t:start -->' || chr(10) || r_name || chr(10) || '<!-- t:end --> b' || case r_regionkey when 0 then '' else '!' end \"text\" from region",
    "q_static_status": f"""select page_id, case when page_id % 5 = 0 then '' else {_H1.replace('html', "coalesce(html, '')")} end content, case when page_id % 5 = 0 then 'HTTP 503' when not regexp_matches(coalesce(html, ''), '<h1>') then 'css_selector matched no elements' else '' end error from pages""",
    "q_projected": f"""select page_id, 200::int status, url, {_H1.replace('html', "coalesce(html, '')")} content from pages""",
    "q_projected_main": f"select page_id, {_ARTICLES}::bigint n_articles from pages",
    "q_evidence": f"""select p.page_id, coalesce(l.n, 0)::bigint n_links, case when p.html is null then 0 else coalesce(cardinality(s.opengraph), 0) end::bigint n_opengraph, len(regexp_extract_all(coalesce(html, ''), '<h[12]>'))::bigint n_headings,
 case when {_H1} <> '' then '# ' || {_H1} else '' end first_block from pages p left join structured_data s using (page_id) left join (select page_id, count(*) n from {_LINKS} where t <> '' and href <> '' group by 1) l on l.page_id = p.page_id""",
    "q_translated": f"select page_id, count(*) n from {_NAV} group by 1",
    "q_siblings": f"select 'span' tag, sum({_ARTICLES})::bigint n from pages",
    "q_ancestors": f"select t tag, i::int distance, sum({_ARTICLES})::bigint n from pages, (select unnest(['article', 'main', 'body', 'html']) t, unnest([1, 2, 3, 4]) i) group by all",
    "q_parents": f"select 'article' tag, sum({_ARTICLES})::bigint n from pages",
    "q_under_main": f"select page_id, {_ARTICLES}::bigint n_links from pages where {_ARTICLES} > 0",
    "q_next_items": f"select page_id, count(*) - 1 n_next, count(*) - 1 n_previous from {_NAV} group by 1",
    "q_paths": f"select page_id, 4::int depth, '/html[1]/body[1]/main[1]/article[' || i || ']/h2[1]' xpath from (select page_id, unnest(range(1, {_ARTICLES} + 1)) i from pages)",
    "q_own_text": f"select page_id, {_ARTICLES}::bigint n, {_ARTICLES}::bigint n_empty, {_ARTICLES}::bigint n_full from pages where {_ARTICLES} > 0",
    "q_first_price": r"""select page_id, list_filter(list_transform(regexp_extract_all(html, '<span class="price">([0-9.]+) EUR</span>', 1), lambda x: x::double), lambda x: x > 50)[1] price from pages where len(list_filter(list_transform(regexp_extract_all(html, '<span class="price">([0-9.]+) EUR</span>', 1), lambda x: x::double), lambda x: x > 50)) > 0""",
    "q_upsert": f"select coalesce(nullif({_HOST}, ''), 'default') \"domain\", coalesce(status::varchar, 'none') identifier, max(record_id) fp, max(record_id) \"version\" from response_cache_records group by 1, 2",
    "q_text_functions": r"""select result_id, regexp_replace(trim(regexp_replace(replace(title, 'e', ' , e'), '[\s\x{00A0}]+', ' ', 'g')), ' ([.,!?;:])', '\1', 'g') tight, title plain, '<' || replace(title, '&', '+') || ' & ©' decoded,
 coalesce(nullif(regexp_extract(title, '([A-Z])\w', 1), ''), 'none') "first", 'http://x.test/find?q=' || replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' ', '%20') || '&n=1' rendered from web_extract_results where title is not null""",
    "q_regex_entities": f"select page_id, {_TITLE} title from pages",
    "q_url_functions": rf"""select page_id, regexp_replace({_BARE}, '/+$', '') || '/y/z/?a=1&b=2' link, 'https://host.test/p?a=' || page_id || '&a=0&b=2' request, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/a/b?x=1' absolute, 'https://other.test/c' other, {_BARE} || '?p=1&q=a+b&q=c' params, 'tar.gz' packed, '' "extension" from pages""",
    "q_blocked_urls": f"select page_id, {_HOST} like '%.example' blocked from pages",
    "q_json_deep": "select o_orderkey, o_orderkey || ',' || -o_orderkey \"keys\", o_orderpriority \"second\", o_orderstatus || ',' || o_orderpriority \"all\" from orders",
    "q_elapsed": "select crawl_id, round((epoch_us(max(enqueued_at)) - epoch_us(min(enqueued_at))) / 1e6, 3) elapsed from scheduler_requests where enqueued_at is not null group by 1",
    "q_backoff": "select request_id, case when retry_count + 1 > 3 then null when retry_count < 1 then 0.0 else 0.5 * power(2, retry_count - 1) end::double wait from scheduler_requests",
    "q_resume": f"""with r as (select request_id, dont_filter, {_FP} fp from scheduler_requests) select (select count(*) from r where request_id % 2 = 0) n_pending, (select count(distinct fp) from r where not dont_filter) n_seen""",
    "q_redirects": """with recursive s as (select s_suppkey::bigint k from supplier where s_suppkey > 0), c as (select k start, k, 0 n from s union all select start, k // 2, n + 1 from c where k > 1 and k <> 3)
select start::varchar url, '1' final_url, max(n)::bigint n_hops from c group by start having bool_or(k = 1)
union all select '0', '0', 0 from supplier where s_suppkey = 0""",
    "q_accessible": f"select page_id, t \"name\", href from {_LINKS} where t <> '' and href <> ''",
}
