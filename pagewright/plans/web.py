"""Queries over pages, requests, results and events, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.dom import nodes as N
from pagewright.functions import json_path
from pagewright.functions import text as T
from pagewright.functions import urls
from pagewright.operators import adaptive, frontier, links, merge, robots, views
from pagewright.session import materialize, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


# Fixed values of the sample queries.
ROBOTS = "User-agent: *\nDisallow: /column\nDisallow: /item/*?ref=\nAllow: /column/a\n\nUser-agent: slowbot\nCrawl-delay: 2\nDisallow: /\n"
PROXIES = ["http://one.test:8080", "http://two.test:8080", "http://three.test:8080"]
EMPTY = "coalesce(html, '')"
# Entities that the pages contain; & last.
DECODE = "replace(replace(replace(replace(replace({}, '&#x27;', ''''), '&gt;', '>'), '&lt;', '<'), '&copy;', '©'), '&amp;', '&')"


def q_outlinks(spark: SparkSession, d: str) -> DataFrame:
    """Links of the navigation by host of the page."""
    pages = _pages(spark, d)
    found = N.select_all(pages, {"nav": "nav a::attr(href)"}).select("page_id", "value")
    hosts = pages.select("page_id", urls.adaptive_domain(F.col("url")).alias("host"))
    return found.join(hosts, "page_id").groupBy("host").agg(F.count("*").alias("n_links"), F.countDistinct("value").alias("n_targets"))


def q_css_attr(spark: SparkSession, d: str) -> DataFrame:
    """All a::attr(href) with their places."""
    return N.select_all(_pages(spark, d), {"a": "a::attr(href)"}).select("page_id", "ord", F.col("value").alias("href"))


def q_css_text(spark: SparkSession, d: str) -> DataFrame:
    """h1::text of every page."""
    return N.select_all(_pages(spark, d), {"h1": "h1::text"}).select("page_id", F.col("value").alias("h1"))


def q_css_cards(spark: SparkSession, d: str) -> DataFrame:
    """Prices of cards by a compound selector with a child combinator."""
    return N.select_all(_pages(spark, d), {"p": "article.card[data-sku] > span.price::text"}).select("page_id", "ord", F.col("value").alias("price"))


def q_css_union(spark: SparkSession, d: str) -> DataFrame:
    """Branches follow each other without removing repeats."""
    found = N.select_all(_pages(spark, d), {"u": "h1::text, title::text, h1::text"})
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("branch").alias("n_branches"))


def q_xpath_attr(spark: SparkSession, d: str) -> DataFrame:
    """data-sku of articles by XPath."""
    return N.select_all(_pages(spark, d), {"x": "//article[@class='card']/@data-sku"}).select("page_id", "ord", F.col("value").alias("sku"))


def q_xpath_nth(spark: SparkSession, d: str) -> DataFrame:
    """The second navigation link's text by a positional path."""
    return N.select_all(_pages(spark, d), {"x": "//nav/ul/li[2]/a/text()"}).select("page_id", F.col("value").alias("label"))


def q_title(spark: SparkSession, d: str) -> DataFrame:
    """Title of every page, '' where there is none."""
    pages = _pages(spark, d)
    found = N.first_of(N.select_all(pages, {"t": "title::text"})).select("page_id", "value")
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("value", F.lit("")).alias("title"))


def q_dom_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each of some tags occurs."""
    nodes = N.dom_nodes(_pages(spark, d), ["tag"], ["a", "li", "h2", "span", "meta", "script", "nav"])
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


def q_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Links under each page's main element, counted where the page is parsed."""
    return N.counted_within(_pages(spark, d), "main", "a").groupBy("page_id").agg(F.sum("n").alias("n_links"))


def q_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of the list in the navigation."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "parent_id", "kind", "tag"])
    return N.children(nodes.where("tag = 'ul'"), nodes).groupBy("page_id").agg(F.count("*").alias("n_items"))


def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Next navigation link of each, by lead over their order in the page."""
    found = N.select_all(_pages(spark, d), {"a": "nav a::attr(href)"})
    w = Window.partitionBy("page_id").orderBy("ord")
    return found.select("page_id", "ord", F.col("value").alias("href"), F.lead("value").over(w).alias("next_href"), F.lag("value").over(w).alias("previous_href"))


def q_nth_of_type(spark: SparkSession, d: str) -> DataFrame:
    """Articles with their place among siblings of the same tag."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "nth_of_type", "attr"], ["article"])
    return nodes.select("page_id", "nth_of_type", F.col("attr")["data-sku"].alias("sku"))


def q_search_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose h1's own text holds "guide", any case."""
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "kind", "text_direct"], ["h1"])
    return N.find_by_text(nodes, " GUIDE ", partial=True).select("page_id", F.col("text_direct").alias("h1"))


def q_search_regex(spark: SparkSession, d: str) -> DataFrame:
    """Prices by a regular expression over elements' own texts."""
    found = N.find_by_regex(N.dom_nodes(_pages(spark, d), ["page_id", "kind", "text_direct"]), r"^\d+\.\d\d eur$")
    return found.select("page_id", F.regexp_extract("text_direct", r"^(\d+\.\d\d)", 1).cast("double").alias("price"))


def q_full_text(spark: SparkSession, d: str) -> DataFrame:
    """Full text of footers."""
    return N.select_all(_pages(spark, d), {"f": "footer"}).select("page_id", F.col("text").alias("footer"))


def q_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Generated selectors of every h1, which select it again."""
    from pagewright.dom.nodes import per_page
    from pagewright.select import css, translate, xpath

    def rows(i, url, root):
        for n in root.walk():
            if n.tag == "h1":
                c, cf, x, xf = (translate.generated(n, k, f) for k in (True, False) for f in (False, True))
                same = all([m is n for _, m, _ in css.select(root, s)] == [True] for s in (c, cf)) and all([m is n for m, _ in xpath.select(root, s)] == [True] for s in (x, xf))
                yield i, c, cf, x, xf, same

    return per_page(_pages(spark, d), "page_id long, css string, css_full string, xpath string, xpath_full string, same boolean", rows)


def q_markdown_h1(spark: SparkSession, d: str) -> DataFrame:
    """First block of each page's Markdown."""
    md = views.markdown_view(_pages(spark, d))
    return md.select("page_id", F.split("markdown", "\n\n")[0].alias("first_block"))


def q_link_view(spark: SparkSession, d: str) -> DataFrame:
    """Links with text and target."""
    return views.link_view(_pages(spark, d))


def q_semantic_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the semantic view."""
    return views.semantic_view(_pages(spark, d)).where("role = 'heading'").groupBy("tag").agg(F.count("*").alias("n"))


def q_interactive(spark: SparkSession, d: str) -> DataFrame:
    """Interactive nodes of each page."""
    return views.semantic_view(_pages(spark, d)).where("interactive").groupBy("page_id", "role").agg(F.count("*").alias("n"))


def q_opengraph(spark: SparkSession, d: str) -> DataFrame:
    """OpenGraph properties of the pages."""
    return views.opengraph_view(_pages(spark, d))


def q_jsonld(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD scripts of the pages, all of them."""
    return views.jsonld_view(_pages(spark, d), objects_only=False)


def q_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Main content of the pages without navigation and footers."""
    return views.cleaned_view(_pages(spark, d)).select("page_id", "text")


def q_links(spark: SparkSession, d: str) -> DataFrame:
    """Taken links of each page, counted."""
    return links.extract_links(_pages(spark, d), links.LinkExtractor()).groupBy("page_id").agg(F.count("*").alias("n_links"))


def q_link_drops(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by reason of drop."""
    return links.link_candidates(_pages(spark, d), links.LinkExtractor(deny=(r"\?ref=",))).groupBy("reason").agg(F.count("*").alias("n"))


def q_link_scope(spark: SparkSession, d: str) -> DataFrame:
    """Links of the main element only."""
    return links.extract_links(_pages(spark, d), links.LinkExtractor(restrict_css=("main",))).groupBy("page_id").agg(F.count("*").alias("n_links"))


def q_rules(spark: SparkSession, d: str) -> DataFrame:
    """First matching rule of each request's URL."""
    found = table(spark, d, "scheduler_requests").select("request_id", "url")
    rules = [links.Rule("paged", links.LinkExtractor(allow=(r"[?&]page=",))), links.Rule("example", links.LinkExtractor(allow_domains=("example",))), links.Rule("rest", links.LinkExtractor())]
    return links.dispatch(found, rules).groupBy("rule").agg(F.count("*").alias("n"))


def q_robots(spark: SparkSession, d: str) -> DataFrame:
    """Requests allowed by a robots file, by path."""
    requests = table(spark, d, "scheduler_requests").select("request_id", "url")
    policies = requests.select(robots.origin(F.col("url")).alias("origin")).distinct().withColumns({"status": F.lit(200), "body": F.lit(ROBOTS)})
    return robots.check(requests, policies, "anybot/1.0").groupBy("allowed").agg(F.count("*").alias("n"), F.max("delay").alias("delay"))


def q_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages by adaptive domain."""
    return _pages(spark, d).groupBy(urls.adaptive_domain(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def q_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical URLs of the pages."""
    return _pages(spark, d).select("page_id", urls.canonical_request(F.col("url")).alias("canonical"))


def q_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Computed fingerprints of all requests; null for a broken URL."""
    return frontier.with_fingerprint(table(spark, d, "scheduler_requests")).select("request_id", "fp")


def q_schedule(spark: SparkSession, d: str) -> DataFrame:
    """All requests that a scheduler takes, in the order it gives them out, within each crawl."""
    own = frontier.with_fingerprint(table(spark, d, "scheduler_requests")).select("request_id", "crawl_id", "priority", "dont_filter", "fp")
    own = materialize(own, "schedule")  # fingerprints are made once
    return frontier.dequeue_order(frontier.accepted(own, "request_id"), "request_id", "crawl_id").select("crawl_id", "request_id", "place")


def q_schedule_global(spark: SparkSession, d: str) -> DataFrame:
    """Orders in one global priority order."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (10 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"))
    return frontier.dequeue_order(rows, "id").select("id", "place")


def q_seen(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose computed fingerprint isn't in any snapshot; broken URLs have none and are left in."""
    seen = table(spark, d, "scheduler_snapshots").select(F.explode("seen").alias("fp")).distinct()
    return q_fingerprints(spark, d).join(seen, "fp", "left_anti").select("request_id")


def q_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merged results with their scores."""
    m = merge.merge_results(table(spark, d, "web_extract_results"))
    return m.select("call_id", "url", "title", "content", F.round("score", 6).alias("score"), F.size("providers").cast("long").alias("n_providers"), F.element_at("providers", 1)["provider"].alias("first_provider"), F.array_join("suggestions", "|").alias("suggestions"), F.coalesce(F.size("fields"), F.lit(-1)).cast("long").alias("n_fields"))


def q_rank(spark: SparkSession, d: str) -> DataFrame:
    """The three best merged results of each call."""
    return merge.ranked(merge.merge_results(table(spark, d, "web_extract_results"))).where("rank <= 3").select("call_id", "url", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def q_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct suggestions of each call in the order they first come."""
    return merge.suggestions(table(spark, d, "web_extract_results")).select("call_id", "suggestion", F.col("ord").cast("long").alias("ord"))


def q_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of titles and contents' first lines."""
    w = table(spark, d, "web_extract_results").where("title is not null and content is not null")
    return w.select("result_id", F.round(T.string_similarity(F.col("title"), F.split("content", "\n")[0]), 6).alias("similarity"))


def q_relocate(spark: SparkSession, d: str) -> DataFrame:
    """Each page's h1 found again, among all elements, by the fingerprint stored for the h1 of its host's
    first page."""
    pages = _pages(spark, d)
    own = lambda df: df.withColumn("domain", urls.adaptive_domain(F.col("url"))).drop("url")
    stored = own(adaptive.element_fingerprints(pages, ("h1",))).groupBy("domain").agg(F.min_by("fp", "page_id").alias("fp")).withColumns({"identifier": F.lit("h1"), "version": F.lit(1).cast("long")})
    return adaptive.relocate(own(adaptive.element_fingerprints(pages)), stored).select("page_id", "identifier", "node_id", F.round("score", 6).alias("score"))


def q_relocated_text(spark: SparkSession, d: str) -> DataFrame:
    """What the relocated h1 of each page says."""
    found = q_relocate(spark, d).select("page_id", "node_id")
    nodes = N.dom_nodes(_pages(spark, d), ["page_id", "node_id", "tag", "text_full"])
    return found.join(nodes, ["page_id", "node_id"]).select("page_id", "tag", F.col("text_full").alias("h1"))


def q_similar(spark: SparkSession, d: str) -> DataFrame:
    """Articles similar to the first one of their page."""
    fps = adaptive.element_fingerprints(_pages(spark, d), ("article",))
    asked = fps.groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    return adaptive.similar(fps, asked).groupBy("page_id").agg(F.count("*").alias("n_similar"))


def q_json_path(spark: SparkSession, d: str) -> DataFrame:
    """Values at a slash path of the requests' meta."""
    own = table(spark, d, "scheduler_requests").where("meta is not null")
    return own.select("request_id", F.try_element_at(json_path.json_values(F.col("meta"), "depth"), F.lit(1)).alias("depth"))


def q_regex(spark: SparkSession, d: str) -> DataFrame:
    """All numbers with decimals in each document, counted and summed."""
    found = T.regex_all(F.col("text"), r"([0-9]+)\.([0-9]+)", 2)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("groups"))


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Titles of results, normalised."""
    return table(spark, d, "web_extract_results").where("title is not null").select("result_id", T.normalize_space(F.col("title")).alias("title"))


def q_extension(spark: SparkSession, d: str) -> DataFrame:
    """Content types and path extensions of results."""
    w = table(spark, d, "web_extract_results").where("extraction is not null")
    path = F.regexp_extract(F.trim("url"), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return w.groupBy(urls.media_type(F.col("extraction.content_type")).alias("media_type"), urls.extension(F.concat(path, F.when(F.col("result_id") % 2 == 0, ".PDF;x").otherwise(""))).alias("extension")).agg(F.count("*").alias("n"))


def q_stats(spark: SparkSession, d: str) -> DataFrame:
    """Crawl statistics of the cached responses."""
    c = table(spark, d, "response_cache_records")
    others = F.element_at(F.array(*map(F.lit, ["failed", "skipped", "offsite", "robots", "dropped"])), (F.col("record_id") % 5).cast("int") + 1)
    outcome = F.when(F.col("record_id") % 7 == 0, others).when(frontier.is_blocked(F.col("status")), "blocked").otherwise("ok")
    log = c.select(outcome.alias("outcome"), "status", F.lit(None).cast("string").alias("sid"), urls.host(F.col("url")).alias("host"), F.coalesce(F.length(F.unbase64("content")), F.lit(0)).cast("long").alias("bytes"), F.lit(0).cast("long").alias("items"))
    return frontier.crawl_stats(log)


def q_retries(spark: SparkSession, d: str) -> DataFrame:
    """Requests to be sent again after a block."""
    c = table(spark, d, "response_cache_records").select("record_id", "url", "status", F.lit(0).alias("priority"), F.lit(1).alias("retry_count"), F.lit(False).alias("dont_filter"))
    return frontier.retries(c).select("record_id", F.col("retry_count").cast("long").alias("retry_count"), F.col("priority").cast("long").alias("priority"))


def q_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Proxies in turn over the events of each user."""
    e = table(spark, d, "events").select("event_id", "user_id")
    return frontier.rotate(e, "event_id", PROXIES, "user_id").select("event_id", "choice")


def q_history(spark: SparkSession, d: str) -> DataFrame:
    """The five latest events of each user."""
    return frontier.last_n(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", F.col("ago").cast("long").alias("ago"))


def q_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Two waves from the first page of each host over the links of all pages."""
    pages = _pages(spark, d)
    seeds = pages.groupBy(urls.adaptive_domain(F.col("url"))).agg(F.min_by("url", "page_id").alias("url")).select("url")
    return frontier.crawl(seeds, pages, lambda p: links.extract_links(p, links.LinkExtractor(restrict_css=("nav",))), 2, ["example", "test"]).groupBy("wave").agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

_A = r"""(select page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '<a[^>]*? href="([^"]*)"', 1)) href, generate_subscripts(regexp_extract_all(coalesce(html, ''), '<a[^>]*? href="([^"]*)"', 1), 1) ord from pages)"""
_NAV = _A.replace("coalesce(html, '')", "regexp_extract(coalesce(html, ''), '<nav>(.*?)</nav>', 1, 's')")
_MAIN = _A.replace("coalesce(html, '')", "regexp_extract(coalesce(html, ''), '<main[^>]*>(.*?)</main>', 1, 's')")
_HOST = r"lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]+)', 1))"
_H1 = r"trim(regexp_replace(" + DECODE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')") + r", '\s+', ' ', 'g'))"
_ARTICLES = r"""(select page_id, unnest(regexp_extract_all(html, '<article class="card" data-sku="([^"]*)"', 1)) sku, generate_subscripts(regexp_extract_all(html, '<article class="card" data-sku="([^"]*)"', 1), 1) nth from pages)"""
_KEY = "coalesce(nullif(trim(extraction.final_url), ''), trim(url))"
_MERGED = f"""(with r as (select *, row_number() over (partition by call_id order by result_id) pos, {_KEY} u from web_extract_results),
w as (select *, case when extraction.provider_weight > 0 then extraction.provider_weight else 1.0 end wt from r)
select call_id, u url, sum(wt / pos) score, min(pos) pos from w group by call_id, u)"""

SQL = {
    "q_outlinks": f"select {_HOST} host, count(*) n_links, count(distinct href) n_targets from {_NAV} group by 1",
    "q_css_attr": f"select page_id, ord::int ord, {DECODE.format('href')} href from {_A}",
    "q_css_text": f"select page_id, {_H1} h1 from pages where {_H1} <> ''",
    "q_css_cards": r"""select page_id, generate_subscripts(regexp_extract_all(html, '<span class="price">([^<]*)</span>', 1), 1)::int ord, unnest(regexp_extract_all(html, '<span class="price">([^<]*)</span>', 1)) price from pages""",
    "q_xpath_attr": f"select page_id, nth::int ord, sku from {_ARTICLES}",
    "q_nth_of_type": f"select page_id, nth::int nth_of_type, sku from {_ARTICLES}",
    "q_dom_counts": "select tag, sum(n)::bigint n from (select t tag, len(regexp_extract_all(regexp_replace(coalesce(html, ''), '(<script[^>]*>).*?(</script>|$)', '\\1', 'gs'), '<' || t || '[ >]')) n from pages, (select unnest(['a', 'li', 'h2', 'span', 'meta', 'script', 'nav']) t)) group by 1 having sum(n) > 0",
    "q_neighbours": f"select page_id, ord::int ord, href, lead(href) over w next_href, lag(href) over w previous_href from {_NAV} window w as (partition by page_id order by ord)",
    "q_search_text": f"select page_id, {_H1} h1 from pages where contains(lower({_H1}), 'guide')",
    "q_search_regex": r"""select page_id, unnest(regexp_extract_all(html, '<span class="price">([0-9]+\.[0-9][0-9]) EUR</span>', 1))::double price from pages""",
    "q_markdown_h1": f"select page_id, case when {_H1} <> '' then '# ' || {_H1} else '' end first_block from pages",
    "q_opengraph": "select page_id, k \"key\", opengraph[k] \"value\" from (select page_id, opengraph, unnest(map_keys(opengraph)) k from structured_data where page_id in (select page_id from pages where html is not null))",
    "q_jsonld": "select page_id, (generate_subscripts(jsonld, 1) - 1)::int ord, unnest(jsonld) text from structured_data where page_id in (select page_id from pages where html is not null)",
    "q_hosts": f"select coalesce(nullif({_HOST}, ''), 'default') host, count(*) n from pages group by 1",
    "q_schedule_global": "select o_orderkey id, row_number() over (order by 10 - substr(o_orderpriority, 1, 1)::int desc, o_orderkey) place from orders",
    "q_merge": "select call_id, url, title, content, round(score, 6) score, len(providers)::bigint n_providers, providers[1].provider first_provider, coalesce(array_to_string(suggestions, '|'), '') suggestions, coalesce(cardinality(fields), -1)::bigint n_fields from merged_results",
    "q_rank": f"select call_id, url, rank, round(score, 6) score from (select *, row_number() over (partition by call_id order by score desc, pos) rank from {_MERGED}) where rank <= 3",
    "q_suggestions": """with s as (select call_id, result_id, trim(unnest(suggestions)) s, generate_subscripts(suggestions, 1) i from web_extract_results),
f as (select call_id, s, min((result_id, i)) m from s where s <> '' group by all)
select call_id, s suggestion, row_number() over (partition by call_id order by m) ord from f""",
    "q_json_path": "select request_id, json_extract_string(meta, '$.depth') depth from scheduler_requests where meta is not null",
    "q_regex": r"""select doc_id, 2 * len(regexp_extract_all(text, '([0-9]+)\.([0-9]+)'))::bigint n, replace(array_to_string(regexp_extract_all(text, '([0-9]+)\.([0-9]+)'), ','), '.', ',') "groups" from documents where text is not null""",
    "q_normalize": r"select result_id, trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) title from web_extract_results where title is not null",
    "q_extension": r"""select lower(trim(split_part(extraction.content_type, ';', 1))) media_type, case when url is null then null when result_id % 2 = 0 then 'pdf' else lower(regexp_extract(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '\.([^./]*)/*$', 1)) end "extension", count(*) n from web_extract_results where extraction is not null group by all""",
    "q_retries": "select record_id, 2::bigint retry_count, -1::bigint priority from response_cache_records where status in (401, 403, 407, 429, 444, 500, 502, 503, 504)",
    "q_rotation": f"select event_id, {PROXIES!r}[(row_number() over (partition by user_id order by event_id) - 1) % 3 + 1] choice from events",
    "q_history": "select user_id, event_id, ago from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) - 1 ago from events) where ago < 5",
    "q_jaccard": r"""with t as (select result_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) a, lower(trim(regexp_replace(split_part(content, chr(10), 1), '\s+', ' ', 'g'))) b from web_extract_results where title is not null and content is not null),
s as (select *, list_distinct(regexp_extract_all(a, '[\p{L}\p{N}]+')) x, list_distinct(regexp_extract_all(b, '[\p{L}\p{N}]+')) y from t)
select result_id, round(case when a = b then 1.0 when a = '' or b = '' then 0.0 when len(x) + len(y) = 0 then 1.0 else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end, 6) similarity from s""",
    "q_stats": r"""with a as (select *, case when record_id % 7 = 0 then ['failed', 'skipped', 'offsite', 'robots', 'dropped'][record_id % 5 + 1] when status in (401, 403, 407, 429, 444, 500, 502, 503, 504) then 'blocked' else 'ok' end o, coalesce(octet_length(from_base64(content)), 0) n, lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]+)', 1)) h from response_cache_records),
l as (select * from a where o in ('ok', 'blocked')),
t as (select count(*) filter (o in ('ok', 'blocked')) requests, 0 items, count(*) filter (o = 'blocked') blocked, count(*) filter (o = 'failed') failed, count(*) filter (o = 'skipped') skipped, count(*) filter (o = 'offsite') offsite, count(*) filter (o = 'robots') robots, count(*) filter (o = 'dropped') dropped, sum(n) filter (o in ('ok', 'blocked')) bytes from a)
select '' "key", name, value::bigint "value" from (unpivot t on columns(*) into name name value value)
union all select 'status', status::varchar, count(*) from l where status is not null group by 2 union all select 'host', h, sum(n)::bigint from l group by 2""",
}

_CLEAN = lambda x: f"trim(regexp_replace({DECODE.format(x)}, '\\s+', ' ', 'g'))"
_TITLE = _CLEAN("regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1, 's')")
_ALL = f"""(select page_id, {DECODE.format("m[1]")} href, {_CLEAN("regexp_replace(m[2], '<[^>]*>', ' ', 'g')")} t, i, inmain, innav from
(select page_id, [regexp_extract(x, ' href="([^"]*)"', 1), regexp_extract(x, '^<a[^>]*>(.*)</a>$', 1, 's')] m, i, contains(regexp_extract(html, '<main[^>]*>(.*?)</main>', 1, 's'), x) inmain, contains(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), x) innav from
(select page_id, html, unnest(regexp_extract_all(coalesce(html, ''), '<a[^>]*? href="[^"]*"[^>]*>.*?</a>', 0, 's')) x, generate_subscripts(regexp_extract_all(coalesce(html, ''), '<a[^>]*? href="[^"]*"[^>]*>.*?</a>', 0, 's'), 1) i from pages)))"""
_FULL = lambda tag: _CLEAN(f"regexp_replace(regexp_extract(coalesce(html, ''), '<{tag}[^>]*>(.*?)</{tag}>', 1, 's'), '<[^>]*>', ' ', 'g')")
SQL |= {
    "q_title": f"select page_id, {_TITLE} title from pages",
    "q_xpath_nth": f"select page_id, {DECODE.format('l')} label from (select page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a[^>]*>([^<]*)</a></li>', 1)[2] l from pages) where l <> ''",
    "q_css_union": f"select page_id, (2 * (h <> '')::int + (t <> '')::int)::bigint n, (2 * (h <> '')::int + (t <> '')::int)::bigint n_branches from (select page_id, coalesce({_H1}, '') h, {_TITLE} t from pages) where h <> '' or t <> ''",
    "q_descendants": f"select page_id, count(*)::bigint n_links from {_MAIN} group by 1",
    "q_children": "select page_id, len(regexp_extract_all(html, '<li>'))::bigint n_items from pages where len(regexp_extract_all(html, '<li>')) > 0",
    "q_full_text": f"select page_id, {_FULL('footer')} footer from pages where html like '%<footer%'",
    "q_semantic_headings": "select t tag, sum(n)::bigint n from (select 'h' || k t, len(regexp_extract_all(coalesce(html, ''), '<h' || k || '>')) n from pages, (select unnest([1, 2]) k)) group by 1",
    "q_link_view": f"select page_id, (row_number() over (partition by page_id order by i))::int ord, t \"text\", href from {_ALL} where t <> '' and href <> ''",
    "q_interactive": f"select page_id, 'link' \"role\", count(*) n from {_ALL} where t <> '' and href <> '' group by 1",
    "q_links": f"select page_id, count(distinct href) n_links from {_ALL} where href not like 'mailto:%' and href <> '' group by 1",
    "q_link_scope": f"select page_id, count(distinct href) n_links from {_ALL} where inmain and href not like 'mailto:%' group by 1",
    "q_link_drops": f"select case when href = '' then 'empty_raw' when href like 'mailto:%' or href like '%?ref=%' then 'filtered' else '' end reason, count(*) n from {_ALL} group by 1",
    "q_canonical": "select page_id, regexp_replace(url, '#.*$', '') canonical from pages",
    "q_relocated_text": f"select page_id, 'h1' tag, {_H1} h1 from pages where html like '%<h1>%'",
    "q_similar": r"""select page_id, len(regexp_extract_all(html, '<article class="card"')) - 1 n_similar from pages where len(regexp_extract_all(html, '<article class="card"')) > 1""",
    "q_crawl": f"""with p as (select page_id, url, {_HOST} h from pages), s as (select h, arg_min(url, page_id) url, min(page_id) page_id from p group by h),
n as (select distinct regexp_extract(s.url, '^([a-z]+://[^/]+)', 1) || a.href u from s join {_ALL} a on a.page_id = s.page_id where a.innav and (s.h like '%.example' or s.h like '%.test') and a.href like '/%')
select 0::int wave, count(*) n from s union all select 1, count(*) from n where u not in (select url from s)""",
}
# Fingerprints from their definition, for the addresses of this data.
_PARTS = """(select *, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) head, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) path, case when regexp_matches(url, '^[^#]*\\?') then regexp_extract(url, '\\?([^#]*)', 1) end q from scheduler_requests)"""
_SORTED = """list_transform(list_sort(list_transform(list_zip(list_filter(string_split(q, '&'), lambda x: x <> ''), range(100)), lambda z: {'k': url_decode(replace(split_part(z[1], '=', 1), '+', ' ')), 'i': z[2], 'v': url_decode(replace(substr(z[1], len(split_part(z[1], '=', 1)) + 2), '+', ' ')), 'p': z[1]})),
 lambda s: replace(url_encode(s.k), '%20', '+') || '=' || replace(url_encode(s.v), '%20', '+'))"""
_CANON = f"lower(head) || path || case when q is null then '' when q = '' then '?' else '?' || array_to_string(list_filter({_SORTED}, lambda x: x is not null and x <> '='), '&') end"
_SHA = f"""(select *, sha1('{{"body":"' || lower(hex(coalesce(body, '')::blob)) || '","method":"' || coalesce(nullif(upper("method"), ''), 'GET') || '","sid":"' || coalesce(sid, '') || '","url":"' || replace({_CANON}, '&', '\\u0026') || '"}}') fp from {_PARTS})"""
_TAKEN = f"""(with r as (select * from {_SHA}) select * from r where dont_filter union all select * exclude (n) from (select *, row_number() over (partition by fp order by request_id) n from r where not dont_filter) where n = 1)"""
SQL |= {
    "q_selectors": "select page_id, '#m > h1' css, 'body > main > h1' css_full, '//*[@id=''m'']/h1' xpath, '//body/main/h1' xpath_full, true same from pages where html like '%<h1>%'",
    "q_cleaned": f"select page_id, {_FULL('main')} \"text\" from pages",
    "q_rules": r"""select case when regexp_matches(url, '[?&]page=') then 'paged' when regexp_matches(lower(url), '^[a-z]+://([^/?#:]*\.)?example[/?#:]') then 'example' else 'rest' end "rule", count(*) n from scheduler_requests group by 1""",
    "q_robots": r"""select not (starts_with(p, '/column') and not starts_with(p, '/column/a') or regexp_matches(p, '^/item/.*\?ref=')) allowed, count(*) n, 0::double "delay" from (select regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^#]*)', 1) p from scheduler_requests) group by 1""",
    "q_diagnose": r"""select r::int "rank", r = 1 accepted, count(*) n from (select unnest(range(1, len(regexp_extract_all(html, '<article ')) + 1)) r from pages) group by all""",
    "q_fingerprints": f"select request_id, fp from {_SHA}",
    "q_seen": f"select request_id from {_SHA} where fp not in (select unnest(seen) from scheduler_snapshots where seen is not null)",
    "q_schedule": f"select crawl_id, request_id, row_number() over (partition by crawl_id order by priority desc, request_id) place from {_TAKEN}",
    "q_stream_new": f"select dont_filter, count(*) n, count(distinct fp) n_keys from {_TAKEN} group by 1",
    "q_static_extract": f"select page_id, {_TITLE} title, {_FULL('main')} content, case when html like '%<main%' then '' else 'css_selector matched no elements' end error from pages",
    "q_follow": f"select (page_id % 3)::int priority, count(*) n, count(*) n_referers from (select distinct page_id, href from {_ALL} where innav and href not like 'mailto:%' and href <> '') group by 1",
    "q_rules_every": r"""select 'paged' "rule", 5::int rule_priority, count(*) n from scheduler_requests where regexp_matches(url, '[?&]page=') union all select 'example', null, count(*) from scheduler_requests where regexp_matches(lower(url), '^[a-z]+://([^/?#:]*\.)?example[/?#:]')""",
}
