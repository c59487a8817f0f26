import json
import random
import sqlite3

import pytest

from pagewright.dom import nodes as N
from pagewright.functions import json_path, urls
from pagewright.functions import text as T
from pagewright.operators import adaptive, browser, frontier, ledger, links, recipes, requests, robots, views
from pagewright.sources import rendered, responses, sitemaps
from pyspark.sql import functions as F


def test_plain_urls_agree_with_python(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        u = rng.choice(["http://", "HTTPS://"]) + rng.choice(["A.test", "b.test:80", "me@c.test", "d_e.test"]) + rng.choice(["", "/", "/x/../y", "/a b", "/é", "/q;v=1", "//z"])
        u += rng.choice(["", "?", "?&", "?" + "&".join(rng.choice(["b=2", "a=1", "a", "a+b=c", "%41=x", "a=x=y", "", "z;y", "-=~"]) for _ in range(rng.randrange(1, 5)))]) + rng.choice(["", "#f", "#"])
        rows.append((i, u, rng.choice([None, "", "get", "PO-ST"]), rng.choice([None, "", "s", 'q"']), rng.choice([None, "", "body", "é"])))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "http://[::1", None, None, None), (1003, "x\x01", None, None, None)]
    df = spark.createDataFrame(rows, "i int, url string, method string, sid string, body string")
    c = F.col
    got = df.select("i", urls.canonical_request(c("url")).alias("a"), urls.canonical_request(c("url"), True).alias("b"), urls.request_fingerprint(c("url"), c("method"), c("sid"), c("body")).alias("f")).collect()
    by = {r[0]: r for r in rows}
    for r in got:
        _, u, m, s, b = by[r["i"]]
        assert (r["a"], r["b"], r["f"]) == (urls.canonical_request_url(u), urls.canonical_request_url(u, True), urls.fingerprint(u, m, s, b)), by[r["i"]]


def test_dequeue_order_with_a_hot_partition(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", None]), rng.randrange(4), float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, crawl string, priority int, d double")
    want, last = {}, {}
    for i, g, p, d in sorted(rows, key=lambda r: (str(r[1]), -r[2], r[0])):
        last[g] = want[i] = last.get(g, 0) + 1
    assert {r["id"]: r["place"] for r in frontier.dequeue_order(df, "id", "crawl").collect()} == want
    hosts = df.withColumn("url", F.concat(F.lit("http://"), F.coalesce("crawl", F.lit("none")), F.lit(".test/")))
    start, last = {}, {}
    for i, g, p, d in sorted(rows, key=lambda r: (-r[2], r[0])):
        start[i] = last.get(g, 0.0)
        last[g] = start[i] + d
    assert {r["id"]: r["starts_at"] for r in frontier.start_times(hosts, "id", F.col("d")).collect()} == start
    assert frontier.dequeue_order(df.limit(0), "id", "crawl").count() == 0


def test_nodes_only_what_is_asked(spark):
    df = spark.createDataFrame([(1, "u", '<p id=a id=b>x <b>y</b></p><p>z</p>', 1), (2, None, None, 2)], "page_id long, url string, html string, tag int")
    every = {r["node_id"]: r.asDict() for r in N.dom_nodes(df).where("page_id = 1 and tag = 'p'").collect()}
    some = N.dom_nodes(df, ["page_id", "node_id", "xpath", "text_full", "nth_of_type", "attr"], ["p"]).where("page_id = 1").collect()
    assert len(some) == 2 and all(every[r["node_id"]][k] == v for r in some for k, v in r.asDict().items())
    assert [r["attr"] for r in some if r["attr"]] == [{"id": "b"}] and {r["text_full"] for r in some} == {"x y", "z"}
    with pytest.raises(ValueError):
        N.dom_nodes(df, ["nope"])


def test_search_defaults(spark):
    nodes = N.dom_nodes(spark.createDataFrame([(1, "u", "<p>Big  News</p>")], "page_id long, url string, html string"))
    assert N.find_by_text(nodes, " big news ").count() == 1 and N.find_by_text(nodes, "big news", case=True).count() == 0
    assert N.find_by_regex(nodes, "^BIG").count() == 1 and N.find_by_regex(nodes, "^BIG", case=True).count() == 0


def test_regex_all_decodes(spark):
    df = spark.createDataFrame([("a=&lt;1&gt; a=2", 1), (None, 2)], "t string, i int")
    got = [r[0] for r in df.select(T.regex_all(F.col("t"), r"a=(\S+)", 1)).collect()]
    assert got == [["<1>", "2"], []]


def test_links_schemes_and_hosts():
    e = links.LinkExtractor(deny_domains=("h.test",))
    assert not e.passes("ftp://x.test/a") and e.passes("file:///a") and not e.passes("http://h.test./a") and e.passes("http://i.test./a")


def test_sitemap_limit(monkeypatch):
    import gzip

    monkeypatch.setattr(sitemaps, "LIMIT", 1000)
    ok = b"<urlset><url><loc>http://a.test/</loc></url></urlset>"
    assert list(sitemaps.parse_sitemap(gzip.compress(ok))) == [("url", "http://a.test/")]
    with pytest.raises(ValueError):
        list(sitemaps.parse_sitemap(gzip.compress(ok + b" " * 2000)))


def test_redirects_past_the_limit(spark):
    hops = spark.createDataFrame([(str(i), str(i + 1)) for i in range(8)] + [("x", "y"), ("y", "x"), ("s", "s")], "source string, target string")
    start = spark.createDataFrame([("0",), ("4",), ("x",), ("s",), ("none",)], "url string")
    got = {r["url"]: (r["final_url"], r["error"]) for r in frontier.redirect_history(start, hops, 5).collect()}
    assert got == {"0": ("5", "stopped after 5 redirects"), "4": ("8", None), "x": ("y", "redirect loop"), "s": ("s", "redirect loop"), "none": ("none", None)}


def test_stores(spark, tmp_path):
    fp = (("p", "t", {"id": "a"}, "div", "", {}, [], [], ["div", "p"]),)
    store = spark.createDataFrame([("a.test", " k ", fp[0], 1), ("a.test", "k", fp[0], 3)], f"domain string, identifier string, fp {adaptive.FINGERPRINT}, version long")
    one = adaptive.upsert(store.limit(0), store)
    assert [(r["identifier"], r["version"]) for r in one.collect()] == [("k", 3)]
    adaptive.write_store(one, str(tmp_path / "s"))
    assert adaptive.read_store(spark, str(tmp_path / "s")).collect()[0]["fp"]["tag"] == "p"
    assert adaptive.read_store(spark, str(tmp_path / "missing")).count() == 0
    db = str(tmp_path / "s.db")
    adaptive.export_database(one, db)
    adaptive.export_database(one.withColumn("version", F.lit(2).cast("long")), db)  # older: stays out
    back = adaptive.import_database(spark, db).collect()
    assert len(back) == 1 and back[0]["version"] == 3 and back[0]["fp"]["attributes"] == {"id": "a"}
    with sqlite3.connect(db) as c:
        c.execute("pragma user_version = 9")
    with pytest.raises(ValueError):
        adaptive.import_database(spark, db)
    with pytest.raises(Exception, match="identifier"):
        adaptive.upsert(store, store.withColumn("identifier", F.lit(" "))).collect()


def test_json_array(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, 'x"é')], "i int, t string")
    for indent in (False, True):
        path = tmp_path / "d" / f"{indent}.json"
        responses.write_json_array(df, str(path), "i", indent)
        assert json.loads(path.read_text()) == [{"i": 1, "t": 'x"é'}, {"i": 2, "t": None}]
    responses.write_json_array(df.limit(0), str(path), "i")
    assert path.read_text() == "[]"


def test_pages_and_views_as_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a")
    pages = responses.read_pages(spark, str(tmp_path))
    assert [r["html"] for r in pages.collect()] == ["<p>a"]
    out = tmp_path / "v.htm"
    assert responses.view_file(pages, str(out)) == str(out) and out.read_text() == "<p>a"
    with pytest.raises(ValueError):
        responses.view_file(pages.limit(0), str(out))


def test_lcs_against_brute_force(spark):
    from functools import lru_cache

    def lcs(a, b):
        @lru_cache(None)
        def f(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

        return f(0, 0)

    rng = random.Random(3)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abc") for _ in range(rng.randrange(6))]) for _ in range(80)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>")
    for r in df.select("i", "a", "b", adaptive.sequence_similarity("a", "b").alias("s")).collect():
        a, b = r["a"], r["b"]
        assert r["s"] == (lcs(tuple(a), tuple(b)) / max(len(a), len(b)) if a and b else float(not a and not b))


def test_percentage_limits_and_names():
    assert adaptive.percentage(0) == adaptive.ACCEPT and adaptive.percentage(50) == 0.5
    with pytest.raises(ValueError):
        adaptive.percentage(101)
    assert requests.effective(None, 4) == requests.effective(0, 4) == requests.effective(-1, 4) == 4 and requests.effective(-1, 3, 0) == 0 and requests.effective(7, 3) == 7
    assert recipes.paging(3, 10) == 21 and recipes.paging(0) == 1 and recipes.language("de-AT") == "de" and recipes.language("all") == "en" and recipes.chosen_value(" Strict ", {"strict": "2"}) == "2"


def test_recipes_skip_no_result_statuses(spark):
    df = spark.createDataFrame([(1, "u", "<h1>a</h1>", 200), (2, "u", "<h1>b</h1>", 404), (3, "u", "<h1>c</h1>", None)], "page_id long, url string, html string, status int")
    assert {r["page_id"] for r in recipes.extract(df, [recipes.Field("h", "h1")], [404]).collect()} == {1, 3}


def test_static_errors(spark):
    df = spark.createDataFrame([(1, "u", "<title>t</title><p></p>", 200), (2, "u", "<p>x</p>", 500), (3, "u", "<p>x</p>", None), (4, None, None, 204)], "page_id long, url string, html string, status int")
    got = {r["page_id"]: (r["content"], r["error"]) for r in recipes.static_extract(df, "div").collect()}
    assert got == {1: ("", "css_selector matched no elements"), 2: ("", "HTTP 500"), 3: ("", "HTTP 0"), 4: ("", "css_selector matched no elements")}
    body = {r["page_id"]: r["content"] for r in recipes.projected(df).collect()}
    assert body == {1: [], 2: ["x"], 3: ["x"], 4: []}
    with pytest.raises(ValueError):
        recipes.projected(df, kind="pdf")


def test_robots_variants():
    body = "User-agent: *\nDisallow: /a\n\nDisallow: /b\nUser-agent: me\nAllow: /a/x\n"
    assert robots.literal_rules(body, "me") == [("/a", False), ("/a/x", True)]
    d = lambda **k: robots.strict_decision(**({"status": 200, "body": body, "url": "http://h.test/a", "token": "anybot"} | k))
    assert d()[0] is False and d(status=None)[1] == "robots.txt unavailable" and d(body=" ")[1] == "empty robots.txt" and d(body="<html>")[1] == "not a usable robots.txt"
    assert d(url="nope")[0] is False and d(body="User-agent: x\nDisallow: /")[1] == "no matching robots rules"
    assert d(body="User-agent: any\nCrawl-delay: 3\n\nDisallow: /*.php$")[1:] == ("specific robots group has no matching path rule", 3.0)
    assert robots.strict_match("/a$", "/a") and not robots.strict_match("/a$", "/ab") and robots.strict_match("/*/c", "/b/c") and not robots.strict_match("/*/c", "/b/cd")


def test_browser_options():
    assert browser.problems(browser.Options()) == []
    bad = browser.Options(proxy="ftp://x", remote="nope", extra_flags=(" ",), wait_state="soon", actions=(("click", "", ""), ("evaluate", "", ""), ("jump", "a", "")), capture_xhr="(", screenshot_quality=200, screenshot_selector="a", screenshot_full_page=True, user_agent="a\nb", stealth=browser.Stealth(solve_challenge=True))
    assert len(browser.problems(bad)) == 12
    assert browser.problems(browser.Options(proxy_user="u")) == ["proxy credentials need a proxy"]
    s = browser.Stealth(block_webrtc=True).merged(browser.Stealth(google_referer=True))
    assert s.enabled and s.google_referer and s.flags(("a", "a")) == ["a", "--force-webrtc-ip-handling-policy=disable_non_proxied_udp"]
    assert browser.block_patterns([" .A.test ", "", "a.test"]) == ["*://*.a.test/*", "*://a.test/*"] and len(browser.block_patterns([], True, True)) == 25


def test_request_options(spark):
    with pytest.raises(ValueError):
        requests.Session("s", proxy="http://a", rotate=("http://b",))
    for bad in ({"url": "http://a.test", "by_scheme": {"http": "http://b.test"}}, {"auth": ("a", "b")}, {"by_scheme": {"ftp": "http://a.test"}}, {"url": "nope"}):
        with pytest.raises(ValueError):
            requests.Proxies(**bad)
    df = spark.createDataFrame([(1, "http://a.test/", None, None, None, None)], "request_id long, url string, headers map<string,array<string>>, body string, data map<string,array<string>>, json string")
    with pytest.raises(ValueError):
        requests.prepare(df, http3=True)
    got = requests.prepare(df, {"q": ["x y"]}, stealthy=True).first()
    assert got["url"] == "http://a.test/?q=x+y" and got["body"] is None and set(got["headers"]) == set(requests.BROWSER_HEADERS)


def test_safe_with_robots(spark):
    r = spark.createDataFrame([(1, "GET", "http://h.test/no"), (2, "GET", "http://h.test/yes"), (3, "GET", "http://[::1]/"), (4, "GET", None)], "request_id long, method string, url string")
    p = spark.createDataFrame([("http://h.test", 200, "User-agent: *\nDisallow: /no")], "origin string, status int, body string")
    got = {x["request_id"]: x["error_kind"] for x in requests.safe(r, policies=p).collect()}
    assert got == {1: "robots", 2: None, 3: "private_address", 4: None}
    with pytest.raises(ValueError):
        requests.safe(r, blocked=("10.0.0.0/99",))


class Flaky:
    made = 0

    def page(self):
        return self

    def close(self):
        pass

    def fetch(self, url, options):
        if "bad" in url:
            raise OSError("down")
        return 200, url, [("http://x.test/api", 201, "{}")]


def test_rendered_and_pool(spark):
    df = spark.createDataFrame([(1, "http://a.test"), (2, "http://bad.test"), (3, None), (4, " ")], "request_id long, url string")
    got = rendered.rendered(df, Flaky, 0)
    rows = {r["request_id"]: (r["status"], r["error"]) for r in got.collect()}
    assert rows == {1: (200, None), 2: (None, "OSError: down"), 3: (None, "url is required"), 4: (None, "url is required")}
    assert [(r["request_id"], r["status"]) for r in rendered.captured(got).collect()] == [(1, 201)]
    pool = rendered.Pool(Flaky(), 1)
    pool.fetch("http://a", {})
    with pytest.raises(OSError):
        pool.fetch("http://bad", {})
    assert pool.counts == {"ready": 0, "busy": 0, "failed": 1}


def test_semantic_names_and_labels(spark):
    html = '<label for=q> Find  me </label><input id=q><button value=Go></button><input type=submit value=Send><a href=/x title=T>y</a><input type=checkbox aria-label=C checked disabled>'
    got = [(r["role"], r["name"], r["checked"], r["disabled"]) for r in views.semantic_view(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).orderBy("id").collect()]
    assert got == [("textbox", "Find me", False, False), ("button", "Go", False, False), ("button", "Send", False, False), ("link", "T", False, False), ("checkbox", "C", True, True)]


def test_json_text(spark):
    assert [json_path.text_of(x) for x in (None, True, " a  b ", 3.0, 0.25, {"b": 1, "a": [None]})] == [None, "true", "a b", "3", "0.25", '{"a":[null],"b":1}']


def test_ledger_sections(spark):
    df = spark.createDataFrame([(1, "a|b\nc", None)], "i int, t string, e string")
    assert [r["line"] for r in ledger.markdown_table(df, ["t", "e"], ["i"]).orderBy("place").collect()] == ["| t | e |", "|---|---|", "| a\\|b c | - |"]
    with pytest.raises(ValueError):
        ledger.selected(df, "all")


def test_retry_clears_its_proxy(spark):
    df = spark.createDataFrame([(503, 0, 1, False, "http://p")], "status int, retry_count int, priority int, dont_filter boolean, proxy string")
    r = frontier.retries(df).first()
    assert r["proxy"] is None and r["retry_count"] == 1 and r["dont_filter"]


def test_scalars_in_lists(spark):
    from pagewright.operators import nested

    rows = spark.createDataFrame([(1, ['{"a": ["x", [true, null], {"b": 1}], "c": [[{}]]}'])], "page_id long, items array<string>")
    nodes = nested.json_nodes(rows, "page_id", "items", items=True)
    items = {(r["node_path"], tuple(r["ordinals"]), r["kind"], r["value"]) for r in nested.list_items(nodes).collect()}
    assert items == {("$[0].a[0]", (0,), "string", "x"), ("$[0].a[1][0]", (1, 0), "boolean", "true"), ("$[0].a[1][1]", (1, 1), "null", None)}
    assert {(r["node_path"], tuple(r["ordinals"])) for r in nested.objects(nodes).collect()} == {("$[0]", (0,)), ("$[0].a[2]", (2,)), ("$[0].c[0][0]", (0, 0))}


def test_tools_and_sessions(spark):
    from pagewright import tools

    assert len(tools.TOOLS) == 10
    for tool, args in (("nope", {}), ("get", {}), ("get", {"url": " "}), ("get", {"url": "a", "x": 1}), ("bulk_get", {"urls": []}), ("get", {"url": "a", "extraction_type": "pdf"}), ("get", {"url": 3})):
        with pytest.raises(ValueError):
            tools.checked(tool, args)
    s = tools.Sessions(Flaky)
    a, b = s.open(), s.open(" mine ", "stealthy", 0)
    assert (a.session_id, b.session_id, b.pool.size, b.options.stealth.enabled) == ("session-1", "mine", 5, True)
    assert [x["session_id"] for x in s.listed()] == ["mine", "session-1"] and s.get("mine", "stealthy") is b
    for bad in (lambda: s.open("mine"), lambda: s.open(kind="other"), lambda: s.get("mine", "dynamic"), lambda: s.get("none", "dynamic"), lambda: s.close("none"), lambda: s.open(options=browser.Options(wait_state="x"))):
        with pytest.raises(ValueError):
            bad()
    s.close("mine")
    assert [x["session_id"] for x in s.listed()] == ["session-1"] and not b.alive
    pages = spark.createDataFrame([(1, "http://a.test/", "<main>m</main><p>p</p>", 200), (2, "http://b.test/", "<p>q</p>", 200)], "page_id long, url string, html string, status int")
    got = tools.bulk_get(pages, {"urls": ["http://a.test/", "http://c.test/"], "main_content_only": True}).collect()
    assert [(r["page_id"], r["content"]) for r in got] == [(1, ["m"])]


def test_command_line(spark, tmp_path, capsys):
    from pagewright.__main__ import main

    page = tmp_path / "p.html"
    page.write_text("<nav>n</nav><main><h1>T</h1><p>x</p></main>")
    assert main(["extract", str(page), str(tmp_path / "o" / "p.md")]) == 0 and (tmp_path / "o" / "p.md").read_text() == "# T\n\nx"
    assert main(["extract", str(page), str(tmp_path / "q.txt"), "--main", "--css", "h1"]) == 0 and (tmp_path / "q.txt").read_text() == "T"
    assert main(["select", str(page), "--xpath", "//h1/text()"]) == 0 and capsys.readouterr().out.splitlines()[-1] == "T"
    assert main(["extract", str(page), "x.pdf"]) == 1 and main(["extract"]) == 2 and main(["select", "missing", "--css", "a"]) == 1
    assert main(["queries"]) == 0 and "q_merge" in capsys.readouterr().out
    ledger_file = tmp_path / "l.json"
    ledger_file.write_text('{"phases": {"2": {"subphases": {"a": {"items": [{"status": "complete"}, {"status": "planned"}]}}}}}')
    assert main(["ledger", str(ledger_file), "rollup"]) == 0
    assert [json.loads(x)["status"] for x in capsys.readouterr().out.splitlines()] == ["in_progress", "in_progress"]


def test_crawl_with_robots_limits_and_items(spark, tmp_path):
    html = "".join(f"<a href=/{i}>x</a>" for i in range(6)) + "<a href=/no/1>y</a><a href=http://off.test/>z</a>"
    pages = spark.createDataFrame([(1, "http://h.test/", html, 200), (2, "http://h.test/0", "<a href=/deep>d</a>", 200), (3, "http://h.test/1", "<a href=/blocked>d</a>", 503)], "page_id long, url string, html string, status int")
    policies = spark.createDataFrame([("http://h.test", 200, "User-agent: *\nDisallow: /no")], "origin string, status int, body string")
    follow = lambda p: links.extract_links(p, links.LinkExtractor()).withColumn("priority", -F.col("ord"))
    target = str(tmp_path / "items")
    got = frontier.crawl(pages.where("page_id = 1").select("url"), pages, follow, 2, ["h.test"], policies, "bot", 3, lambda p: p.select("page_id"), target)
    assert sorted((r["url"], r["wave"]) for r in got.collect()) == [("http://h.test/", 0), ("http://h.test/0", 1), ("http://h.test/1", 1), ("http://h.test/2", 1), ("http://h.test/deep", 2)]
    assert sorted((r["page_id"], r["wave"]) for r in spark.read.parquet(target).collect()) == [(1, 0), (2, 1)]


def test_follow_ups_merge_meta(spark):
    found = spark.createDataFrame([(1, "http://a.test/x", {"a": "2", "c": "3"})], "page_id long, url string, meta map<string,string>")
    origin = spark.createDataFrame([(1, "http://a.test/", "GET", None, {"a": "1", "b": "1"})], "page_id long, request_url string, method string, headers map<string,array<string>>, meta map<string,string>")
    assert frontier.follow_ups(found, origin).first()["meta"] == {"a": "2", "b": "1", "c": "3"}


def test_adaptive_selection_needs_a_store(spark):
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
    with pytest.raises(ValueError):
        adaptive.select_adaptive(pages, "p", "k", None)


def test_checkpoints_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        frontier.load_checkpoint(spark, path)
    r = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, None, None)], "request_id long, fp string, dont_filter boolean")
    for n in (3, 2):
        frontier.save_checkpoint(r.where(f"request_id <= {n}"), r.where("fp = 'b'"), path)
        pending, seen = frontier.load_checkpoint(spark, path)
        assert pending.count() == n and {x[0] for x in seen.collect()} == {"a", "b"}


def test_the_stream_lets_the_first_request_of_a_key_through(spark, tmp_path):
    from pagewright.streaming import frontier as streaming

    schema = "request_id long, url string, method string, sid string, body string, dont_filter boolean"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [[(5, "http://a.test/", False), (3, "http://a.test/", None), (4, "http://b.test/", True)], [(1, "http://a.test/", False), (6, "http://b.test/", False), (7, None, False), (8, "http://b.test/", True)]]
    for rows in batches:
        spark.createDataFrame([(i, u, "GET", None, None, f) for i, u, f in rows], schema).coalesce(1).write.mode("append").parquet(source)
        streaming.run(streaming.request_stream(spark, source, spark.createDataFrame([], schema).schema), target, state).awaitTermination()
    got = {r["request_id"] for r in spark.read.parquet(target).collect()}
    assert got - {7} == {3, 4, 6, 8} and spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != streaming.ROCKSDB


def test_shared_folder(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from pagewright import session

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: d)))
    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://h:7077"))
    assert session.shared_dir(fake("local[2]")).startswith("file://")
    monkeypatch.setattr(session, "_made", [])
    df = session.materialize(spark.range(5).toDF("i"), "t")
    path = session._made[0][1]
    assert df.count() == 5
    session.release()
    assert not session._made and not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def test_small_inputs_are_spread(spark, tmp_path):
    from pagewright.session import spread

    path = str(tmp_path / "p")
    spark.range(100).coalesce(1).write.parquet(path)
    assert spread(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = str(tmp_path / "q")
    spark.range(100).repartition(8).write.parquet(many)
    plan = spread(spark.read.parquet(many))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
