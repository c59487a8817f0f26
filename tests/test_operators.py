import json

from pagewright.operators import adaptive, frontier, ledger, merge, nested
from pagewright.sources import curl, responses, sitemaps


def brute(value, path, parent):
    """(node_path, parent_path) of all objects, by recursion."""
    if isinstance(value, dict):
        yield path, parent
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}", path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}[{i}]", parent)


TEXTS = ['{"a": [1, {"b": [[{"c": null}], []]}], "d": {}}', "[{}]", '{"a": NaN}', '{"a": 1,}', None, "", '{"x": 1} {}', ' {"k.k": {"é": {}}} ', '{"a": 1, "a": {}}']


def test_nested_paths(spark):
    rows = spark.createDataFrame([(1, TEXTS, "x"), (2, None, "y"), (3, [], "z")], "page_id long, items array<string>, node_path string")
    got = sorted((r["node_path"], r["parent_path"]) for r in nested.json_nodes(rows, "page_id", "items").collect())
    want = sorted(x for i in (0, 7, 8) for x in brute(json.loads(TEXTS[i]), f"$[{i}]", ""))
    assert got == want


def test_deep_nesting_and_strictness():
    deep = '{"a":' * 20_000 + "{}" + "}" * 20_000
    assert len(list(nested.flat_rows(0, nested.strict_object(deep)))) == 20_001
    for t in TEXTS:
        a = nested.strict_object(t)
        b = nested._deep(t.strip()) if t and t.strip() else None
        assert (b if isinstance(b, dict) else None) == a


def test_child_tables(spark):
    rows = spark.createDataFrame([(1, ['{"o": [{"v": 1, "page_id": "p"}, {"V": true}]}'])], "page_id long, items array<string>")
    t = nested.child_table(nested.json_nodes(rows, "page_id", "items"), "$[].o[]")
    assert sorted((r["ordinal"], r["parent_path"]) for r in t.collect()) == [(0, "$[0]"), (1, "$[0]")] and len(t.columns) == 7


def test_map_nodes(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "a:b": "2", "x:y": "3", "a:b:c": None}), (2, None)], "page_id long, og map<string,string>")
    got = {r["node_path"]: r["parent_path"] for r in nested.map_nodes(rows, "page_id", "og", "og:").collect()}
    assert got == {"og:a": "", "og:a:b": "og:a", "og:x:y": "", "og:a:b:c": "og:a:b"}


RESULT = "call_id long, result_id long, url string, title string, content string, fields map<string,struct<type:string,value:string>>, suggestions array<string>, extraction struct<final_url:string,provider:string,provider_weight:double>"


def test_merge(spark):
    rows = [
        (1, 1, "u1", " T ", None, {"a": ("t", "1")}, ["s", " "], ("http://a", "docs", 2.0)),
        (1, 2, "u2", "", "x", None, None, None),
        (1, 3, "u1", "other", " c ", {"a": ("t", "9"), "b": ("t", "2")}, ["s", "t"], ("http://a ", "", -1.0)),
    ]
    got = {r["key"]: r for r in merge.merge_results(spark.createDataFrame(rows, RESULT)).collect()}
    a = got["http://a"]
    assert a["score"] == 2.0 + 1 / 3 and a["title"] == "T" and a["content"] == "c" and a["suggestions"] == ["s", "t"] and [p["provider"] for p in a["providers"]] == ["docs", "unknown"]
    assert {k: v["value"] for k, v in a["fields"].items()} == {"a": "1", "b": "2"} and got["u2"]["fields"] is None
    assert merge.merge_results(spark.createDataFrame([], RESULT)).count() == 0


def test_scheduler(spark):
    rows = [(1, "a", 0, False), (2, "b", 5, False), (3, "a", 9, False), (4, "b", 1, True), (5, None, 1, False), (6, "c", 5, None)]
    r = spark.createDataFrame(rows, "request_id long, fp string, priority int, dont_filter boolean")
    out = frontier.dequeue_order(frontier.accepted(r, "request_id"), "request_id")
    assert [x["request_id"] for x in out.orderBy("place").collect()] == [2, 6, 4, 1] and sorted(x["place"] for x in out.collect()) == [1, 2, 3, 4]
    seen = spark.createDataFrame([("a",)], "fp string")
    assert {x["request_id"] for x in frontier.accepted(r, "request_id", seen).collect()} == {2, 4, 6}


def test_checkpoint(spark, tmp_path):
    pending = spark.createDataFrame([(1, "a", True), (2, "b", False)], "request_id long, fp string, dont_filter boolean")
    frontier.save_checkpoint(pending, spark.createDataFrame([("z",)], "fp string"), str(tmp_path / "c"))
    again, seen = frontier.load_checkpoint(spark, str(tmp_path / "c"))
    assert again.count() == 2 and {r["fp"] for r in seen.collect()} == {"z", "b"}


def test_redirects(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "source string, target string")
    start = spark.createDataFrame([("a",), ("c",), ("x",)], "url string")
    got = {r["url"]: (r["final_url"], r["history"]) for r in frontier.redirect_history(start, hops).collect()}
    assert got["a"] == ("c", ["a", "b"]) and got["c"] == ("c", []) and got["x"][0] == "x"


def test_relocation(spark):
    before = '<div class="card"><h2 class="t">Trail Kit</h2></div>'
    after = '<section><div class="card new"><h2 class="t">Trail Kit</h2></div><h2>Else</h2></section>'
    pages = spark.createDataFrame([(1, "http://a.test/", before), (2, "http://a.test/", after)], "page_id long, url string, html string")
    from pyspark.sql import functions as F

    fps = adaptive.element_fingerprints(pages).withColumn("domain", F.lit("a.test"))
    stored = fps.where("page_id = 1 and fp.tag = 'h2'").select("domain", F.lit("title").alias("identifier"), "fp")
    got = adaptive.relocate(fps.where("page_id = 2"), stored).collect()
    assert len(got) == 1 and got[0]["score"] > 0.8
    assert adaptive.diagnose(fps.where("page_id = 2"), stored).where("accepted").collect()[0]["node_id"] == got[0]["node_id"]
    assert abs(sum(adaptive.WEIGHTS.values()) - 1) < 1e-9


def test_ledger(spark):
    items = spark.createDataFrame([("p", "s", "complete"), ("p", "t", "planned"), ("q", "s", "complete")], "phase string, subphase string, status string")
    got = {(r["phase"], r["subphase"]): r["status"] for r in ledger.roll_up(items).collect()}
    assert got == {("p", "s"): "complete", ("p", "t"): "planned", ("q", "s"): "complete", ("p", None): "in_progress", ("q", None): "complete"}


def test_sources_take_nulls(spark):
    docs = spark.createDataFrame([("o", None, None), ("o", bytearray(b"<urlset><url><loc>u"), "x")], "origin string, body binary, content_type string")
    assert sitemaps.sitemap_urls(docs).count() == 0
    got = curl.curl_requests(spark.createDataFrame([("curl http://a.test",), (None,)], "command string")).collect()
    assert sorted(bool(r["error"]) for r in got) == [False, True]
    cache = spark.createDataFrame([(1, " u ", 200, "OK", "4Q==", "latin1", {"CONTENT-type": ["Text/HTML; charset=x"]}, None, None)], "record_id long, url string, status int, reason string, content string, encoding string, headers map<string,array<string>>, method string, stored_at timestamp")
    r = responses.responses(cache).collect()[0]
    assert (r["text"], r["media_type"], r["method"], r["url"]) == ("á", "text/html", "GET", "u")


def test_adaptive_selection(spark):
    old = '<div class="card"><h2 class="t">Trail Kit</h2></div>'
    new = '<div class="card"><h2 class="u">Trail Kit</h2></div>'
    pages = spark.createDataFrame([(1, "http://a.test/", old), (2, "http://a.test/2", new), (3, "http://a.test/3", None)], "page_id long, url string, html string")
    none = spark.createDataFrame([], f"domain string, identifier string, fp {adaptive.FINGERPRINT}")
    found, save = adaptive.select_adaptive(pages, "h2.t", "title", none)
    assert [(r["page_id"], r["relocated"]) for r in found.collect()] == [(1, False)]
    found, _ = adaptive.select_adaptive(pages, "h2.t", "title", save)
    assert sorted((r["page_id"], r["relocated"]) for r in found.collect()) == [(1, False), (2, True)]


def test_render():
    import pytest

    from pagewright.api import parse, render

    d = parse("<h1>T</h1><p>x <b>y</b></p>")
    assert render(d, "a.md") == "# T\n\nx y" and render(d, "a.txt", "b") == "y" and render(d, "a.html", "b") == "<b>y</b>" and render(d, "a") == "T x y"
    with pytest.raises(ValueError):
        render(d, "a.pdf")


def test_requests_without_a_delivered_fingerprint(spark, tmp_path):
    from pagewright.plans import web

    rows = [
        (1, 1, "http://a.test/x", "GET", None, None, 0, False, " "),
        (2, 1, "http://a.test/x", "GET", None, None, 5, False, None),  # a repeat of 1
        (3, 1, "http://a.test/x", "GET", None, None, 1, True, ""),  # forced
        (4, 1, "http://a.test/y", "GET", None, None, 2, False, None),
        (5, 2, "http://a.test/z", "POST", "s", b"b", 0, None, ""),
    ]
    schema = "request_id long, crawl_id long, url string, method string, sid string, body binary, priority int, dont_filter boolean, fingerprint string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/scheduler_requests.parquet")
    d = str(tmp_path)
    fps = {r["request_id"]: r["fp"] for r in web.q_fingerprints(spark, d).collect()}
    assert len(fps) == 5 and None not in fps.values() and fps[1] == fps[2] == fps[3] and len(set(fps.values())) == 3
    assert {tuple(r) for r in web.q_schedule(spark, d).collect()} == {(1, 4, 1), (1, 3, 2), (1, 1, 3), (2, 5, 1)}
    spark.createDataFrame([([fps[1]],)], "seen array<string>").write.parquet(f"{tmp_path}/scheduler_snapshots.parquet")
    assert {r[0] for r in web.q_seen(spark, d).collect()} == {4, 5}
