import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagewright.api import parse
from pagewright.dom import nodes as N
from pagewright.dom import tree
from pagewright.functions import urls
from pagewright.functions.json_path import values_at
from pagewright.operators import links, recipes, robots, views
from pagewright.select import css, translate, xpath
from pagewright.sources import curl, sitemaps

SHOP = """<div id=shop><section><article class="product card" data-sku=1><h1>Trail <i>Kit</i></h1><a href="/a">A</a></article>
<article class="product"><h1>City Pack</h1><a href="/b?x=1&amp;y=2">B</a><a>C</a></article></section></div><p>one<b>two<p>three"""


def test_tree_reopens_formatting_and_implies_ends():
    d = tree.parse("<p><b>one<br><p>two</p><ul><li>a<li>c</ul>")
    assert tree.outer_html(d) == "<html><head></head><body><p><b>one<br/></b></p><p><b>two</b></p><ul><li><b>a</b></li><li><b>c</b></li></ul></body></html>"


def test_raw_text_ends_only_at_its_end_tag():
    d = parse('<script>if (a<b) "</p>"</script><p>x</p>')
    assert d.css("script::text").get_all() == ['if (a<b) "</p>"'] and len(d.css("p")) == 1


@pytest.mark.parametrize("source", [None, "", "<", "<p", "</", "<!--", "<table>x<tr><td>y", "\x00<b></i></b>", "<a><a><a>"])
def test_any_source_gives_a_tree(source):
    d = parse(source)
    assert [n.tag for n in d.root.elements()] == ["html"] and len(d.css("body")) == 1


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("article.product h1::text", ["Trail", "City Pack"]),
        ("#shop > section > article:nth-of-type(2) a::attr(href)", ["/b?x=1&y=2"]),
        ("a[href^='/b']::text, h1::text", ["B", "Trail", "City Pack"]),
        ("article:not(.card) > a:last-child::text", ["C"]),
        ("h1 + a::text", ["A", "B"]),
        ("article:has(i)::attr(data-sku)", ["1"]),
        ("a[", []),
        ("a::attr()", []),
        ("a::before", []),
    ],
)
def test_css(selector, want):
    assert parse(SHOP).css(selector).get_all() == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//article/h1/text()", ["Trail", "City Pack"]),
        ("//a/@href", ["/a", "/b?x=1&y=2"]),
        ("//article[last()]//a[not(@href)]/text()", ["C"]),
        ("//h1[contains(., 'City')]/following-sibling::a[1]/@href", ["/b?x=1&y=2"]),
        ("count(//a)", ["3"]),
        ("//a[", []),
    ],
)
def test_xpath(expression, want):
    assert parse(SHOP).xpath(expression).get_all() == want


def test_selectors_find_their_element_first():
    d = parse(SHOP)
    for n in d.root.walk():
        if n.kind == "element" and n.tag not in ("html", "head", "body"):
            for full in (False, True):
                assert [m is n for _, m, _ in css.select(d.root, translate.generated(n, True, full))][0]
                assert [m is n for m, _ in xpath.select(d.root, translate.generated(n, False, full))][0]


def test_translation():
    assert translate.css_to_xpath("div > a[href]::attr(href)") == "//div/a[@href]/@href"
    with pytest.raises(css.InvalidSelector):
        translate.css_to_xpath("a:nth-child(2)")


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://A.test/x/../y?b=2&a=1#f", "http://a.test/x/../y?a=1&b=2"), ("https://u:P@H.test:80/", "https://u:P@h.test:80/"), ("http://a.test/?q=a+b%20c", "http://a.test/?q=a+b+c"), ("http://a test/", None), ("http://a.test/%zz", None)],
)
def test_canonical_request(url, want):
    assert urls.canonical_request_url(url) == want


def test_canonical_link_resolves_dots():
    assert urls.canonical_link_url("http://A.test//x/./y/../z/") == "http://a.test/x/z/"


@given(st.text(max_size=40))
def test_canonicalisation_is_idempotent(path):
    once = urls.canonical_link_url("http://a.test/" + path)
    assert once is None or urls.canonical_link_url(once) == once


def test_fingerprint_folds_order_and_fragment():
    a, b = (urls.fingerprint(u) for u in ("http://a.test/?b=1&a=2#x", "http://A.test/?a=2&b=1"))
    assert a == b != urls.fingerprint("http://a.test/?a=2&b=1", "post") and urls.fingerprint("http://a b/") is None


@pytest.mark.parametrize(("base", "ref", "want"), [("http://a.test/x/y", "../q", "http://a.test/q"), ("http://a.test/x", "//b.test/p", "http://b.test/p"), ("http://a.test/x", "mailto:q@b", "mailto:q@b"), (None, "x", None)])
def test_resolve(base, ref, want):
    assert urls.resolve_url(base, ref) == want


def test_json_paths_fan_out():
    text = '{"a": [{"b": 1}, {"b": [2.5, null]}], "c": "x  y"}'
    assert values_at(text, "a/b", True) == ["1", "2.5"] and values_at(text, "a/1/b/0") == ["2.5"] and values_at(text, "c") == ["x y"] and values_at("{", "a") == [] and values_at(None, "a") == []


def test_robots():
    body = "Disallow: /early\nUser-agent: *\nDisallow: /private\nCrawl-delay: 1.5\nRequest-rate: 4/8\n\nUser-agent: shopbot\nAllow: /private/x$\nDisallow: /private*\n"
    p = robots.policy(body, "ShopBot/2.0")
    assert robots.can_fetch(p["rules"], "http://a.test/private/x") and not robots.can_fetch(p["rules"], "http://a.test/private/xy")
    other = robots.policy(body, "else")
    assert other["delay"] == 1.5 and other["rate"] == (4, 8.0) and robots.can_fetch(other["rules"], "http://a.test/early")


def test_sitemap_takes_direct_locations_only():
    xml = b'<urlset><url><loc> http://a.test/1 </loc><x:image xmlns:x="i"><x:loc>no</x:loc></x:image></url><sitemap><loc>http://a.test/s.xml</loc></sitemap>'
    assert list(sitemaps.parse_sitemap(xml)) == [("url", "http://a.test/1"), ("sitemap", "http://a.test/s.xml")]


def test_curl():
    r = curl.parse("curl 'http://a.test/?q=1' \\\n -H 'X: y' -b 'a=b; c=d' -d x=1 --data-raw $'y=\\'2'")
    assert r["method"] == "POST" and r["params"] == [("q", "1")] and r["body"] == "x=1&y='2" and r["cookies"] == {"a": "b", "c": "d"}
    with pytest.raises(curl.CurlError):
        curl.parse("curl --nope http://a.test")


def test_link_reasons():
    e = links.LinkExtractor(deny=("secret",), allow_domains=("a.test",))
    got = [e.prepared("http://a.test/", raw) for raw in (" ", "http://b b/", "/x.pdf", "/secret", "http://nota.test/", "http://s.a.test/y?b=1&a=2#z")]
    assert [r for _, r in got] == ["empty_raw", "invalid_raw", "filtered", "filtered", "filtered", ""] and got[-1][0] == "http://s.a.test/y?a=2&b=1"


def test_views():
    d = parse('<head><meta property="og:title" content="T"><script type="application/ld+json">{"a":1}</script><script type="application/ld+json">[1]</script></head><nav>n</nav><h2>H</h2><p>a <a href=/x>b</a> .</p><ul><li>i</ul><label for=q>Q</label><input id=q type=checkbox checked>')
    assert d.markdown == "## H\n\na [b](/x).\n\n- i" and d.opengraph == {"title": "T"} and d.jsonld == [{"a": 1}]
    assert [(x[1], x[3], x[8]) for x in views.semantic(d.root)] == [("heading", "H", False), ("link", "b", False), ("checkbox", "Q", True)]


def test_frames(spark):
    pages = spark.createDataFrame([(1, "http://a.test/", SHOP, "x"), (2, None, None, None)], "page_id long, url string, html string, tag string")
    nodes = N.dom_nodes(pages).cache()
    assert N.descendants(nodes.where("tag = 'section'"), nodes).where("tag = 'a'").count() == 3
    assert {r["tag"] for r in N.parents(nodes.where("tag = 'i'"), nodes).collect()} == {"h1"}
    assert N.siblings(nodes.where("tag = 'h1'"), nodes).count() == 3
    assert N.find_by_text(nodes, "city pack", case=False).count() == 1
    got = recipes.extract(pages, [recipes.Field("h", "h1::text"), recipes.Field("bad", "a[")])
    assert sorted((r["page_id"], r["name"], r["value"], bool(r["error"])) for r in got.collect()) == [(1, "bad", "", True), (1, "h", "Trail", False), (2, "bad", "", True), (2, "h", "", True)]
    assert links.extract_links(pages, links.LinkExtractor()).count() == 2
