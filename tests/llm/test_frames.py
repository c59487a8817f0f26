import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import boilerplate, leaks, mojibake, near_duplicates, queries, repetition, residue, seen
from pagewright.llm import tokens as T

DATA = "/root/testdata/sf0.001"


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def brute_pairs(rows):
    from tests.llm.test_algorithms import plain_words

    sets = {}
    for i, t in rows:
        w = plain_words(t)
        if len(w) >= 30:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = [(0, None), (2, ""), (4, "short text")]
    for k in range(30):
        base = [sentence(rng) for _ in range(8)]
        rows += [(6 + 6 * k, ". ".join(base)), (8 + 6 * k, ". ".join([*base[4:], *base[:4]])), (10 + 6 * k, ". ".join([*base, sentence(rng)]).upper())]
    rows += [(1000 + 2 * i, rows[3][1]) for i in range(20)]  # a hot group of copies
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "code long, text string, shingles string")
    got = near_duplicates.expand(*near_duplicates.similar_classes(df)).collect()
    assert {(2 * r["id_a"], 2 * r["id_b"]) for r in got} == brute_pairs(rows) and len(got) == len(brute_pairs(rows))
    empty = spark.createDataFrame([], "code long, text string")
    assert near_duplicates.expand(*near_duplicates.similar_classes(empty)).count() == 0


def test_a_hot_probe_key_is_cut_into_cells(spark, monkeypatch):
    """Many different records that are all alike: every pair is a link, whatever the size of a cell."""
    rng = random.Random(18)
    base = sentence(rng, 80)
    rows = [(2 * i, f"{base} {sentence(rng, 2)}") for i in range(40)] + [(100 + 2 * i, sentence(rng, 80)) for i in range(10)]
    df = spark.createDataFrame(rows, "code long, text string")
    monkeypatch.setattr(near_duplicates, "CELL", 7)
    got = near_duplicates.expand(*near_duplicates.similar_classes(df)).collect()
    assert {(2 * r["id_a"], 2 * r["id_b"]) for r in got} == brute_pairs(rows) and len(got) == 40 * 39 // 2


def test_thresholds_that_cannot_reach_the_miss_rate():
    with pytest.raises(ValueError):
        near_duplicates.allocate({(i, t): 1.0 for i in range(2) for t in (0, 1)}, parts=2)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 30), "k") for i in range(10)] + [(None, "x", "k"), (11, None, "k"), (12, "too short", "k")]
    docs = [(100 + i, sentence(rng, 20) + " " + " ".join(items[i][1].split()[5:17]).upper() + "! " + sentence(rng, 5)) for i in range(10)]
    docs += [(200, " ".join(items[0][1].split()[5:16])), (201, None), (202, ""), (203, items[1][1]), (203, items[1][1]), (None, items[1][1])]
    edited = items[2][1].split()[5:17]
    edited[6] = "zzz"
    docs.append((300, sentence(rng, 9) + " " + " ".join(edited) + " " + sentence(rng, 9)))
    i = spark.createDataFrame(items, "item_id long, text string, key string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in leaks.whole_leaks(spark, i, d).collect()} == {(100 + k, k) for k in range(10)} | {(203, 1)}
    near = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.near_leaks(spark, i, d).collect()}
    assert near[100, 0] == 0 and near[203, 1] == 0
    assert leaks.whole_leaks(spark, i.limit(0), d).count() == 0


def test_near_leak_recall(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 12)) for i in range(200)]
    docs = []
    for i, t in items:
        w = t.split()
        w[rng.randrange(8, 12)] = items[(i + 1) % 200][1].split()[0]
        docs.append((i, " ".join(w)))
    got = leaks.near_leaks(spark, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(r["doc_id"] == r["item_id"] for r in got.collect()) >= 0.9 * len(items)


def test_near_leaks_against_brute_force(spark):
    import numpy as np

    rng = random.Random(8)
    items, docs, want = [(i, sentence(rng, 12)) for i in range(300)], [], {}
    for i, t in items:
        w = t.split()
        for _ in range(1 + i % 2):
            at = rng.randrange(len(w))
            if i % 3 == 0:
                w[at] = items[(i + 1) % 300][1].split()[0]
            elif i % 3 == 1:
                w.insert(rng.randrange(len(w) + 1), items[(i + 1) % 300][1].split()[0])
            else:
                del w[at]
        w += items[(i + 2) % 300][1].split()[: max(0, 12 - len(w))]
        docs.append((i, " ".join(w)))
        codes = {x: k for k, x in enumerate({*t.split(), *w})}
        own = np.array([[codes[x] for x in t.split()]])
        want[i] = min(int(leaks.edit_distances(own, np.array([[codes[x] for x in w[s : s + 12]]]))[0]) for s in range(len(w) - 11))
    got = leaks.near_leaks(spark, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["edits"] for r in got if r["doc_id"] == r["item_id"]} == {i: n for i, n in want.items() if n <= leaks.EDITS}
    assert sum(n <= leaks.EDITS for n in want.values()) > 200


def test_walks_find_nearly_what_blocks_find(spark):
    rng = random.Random(16)
    items, docs = [(i, sentence(rng, 20)) for i in range(150)], []
    for i, t in items:
        w = t.split()
        for _ in range(1 + i % 2):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [sentence(rng, 1)] * rng.randrange(2)
        docs.append((i, " ".join([sentence(rng, 5), *w, sentence(rng, 5)])))
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    exact = {tuple(r) for r in leaks.near_leaks(spark, i, d).collect()}
    got = {tuple(r) for r in leaks.near_leaks(spark, i, d, walks=True).collect()}
    assert len({x[:2] for x in got & exact}) >= 0.9 * len(exact) and {x[:2] for x in got} <= {x[:2] for x in exact}


def test_leaks_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(17)
    items = spark.createDataFrame([(i, sentence(rng, 12)) for i in range(20)], "item_id long, text string")
    docs = items.select((F.col("item_id") + 100).alias("doc_id"), "text")
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in leaks.whole_leaks(spark, items, docs).collect()} == {(100 + i, i) for i in range(20)}


def test_seen_over_batches(spark, tmp_path):
    requests = [(1, "A", False), (2, " a ", False), (3, None, False), (4, " ", None), (5, "b", True), (6, "b", False), (7, "s", False), (8, "b", False), (9, "hot", False)] + [(10 + i, "hot", False) for i in range(50)]
    r = spark.createDataFrame([(*x, "e") for x in requests], "request_id long, fingerprint string, dont_filter boolean, key string")
    s = spark.createDataFrame([(["S ", None],), (None,)], "seen array<string>")
    path = str(tmp_path / "keys")
    schema = "key binary, arrival long"
    seen.all_keys(r.where("request_id <= 6"), s).coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    root = str(tmp_path / "root")
    seen.first_arrivals(stream(), root)
    seen.all_keys(r.where("request_id > 6"), s.limit(0)).coalesce(1).write.mode("append").parquet(path)
    first = seen.first_arrivals(stream(), root)  # goes on where the first run ended
    assert {x["request_id"] for x in seen.repeats(r, first).collect()} == {2, 7, 8, *range(10, 60)}


def test_seen_in_any_order(spark, tmp_path):
    """Requests, and a snapshot's key, that come after later requests of their key."""
    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot", f"k{i}"]).encode()) for i in range(200)]
    files = [[(i, k) for i, k in rows if i % 7 == part] for part in rng.sample(range(7), 7)] + [[(seen.BEFORE, b"b"), (seen.BEFORE, b"k3")], [(7, rows[7][1])]]
    path, root = str(tmp_path / "keys"), str(tmp_path / "root")
    sofar: dict[int, bytes] = {}
    before: set[bytes] = set()
    for f in files:
        spark.createDataFrame([(k, i) for i, k in f], "key binary, arrival long").coalesce(1).write.mode("append").parquet(path)
        got = [r[0] for r in seen.stream_repeats(spark.readStream.schema("key binary, arrival long").parquet(path), root, 4).collect()]
        sofar |= {i: k for i, k in f if i != seen.BEFORE}
        before |= {k for i, k in f if i == seen.BEFORE}
        want = [i for i, k in sofar.items() if k in before or any(j < i and q == k for j, q in sofar.items())]
        assert sorted(got) == sorted(want)


def test_late_first_request(spark, tmp_path):
    path, root = str(tmp_path / "keys"), str(tmp_path / "root")
    for i in (5, 1):
        spark.createDataFrame([(b"A", i)], "key binary, arrival long").coalesce(1).write.mode("append").parquet(path)
        got = seen.stream_repeats(spark.readStream.schema("key binary, arrival long").parquet(path), root).collect()
    assert [r[0] for r in got] == [5]
    assert seen.stream_repeats(spark.readStream.schema("key binary, arrival long").parquet(path).where("false")).count() == 0


def test_repetition_frame(spark):
    d = spark.createDataFrame([(1, "a b c d e " * 9, "x", 5), (2, None, None, 1), (3, "", "x", 2), (None, "one two", "y", 3)], "doc_id long, text string, kind string, share int")
    got = repetition.repetition(d, "doc_id", "text", "kind")
    assert {(r["doc_id"], r["n_words"], r["share"]) for r in got.collect()} == {(1, 45, 1.0), (2, 0, 0.0), (3, 0, 0.0), (None, 2, 0.0)}
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 2)], "doc_id long, quality int")
    cut = {r["kind"]: (r["cutoff"], r["certified"]) for r in repetition.risk_cutoffs(got, labels).collect()}
    assert cut == {"x": (0.4, False), "": (0.4, False), "y": (0.4, False)}


def test_cutoffs_move_with_the_labels(spark):
    """Good documents without repetition certify low cutoffs; good ones that repeat themselves forbid them."""
    rows = [(i, "clean", 0.05) for i in range(300)] + [(1000 + i, "mixed", 0.75 if i % 3 == 0 else 0.0) for i in range(300)] + [(2000 + i, "few", 0.0) for i in range(5)] + [(3000, None, 0.5)]
    shares = spark.createDataFrame(rows, "doc_id long, kind string, share double")
    labels = spark.createDataFrame([(i, 5) for i, _, _ in rows] + [(0, 1), (None, 5), (1, None)], "doc_id long, quality int")
    got = {r["kind"]: r for r in repetition.risk_cutoffs(shares, labels).collect()}
    assert (got["clean"]["cutoff"], got["clean"]["certified"], got["clean"]["n_rejected"]) == (0.1, True, 0)
    assert (got["mixed"]["cutoff"], got["mixed"]["certified"]) == (0.8, True)
    assert not got["few"]["certified"] and not got[""]["certified"]
    bad = labels.withColumn("quality", F.lit(1))
    assert not any(r["certified"] for r in repetition.risk_cutoffs(shares, bad).collect())
    out = {r["doc_id"]: (r["found"], r["rejected"]) for r in repetition.judged(shares, repetition.risk_cutoffs(shares, labels)).collect()}
    assert out[1000] == (True, False) and out[0] == (False, False) and out[3000] == (True, False)
    assert repetition.risk_cutoffs(shares.limit(0), labels).count() == 0


def test_false_rejections_stay_under_the_bound():
    """With a true rate above ALPHA, a cutoff is certified with a probability of at most DELTA."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, trials = 200, 2000
    passed = sum(repetition.upper_bound(int(r), n, 1 - repetition.DELTA) <= repetition.ALPHA for r in rng.binomial(n, repetition.ALPHA * 1.001, trials))
    assert passed <= trials * repetition.DELTA * 1.3


def test_garbled_records(spark):
    words = "déjà après élève Größe über für naïve café señor año"
    rows = [(i, words) for i in range(6)] + [(10, words.encode().decode("cp1252")), (11, 'see "Ã©" in place of é'), (12, "Âge plain")]
    data = [(i, base64.b64encode(t.encode()).decode(), "utf-8") for i, t in rows]
    data += [(20, base64.b64encode(words.encode("latin-1")).decode(), None), (21, None, "utf-8"), (22, "!", "nope"), (23, "", "")]
    df = spark.createDataFrame(data, "record_id long, content string, encoding string")
    pairs = mojibake.record_tokens(df)
    bad = mojibake.garbled_tokens(pairs).select("token")
    assert {r[0] for r in pairs.join(bad, "token", "left_semi").select("record_id").distinct().collect()} == {10, 20}
    fixed = {r["record_id"]: (r["text"], r["complete"]) for r in mojibake.restored(df).collect()}
    assert fixed == {10: (words, True), 20: (words, True)}


@pytest.mark.parametrize("chain", [("mac_roman",), ("cp1252",), ("latin-1", "cp1252"), ("cp1251", "mac_roman"), ("koi8-r",)])
def test_long_words_of_unspaced_scripts(spark, chain):
    """A unit longer than any bound, behind a letter, and units between punctuation, whose clean forms stand
    elsewhere in the corpus."""
    units = ["A数据处理流程需要稳定的存储系统和网络连接" * 3, "流程需要稳定", "Съешьжеещёэтихмягкихфранцузскихбулокдавыпейчаю" * 2]
    clean = f"{units[0]} {units[2]} 存储系统。{units[1]}、网络连接"
    bad = clean
    for r in chain:
        bad = mojibake.read(bad.encode(), r)
    data = [(i, base64.b64encode(t.encode()).decode(), "utf-8") for i, t in enumerate([units[0], f"x {units[1]}。", units[2], "存储系统 网络连接", bad])]
    df = spark.createDataFrame(data, "record_id long, content string, encoding string")
    got = mojibake.restored(df).collect()
    assert [(r["record_id"], r["text"], r["complete"]) for r in got] == [(4, clean, True)]


def test_units_give_the_token_back():
    rng = random.Random(12)
    for _ in range(300):
        t = "".join(rng.choice("aé。、数据ã€‚€¡£ï¼ÃО") for _ in range(rng.randrange(30)))
        assert "".join(t[a:b] for a, b in mojibake.units(t)) == t


def test_garbled_host(spark):
    """A host with a third of the rows garbles: its forms are commoner than the clean words."""
    russian = "Привет большой страны народ говорит правду"
    hungarian = "női erdők felhők időben"
    data = []
    for i in range(60):
        host, text = (f"h{i % 6}.test", russian if i < 4 else hungarian if i < 8 else "plain words") if i % 3 else ("hot.test", "")
        body = text.encode() if text else f"{russian.encode('cp1251').decode('latin-1')} {hungarian.encode('cp1250').decode('latin-1')}".encode()
        data.append((i, f"http://{host}/{i}", base64.b64encode(body).decode(), "utf-8"))
    df = spark.createDataFrame(data, "record_id long, url string, content string, encoding string")
    pairs = mojibake.record_tokens(df)
    bad = mojibake.garbled_tokens(pairs).select("token")
    assert {r[0] for r in pairs.join(bad, "token", "left_semi").select("record_id").distinct().collect()} == set(range(0, 60, 3))
    fixed = {r["record_id"]: r["text"] for r in mojibake.restored(df).collect()}
    assert fixed == {i: f"{russian} {hungarian}" for i in range(0, 60, 3)}


def test_encoding_frame(spark):
    d = spark.createDataFrame([(1, "x y", "z"), (2, None, "z"), (None, "", "z")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_texts(d, "doc_id", "text").collect()}
    assert len(got[1]) == 2 and got[2] == [] and got[None] == []
    back = T.decode_ids(T.encode_texts(d, "doc_id", "text"), "doc_id")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "x y", 2: "", None: ""}


def test_boilerplate_frame(spark):
    rng = random.Random(6)
    rows = [(0, None, None, None), (1, None, None, "  ")]
    for i in range(2, 40):
        host = f"s{i % 4}.site{i % 4}.test"
        rows.append((i, f"http://{host}/{i}", f"Title {i}", f"Shop | Sale | Help\nTitle {i}\n{sentence(rng, 30)}.\n{sentence(rng, 30)}.\n© 2030 Site{i % 4} Holdings. All rights reserved.\nBack to top"))
    df = spark.createDataFrame(rows, "code long, url string, title string, text string")
    got = {(r["code"], r["line_no"]) for r in boilerplate.boilerplate_lines(df).collect()}
    assert got == {(i, n) for i in range(2, 40) for n in (1, 5, 6)}


def test_headings_of_a_large_host_are_main_text(spark):
    rng = random.Random(9)
    rows = [(i, f"http://a.big.test/{i}", f"Title {i}", f"Title {i}\n{sentence(rng, 30)}.\n" + ("## Installation\n" if i < 4 else "") + f"{sentence(rng, 30)}.\nBack to top") for i in range(1200)]
    got = boilerplate.boilerplate_lines(spark.createDataFrame(rows, "code long, url string, title string, text string"))
    assert {(r["code"], r["line_no"]) for r in got.collect()} == {(i, 5 if i < 4 else 4) for i in range(1200)}


def test_residue_frame(spark):
    rng = random.Random(7)
    notice = "This site works best with JavaScript enabled."
    rows = [(2 * i, f"http://h{i % 4}.test/{i}", None, f"{sentence(rng, 60)}.\n{notice}\nPlease enable JavaScript for the basket.", None) for i in range(20)]
    rows += [(100, "http://h0.test/x", "T", "T\nPlease enable JavaScript to view this page.", None), (102, None, None, None, None), (104, None, None, " ", None)]
    rows += [(107, "http://h1.test/", None, base64.b64encode(b"<title>t</title><nav>a</nav><p>Sorry: this account is suspended.</p>").decode(), "utf-8"), (109, None, None, "!!", None)]
    df = spark.createDataFrame(rows, "code long, url string, title string, content string, encoding string")
    assert {(r["code"], r["kind"]) for r in residue.residue(df).collect()} == {(100, "notice"), (107, "notice")}


def test_residue_has_no_length_bounds(spark):
    """Long placeholders, long boilerplate lines, menus with bars, quotes and code of any length."""
    rng = random.Random(13)
    cookie = "Please enable JavaScript to accept our cookies, " + sentence(rng, 40) + "."
    real = [(i, f"http://h{i % 4}.test/{i}", None, f"{sentence(rng, 60)}.\nHome | Error 404: Not found | Sale\n{cookie}", None) for i in range(0, 40, 2)]
    short = [(100 + 2 * i, f"http://h{i % 4}.test/s{i}", None, f"{sentence(rng, 20)}.\nShop | Help", None) for i in range(8)]
    cases = [
        (200, "http://h0.test/a", None, "Text {{" + "x" * 61 + "}} here", None),
        (202, "http://h0.test/b", None, "Text *|" + "NAME_" * 20 + "X|* here", None),
        (204, "http://h0.test/c", None, f"Sorry: this account is suspended.\n{cookie}\nHome | Error 404: Not found | Sale", None),
        (206, "http://h0.test/d", None, "Write `" + "a " * 300 + "{{name}}` in a template", None),
    ]
    same = [(300 + 2 * i, f"http://h{i % 4}.test/e{i}", None, "Home | Help\n404 Not Found: the page is gone.", None) for i in range(12)]
    df = spark.createDataFrame(real + short + cases + same, "code long, url string, title string, content string, encoding string")
    got = {r["code"]: r["kind"] for r in residue.residue(df).collect()}
    assert got == {200: "placeholder", 202: "placeholder", 204: "notice"} | {c: "notice" for c, *_ in same}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["p1_found", "p1_classes", "p3_found", "p3_wrong", "p8_roundtrip", "p9_found", "p9_items", "p9_near", "p10_found", "p10_shares", "p10_cutoffs", "p10_rejected"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got = queries.queries()[name](spark, DATA)
    cursor = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(cursor.fetchall())


def test_wide_menus_and_long_notices(spark):
    """A menu of 80 entries that marks the current one, and a notice of 22 sentences of which one changes."""
    rng = random.Random(19)
    entries = [f"Topic{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    notice = [sentence(rng, 6).capitalize() + "." for _ in range(22)]
    rows = []
    for i in range(40):
        menu = " | ".join(f"[{e}]" if k == i else e for k, e in enumerate(entries))
        own = " ".join([*notice[:11], sentence(rng, 6).capitalize() + ".", *notice[12:]])
        rows.append((i, f"http://s{i % 4}.site{i % 4}.test/{i}", f"Title {i}", f"{menu}\nTitle {i}\n{sentence(rng, 40)}.\n{own}\n{sentence(rng, 40)}."))
    got = boilerplate.boilerplate_lines(spark.createDataFrame(rows, "code long, url string, title string, text string"))
    assert {(r["code"], r["line_no"]) for r in got.collect()} == {(i, n) for i in range(40) for n in (1, 4)}


def test_classes_must_be_ordered_and_nested(spark):
    """Classes on one host: one in order, one shuffled, and two whose spans cross."""
    rng = random.Random(20)
    rows = []
    for page in range(10):
        mixed = rng.sample([10, 11, 12, 13], 4)
        lines = [1, 2, 3, *mixed, 20, 30, 21, 31, 22, 32]
        if page >= 8:  # the vectors differ by these pages
            lines = [x for x in lines if x < 10 or page == 8 and x < 20 or page == 9 and 20 <= x < 30]
        rows += [(page, p, 0, boilerplate.FIRST, 2, False, 1, token, 100 + page) for p, token in enumerate(lines)]
    tokens = spark.createDataFrame(rows, boilerplate.TOKENS)
    found = boilerplate.classes(boilerplate.occurrences(tokens))
    by = {r["token"]: r["vector"] for r in found.collect()}
    valid = {r["vector"]: (r["ordered"] >= boilerplate.VALID, r["nested"] >= boilerplate.VALID) for r in boilerplate.valid_classes(tokens, found).collect()}
    assert len({by[1], by[10], by[20], by[30]}) == 4
    assert valid[by[1]] == (True, True) and valid[by[10]] == (False, True)
    assert valid[by[20]][1] is False and valid[by[30]][1] is False


def test_a_copied_page_keeps_another_hosts_template(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        k = i % 6
        name = ["Aldermoor", "Brightwell", "Calverton", "Dunwich", "Eastleigh", "Farnham"][k]
        other = "Brightwell" if i == 0 else name
        rows.append((i, f"http://www.{name.lower()}.test/{i}", f"Title {i}", f"Title {i}\n{sentence(rng, 30)}.\nAll offers, prices and terms on these pages are subject to change by {other} and its partners without any notice, as told in the terms of use.\n{sentence(rng, 30)}."))
    got = boilerplate.boilerplate_lines(spark.createDataFrame(rows, "code long, url string, title string, text string"))
    assert {(r["code"], r["line_no"]) for r in got.collect()} == {(i, 3) for i in range(60)}


def test_a_hot_host(spark):
    """A host with a third of all rows keeps its paragraphs and loses its template."""
    rng = random.Random(22)
    rows = []
    for i in range(240):
        host = "hot.big.test" if i % 3 == 0 else f"h{i % 11}.small{i % 11}.test"
        rows.append((i, f"http://{host}/{i}", f"Title {i}", f"Shop | Sale | Help\nTitle {i}\n{sentence(rng, 30)}.\n{sentence(rng, 30)}.\nBack to top"))
    got = boilerplate.boilerplate_lines(spark.createDataFrame(rows, "code long, url string, title string, text string"))
    assert {(r["code"], r["line_no"]) for r in got.collect()} == {(i, n) for i in range(240) for n in (1, 5)}


def test_bitmaps_hold_what_they_are_given(spark):
    import numpy as np

    from pagewright.llm import kernel

    values = [i * 0x9E3779B97F4A7C15 % 2**64 for i in range(1, 3000)]
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in [*values, *values[:500]]], "h long").repartition(5)
    own = lambda b: [b.column(0).to_numpy().view(np.uint64)]
    once, twice = kernel.gathered_bitmap(df, own, 24), kernel.gathered_bitmap(df, own, 24, twice=True)
    h = np.array(values, np.uint64)
    assert len(once) == 2**21 and kernel.has(once, h, 24).all() and kernel.has(twice, h[:500], 24).all() and kernel.has(twice, h[500:], 24).mean() < 0.01
    assert not kernel.has(once, h ^ np.uint64(1 << 62), 24).all() and not kernel.gathered_bitmap(df.limit(0), own, 24).any()
