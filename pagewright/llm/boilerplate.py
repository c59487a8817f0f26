"""Main text of pages, by deducing each site's template from tokens that share occurrence vectors.

Tokens are the lines of a page, without list, heading and link markup; for lines of several parts
(menus, breadcrumbs) and lines of several sentences (notices with buttons) the parts are tokens as
well, however many. The occurrence vector of a token on a host is the set of the host's pages it stands
on; it is kept as the number of pages and a commutative hash of their keys. Tokens of a host with equal
vectors form an equivalence class. A class of ``CLASS`` tokens or more is valid if it is ordered, i.e. its
tokens follow each other in one order on the part ``VALID`` of its records, and nested, i.e. on the same
part its span crosses that of no other class: spans lie apart or inside each other. The valid classes nest
into the host's template.

A token is template if it is in a valid class on ``PAGES`` pages, or if it alone stands on as many pages,
more the longer it is, in either case on the part ``SHARE`` of the host's pages. Tokens as frequent over
``HOSTS`` hosts and their pages belong to the template that all hosts share; there they may bear the name
of any site, since a copied page keeps the template of the host that it was copied from.

Pages are told apart by what they say, not by where they lie: the key of a page is its title, or else
a minhash of the word sequences of its paragraphs, so copies and edited copies of one article count as few
pages and their paragraphs don't become template.

What the template leaves are slots. A slot behind a template line that opens lists of titles (learnt:
at least ``OPENS`` of its occurrences are followed by two entries) holds a sidebar's entries and goes
with it; all other slots are main text. Code, tables, formulas and the page's title are main text
whatever their counts; a record of which nothing but its title would be left keeps all its lines.

Lines are analysed once, into a table of tokens with their places. Tokens that stand once in the whole
collection, told by a bitmap of fixed size, needn't be counted, and only template tokens are joined back.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import kernel
from pagewright.llm.residue import host_of, site_name
from pagewright.session import materialize, spread, table

PAGES, HOSTS, OPENS = 4, 3, 0.5
#: Tokens of a class that is looked at, and part of its records on which it must be ordered and nested.
CLASS, VALID = 3, 0.8
#: Bits of the bitmaps of tokens (8 MB) and of site names (128 kB).
TOKEN_BITS, SITE_BITS = 26, 20
#: Words of a token for each further page that its class must have.
WORDS_A_PAGE = 4
#: Part of a token's records that must be different pages; what stands in copies of one article has less.
DIVERSE = 0.5
#: Lines whose analysis a worker keeps; a page's lines are asked about several times.
CACHED = 2048
#: Part of the pages of a host, or of all hosts that a token stands on, that it must stand on.
SHARE = 0.005
#: Characters that a line of a paragraph has at least.
LONGER = 120
#: A line that could be an entry of a sidebar has at most so many words.
ENTRY = 14
#: A page's text that isn't its title has at least so many words in one line.
SUBSTANCE = 5

_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)|\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[https?://\S+ ([^\]]*)\]")
_LEAD = re.compile(r"^\s*(?:[-*+•]\s+|\d{1,3}[.)]\s+|#{1,6}\s+|={2,6}\s*|>\s+|\\item\s+|[*#:;]+\s+)")
_TRAIL = re.compile(r"\s*(?:#{1,6}|={2,6})\s*$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LATEX = re.compile(r"\\(?:(?:sub)*section|paragraph|textbf|textit|emph|href\{[^{}]*\})\*?\{([^{}]*)\}")
_YEAR = re.compile(r"\b(?:19|20)\d\d\b")
_PARTS = re.compile(r"\s*(?:\s[|>»·•/–-]\s|[|>»·•])\s*|\s{2,}|\t")
_PARTED = re.compile(r"[|>»·•\t]|\s[/–-]\s|\s\s")
_SIGN = re.compile(r"[|>»·•]|\s[/–-]\s|\]\(")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_OPEN = re.compile(r"(?i)<(pre|code|syntaxhighlight|math|table)\b|\\begin\{(verbatim|lstlisting|tabular|equation|align|itemize|enumerate|quote)\*?\}|^\s*(\{\|)|^\s*(\\\[|\$\$)\s*$")
#: Characters that code, tables and formulas have and template lines don't.
_CODE = re.compile(r"[{}\\$=;<>~^]|\|\s*$|^\s*\||\[\]|\(\)|__|^\s*[-=]{3,}\s*$|^\s*[}\])]|!!|&&|\d\s*\|\s*\d|\w\(\w*\)|^\s*[a-z]+ --?[a-z]\b")
_HEADING = re.compile(r"(?i)^\s*(?:#\s|=\s?[^=]|==\s?[^=]|<h1\b|\\section\b)")
_END = re.compile(r"[.!?:;,…]\s*$")


@lru_cache(maxsize=CACHED)
def stripped(line: str) -> str:
    """A line without markup around and inside its words."""
    out = _LEAD.sub("", line.strip(), count=1)
    if out and out[-1] in "#=":
        out = _TRAIL.sub("", out)
    if "[" in out:
        out = _LINK.sub(lambda m: next((x for x in m.groups() if x is not None), ""), out)
    if "\\" in out:
        out = _LATEX.sub(r"\1", out)
    if "<" in out and _TAG.search(out):  # the blanks that tags leave part nothing
        out = " ".join(_TAG.sub(" ", out).split())
    if "&" in out:
        out = html.unescape(out)
    return out.strip(" *_'`\t")


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def marked(text: str, site: str) -> str:
    """A folded text with years and the site's name as marks."""
    if "19" in text or "20" in text:
        text = _YEAR.sub("\x02", text)
    return text.replace(site, "\x01") if site else text


def guarded(lines: list[str]) -> list[bool]:
    """Which lines are code, tables or formulas."""
    out, until = [], None
    signs = [_SIGNS.search(x) is not None for x in lines]
    if not any(signs):  # most pages
        return [x.startswith(("    ", "\t")) and not _LEAD.match(x) for x in lines]
    for line, sign in zip(lines, signs, strict=True):
        if until is None and not sign:
            out.append(False)
            continue
        if until is not None:
            out.append(True)
            if until(line):
                until = None
            continue
        fence = _FENCE.match(line)
        if fence:
            out.append(True)
            mark = fence[1]
            until = lambda x, m=mark: x.strip().startswith(m) and not x.strip().strip(m[0])
            continue
        m = _OPEN.search(line)
        if m and any(m.groups()):
            word = next(x for x in m.groups() if x)
            end = {"{|": "|}", "\\[": "\\]", "$$": "$$"}.get(word) or ("</" + word.lower() if line[m.start()] == "<" else "\\end{" + word)
            out.append(True)
            if end not in line[m.end() :].lower().replace("\\end{" + word.lower(), "\\end{" + word):
                until = lambda x, e=end: e in x or e in x.lower()
            continue
        out.append(False)
    return [g or x.startswith(("    ", "\t")) and not _LEAD.match(x) or sign and _code(x) for g, x, sign in zip(out, lines, signs, strict=True)]


def _code(line: str) -> bool:
    bare = _TAG.sub("", _LINK.sub(r"\1", line.replace("=" * 2, "")))
    return bool(_CODE.search(bare) and not _PARTS.search(line.strip())) or bool(_FORMULA.search(line))


#: One of these stands in every line of code, of a table or of a formula.
_SIGNS = re.compile(r"[{}\\$=;<>~^|\[\]()_!&`]|\s-|^\s*-")
_FORMULA = re.compile(r"^\s*[a-z]+ --?[a-z]\b|\$[^$\s][^$]*\$|\\\(|\\\[|\{\{|\\[a-z]+\{|^\s*\|.*\|\s*$|^\s*[!|][^|]*(?:!!|\|\|)")


@lru_cache(maxsize=CACHED)
def parts_of(line: str) -> list[str]:
    """The parts of a menu line: link texts, or what separators part."""
    links = _LINK.findall(line) if "[" in line else []
    if len(links) > 1 and len(_LINK.sub("", line).strip(" -|>·•/,")) < 4:
        return [next((y for y in x if y), "") for x in links]
    core = stripped(line)
    if not _PARTED.search(core):
        return []
    parts = [p.strip() for p in _PARTS.split(core) if p.strip()]
    return parts if len(parts) > 1 else []


def tokens_of(line: str, site: str) -> list[tuple[int, str, int]]:
    """(role, token, words) of a line: 0 for the line, odd roles for parts, even ones for sentences."""
    core = stripped(line)
    low = folded(core)
    parts = parts_of(line)
    if parts:
        out = [(0, low, len(_WORD.findall(core)))]
        out += [(2 * i + 1, folded(p), len(_WORD.findall(p))) for i, p in enumerate(parts)]
    else:  # sentences of the folded text, so each word is looked at once
        sentences = _SENTENCES.split(low)
        sizes = [len(_WORD.findall(s)) for s in sentences]
        out = [(0, low, sum(sizes))]
        if len(sentences) > 1:
            out += [(2 * i + 2, s, n) for i, (s, n) in enumerate(zip(sentences, sizes, strict=True))]
    if not out[0][2]:
        return []
    if site and site in low or "19" in low or "20" in low:
        out = [(role, marked(text, site), n) for role, text, n in out]
    return [t for t in out if t[1] and t[2]]


_WORD = re.compile(r"[^\W_]+")


_NAME = re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿ]{3,}\b")


def renamed_tokens(line: str, site: str, known: Callable[[str], bool]) -> list[tuple[int, str, int]]:
    """The tokens of a line and of its sentences that would arise if a name in it, one of those that may be
    a site's, were the site's own."""
    core = stripped(line)
    out = []
    for name in sorted({x.lower() for x in _NAME.findall(core)} - {site}):
        if known(name):
            out += [t for t in tokens_of(line, name) if "\x01" in t[1] and t[0] % 2 == 0]
    return out


@lru_cache(maxsize=CACHED)
def entry_like(line: str) -> bool:
    """A title as a sidebar lists it: several words or a number, no end of sentence."""
    core = stripped(line)
    n = len(_WORD.findall(core))
    return 0 < n <= ENTRY and (n > 2 or bool(re.search(r"\d", core))) and not _END.search(core) and not _HEADING.match(line)


def next_entries(lines: list[str], i: int, taken: list[bool], stop: set[int]) -> list[int]:
    """Places of the entries right behind line i, blank lines aside."""
    out = []
    for j in range(i + 1, len(lines)):
        if not lines[j].strip():
            continue
        if taken[j] or j in stop or not entry_like(lines[j]):
            break
        out.append(j)
    return out


def _digest(text: str) -> int:
    got = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return got - (1 << 64) if got >> 63 else got


def page_keys(titles: list[str | None], texts: list[str]) -> np.ndarray:
    """A key that copies of one page share: of its title, or else a minhash of the word sequences of
    its longer lines (of all lines where none is longer)."""
    out = np.zeros(len(texts), np.uint64)
    body = ["\n".join(x for x in t.split("\n") if len(x) > LONGER) or t for t in texts]
    for first, block in kernel.blocks(body):
        w = kernel.words(block)
        h, at = kernel.grams(w, 3)
        if len(h):
            own = w.owner()[at]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[first + own[begin]] = np.minimum.reduceat(h, begin)
    out = out.view(np.int64)
    for i, (title, text) in enumerate(zip(titles, texts, strict=True)):
        if not title:
            title = next((stripped(x) for x in text.split("\n") if _HEADING.match(x)), None)
        if title and not title.isspace():
            out[i] = _digest("title " + " ".join(title.lower().split()))
    return out


def _page_lines(text: str, title: str | None) -> tuple[list[str], list[bool], set[int]]:
    """Lines, which are guarded, and the places of the title."""
    lines = text.split("\n")
    guard = guarded(lines)
    want = " ".join((title or "").lower().split())
    titles = {i for i, x in enumerate(lines) if want and " ".join(stripped(x).lower().split()) == want}
    for i, x in enumerate(lines):  # a heading of the first rank, or one underlined
        if _HEADING.match(x) or (i + 1 < len(lines) and re.match(r"^\s*={3,}\s*$", lines[i + 1]) and x.strip()):
            titles.add(i)
    return lines, guard, titles


TOKENS = "code long, place int, role int, kind int, words int, opens boolean, host long, token long, page long"
FIRST, AGAIN, RENAMED = range(3)


def _name_hash(name: str) -> int:
    return _digest("site " + name) & (1 << 64) - 1


def page_tokens(rows: DataFrame) -> DataFrame:
    """The tokens of all lines of (code, url, title, text) that aren't guarded or titles, with their places;
    kind tells the first occurrence in a record from later ones and from renamed forms."""
    spark = rows.sparkSession

    def names(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.array([_name_hash(n) for n in {site_name(host_of(u)) for u in set(b.column(0).to_pylist())}], np.uint64)

    sites = spark.sparkContext.broadcast(kernel.gathered_bitmap(rows.select("url"), names, SITE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = sites.value, 64 - SITE_BITS

        @lru_cache(maxsize=1 << 16)
        def known(name: str) -> bool:
            at = _name_hash(name) >> mask
            return bool(bits[at >> 3] >> (at & 7) & 1)

        for b in batches:
            codes, addresses, titles, texts = (c.to_pylist() for c in b.columns)
            texts = [t or "" for t in texts]
            pages = page_keys(titles, texts)
            out = _Columns()
            for code, url, title, text, page in zip(codes, addresses, titles, texts, pages.tolist(), strict=True):
                if not text.strip():
                    continue
                host = host_of(url)
                site = site_name(host)
                lines, guard, skip = _page_lines(text, title)
                seen: set[int] = set()
                n = len(out.token)
                for i, line in enumerate(lines):
                    if guard[i] or i in skip or not line.strip():
                        continue
                    for role, token, words in tokens_of(line, site):
                        t = _digest(token)
                        out.add(i, role, AGAIN if t in seen else FIRST, words, role == 0 and words <= 6 and len(next_entries(lines, i, guard, skip)) > 1, t)
                        seen.add(t)
                    for role, token, words in renamed_tokens(line, site, known):
                        out.add(i, role, RENAMED, words, False, _digest(token))
                out.record(code, _digest(host), page, len(out.token) - n)
                if len(out.token) > 100_000:
                    yield out.batch()
                    out = _Columns()
            yield out.batch()

    return spread(rows.select("code", "url", "title", "text")).mapInArrow(run, TOKENS)


class _Columns:
    """Columns of token rows; what a record's rows have in common is kept once a record."""

    def __init__(self) -> None:
        self.place, self.role, self.kind, self.words, self.opens, self.token = [], [], [], [], [], []
        self.records: list[tuple[int, int, int]] = []
        self.sizes: list[int] = []

    def add(self, place: int, role: int, kind: int, words: int, opens: bool, token: int) -> None:
        self.place.append(place)
        self.role.append(role)
        self.kind.append(kind)
        self.words.append(words)
        self.opens.append(opens)
        self.token.append(token)

    def record(self, code: int, host: int, page: int, size: int) -> None:
        self.records.append((code, host, page))
        self.sizes.append(size)

    def batch(self) -> pa.RecordBatch:
        own = np.repeat(np.array(self.records, np.int64).reshape(-1, 3), self.sizes, axis=0)
        four = [np.array(x, np.int32) for x in (self.place, self.role, self.kind, self.words)]
        arrays = [own[:, 0], *four, np.array(self.opens, bool), own[:, 1], np.array(self.token, np.int64), own[:, 2]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], names=[x.split()[0] for x in TOKENS.split(", ")])


def _only(tokens: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows whose tokens a bitmap may hold."""
    shared = tokens.sparkSession.sparkContext.broadcast(bitmap)  # 8 MB, always
    place = tokens.columns.index("token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(kernel.has(shared.value, b.column(place).to_numpy().view(np.uint64), TOKEN_BITS)))

    return tokens.mapInArrow(run, tokens.schema)


def _hashes(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(0).to_numpy().view(np.uint64)]


def occurrences(tokens: DataFrame) -> DataFrame:
    """(host, token, page, words, opens, records): the tokens of each page, with the records it has; those
    that stand in one record only needn't be there."""
    first = tokens.where(F.col("kind") == FIRST)
    often = _only(first.select("host", "token", "page", "words", "opens"), kernel.gathered_bitmap(first.select("token"), _hashes, TOKEN_BITS, twice=True))
    return often.groupBy("host", "token", "page").agg(F.max("words").alias("words"), F.max("opens").alias("opens"), F.count("*").alias("records"))


def classes(seen: DataFrame) -> DataFrame:
    """(host, token, words, pages, records, vector, opened, size): occurrence vectors, and the number of
    tokens of the host that share each."""
    vectors = seen.groupBy("host", "token").agg(
        F.max("words").alias("words"),
        F.count("*").alias("pages"),
        F.sum("records").alias("records"),
        F.bit_xor(F.xxhash64("page")).alias("vector"),
        F.sum(F.col("opens").cast("long")).alias("opened"),
    )
    sizes = vectors.groupBy("host", "vector", "pages").agg(F.count("*").alias("size"))
    return vectors.join(sizes, ["host", "vector", "pages"])


def valid_classes(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(host, vector, pages, ordered, nested): of each class of enough tokens and pages, the part of its
    records on which its tokens stand in their commonest order, and on which its span crosses no other's."""
    large = found.where((F.col("size") >= CLASS) & (F.col("pages") >= PAGES)).select("host", "token", "vector", "pages")
    bitmap = kernel.gathered_bitmap(large.select("token"), _hashes, TOKEN_BITS)
    # a line stands for its parts: what counts is where each token is first met
    places = _only(tokens.where(F.col("kind") == FIRST).select("code", "host", "token", "place", "role"), bitmap)
    own = places.join(large, ["host", "token"])
    # bounded by the tokens of one record
    runs = own.groupBy("code", "host", "vector", "pages").agg(
        F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "token"))), lambda x: x["token"])).alias("sequence"), F.min("place").alias("a"), F.max("place").alias("z")
    )
    runs = materialize(runs, "p4-runs")

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, vectors, pages, crossed = [], [], [], []
            for spans in b.column(0).to_pylist():
                spans.sort(key=lambda x: (x["a"], -x["z"]))
                open_: list[dict] = []
                bad: set[int] = set()
                for k, x in enumerate(spans):
                    x["k"] = k
                    while open_ and open_[-1]["z"] < x["a"]:
                        open_.pop()
                    for y in reversed(open_):  # those that x isn't inside of
                        if y["z"] >= x["z"]:
                            break
                        if y["z"] >= x["a"] > y["a"]:
                            bad |= {x["k"], y["k"]}
                    open_.append(x)
                    open_.sort(key=lambda y: -y["z"])
                for k, x in enumerate(spans):
                    hosts.append(x["host"])
                    vectors.append(x["vector"])
                    pages.append(x["pages"])
                    crossed.append(k in bad)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(vectors, pa.int64()), pa.array(pages, pa.int64()), pa.array(crossed, pa.bool_())], names=["host", "vector", "pages", "crossed"])

    key = ["host", "vector", "pages"]
    # bounded by the classes of one record
    spans = runs.groupBy("code").agg(F.collect_list(F.struct(*key, "a", "z")).alias("spans")).select("spans")
    nested = spans.mapInArrow(crossing, "host long, vector long, pages long, crossed boolean").groupBy(*key).agg(F.avg((~F.col("crossed")).cast("double")).alias("nested"))
    orders = runs.groupBy(*key, "sequence").agg(F.count("*").alias("n")).groupBy(*key).agg((F.max("n") / F.sum("n")).alias("ordered"))
    return orders.join(nested, key)


def template(tokens: DataFrame) -> DataFrame:
    """(host, token, opens): tokens of the hosts' templates; host 0 is the template of all hosts.

    ``tokens`` are those of all pages. A page that lies under several hosts counts once for all hosts.
    """
    seen = materialize(occurrences(tokens), "p4-seen")
    found = materialize(classes(seen), "p4-classes")
    valid = valid_classes(tokens, found).where((F.col("ordered") >= VALID) & (F.col("nested") >= VALID)).select("host", "vector", "pages", F.lit(True).alias("valid"))
    sizes = tokens.where(F.col("kind") == FIRST).select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    found = found.join(valid, ["host", "vector", "pages"], "left").join(sizes, "host")
    need = PAGES + F.floor(F.col("words") / WORDS_A_PAGE)
    common = F.col("pages") >= SHARE * F.col("host_pages")
    rate = F.col("opened") >= OPENS * F.col("pages")
    diverse = F.col("pages") >= DIVERSE * F.col("records")
    # long tokens of a small class are as likely the paragraphs of an article that was edited several times
    classed = F.col("valid") & (F.col("pages") >= PAGES) & (F.col("words") <= 2 * WORDS_A_PAGE)
    own = found.where(diverse & common & ((F.col("pages") >= need) | F.coalesce(classed, F.lit(False)))).select("host", "token", rate.alias("opens"))
    pages = seen.groupBy("token", "page").agg(F.max("words").alias("words"), F.max("opens").alias("opens"), F.sum("records").alias("records"))
    every = pages.groupBy("token").agg(
        F.max("words").alias("words"), F.count("*").alias("pages"), F.sum("records").alias("records"), F.sum(F.col("opens").cast("long")).alias("opened")
    )
    every = every.where(F.col("pages") >= PAGES).join(found.groupBy("token").agg(F.count("*").alias("hosts"), F.sum("host_pages").alias("host_pages")), "token")
    shared = every.where((F.col("hosts") >= HOSTS) & (F.col("pages") >= need) & diverse & common).select(F.lit(0).cast("long").alias("host"), "token", rate.alias("opens"))
    return own.unionByName(shared)


def decide(lines: list[str], guard: list[bool], titles: set[int], marks: dict[int, dict[int, bool]]) -> list[int]:
    """Places of the lines that aren't main text, given the template tokens of each line."""
    out = list(guard)
    chosen: list[int] = []
    opening: list[int] = []
    for i, line in enumerate(lines):
        own = marks.get(i)
        if not own or guard[i] or i in titles:
            continue
        hit = 0 in own
        if not hit:
            parts = parts_of(line)
            if parts:
                hits = [2 * k + 1 in own for k in range(len(parts))]
                sizes = [len(_WORD.findall(p)) for p in parts]
                some = 2 * sum(n for n, h in zip(sizes, hits, strict=True) if h) >= sum(sizes)
                # a breadcrumb ends with a title, so its words say nothing
                hit = some or bool(_SIGN.search(line)) and sum(sizes) <= 30 and sum(hits) >= max(1, (len(parts) - 1) / 2)
            else:
                sentences = _SENTENCES.split(stripped(line))
                sizes = [len(_WORD.findall(s)) for s in sentences]
                got = sum(n for k, n in enumerate(sizes) if 2 * k + 2 in own)
                hit = 2 * got >= sum(sizes)
        if hit:
            chosen.append(i)
            if own.get(0):
                opening.append(i)
    taken = list(out)
    for i in chosen:
        taken[i] = True
    for i in opening:
        entries = next_entries(lines, i, taken, titles)
        if len(entries) > 1:
            chosen += entries
            for j in entries:
                taken[j] = True
    left = any(x.strip() and not taken[i] and i not in titles and len(_WORD.findall(x)) >= SUBSTANCE for i, x in enumerate(lines)) or any(guard)
    return sorted(chosen) if left else []


def boilerplate_lines(rows: DataFrame) -> DataFrame:
    """(code, line_no) of lines that belong to the site; lines count from 1, at each line feed.

    ``rows`` has code (unique), url, title and text. Null and blank texts have none.
    """
    tokens = materialize(page_tokens(rows), "p4-tokens")
    chosen = materialize(template(tokens), "p4-template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, places = [], []
            for code, title, text, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines, guard, titles = _page_lines(text, title)
                by_line: dict[int, dict[int, bool]] = {}
                for m in marks:
                    own = by_line.setdefault(m["place"], {})
                    own[m["role"]] = own.get(m["role"], False) or m["opens"]
                got = decide(lines, guard, titles, by_line)
                codes += [code] * len(got)
                places += [i + 1 for i in got]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(places, pa.int64())], names=["code", "line_no"])

    hits = _only(tokens.select("code", "place", "role", "host", "token"), kernel.gathered_bitmap(chosen.select("token"), _hashes, TOKEN_BITS))
    both = hits.withColumn("host", F.explode(F.array("host", F.lit(0).cast("long"))))  # its host's template, and the shared one
    # bounded by the tokens of one record
    marked = both.join(chosen, ["host", "token"]).groupBy("code").agg(F.collect_list(F.struct("place", "role", "opens")).alias("marks"))
    return rows.select("code", "title", "text").join(marked, "code").select("code", "title", "text", "marks").mapInArrow(run, "code long, line_no long")


SOURCES = ["web_extract_results", "browser_markdown_dumps"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, SOURCES[0]).where("result_id is not null")
    dumps = table(spark, sf_dir, SOURCES[1]).where("dump_id is not null")
    k = len(SOURCES)
    return web.select((F.col("result_id") * k).alias("code"), "url", "title", F.col("content").alias("text")).unionByName(
        dumps.select((F.col("dump_id") * k + 1).alias("code"), "url", F.lit(None).cast("string").alias("title"), F.col("markdown").alias("text"))
    )


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(t) for t in SOURCES]), (F.col("code") % len(SOURCES)).cast("int") + 1)
    return df.select(name.alias("tbl"), F.floor(F.col("code") / len(SOURCES)).alias("record_id"), *[c for c in df.columns if c != "code"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id, line_no) of lines that belong to the site rather than to the page."""
    return _named(boilerplate_lines(_rows(spark, sf_dir)))


def p4_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id, text): the main text of every record; null where the record has no text."""
    rows = _rows(spark, sf_dir)
    gone = boilerplate_lines(rows).groupBy("code").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), (i + 1).cast("long")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return _named(rows.join(gone, "code", "left").select("code", F.trim(text).alias("text")))


def p4_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tokens, pages, n_classes, n_valid): the equivalence classes of enough tokens and pages by size and
    frequency, and how many of them are ordered and nested."""
    tokens = materialize(page_tokens(_rows(spark, sf_dir)), "p4-tokens")
    found = classes(occurrences(tokens))
    valid = valid_classes(tokens, found).select("host", "vector", "pages", ((F.col("ordered") >= VALID) & (F.col("nested") >= VALID)).alias("valid"))
    each = found.select("host", "vector", "pages", "size").distinct().join(valid, ["host", "vector", "pages"])
    return each.groupBy(F.col("size").alias("tokens"), "pages").agg(F.count("*").alias("n_classes"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"))
