"""Records that are error pages, script notices, filler or unfilled templates.

1. Every line is normalised (lower case, digits to 0, the host's own name to a mark) and counted by host in
   all records, over distinct pages. Pages are told apart by their longest line: copies of an article are
   one page, so their paragraphs don't recur, and error pages that say the same are one page, so what they
   say isn't boilerplate. Lines that recur on a host, or under many hosts, are boilerplate.
2. Records that show any evidence are looked at again: boilerplate lines and the title are
   subtracted, and evidence counts in what is left. A notice (error, block, script demand) needs to
   be what the record has instead of a text: next to nothing else may be left. Filler needs to make up
   most of a line. A placeholder counts anywhere unless it is quoted or marked as code.

Words of filler are learnt: those that recur in lines that begin with the usual filler phrase.
Their number is bounded by the recurrence that is asked for, not by the data.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import kernel
from pagewright.llm.bodies import body_text
from pagewright.session import materialize, spread, table

#: A line is boilerplate if it stands on so many pages of a host, or under so many hosts.
PAGES, HOSTS = 3, 3
#: Words that a record may have besides a notice (reference numbers, advice what to do next).
BESIDES = 24
#: Part of a line's words that are filler words; part of the seed lines a filler word is in at least.
FILLER, SEED_PART = 0.7, 0.02

WORD = re.compile(r"[^\W_]+")
_BLOCK = re.compile(r"(?is)<(script|style|nav|footer|template)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<title\b.*?(?:</title\s*>|$)")
_CODE = re.compile(r"(?is)<(code|pre|kbd|samp|tt)\b[^>]*>(.*?)</\1\s*>")
_BREAK = re.compile(r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|table|tr|td|th|section|article|header|main|aside|body|html|head|blockquote|pre|form|hr)\b[^>]*>")
_TAG = re.compile(r"</?[A-Za-z][^<>%]*>|<![A-Za-z][^<>]*>")
_IS_HTML = re.compile(r"(?i)</?(?:html|head|body|div|p|article|header|h[1-6]|br|span|table|ul|section|main)\b[^<>]*>")


def page_text(text: str) -> str:
    """The lines of a body: an HTML body without navigation, footers, scripts and title, its code
    between backticks; any other body as it is."""
    if not _IS_HTML.search(text):
        return text
    text = _BLOCK.sub("\n", text)
    text = _CODE.sub(lambda m: "`" + m[2] + "`", text)
    return html.unescape(_TAG.sub(" ", _BREAK.sub("\n", text)))


def site_name(host: str | None) -> str:
    """The word of a host that names the site: the label before the last."""
    labels = (host or "").lower().split(".")
    return labels[-2] if len(labels) > 1 else labels[0]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


_DIGITS = re.compile(r"\d+")


def normalised(line: str, site: str) -> str:
    """A line for counting; empty for one without words."""
    out = _DIGITS.sub("0", " ".join(line.lower().split()))
    if site:
        out = out.replace(site, "\x01")
    return out if WORD.search(out) else ""


# Placeholders: template languages, mail merge, and brackets left to be filled.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]+\}?\}\}|\{\{\{[^{}\n]+\}|\{%[^%\n]+%\}|[$#]\{[^{}\n]+\}|\{\$\w+\}|<%[^%\n]+%>|&lt;%[^%\n]+%&gt;"
    r"|%%[A-Za-z_]{2,}%%|(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])|\*\|[A-Z_:]{2,}\|\*|__[A-Z][A-Z0-9_]*?[A-Z0-9]__|@@\w{2,}@@"
    r"|\[(?:INSERT|YOUR|ENTER|ADD|PLACEHOLDER|REPLACE|COMPANY|NAME|TITLE|DATE)\b[A-Z0-9 _.]*\](?!\()|\[(?:[A-Z][a-z]+\.?)(?: [A-Z][a-z]*\.?){0,2}\](?![(:\[\]])|\[object Object\]"
)
# What is left of a text that was to be written: whole-line evidence.
UNWRITTEN = re.compile(
    r"(?i)^\W*(?:TODO|TBD|FIXME)\b\s*[:(–-]|\b(?:your|the) (?:content|text|headline|title) goes here\b|\breplace this (?:text|paragraph|line)\b|\binsert (?:your )?(?:text|content) here\b"
    r"|^\W*(?:sample|placeholder|dummy) (?:text|content|page)\b"
)
QUOTES = "\"'`“”„«»‘’‹›"
SEED = re.compile(r"(?i)^\W*lorem ipsum\b")

# Notices, as they begin a sentence. Real sentences that speak of errors begin otherwise.
_START = (
    r"(?:oops|whoops|uh[ -]?oh|hm+|sorry|(?:we are|we're) sorry|apologies|notice|attention|warning|error|alert|fatal error|something (?:broke|went wrong)|pardon|hoppla|désolé|lo sentimos|leider)"
)
NOTICE = re.compile(
    r"\W*(?:"
    + "|".join(
        [
            rf"{_START}\s*(?:[!:,.…–—-]|\d)",
            r"(?:http(?: error)?|error|status|fehler|erreur|code)?\s*[45]\d\d\b\s*(?:[-:–—.]\s*)?(?:not found|forbidden|bad|internal|service|gateway|unauthori[sz]ed|gone|too many|method|request|unavailable|proxy|nginx)",
            r"(?:error|fehler|erreur)\s+[45]\d\d\s*[:.–—-]",
            r"(?:page|seite|página|pagina|site|url|file|document|item|article|product)\s+(?:not found|introuvable|nicht gefunden|no encontrada|não encontrada|unavailable|no existe)\b",
            r"(?:(?:the|this|that|your) )(?:\w+ ){0,3}(?:page|link|url|address|product|item|listing|article|document|file|offer|account|site|shop|store|session|request|connection|link)\b.{0,40}\b(?:not found|could not be found|does not exist|no longer (?:available|exists?)|has (?:expired|been (?:removed|withdrawn|suspended|blocked|deleted|moved))|is (?:suspended|unavailable|broken|down|currently unavailable|temporarily unavailable)|was (?:withdrawn|removed|deleted))",
            r"(?:access (?:denied|forbidden|to this)|forbidden|unauthori[sz]ed|permission denied|not found|gone|bad (?:request|gateway)|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|request (?:blocked|denied|timed? ?out)|connection (?:refused|timed|failed|reset))\b",
            r"(?:database|server|connection|application|script|runtime) (?:connection |query )?(?:error|failed|failure|timeout|unavailable)\b",
            r"(?:under construction|coming soon|(?:down|closed) for maintenance|scheduled maintenance|site maintenance|we(?:'ll| will) be (?:right )?back|this (?:site|page|shop|domain) is (?:under construction|being|parked|for sale|down for))\b",
            r"(?:please |you (?:must|need to|have to) |to (?:continue|view|read)[^.]{0,40}\b)?(?:sign|log) in (?:to|first|again|before)\b|^\W*(?:you are|you're) not (?:signed|logged) in\b|your session (?:has )?(?:expired|timed out|ended)",
            r"(?:captcha|(?:please )?(?:prove|verify|confirm) that you(?: are|'re) (?:not a robot|human)|are you (?:a robot|human)|checking your browser|verifying (?:you are human|your browser)|one more step|(?:please )?complete the (?:captcha|security check))",
            r"your (?:ip|address|ip address|access|browser|request|network) (?:has been|was|is|address (?:has been|was|is)) (?:blocked|banned|denied|flagged|not supported|rate)",
        ]
        )
    + ")",
    re.I,
)
_SCRIPT = r"(?:java ?script|scripts?|scripting)"
SCRIPTS = re.compile(
    rf"^\W*(?:please |bitte |veuillez |por favor |to (?:continue|proceed|view[^.,]*),? ?)?(?:enable|activate|allow|turn on|switch on|aktivieren sie|schalten sie|activer|activez|active|habilite|ative|attiva|włącz|включите)\b.{{0,24}}\b{_SCRIPT}"
    rf"|^.{{0,60}}\b(?:needs?|requires?|must have|won't work without|does not work without|cannot (?:start|run|load|work|display)[^.]*because|will not (?:load|start|work|open)[^.]*(?:until|without|because))\b.{{0,40}}\b{_SCRIPT}"
    rf"|^{_SCRIPT} (?:is|are|has been|must be|seems to be|appears to be) (?:disabled|off|turned off|switched off|blocked|required|needed|not)"
    rf"|^.{{0,40}}\b(?:does not|doesn't|cannot|can't|won't) (?:run|support|execute|allow) {_SCRIPT}"
    rf"|^.{{0,40}}\bhas {_SCRIPT} (?:disabled|turned off|switched off|blocked)|\b{_SCRIPT} and cookies must be\b|^you need to .{{0,30}}\b{_SCRIPT}|^(?:loading|if (?:nothing|the page|it)).{{0,40}}\b{_SCRIPT}",
    re.I,
)
_QUOTED = re.compile(r"[\"“«„][^\"”»“\n]*[\"”»“]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def placeholder(text: str) -> bool:
    """Whether an unfilled placeholder stands in the text, neither quoted nor marked as code."""
    fenced = None
    for m in PLACEHOLDER.finditer(text):
        a, b = m.span()
        if a and text[a - 1] in QUOTES and b < len(text) and text[b] in QUOTES:
            continue
        if "`" in text or "~~~" in text:
            if fenced is None:
                fenced = [x.span() for x in re.finditer(r"(?s)(`{3,}|~{3,}).*?(?:\1|\Z)|`[^`\n]*`", text)]
            if any(x <= a and b <= y for x, y in fenced):
                continue
        return True
    return False


def notice(sentence: str) -> bool:
    return bool(NOTICE.match(sentence)) or "script" in sentence.lower() and bool(SCRIPTS.search(_QUOTED.sub(" ", sentence)))


_MARK = re.compile(r"[{\[]|%%|<%|&lt;%|%[A-Z]|\*\||__[A-Z]|@@")
#: Words that every unwritten text has one of.
_UNWRITTEN_WORDS = ("todo", "tbd", "fixme", "goes here", "replace this", "insert", "sample", "placeholder", "dummy")
def any_evidence(text: str, filler: frozenset[str]) -> bool:
    """Whether a record may be left out at all: whether any evidence stands anywhere in it."""
    low = text.lower()
    if _MARK.search(text) and PLACEHOLDER.search(text):
        return True
    if any(k in low for k in _UNWRITTEN_WORDS) and any(UNWRITTEN.search(x) for x in text.split("\n")):
        return True
    words = low.replace(".", " ").split()
    if "ipsum" in low or 4 * sum(w in filler for w in words) >= len(words):
        return True
    return any(notice(s) for x in text.split("\n") if x.strip() for s in _SENTENCE.split(x.strip()))


def verdict(lines: list[str], filler: frozenset[str]) -> str | None:
    """What a record's residual lines are evidence of: "placeholder", "filler", "notice" or none."""
    if placeholder("\n".join(lines)):
        return "placeholder"
    words = noticed = fill = 0
    shown = False
    for line in lines:
        own = [w.lower() for w in WORD.findall(line)]
        words += len(own)
        if UNWRITTEN.search(line) or SEED.search(line):
            fill += len(own)
        elif own and len(own) > 2 and sum(w in filler for w in own) >= FILLER * len(own):
            fill += len(own)
        else:
            for s in _SENTENCE.split(line.strip()):
                n = len(WORD.findall(s))
                if n and notice(s):
                    noticed, shown = noticed + n, True
    if fill and 2 * fill >= words:
        return "filler"
    return "notice" if shown and words - noticed <= BESIDES else None


ROWS = "code long, host string, page long, title string, text string"
SOURCES = ["web_extract_results", "response_cache_records"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, url, title, content, encoding) of both tables; encoding is only set for cached bodies."""
    web = table(spark, sf_dir, SOURCES[0]).where("result_id is not null")
    cache = table(spark, sf_dir, SOURCES[1]).where("record_id is not null")
    k = len(SOURCES)
    return web.select((F.col("result_id") * k).alias("code"), "url", "title", "content", F.lit(None).cast("string").alias("encoding")).unionByName(
        cache.select((F.col("record_id") * k + 1).alias("code"), "url", F.lit(None).cast("string").alias("title"), "content", "encoding")
    )


def _texts(b: pa.RecordBatch, word: str = "") -> Iterator[tuple[int, str, str, str, str]]:
    """(code, host, url, title, text) of the rows of a batch that have any text, and in it ``word``."""
    for code, url, title, content, encoding in zip(*(c.to_pylist() for c in b.columns), strict=True):
        if content:
            text = content if code % len(SOURCES) == 0 else body_text(content, encoding)
            if word and word not in text.lower():
                continue
            text = text if code % len(SOURCES) == 0 else page_text(text)
            if text and not text.isspace():
                yield code, host_of(url), (url or "").strip(), title or "", text


def _digest(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "replace")), "big", signed=True)


#: Bits of the bitmap of the lines that are asked about (2 MB).
LINE_BITS = 24


def line_counts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(host, line): hashes of lines that are boilerplate of a host; host 0 stands for any host.

    All records are counted; lines that aren't in ``asked`` (line), told by a bitmap of fixed size without
    false negatives, needn't be shuffled.
    """
    spark = rows.sparkSession
    bitmap = kernel.gathered_bitmap(asked.select("line"), lambda b: [b.column(0).to_numpy().view(np.uint64)], LINE_BITS)
    shared = spark.sparkContext.broadcast(bitmap)  # 2 MB, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value, 64 - LINE_BITS
        for b in batches:
            seen = set()
            for _, host, _, _, text in _texts(b):
                site = site_name(host)
                lines = {n for x in text.split("\n") if x and (n := normalised(x, site))}
                p = h = None
                for n in lines:
                    line = _digest(n)
                    at = (line & (1 << 64) - 1) >> mask
                    if bits[at >> 3] >> (at & 7) & 1:
                        if p is None:
                            h, p = _digest(host), _digest(max(lines, key=lambda n: (len(n), n)))
                        seen.add((h, line, p))
            out = [*zip(*seen, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["host", "line", "page"])

    pages = rows.mapInArrow(run, "host long, line long, page long").distinct()
    by_host = pages.groupBy("host", "line").agg(F.count("*").alias("pages"))
    # a page under several hosts is one page: the line needs as many pages as hosts
    by_page = pages.groupBy("line", "page").agg(F.lit(1).alias("n")).groupBy("line").agg(F.count("*").alias("all_pages"))
    hosts = by_host.groupBy("line").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= HOSTS)
    everywhere = hosts.join(by_page.where(F.col("all_pages") >= HOSTS), "line").select(F.lit(0).cast("long").alias("host"), "line")
    return by_host.where(F.col("pages") >= PAGES).select("host", "line").unionByName(everywhere)


def filler_words(rows: DataFrame) -> frozenset[str]:
    """Words in at least SEED_PART (and three) of the lines that begin with the filler phrase.

    A word counts once a line, so what comes to the driver is at most the mean number of words of such a
    line divided by SEED_PART.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            for *_, text in _texts(b, "ipsum"):
                for line in text.split("\n"):
                    if SEED.search(line):
                        found.update({w.lower() for w in WORD.findall(line)})
                        found["\n"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.where("word = '\n'").select(F.col("n").alias("seeds"))
    often = counts.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(3), F.col("seeds") * SEED_PART))  # total is one row
    return frozenset(often.select("word").toArrow().column(0).to_pylist())


def residue(rows: DataFrame) -> DataFrame:
    """(code, kind) of the records that aren't real content."""
    rows = spread(rows)
    filler = filler_words(rows)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for code, host, _, title, text in _texts(b):
                lines = [x.strip() for x in text.split("\n")]
                if any_evidence(text, filler):
                    site, h, t = site_name(host), _digest(host), " ".join(title.split()).lower()
                    for i, x in enumerate(lines):
                        if x and " ".join(x.split()).lower() != t:
                            n = _digest(normalised(x, site) or x)
                            stays = bool(PLACEHOLDER.search(x))
                            out += [(code, i, x, stays, h, n), (code, i, x, stays, 0, n)]
            columns = [*zip(*out, strict=True)] or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["code", "place", "text", "stays", "host", "line"])

    lines = rows.mapInArrow(candidates, "code long, place int, text string, stays boolean, host long, line long")
    lines = materialize(lines, "p6-lines")
    boilerplate = line_counts(rows, lines)
    marked = lines.join(boilerplate.withColumn("recurs", F.lit(1)), ["host", "line"], "left")
    once = marked.groupBy("code", "place").agg(F.first("text").alias("text"), F.first("stays").alias("stays"), F.max("recurs").alias("recurs"))
    # bounded by the lines of one record
    kept = once.groupBy("code").agg(F.sort_array(F.collect_list(F.when(F.col("recurs").isNull() | F.col("stays"), F.struct("place", "text")))).alias("lines"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, kinds = [], []
            for code, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind = verdict([x["text"] for x in own], filler)
                if kind:
                    codes.append(code)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(kinds, pa.string())], names=["code", "kind"])

    return kept.mapInArrow(judge, "code long, kind string")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id, kind) of the records to be left out."""
    name = F.element_at(F.array(*[F.lit(t) for t in SOURCES]), (F.col("code") % len(SOURCES)).cast("int") + 1)
    return residue(_rows(spark, sf_dir)).select(name.alias("tbl"), F.floor(F.col("code") / len(SOURCES)).alias("record_id"), "kind")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id) of the records to be left out."""
    return p6_kinds(spark, sf_dir).select("tbl", "record_id")
