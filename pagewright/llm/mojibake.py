"""Garbled text from wrong character encodings: found by a join with garbled forms, and restored.

A token is a run of ASCII letters and digits and of any characters beyond ASCII that holds at least
one of the latter; tokens that stand alone between quotation marks are quotations and don't count. Runs of
unspaced scripts are cut at their own punctuation, and garbled ones at the garbled forms of that
punctuation, so a clean unit and its garbled form always have the same borders, however long they are.

Every distinct token of the corpus is taken as a word, and its garbled form under every chain is generated:
UTF-8 read in any of ``READ``, once or twice in a row (all pairs), any of ``WRITTEN`` and ``WIDE`` read in
any of ``READ``; lossy ones leave U+FFFD. A bitmap of the corpus's tokens, of fixed size and without false
negatives, drops forms that no token can equal; the others are the table, which is hash-joined with the
corpus's tokens. A match is verified: forms of UTF-8 texts carry UTF-8's byte structure and can't arise by
chance; forms of single-byte chains must have three characters (of wide encodings six), and since such a
chain can be read both ways, its direction is told by the letters: the form must have more ``oddities``
than the word. Where both have as many, the word must stand on at least as many hosts; a host counts once
however many records it has, so no host turns the count round (records without a host count each). Where
hosts are as many too, records decide. Longer chains need no entries of their own, since a garbled token is
itself a token with its garbled forms.

Only for tokens that the table doesn't explain, since their original never occurs clean (names), there is
a fallback, counted in ``p7_ways``: those are read back where their characters are, as a whole, well-formed
UTF-8 read in another encoding; U+FFFD and control characters U+0080-U+009F are wrong letters in themselves.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.llm import kernel
from pagewright.llm.bodies import body_text
from pagewright.session import materialize, spread, table

TOKEN = re.compile(r"[0-9A-Za-z]*[\x80-\U0010ffff][0-9A-Za-z\x80-\U0010ffff]*")
#: Quotation marks; a token between an opening and a closing one is quoted.
OPEN, CLOSE = "\"“„«‹'‘`", "\"”“»›'’`"
#: Punctuation of unspaced scripts, at which their runs are cut; no encoding that texts are wrongly read in has it.
STOPS = "、。・「」『』（）［］【】〈〉《》！？：；，．～　"
#: Bits of the bitmap of tokens (8 MB).
TOKEN_BITS = 26
#: Encodings that texts are wrongly read in, and single-byte ones that they are written in.
READ = ["cp1252", "latin-1", "cp1251", "mac_roman", "cp1250", "koi8-r", "cp437", "cp850", "iso8859-2", "iso8859-15"]
WRITTEN = ["cp1251", "cp1250", "cp1252", "iso8859-2", "koi8-r", "cp866", "mac_roman"]
WIDE = ["shift_jis", "euc_jp", "gbk", "euc_kr", "big5"]


@lru_cache(maxsize=64)
def _charset(name: str) -> tuple[str, object]:
    """A single-byte encoding both ways; bytes it leaves undefined are control characters."""
    to = []
    for b in range(256):
        try:
            to.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            to.append(chr(b))
    table_ = "".join(to)
    return table_, codecs.charmap_build(table_)


def read(data: bytes, name: str) -> str:
    return codecs.charmap_decode(data, "strict", _charset(name)[0])[0]


def written(text: str, name: str) -> bytes | None:
    """The bytes of a text; none if it doesn't fit the encoding."""
    try:
        return codecs.charmap_encode(text, "strict", _charset(name)[1])[0]
    except UnicodeEncodeError:
        return None


def garbled_forms(word: str) -> dict[str, str]:
    """Garbled form -> kind of chain ("utf", "byte", "wide" or "lost") of a word, without the word itself."""
    out: dict[str, str] = {}
    lost: list[str] = []
    data = word.encode("utf-8", "replace")
    once = [read(data, r) for r in READ]
    for g in once:
        out.setdefault(g, "utf")
    for g in dict.fromkeys(once):  # twice
        again = g.encode()
        for r in READ:
            out.setdefault(read(again, r), "utf")
    for w in WRITTEN:
        own = written(word, w)
        if own is not None:
            for r in READ:
                out.setdefault(read(own, r), "byte")
            lost.append(own.decode("utf-8", "replace"))
    for w in WIDE:
        try:
            own = word.encode(w)
        except UnicodeEncodeError:
            continue
        for r in READ:
            out.setdefault(read(own, r), "byte" if r in ("cp1252", "latin-1") else "wide")
        lost.append(own.decode("utf-8", "replace"))
    for g in lost:
        if "\ufffd" in g:  # else it would be the way back
            out.setdefault(g, "lost")
    for w in WIDE[:1]:
        try:
            out.setdefault(data.decode(w), "utf")
        except UnicodeDecodeError:
            pass
    out.pop(word, None)
    return {g: k for g, k in out.items() if not g.isascii()}


def _trie(words: set[str]) -> str:
    """A pattern of any of some words, the longest first, that branches by their letters."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    body = "(?:" + "|".join(parts) + ")" if parts else ""
    return body + "?" if body and "" in words else body


@lru_cache(maxsize=1)
def _stops() -> re.Pattern:
    found = set(STOPS)
    for c in STOPS:
        data = c.encode()
        once = {read(data, r) for r in READ}
        found |= once | {read(g.encode(), r) for g in once for r in READ}
    # forms that begin with a letter that cuts alone would never be reached
    return re.compile(_trie(found))


def units(token: str) -> Iterator[tuple[int, int]]:
    """The parts of a token between the punctuation of unspaced scripts, or its garbled forms; both sides
    of a cut are kept, so a text is put together again from its units."""
    at = 0
    for m in _stops().finditer(token):
        if m.start() > at:
            yield at, m.start()
        yield m.span()
        at = m.end()
    if at < len(token):
        yield at, len(token)


def read_back(token: str) -> str | None:
    """What a token was if its characters are UTF-8 bytes read in another encoding; else none."""
    for r in READ[:5]:
        data = written(token, r)
        if data is not None and not data.isascii():
            try:
                got = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not any("\x80" <= c <= "\x9f" for c in got) or read_back(got):
                return got
    return None


WRONG = re.compile("[�\x80-\x9f]")
#: Signs that stand beside a letter in clean texts, and those that stand between two.
SIGNS = frozenset("’‘‚‛“”„‟«»‹›–—―‑‐…•·°©®™§€£¥\u00a0\u202f\u200b\u200c\u200d\ufeff¿¡²³¹½¼¾")
BETWEEN = frozenset("’‘“”„«»–—―‑‐…·\u00a0\u202f\u200b\u200c\u200d\ufeff")
#: Accented Latin letters in a row that words have at most.
ROW = 4


def _script(c: str) -> str:
    if c in "ªº" or not c.isalpha():
        return ""
    if c < "\u0250" or "\u1e00" <= c < "\u1f00":
        return "latin"
    return "cyrillic" if "\u0400" <= c < "\u0530" else "greek" if "\u0370" <= c < "\u0400" or "\u1f00" <= c < "\u2000" else "other"


def oddities(token: str) -> int:
    """Places of a token that clean words hardly have: strange signs beside or between letters,
    letters of two scripts side by side, capitals behind small letters, accented Latin letters only."""
    scripts = [_script(c) for c in token]
    n = row = 0
    for i, c in enumerate(token):
        left, right = scripts[i - 1] if i else "", scripts[i + 1] if i + 1 < len(token) else ""
        if scripts[i]:
            n += bool(left) and (left != scripts[i] or token[i - 1].islower() and c.isupper() and not c.isascii())
            row = row + 1 if scripts[i] == "latin" and c > "\x7f" else 0
            n += row > ROW
        else:
            row = 0
            if c > "\x7f" and not unicodedata.combining(c):
                n += bool(left and right) and c not in BETWEEN or bool(left or right) and c not in SIGNS
    return n + (len(token) > 2 and all(s == "latin" and c > "\x7f" for s, c in zip(scripts, token, strict=True)))


def tokens(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, quoted) of the tokens of a text."""
    for m in TOKEN.finditer(text):
        a, b = m.span()
        core_a, core_b = a, b
        while core_a < core_b and text[core_a] in OPEN:
            core_a += 1
        while core_b > core_a and text[core_b - 1] in CLOSE:
            core_b -= 1
        before = text[core_a - 1] if core_a else " "
        after = text[core_b] if core_b < len(text) else " "
        yield a, b, core_a < core_b and before in OPEN and after in CLOSE and not any(c.isascii() and c.isalpha() for c in text[core_a:core_b])


TOKENS = "record_id long, token string, n long, source long"


def record_tokens(df: DataFrame) -> DataFrame:
    """(record_id, token, n, source): the distinct unquoted tokens of each record's body. The source is
    a hash of the host of its url, or the record's own where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, counts, sources = [], [], [], []
            for i, content, encoding, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = body_text(content, encoding)
                if text.isascii():
                    continue
                own: dict[str, int] = {}
                for a, z, quoted in tokens(text):
                    if not quoted:
                        run = text[a:z]
                        for s, e in units(run):
                            t = run[s:e]
                            if not t.isascii():
                                own[t] = own.get(t, 0) + 1
                ids += [i] * len(own)
                found += own
                counts += own.values()
                sources += [source] * len(own)
            found = [t.encode("utf-8", "replace").decode() for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(counts, pa.int64()), pa.array(sources, pa.int64())], names=["record_id", "token", "n", "source"])

    own = F.xxhash64(F.lit("record"), "record_id")
    source = F.coalesce(F.when(urls.host(F.col("url")) != "", F.xxhash64(urls.host(F.col("url")))), own) if "url" in df.columns else own
    return spread(df.where(F.col("record_id").isNotNull()).select("record_id", "content", "encoding", source.alias("source"))).mapInArrow(run, TOKENS)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def garbled_tokens(pairs: DataFrame) -> DataFrame:
    """(token, original, way): the garbled tokens of (record_id, token, source), with the original where known,
    and how they were found: "table", "read back" or "wrong signs"."""
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = pairs.groupBy("token", "source").agg(F.lit(1).cast("long").alias("sources"), F.count("*").alias("documents")).select("token", "sources", "documents")
    # the punctuation that cuts is known, whether or not it occurs clean
    known = spark.createDataFrame([(c, 0, 0) for c in STOPS], counted.schema)
    counted = counted.unionByName(known).groupBy("token").agg(F.sum("sources").alias("sources"), F.sum("documents").alias("documents"))
    words = materialize(counted, "p7-words").repartition(tasks)  # few bytes, much work: over all cores
    bitmap = kernel.gathered_bitmap(words.select("token"), lambda b: [np.array([_hash(t) for t in b.column(0).to_pylist()], np.uint64)], TOKEN_BITS)
    shared = spark.sparkContext.broadcast(bitmap)  # 8 MB, always

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value, 64 - TOKEN_BITS
        for b in batches:
            rows: list[tuple] = []
            for word, sources, documents in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if WRONG.search(word):
                    continue
                odd = None
                for g, kind in garbled_forms(word).items():
                    at = _hash(g) >> mask
                    if bits[at >> 3] >> (at & 7) & 1:
                        odd = oddities(word) if odd is None else odd
                        rows.append((g, word, kind, odd, sources, documents))
            columns = [*zip(*rows, strict=True)] or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "word", "kind", "word_odd", "word_sources", "word_documents"])

    def odd_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([oddities(t) for t in b.column(0).to_pylist()], pa.int64())], names=[*b.schema.names, "odd"])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, read_back(t)) for t in b.column(0).to_pylist()]
            rows = [(t, u, "wrong signs" if u is None else "read back") for t, u in rows if u is not None or WRONG.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([*zip(*rows, strict=True)] or [()] * 3)], names=["token", "original", "way"])

    table_ = words.mapInArrow(forms, "token string, word string, kind string, word_odd long, word_sources long, word_documents long")
    joined = words.join(table_, "token")
    joined = joined.select("token", *[c for c in joined.columns if c != "token"]).mapInArrow(odd_of, "token string, sources long, documents long, word string, kind string, word_odd long, word_sources long, word_documents long, odd long")
    # both readings of a single-byte chain are words of the corpus; the likelier is the word
    likelier = F.struct(-F.col("word_odd"), "word_sources", "word_documents") >= F.struct(-F.col("odd"), "sources", "documents")
    long_enough = F.char_length("token") >= F.when(F.col("kind") == "wide", 6).otherwise(3)
    joined = joined.where(~F.col("kind").isin("byte", "wide") | long_enough & likelier)
    best = joined.groupBy("token").agg(F.max_by("word", F.struct(F.col("kind") == "utf", -F.col("word_odd"), "word_sources", "word_documents", "word")).alias("original"))
    best = materialize(best, "p7-best")
    rest = words.select("token").join(best.select("token"), "token", "left_anti").mapInArrow(direct, "token string, original string, way string")
    return best.withColumn("way", F.lit("table")).unionByName(rest)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id) of records whose body shows wrong letters."""
    pairs = materialize(record_tokens(table(spark, sf_dir, "response_cache_records")), "p7")
    return pairs.join(garbled_tokens(pairs).select("token"), "token", "left_semi").select("record_id").distinct()


KANA = re.compile("[぀-ヿ]")


def reread(content: str | None, encoding: str | None) -> str | None:
    """The body read in another multi-byte encoding, if reading it as told left U+FFFD, the bytes are
    well-formed there and a tenth of the characters beyond ASCII are kana; else none."""
    from pagewright.llm.bodies import raw_body

    data = raw_body(content)
    for name in WIDE[:2]:
        try:
            got = data.decode(name)
        except UnicodeDecodeError:
            continue
        wide = sum(c > "\x7f" for c in got)
        if wide and len(KANA.findall(got)) * 10 >= wide:
            return got
    return None


def restored(df: DataFrame) -> DataFrame:
    """(record_id, text, complete) of the garbled records of (record_id, content, encoding).

    Each unquoted garbled token is replaced by its verified original, again where that is garbled
    too. ``complete`` tells whether no wrong letter is left.
    """
    df = df.where(F.col("record_id").isNotNull())
    pairs = materialize(record_tokens(df), "p7")
    bad = materialize(garbled_tokens(pairs), "p7-tokens")
    again = bad.select(F.col("token").alias("original"), F.col("original").alias("deeper"))
    bad = bad.join(again, "original", "left").select("token", F.coalesce("deeper", "original").alias("original"))
    # bounded by the distinct tokens of one record
    changes = pairs.join(bad, "token").groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("original", F.lit(""))))).alias("changes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, whole = [], [], []
            for i, content, encoding, changes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                known = dict(changes)
                text = body_text(content, encoding)
                other = reread(content, encoding) if "�" in text else None
                ok = True
                if other is None:
                    parts, at = [], 0
                    for a, z, quoted in tokens(text):
                        if quoted:
                            continue
                        parts.append(text[at:a])
                        run = text[a:z]
                        for s, e in units(run):
                            t = run[s:e]
                            new = known.get(t)
                            ok &= new is None or new != ""
                            parts.append(new or t)
                        at = z
                    other = "".join(parts) + text[at:]
                ids.append(i)
                texts.append(other.encode("utf-8", "replace").decode())
                whole.append(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())], names=["record_id", "text", "complete"])

    rows = df.join(changes, "record_id").select("record_id", "content", "encoding", "changes")
    return rows.mapInArrow(run, "record_id long, text string, complete boolean")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled records with their restored texts."""
    return restored(table(spark, sf_dir, "response_cache_records"))


def p7_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way, n_tokens, n_records): how garbled tokens were found, and in how many records."""
    pairs = materialize(record_tokens(table(spark, sf_dir, "response_cache_records")), "p7")
    found = pairs.join(garbled_tokens(pairs), "token")
    return found.groupBy("way").agg(F.countDistinct("token").alias("n_tokens"), F.countDistinct("record_id").alias("n_records"))
