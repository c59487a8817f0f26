"""Evaluation passages inside a corpus.

Words of passages and documents are symbols. Every window of ``WIDTH`` consecutive words is embedded by
CGK's random walk: a walker goes along the window, writes the symbol it stands on, and steps on or stays by
a random bit that depends on the step and the symbol. Windows within a few edits fall into step again, so
their embeddings differ in few places, and a sample of ``SAMPLE`` places is a key that they may share.

The embedding and the sampling are repeated with independent bits, one table each. Equal windows share
every key, so whole leaks need one table and miss nothing.

Near leaks come in two ways. By walks: of ``TABLES`` tables, a pair of windows shares a key with a measured
probability of 1.0 after one edit and of 0.95 to 0.99 after two, whatever their places (``recall``). By
blocks, the default, since it misses nothing and brings fewer candidates: an item's window is cut into one
block more than there may be edits, so many edits leave a block unbroken and move it by so many places at
most, and a document's window has a key for each block at each such place. Candidates are verified, whole
leaks by equality, near ones by their edit distance.

Only two bitmaps of fixed size, whatever the number of items, travel to the tasks that read the corpus:
those of the item words and of the item keys, without false negatives. The lookup itself is a join. Item
windows are broadcast where their measured size is at most ``BROADCAST_BYTES``; more of them are joined by
shuffle, salted by document, so a passage that many documents share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import kernel
from pagewright.session import materialize, spread, table

WIDTH = 12
#: Edits (words inserted, deleted or replaced in a window) that ``near`` still reports.
EDITS = 2
TABLES, SAMPLE = 40, 5
#: Words that a sample must have, else it says too little and is left out; places of the walk.
DISTINCT, STEPS = 4, 22
WORD_BITS, KEY_BITS = 20, 24
#: Bytes of item windows that are broadcast at most, and salts beyond that.
BROADCAST_BYTES, SALTS = 64 << 20, 16
U64 = np.uint64
_rng = np.random.default_rng(20240209)
_SEEDS = _rng.integers(1, 2**63, (TABLES, STEPS), dtype=np.uint64)
_PLACES = [np.sort(_rng.choice(STEPS, SAMPLE, replace=False)) for _ in range(TABLES)]


def table_keys(symbols: np.ndarray, starts: np.ndarray, table: int, width: int = WIDTH) -> np.ndarray:
    """A table's keys of the windows that begin at ``starts``; equal windows have equal ones."""
    key = np.zeros(len(starts), U64)
    walk = np.zeros(len(starts), np.int64)
    words, at = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    places = set(_PLACES[table].tolist())
    for j in range(max(places) + 1):
        here = np.where(walk < width, symbols[np.minimum(starts + walk, len(symbols) - 1)], U64(0))
        if j in places:
            key = kernel.mix(key ^ (here + U64(j + 1)))
            words += (walk != at) & (walk < width)
            at = walk.copy()
        walk += (kernel.mix(here ^ _SEEDS[table, j]) >> U64(63)).astype(np.int64)
    return kernel.mix(key + U64(table + 1)), words >= DISTINCT


def embed_keys(symbols: np.ndarray, starts: np.ndarray, tables: int, width: int = WIDTH) -> np.ndarray:
    """Keys of the windows that begin at ``starts``: one row for each table, 0 for samples of too few words."""
    pairs = (table_keys(symbols, starts, t, width) for t in range(tables))
    return np.array([np.where(ok, key, U64(0)) for key, ok in pairs]).reshape(tables, len(starts))


def recall(a: np.ndarray, b: np.ndarray, tables: int = TABLES) -> float:
    """Part of the pairs of rows of two arrays of symbols that share a key of any table."""
    n, width = a.shape
    both = np.concatenate([a.ravel(), b.ravel()])
    starts = np.arange(2 * n) * width
    keys = embed_keys(both, starts, tables, width)
    return float(((keys[:, :n] == keys[:, n:]) & (keys[:, :n] != 0)).any(axis=0).mean())


def block_keys(symbols: np.ndarray, starts: np.ndarray, width: int, edits: int, moved: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(block, keys) of the windows: of each of ``edits`` + 1 blocks, and if ``moved`` at each place in
    the window that it may be moved to."""
    size = width // (edits + 1)
    if not size:
        raise ValueError("a window needs more words than edits")
    grams = np.zeros(len(symbols) - size + 1, U64)
    for j in range(size):
        grams = kernel.mix(grams ^ (symbols[j : len(symbols) - size + 1 + j] + U64(j + 1)))
    for k in range(edits + 1):
        for at in range(max(0, k * size - edits), min(width - size, k * size + edits) + 1) if moved else (k * size,):
            yield k, kernel.mix(grams[starts + at] + U64(k + 1))


def window_starts(w: kernel.Words, known: np.ndarray, width: int = WIDTH, strange: int = 0) -> np.ndarray:
    """Beginnings of windows inside one text of which at most ``strange`` words aren't item words."""
    n = len(w.hashes)
    if n < width:
        return np.empty(0, np.int64)
    run = np.zeros(n + 1, np.int64)
    np.cumsum(~known, out=run[1:])
    first = np.repeat(w.first[1:], w.counts)
    ok = (run[width:] - run[:-width] <= strange) & (np.arange(n - width + 1) + width <= first[: n - width + 1])
    return np.flatnonzero(ok)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def item_windows(items: DataFrame, id_column: str, text_column: str, width: int, edits: int, walks: bool) -> DataFrame:
    """(item_id, at, tab, key, win): the keys of all windows, and the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            for first, block in kernel.blocks(b.column(1).to_pylist()):
                yield from _emit(kernel.words(block), ids[first : first + len(block)], None, None, width, edits, walks, "item_id")

    return items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), text_column).mapInArrow(run, "item_id long, at int, tab int, key long, win binary")


def _emit(w: kernel.Words, ids: np.ndarray, word_bits, key_bits, width: int, edits: int, walks: bool, name: str) -> Iterator[pa.RecordBatch]:
    known = np.ones(len(w.hashes), bool) if word_bits is None else kernel.has(word_bits, w.hashes, WORD_BITS)
    starts = window_starts(w, known, width, edits)
    if not len(starts):
        return
    own = w.owner()[starts]
    data = w.hashes.view(np.int64)
    if edits and not walks:
        keys = ((t, key, np.ones(len(key), bool)) for t, key in block_keys(w.hashes, starts, width, edits, key_bits is not None))
    elif edits:
        keys = ((t, *table_keys(w.hashes, starts, t, width)) for t in range(TABLES))
    else:  # equality is verified, and there is no other table
        keys = [(0, table_keys(w.hashes, starts, 0, width)[0], np.ones(len(starts), bool))]
    for t, key, ok in keys:
        hit = np.flatnonzero(ok if key_bits is None else ok & kernel.has(key_bits, key, KEY_BITS))
        if not len(hit):
            continue
        s = starts[hit]
        win = np.ascontiguousarray(data[s[:, None] + np.arange(width)])
        binary = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer((np.arange(len(s) + 1) * (8 * width)).astype(np.int32)), pa.py_buffer(win)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[own[hit]].astype(np.int64)), pa.array((s - w.first[own[hit]]).astype(np.int32)), pa.array(np.full(len(s), t, np.int32)), _signed(key[hit]), binary],
            names=[name, "at", "tab", "key", "win"],
        )


def _candidates(spark: SparkSession, items: DataFrame, docs: DataFrame, width: int, edits: int, walks: bool = False) -> DataFrame:
    windows = materialize(item_windows(items, "item_id", "text", width, edits, walks), "p9-items")

    def words(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, block in kernel.blocks(b.column(0).to_pylist()):
            yield kernel.words(block).hashes

    word_bits = kernel.gathered_bitmap(items.select("text"), words, WORD_BITS)
    key_bits = kernel.gathered_bitmap(windows.select("key"), lambda b: [b.column(0).to_numpy().view(U64)], KEY_BITS)
    shared = spark.sparkContext.broadcast((word_bits, key_bits))  # 128 kB and 2 MB, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wb, kb = shared.value
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            for first, block in kernel.blocks(b.column(1).to_pylist()):
                yield from _emit(kernel.words(block), ids[first : first + len(block)], wb, kb, width, edits, walks, "doc_id")

    rows = spread(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text"))
    found = rows.mapInArrow(run, "doc_id long, at int, tab int, key long, win binary")
    own = windows.withColumnsRenamed({"at": "item_at", "win": "item_win"})
    if windows.count() * (8 * width + 48) <= BROADCAST_BYTES:
        return found.join(F.broadcast(own), ["tab", "key"])
    salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["tab", "key", "salt"]).drop("salt")


def whole_leaks(spark: SparkSession, items: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id): documents that hold ``width`` consecutive words of an item unbroken.

    ``items`` has item_id and text, ``docs`` doc_id and text; other columns play no part. Null ids
    and null, empty or shorter texts give nothing; repeated rows give a pair once. Equal
    windows have equal keys, so nothing is missed.
    """
    return _candidates(spark, items, docs, width, 0).where("win = item_win").select("doc_id", "item_id").distinct()


def near_leaks(spark: SparkSession, items: DataFrame, docs: DataFrame, width: int = WIDTH, edits: int = EDITS, walks: bool = False) -> DataFrame:
    """(doc_id, item_id, edits): the least number of word edits between a window of the item and a
    window of the document of the same width, where it is at most ``edits``. Items and documents shorter
    than a window have none. With ``walks`` candidates come from the walks' tables instead of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wins = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.int64).reshape(-1, width) for i in (2, 3)]
            got = edit_distances(*wins) if len(b) else np.empty(0, np.int32)
            ok = np.flatnonzero(got <= edits)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(got[ok], pa.int32())], names=["doc_id", "item_id", "edits"])

    # a pair of windows that shares several keys is verified once
    rows = _candidates(spark, items, docs, width, edits, walks).select("doc_id", "item_id", "win", "item_win", "at", "item_at").dropDuplicates(["doc_id", "at", "item_id", "item_at"])
    return rows.mapInArrow(run, "doc_id long, item_id long, edits int").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of two equal-shaped arrays."""
    n, width = a.shape
    row = np.tile(np.arange(width + 1, dtype=np.int32), (n, 1))
    for i in range(width):
        diagonal, row[:, 0] = row[:, 0].copy(), i + 1
        for j in range(width):
            best = np.minimum(np.minimum(row[:, j] + 1, row[:, j + 1] + 1), diagonal + (a[:, i] != b[:, j]))
            diagonal = row[:, j + 1].copy()
            row[:, j + 1] = best
    return row[:, width]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of whole or partial leaks."""
    return whole_leaks(spark, *_tables(spark, sf_dir))


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to EDITS word edits in a window."""
    return near_leaks(spark, *_tables(spark, sf_dir))


def p9_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near leaks as in p9_near, with the candidates of the walks' tables."""
    return near_leaks(spark, *_tables(spark, sf_dir), walks=True)


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, n_docs): in how many documents each item leaked, 0 included."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    counts = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"))


_GRAMS = r"""(select {id}, i, string_agg(word, ' ') over (partition by {id} order by i rows between current row and 11 following) g, count(*) over (partition by {id} order by i rows between current row and 11 following) n
from (select {id}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) word, generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), 1) i from {tbl}))"""
SQL = {"p9_found": f"select distinct d.doc_id, b.item_id from {_GRAMS.format(id='doc_id', tbl='documents')} d join {_GRAMS.format(id='item_id', tbl='benchmark')} b on d.g = b.g where d.n = 12 and b.n = 12"}
SQL["p9_items"] = f"select b.item_id, count(f.doc_id)::bigint n_docs from benchmark b left join ({SQL['p9_found']}) f on f.item_id = b.item_id group by b.item_id"
# Windows that share an unbroken block of four words at most two places apart, and their edit distance: each
# pair's words are written as letters of their own, so the distance of texts is that of word lists.
_NEAR = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents), b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark),
dg as (select doc_id, w, j, array_to_string(w[j:j + 3], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 2)) j from d)),
ig as (select item_id, w, f, k, array_to_string(w[f + 4 * k:f + 4 * k + 3], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) f from b), (select unnest([0, 1, 2]) k)),
c as (select distinct doc_id, item_id, dg.w[j - 4 * k - m:j - 4 * k - m + 11] x, ig.w[f:f + 11] y from dg join ig using (g), (select unnest(range(-2, 3)) m) where j - 4 * k - m >= 1 and j - 4 * k - m + 11 <= len(dg.w)),
p as (select *, list_distinct(list_concat(x, y)) v from c),
l as (select doc_id, item_id, levenshtein(array_to_string(list_transform(x, lambda a: chr(64 + list_position(v, a)::int)), ''), array_to_string(list_transform(y, lambda a: chr(64 + list_position(v, a)::int)), '')) e from p)
select doc_id, item_id, min(e)::int edits from l where e <= 2 group by doc_id, item_id"""
SQL["p9_near"] = _NEAR
