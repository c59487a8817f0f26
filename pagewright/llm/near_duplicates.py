"""Near-duplicate records by generalised pigeonhole over minhash bits.

A record is the set of its distinct sequences of ``SPAN`` words. Its signature is ``PARTS * SLOTS``
minhash values of 32 bits. The bits of one value are fully correlated (they agree or differ
together), so they are kept in one group, and ``SLOTS`` values form a partition; distances are
counted in values. Each partition i gets its own threshold t_i: -1 leaves it out, 0 asks for equal
values, 1 allows one value to differ. A pair is a candidate if some partition keeps within its
threshold.

The thresholds minimise the estimated number of candidates, by dynamic programming. A partition's
candidates under a threshold are the pairs of equal probe keys, i.e. the second moment of the keys'
counts, which is estimated over all records with a tug-of-war sketch of a few numbers. The budget is
the pigeonhole condition in expectation rather than in the worst case: minhash values of a pair with
similarity s agree independently with probability s, so a partition catches it with a known
probability, and the thresholds must together miss a pair of similarity ``LIMIT`` with probability
at most ``MISS`` (pairs above it are missed far more seldom).

Candidates are verified on the sets themselves. Records with equal sets are one class throughout;
copies are expanded only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import kernel
from pagewright.session import materialize, table

SPAN, LIMIT, LEAST_WORDS = 3, 0.6, 30
PARTS, SLOTS = 36, 3
MISS = 5e-4
#: Ratio of the size classes that a class key carries in its last byte.
SIZE_STEP = 1.05
#: Classes of a probe key that one join key takes.
CELL = 512
#: Numbers of a tug-of-war sketch; its relative error is about sqrt(2 / COPIES).
COPIES = 32
U64, U32 = np.uint64, np.uint32
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**32, PARTS * SLOTS, dtype=np.uint32) | U32(1)
_FLIP = _rng.integers(0, 2**32, PARTS * SLOTS, dtype=np.uint32)
_SIGNS = _rng.integers(1, 2**63, COPIES, dtype=np.uint64) | U64(1)


def shingle_sets(texts: list[str | None], span: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: places of the texts with enough words, sorted distinct 32-bit shingles
    of all of them in a row, and where each text's begin (one more than texts)."""
    for first, block in kernel.blocks(texts):
        w = kernel.words(block)
        h, at = kernel.grams(w, span)
        own = w.owner()[at] if len(at) else at
        enough = (w.counts >= max(least, span))[own] if len(own) else np.empty(0, bool)
        key = np.unique((own[enough].astype(U64) << U64(32)) | (h[enough] >> U64(32)))
        owner = (key >> U64(32)).astype(np.int64)
        if not len(owner):
            continue
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        yield owner[begin] + first, key.astype(U32), np.append(begin, len(owner))


def signature(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minhash values: a row for each slot, a column for each set."""
    out = np.empty((PARTS * SLOTS, len(begin) - 1), U32)
    for k in range(PARTS * SLOTS):
        x = (shingles ^ _FLIP[k]) * _MULTIPLY[k]
        x ^= x >> U32(16)
        x *= U32(0x45D9F3B)
        np.minimum.reduceat(x, begin[:-1], out=out[k])
    return out


def probe_keys(slots: np.ndarray, part: int, threshold: int) -> list[np.ndarray]:
    """Keys by which two records meet if the partition's values are within the threshold."""
    own = [slots[part * SLOTS + j].astype(U64) for j in range(SLOTS)]
    out = []
    for left_out in range(SLOTS) if threshold else [SLOTS]:
        key = np.full(slots.shape[1], part * 8 + left_out + 1, U64)
        for j in range(SLOTS):
            if j != left_out:
                key = kernel.mix(key ^ (own[j] + U64(j + 1)))
        out.append(key)
    return out


def allocate(cost: dict[tuple[int, int], float], limit: float = LIMIT, miss: float = MISS, parts: int = PARTS, slots: int = SLOTS) -> list[int]:
    """Thresholds of the partitions. ``cost[i, t]`` is the estimated number of candidates."""
    catch = {0: limit**slots, 1: limit**slots + slots * limit ** (slots - 1) * (1 - limit)}
    unit = 0.01
    gain = {-1: 0} | {t: int(-np.log1p(-p) / unit) for t, p in catch.items()}
    need = int(np.ceil(-np.log(miss) / unit))
    best = np.full(need + 1, np.inf)
    best[0] = 0.0
    choice = []
    for i in range(parts):
        new = best.copy()
        pick = np.full(need + 1, -1)
        for t in (0, 1):
            for g in range(need + 1):
                if best[g] < np.inf:
                    to = min(need, g + gain[t])
                    if best[g] + cost[i, t] < new[to]:
                        new[to], pick[to] = best[g] + cost[i, t], t * (need + 1) + g
        choice.append(pick)
        best = new
    if best[need] == np.inf:
        raise ValueError(f"{parts} partitions of {slots} values can't reach a miss rate of {miss} at a similarity of {limit}")
    out, g = [], need
    for pick in reversed(choice):
        if pick[g] < 0:
            out.append(-1)
        else:
            t, g = divmod(int(pick[g]), need + 1)
            out.append(t)
    return out[::-1]


def _sets(rows: DataFrame, span: int, least: int) -> DataFrame:
    """(code, ka, kb, shingles) of the rows (code, text) with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0)
            for place, shingles, begin in shingle_sets(b.column(1).to_pylist(), span, least):
                wide = shingles.astype(U64)
                ka, kb = (np.add.reduceat(kernel.mix(wide + U64(s)), begin[:-1]).view(np.int64) for s in (1 << 40, 1 << 50))
                ka = ka & ~np.int64(255) | size_code(np.diff(begin))
                data = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(shingles)])
                yield pa.RecordBatch.from_arrays(
                    [codes.take(pa.array(place)), pa.array(ka), pa.array(kb), data],
                    names=["code", "ka", "kb", "shingles"],
                )

    return rows.mapInArrow(run, "code long, ka long, kb long, shingles binary")


def _slots(column: pa.Array) -> np.ndarray:
    sizes = np.array([len(x) // 4 for x in column.to_pylist()]) if len(column) else np.empty(0, int)
    shingles = np.frombuffer(b"".join(column.to_pylist()), U32)
    return signature(shingles, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def estimated_candidates(sets: DataFrame) -> dict[tuple[int, int], float]:
    """Second moments of the probe keys' counts for each partition and threshold, over all rows.
    What comes to the driver is PARTS * 2 * COPIES numbers, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 2, SLOTS, COPIES), np.int64)
        for b in batches:
            if not len(b):
                continue
            slots = _slots(b.column(0))
            for i in range(PARTS):
                for t in (0, 1):
                    for v, key in enumerate(probe_keys(slots, i, t)):
                        for c in range(COPIES):
                            total[i, t, v, c] += len(key) - 2 * int(((key * _SIGNS[c]) >> U64(63)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "total"])

    sums = sets.select("shingles").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).toPandas()
    total = np.zeros(PARTS * 2 * SLOTS * COPIES)
    total[sums["place"].to_numpy()] = sums["total"].to_numpy()
    moment = (total.reshape(PARTS, 2, SLOTS, COPIES) ** 2).mean(axis=3).sum(axis=2)
    return {(i, t): float(moment[i, t]) for i in range(PARTS) for t in (0, 1)}


def size_code(n: np.ndarray) -> np.ndarray:
    """A set's size on a logarithmic scale of 256 steps; larger sizes share the last one."""
    return np.minimum(np.floor(np.log(n) / np.log(SIZE_STEP)), 255).astype(np.int64)


def candidate_classes(sets: DataFrame, thresholds: list[int], limit: float = LIMIT) -> DataFrame:
    """(a, b): class keys that share a probe key and whose sizes allow the similarity, each once.

    Probes of one class are merged within a batch before they are shuffled and over all batches behind the
    shuffle; most keys are joined there. A key that more than ``CELL`` classes share is cut into cells of about
    as many, each joined with all of the key in a task of its own, so no task gets all its pairs.
    """
    used = [(i, t) for i, t in enumerate(thresholds) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            keys, first = np.unique(b.column(0).to_numpy(), return_index=True)
            slots = _slots(b.column(1).take(pa.array(first)))
            for i, t in used:
                for key in probe_keys(slots, i, t):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(keys)], names=["probe", "class"])

    probes = sets.select("ka", "shingles").mapInArrow(run, "probe long, class long").repartition("probe").dropDuplicates()
    counted = probes.withColumn("n", F.count("class").over(Window.partitionBy("probe"))).where("n > 1")
    # most keys are joined where they lie; only those of more than a cell are shuffled again, by cell
    cold, hot = counted.where(F.col("n") <= CELL), counted.where(F.col("n") > CELL)
    cells = F.ceil(F.col("n") / CELL).cast("int")
    near = cold.select("probe", F.col("class").alias("a")).join(cold.select("probe", F.col("class").alias("b")), "probe").select("a", "b")
    own = hot.select("probe", F.col("class").alias("a"), F.pmod(F.xxhash64("class"), cells).cast("int").alias("cell"))
    every = hot.select("probe", F.col("class").alias("b"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    pairs = near.unionByName(own.join(every, ["probe", "cell"]).select("a", "b"))
    apart = int(np.ceil(-np.log(limit) / np.log(SIZE_STEP))) + 1
    sizes = F.abs(F.col("a").bitwiseAND(F.lit(255)) - F.col("b").bitwiseAND(F.lit(255)))
    return pairs.where((F.col("a") < F.col("b")) & (sizes <= apart)).select("a", "b").distinct()


def _verified(pairs: DataFrame, limit: float) -> DataFrame:
    """Of (x, y, sx, sy) with two sets, (x, y, similarity) of those that reach the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
            score = np.empty(len(a))
            for i, (p, q) in enumerate(zip(a, c, strict=True)):
                both = np.intersect1d(np.frombuffer(p, U32), np.frombuffer(q, U32), assume_unique=True).size
                score[i] = both / ((len(p) + len(q)) // 4 - both)
            ok = pa.array(np.flatnonzero(score >= limit))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array(score).take(ok)], names=["x", "y", "similarity"])

    return pairs.mapInArrow(run, "x long, y long, similarity double")


def similar_classes(rows: DataFrame, span: int = SPAN, limit: float = LIMIT, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Membership (code, class) and links (x, y, similarity) between classes, x < y.

    ``rows`` has code (a unique long, not null) and text. A class is the records with equal shingle
    sets, named by its smallest code. Null, empty and shorter texts are in no class.
    """
    # Sets are as large as the texts and cheap to make, so they are made again where they are needed
    # rather than kept on disk; only their keys are.
    sets = _sets(rows.select("code", "text"), span, least)
    keys = materialize(sets.select("code", "ka", "kb"), "p1-keys")
    reps = keys.groupBy("ka", "kb").agg(F.min("code").alias("class"))
    links = candidate_classes(sets, allocate(estimated_candidates(sets), limit), limit)
    data = sets.select(F.col("code").alias("c"), "shingles")
    for key, name, s in (("a", "x", "sx"), ("b", "y", "sy")):
        links = links.join(reps.select(F.col("ka").alias(key), F.col("class").alias(name)), key).drop(key)
    for name, s in (("x", "sx"), ("y", "sy")):
        links = links.join(data.select(F.col("c").alias(name), F.col("shingles").alias(s)), name)
    found = _verified(links.select("x", "y", "sx", "sy"), limit).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "similarity")
    return keys.join(reps, ["ka", "kb"]).select("code", "class"), found


#: The tables that hold contents, with their ids. A record's code is its id times the number of tables, plus the table's place.
SOURCES = [("web_extract_results", "result_id"), ("merged_results", "merged_id")]


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, t).where(F.col(i).isNotNull()).select((F.col(i) * len(SOURCES) + k).alias("code"), F.col("content").alias("text"))
        for k, (t, i) in enumerate(SOURCES)
    ]
    return parts[0].unionByName(parts[1])


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): pairs of records of one table from class links and from equal sets."""
    k = len(SOURCES)
    m = materialize(members.select((F.col("code") % k).alias("t"), F.floor(F.col("code") / k).alias("id"), "class"), "p1-members")
    a = m.select("t", F.col("id").alias("p"), F.col("class").alias("x"))
    b = m.select("t", F.col("id").alias("q"), F.col("class").alias("y"))
    linked = links.select("x", "y").join(a, "x").join(b, ["y", "t"]).select("t", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    equal = a.join(b.withColumnRenamed("y", "x"), ["x", "t"]).where("p < q").select("t", F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    name = F.element_at(F.array(*[F.lit(t) for t, _ in SOURCES]), F.col("t").cast("int") + 1)
    return linked.unionByName(equal).select(name.alias("tbl"), "id_a", "id_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id_a, id_b): near-duplicate pairs within web_extract_results and within merged_results."""
    return expand(*similar_classes(_coded(spark, sf_dir)))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id, class_id, n_links): a row for each record with enough words; the class is
    that of records with equal sets, n_links the number of other classes it is linked with."""
    members, links = similar_classes(_coded(spark, sf_dir))
    ends = links.select(F.explode(F.array("x", "y")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    name = F.element_at(F.array(*[F.lit(t) for t, _ in SOURCES]), (F.col("code") % len(SOURCES)).cast("int") + 1)
    return members.join(ends, "class", "left").select(name.alias("tbl"), F.floor(F.col("code") / len(SOURCES)).alias("record_id"), F.col("class").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


SQL = {
    "p1_found": r"""
with r as (select 'web_extract_results' tbl, result_id id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w from web_extract_results
 union all select 'merged_results', merged_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') from merged_results),
s as (select distinct tbl, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from (select tbl, id, w, unnest(range(1, len(w) - 1)) i from r where len(w) >= 30)),
n as (select tbl, id, count(*) n from s group by all)
select a.tbl, a.id id_a, b.id id_b from s a join s b on a.tbl = b.tbl and a.s = b.s and a.id < b.id
join n x on x.tbl = a.tbl and x.id = a.id join n y on y.tbl = b.tbl and y.id = b.id
group by a.tbl, a.id, b.id, x.n, y.n having count(*) >= 0.6 * (x.n + y.n - count(*))""",
}
SQL["p1_classes"] = r"""
with r as (select 'web_extract_results' tbl, result_id id, result_id * 2 code, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w from web_extract_results
 union all select 'merged_results', merged_id, merged_id * 2 + 1, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') from merged_results),
g as (select tbl, id, code, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) s from r where len(w) >= 30),
c as (select s, min(code) class_id, len(s) n from g group by s),
t as (select class_id, n, unnest(s) s from c),
l as (select a.class_id a, b.class_id b from t a join t b on a.s = b.s and a.class_id <> b.class_id group by a.class_id, b.class_id, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*))),
k as (select a class_id, count(*) n_links from l group by a)
select g.tbl, g.id record_id, c.class_id, coalesce(k.n_links, 0)::bigint n_links from g join c on c.s = g.s left join k on k.class_id = c.class_id"""
