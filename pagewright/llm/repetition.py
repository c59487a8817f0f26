"""Repetition inside one document, with cutoffs chosen under a bound on false rejections.

The share of a document is the part of its words that lie in a sequence of ``SPAN`` consecutive
words occurring at least ``TIMES`` times in it (occurrences may overlap). It is computed for all
documents in one pass over whole texts, without a shuffle. A document is repetitive (``found``) if its
share reaches ``FLOOR``; that bound is the problem's definition and no label moves it.

Which share a pipeline may reject from without losing good documents is another question, and it is
answered for each stratum (``kind``) by people's labels: a labelled document of quality ``GOOD`` or more
must be kept, whatever its share, and rejecting it is a false rejection. All labelled documents are the
holdout; nothing else is fitted on them. Cutoffs of a fixed grid, below and above FLOOR, are tested from
the highest down: one passes if the exact (Clopper-Pearson) upper bound of its false-rejection rate at
confidence 1 - DELTA / strata is at most ``ALPHA``, and the first that fails ends the stratum's sequence.
Fixed-sequence testing needs no further division by the size of the grid, and the division by the strata
makes all bounds hold together. A stratum's cutoff is the lowest that passed; one where none passes (too
few labels, or good documents that repeat themselves) is not certified and rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import kernel
from pagewright.session import materialize, table

SPAN, TIMES = 5, 3
FLOOR = 0.4
#: Cutoffs, from the safest on.
GRID = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
#: Quality from which a labelled document must be kept; the rate of false rejections that is allowed; the
#: probability that any stratum's cutoff exceeds it.
GOOD, ALPHA, DELTA = 4, 0.1, 0.05


def repeated_words(w: kernel.Words, span: int = SPAN, times: int = TIMES) -> np.ndarray:
    """Of each text, the number of words inside a sequence that occurs ``times`` times in it."""
    h, at = kernel.grams(w, span)
    out = np.zeros(len(w.first) - 1, np.int64)
    if not len(h):
        return out
    own = w.owner()
    key = kernel.mix(h + kernel.mix(own[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(new, len(ranked)))
    often = order[np.repeat(size >= times, size)]
    if not len(often):
        return out
    mark = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(mark, at[often], 1)
    np.add.at(mark, at[often] + span, -1)
    return np.bincount(own[np.cumsum(mark[:-1]) > 0], minlength=len(out)).astype(np.int64)


def repetition(df: DataFrame, id_column: str, text_column: str, *keep: str) -> DataFrame:
    """(id, *keep, n_words, n_repeated, share): one row for each row of ``df``.

    Null, empty and wordless texts have share 0. Ids may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = [], []
            for _, block in kernel.blocks(b.column(0).to_pylist()):
                w = kernel.words(block)
                n.append(w.counts)
                r.append(repeated_words(w))
            n, r = np.concatenate(n), np.concatenate(r)
            share = np.where(n > 0, r / np.maximum(n, 1), 0.0)
            arrays = [*b.columns[1:], pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_column, *keep, "n_words", "n_repeated", "share"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (id_column, *keep))
    rows = df.select(F.col(text_column).alias("__text"), id_column, *keep)
    return rows.mapInArrow(run, kinds + "n_words long, n_repeated long, share double")


def upper_bound(rejected: int, n: int, confidence: float) -> float:
    """Clopper-Pearson: the largest rate under which at most ``rejected`` of n still has a
    probability of 1 - confidence."""
    if n == 0 or rejected >= n:
        return 1.0
    k = np.arange(rejected + 1)
    steps = np.concatenate([[0.0], np.cumsum(np.log(n - np.arange(rejected)) - np.log(np.arange(rejected) + 1.0))])
    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = np.exp(steps + k * np.log(p) + (n - k) * np.log1p(-p)).sum() if p < 1 else 0.0
        low, high = (p, high) if tail > 1 - confidence else (low, p)
    return high


def risk_cutoffs(shares: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(kind, cutoff, n_holdout, n_rejected, bound, certified): one row for each kind of ``shares``
    (a null kind counts as '').

    Of several labels of a document the best counts; null ones don't. An uncertified kind has the cutoff
    FLOOR, which rejects nothing by itself, with the bound that the safest cutoff reached.
    """
    shares = shares.select("doc_id", F.coalesce("kind", F.lit("")).alias("kind"), "share")
    quality = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kept = shares.join(quality.where(F.col("quality") >= GOOD).select("doc_id"), "doc_id", "left_semi")
    counts = kept.groupBy("kind").agg(F.count("*").alias("n"), *[F.sum((F.col("share") >= c).cast("long")).alias(f"r{i}") for i, c in enumerate(GRID)])
    strata = shares.groupBy("kind").agg(F.count("*").alias("documents"))
    m = strata.agg(F.count("*").alias("m"))
    rows = strata.join(counts, "kind", "left").join(F.broadcast(m))  # m is one row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.fillna(0).to_dict("records"):
                n, best = int(x["n"]), None
                for i, c in enumerate(GRID):
                    r = int(x[f"r{i}"])
                    b = upper_bound(r, n, 1 - delta / x["m"])
                    if b > alpha:
                        best = best or (x["kind"], FLOOR, n, r, b, False)
                        break
                    best = (x["kind"], c, n, r, b, True)
                out.append(best)
            yield pd.DataFrame(out, columns=["kind", "cutoff", "n_holdout", "n_rejected", "bound", "certified"])

    return rows.mapInPandas(run, "kind string, cutoff double, n_holdout long, n_rejected long, bound double, certified boolean")


def judged(shares: DataFrame, cutoffs: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Shares with ``found`` (the share reaches the floor) and ``rejected`` (it reaches its kind's certified
    cutoff)."""
    own = cutoffs.where("certified").select(F.col("kind").alias("__kind"), F.col("cutoff").alias("__cutoff"))
    out = shares.join(own, F.coalesce("kind", F.lit("")) == F.col("__kind"), "left")
    rejected = F.coalesce(F.col("share") >= F.col("__cutoff"), F.lit(False))
    return out.withColumns({"found": F.col("share") >= floor, "rejected": rejected}).drop("__kind", "__cutoff")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"), "doc_id", "text", "kind")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = materialize(_shares(spark, sf_dir), "p10")
    return judged(shares, risk_cutoffs(shares, table(spark, sf_dir, "labels")))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_repeated, share) of every document."""
    return _shares(spark, sf_dir).select("doc_id", "n_words", "n_repeated", F.round("share", 6).alias("share"))


def p10_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff of each kind, with what it rests on."""
    got = risk_cutoffs(_shares(spark, sf_dir), table(spark, sf_dir, "labels"))
    return got.select("kind", "cutoff", "n_holdout", "n_rejected", "certified")


def p10_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, n_found, n_rejected): repetitive documents, and those that certified cutoffs reject."""
    count = lambda c: F.count(F.when(F.col(c), 1))
    return _judged(spark, sf_dir).groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(count("found").alias("n_found"), count("rejected").alias("n_rejected"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of repetitive documents, judged together with their kinds' certified cutoffs."""
    return _judged(spark, sf_dir).where("found").select("doc_id")


SQL = {
    "p10_shares": r"""
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) i from documents),
g as (select doc_id, i, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p || ' ' || lead(word, 3) over p || ' ' || lead(word, 4) over p g from w window p as (partition by doc_id order by i)),
c as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from g where g is not null) where n >= 3),
r as (select doc_id, count(distinct i + k) n_repeated from c, (select unnest([0, 1, 2, 3, 4]) k) group by doc_id),
n as (select doc_id, count(*) n_words from w group by doc_id)
select d.doc_id, coalesce(n.n_words, 0) n_words, coalesce(r.n_repeated, 0) n_repeated, round(case when n.n_words > 0 then coalesce(r.n_repeated, 0)::double / n.n_words else 0 end, 6) share
from documents d left join n using (doc_id) left join r using (doc_id)""",
}
SQL["p10_found"] = f"select doc_id from ({SQL['p10_shares']}) where share >= 0.4"

_CUTOFFS = f"""(with s as (select d.doc_id, coalesce(d.kind, '') kind, x.share from documents d join ({SQL['p10_shares']}) x using (doc_id)),
m as (select count(distinct kind) m from s), q as (select doc_id from labels group by doc_id having max(quality) >= {GOOD}),
g as (select unnest({GRID!r}::double[]) c, unnest(range(1, {len(GRID) + 1})) i),
t as (select s.kind, c, i, count(q.doc_id) n, count(q.doc_id) filter (share >= c) r from s cross join g left join q on q.doc_id = s.doc_id group by all),
p as (select *, coalesce(list_sum(list_transform(range(0, r + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({ALPHA}) + (n - k) * ln(1 - {ALPHA})))), 1) <= {DELTA} / m ok from t, m),
f as (select *, bool_and(ok) over (partition by kind order by i) good from p)
select kind, case when bool_or(good) then min(c) filter (good) else {FLOOR} end cutoff, any_value(n) n_holdout, case when bool_or(good) then arg_max(r, i) filter (good) else arg_min(r, i) end n_rejected, bool_or(good) certified from f group by kind)"""
SQL["p10_cutoffs"] = f"select * from {_CUTOFFS}"
SQL["p10_rejected"] = f"select coalesce(d.kind, '') kind, count(*) filter (x.share >= {FLOOR}) n_found, count(*) filter (c.certified and x.share >= c.cutoff) n_rejected from documents d join ({SQL['p10_shares']}) x using (doc_id) join {_CUTOFFS} c on c.kind = coalesce(d.kind, '') group by 1"
