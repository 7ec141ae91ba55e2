"""Hard negatives by search through buckets of candidates sorted by norm.

Vectors are whole numbers (``floor(256*x)``), scores their inner products.  Candidates
are dealt by range of norm, longest first, into buckets of one written table; a
task reads its bucket in chunks of falling norm.  An anchor's window asks for the first k rows in
a range of scores: its positives are one window over rows of its own label without a range,
and each positive opens a window over rows of other labels between 0.3 and 0.9 of its
score.  By Cauchy-Schwarz no score of a chunk exceeds the anchor's norm
times the longest norm in it, so a window skips chunks whose bound is below its
lower limit or its running kth score.  The first sixteenth of the buckets is searched first
and hands each window its kth score for the rest, so tasks return few rows of an anchor
however many buckets there are.  Anchors are read in blocks of at most ``BLOCK_CELLS`` components.

Defined results: rows with a null label, vector or vec_id or with a null or non-finite
component take no part; shorter vectors count as filled up with zeros, and an empty
one as all zeros; the row of a repeated vec_id with the smallest label and vector is the
anchor, all rows of a vec_id other than the anchor's are candidates, and rows that share a
vec_id are returned each for itself; an anchor without positives has no rows, nor has a positive without
negatives, as one of negative score; equal scores go by the smaller vec_id; an empty table gives an
empty one; other columns are not read.  Components beyond 31 bits after scaling
raise an error, as scores would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Appended, materialize
from .words import release

#: Components of the anchors of a block, rows of a bucket, least buckets, and the share of buckets searched first.
BLOCK_CELLS, BUCKET_ROWS, LEAST_BUCKETS, HEAD = 1 << 19, 1 << 16, 16, 16
#: Scores (windows by candidates) held at once, and rows of a chunk.
TILE, CHUNK = 1 << 20, 1 << 11

FOUND = "anchor_id long, window int, vec_id long, score long"


def integer_vectors(rows: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label as the contract relabels it, v (integers) and norm2."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    taken = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    fits = F.forall("v", lambda x: F.abs(x) < 1 << 31)
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component leaves 31 bits")).cast("array<long>"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return taken.select("vec_id", label.cast("long").alias("label"), whole.alias("v")).select("vec_id", "label", checked.alias("v"), norm2.alias("norm2"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as rows of a matrix, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, in doubles where no sum can round."""
    most = float(np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(1).max(initial=0)))
    if most >= 1 << 62:
        raise ValueError("scores leave 64 bits")
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 52 else a @ b.T


class Anchors:
    """Anchors of a block and their windows: [low, high] of scores, labels alike or not, and the kth score so far."""

    def __init__(self, rows: pa.Table, width: int, k: int, alike: bool):
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.vectors = np.concatenate([_matrix(c, width) for c in rows.column("v").chunks] or [np.zeros((0, width), np.int64)])
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        self.k, self.alike = k, alike
        n = len(self.ids)
        least = np.iinfo(np.int64).min
        self.windows(np.arange(n), np.zeros(n, np.int32), np.full(n, least), np.full(n, np.iinfo(np.int64).max))

    def windows(self, of: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        order = np.argsort(of, kind="stable")
        self.of, self.number, self.low, self.high = of[order], number[order], low[order], high[order]

    def raised(self, kth: np.ndarray) -> None:
        """A kth score found elsewhere is a lower limit: rows that tie with it still count."""
        self.low = np.maximum(self.low, kth)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first k rows of every window among the batches' rows (vec_id, label, v, norm2, by falling norm)."""
        need = self.low.copy()  # falls short of nothing: the lower limit, then the running kth score
        pool = np.zeros((3, 0), np.int64)  # window, score, vec_id
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                longest = float(np.sqrt(part.column(3).to_numpy().max()))
                live = np.flatnonzero(self.norms[self.of] * longest * (1 + 1e-9) + 1 >= need)
                if not len(live):
                    continue
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                vectors = _matrix(part.column(2), self.vectors.shape[1])
                step = max(1, TILE // len(part))
                for low in range(0, len(live), step):
                    w = live[low : low + step]
                    anchors, back = np.unique(self.of[w], return_inverse=True)
                    scores = _exact(self.vectors[anchors], vectors)[back]
                    fits = (self.labels[self.of[w]][:, None] == labels) == self.alike
                    fits &= (scores >= need[w][:, None]) & (scores <= self.high[w][:, None]) & (self.ids[self.of[w]][:, None] != ids)
                    i, j = np.nonzero(fits)
                    if len(i):
                        pool = self._first(np.concatenate([pool, np.stack([w[i], scores[i, j], ids[j]])], axis=1), need)
            release()
        window, score, vec_id = pool
        columns = [self.ids[self.of[window]], self.number[window].astype(np.int32), vec_id, score]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "window", "vec_id", "score"])

    def _first(self, pool: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The pool without what stands behind k others of its window; raises the running kth scores."""
        window, score, vec_id = pool
        pool = pool[:, np.lexsort((vec_id, -score, window))]
        place = np.arange(pool.shape[1]) - np.searchsorted(pool[0], pool[0])
        full = pool[:, place == self.k - 1]
        need[full[0]] = full[1]
        return pool[:, place < self.k]


def _searched(candidates: DataFrame, anchors: Anchors) -> DataFrame:
    sent = candidates.sparkSession.sparkContext.broadcast(anchors)
    return candidates.select("vec_id", "label", "v", "norm2").mapInArrow(lambda batches: sent.value.search(batches), FOUND)


def _first_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(candidates: DataFrame, heads: int, anchors: Anchors) -> DataFrame:
    """First rows of all windows: those of the longest vectors, then the others against the kth scores so far."""
    head = materialize(_first_rows(_searched(candidates.where(F.col("bucket") < heads), anchors), anchors.k))
    known = head.where(F.col("rank") == anchors.k).select("anchor_id", "window", "score").toArrow()
    place = {key: i for i, key in enumerate(zip(anchors.ids[anchors.of].tolist(), anchors.number.tolist()))}
    kth = np.full(len(anchors.of), np.iinfo(np.int64).min)
    for anchor, window, score in zip(*(known.column(c).to_pylist() for c in ("anchor_id", "window", "score"))):
        kth[place[anchor, window]] = score
    anchors.raised(kth)
    rest = _searched(candidates.where(F.col("bucket") >= heads), anchors)
    return _first_rows(head.drop("rank").unionByName(rest), anchors.k)


def candidate_buckets(rows: DataFrame) -> DataFrame:
    """Candidates in buckets of falling norm (bucket 0 has the longest), sorted inside."""
    buckets = max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    dealt = rows.repartitionByRange(buckets, F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"), "vec_id")
    return materialize(dealt.withColumn("bucket", F.spark_partition_id()))


def hard_negatives(rows: DataFrame, is_anchor, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and positive the first k rows of other labels whose score lies in low to high hundredths of the positive's.

    ``rows`` are those of ``integer_vectors``; ``is_anchor`` is a condition on them.
    """
    spark = rows.sparkSession
    candidates = candidate_buckets(rows)
    chosen = materialize(candidates.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"))
    buckets, width = candidates.agg(F.coalesce(F.max("bucket"), F.lit(-1)) + 1, F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    heads, blocks = -(-buckets // HEAD), max(1, -(-chosen.count() * width // BLOCK_CELLS))
    out = Appended(spark, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        positives = materialize(_rounds(candidates, heads, Anchors(block, width, n_positives, True)))
        opened, anchors = positives.select("anchor_id", "rank", "score").toArrow(), Anchors(block, width, k, False)
        place = np.argsort(anchors.ids)
        of = place[np.searchsorted(anchors.ids[place], opened.column("anchor_id").to_numpy())]
        score = opened.column("score").to_numpy()
        anchors.windows(of, opened.column("rank").to_numpy(), -(-low * score // 100), high * score // 100)
        named = positives.select("anchor_id", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = _rounds(candidates, heads, anchors).join(named, ["anchor_id", "window"])
        out.add(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out.read()


ORACLE = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) IS NOT FALSE),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS alike,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
