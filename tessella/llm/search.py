"""Ranked lexical search over a two-level index of quantised impacts.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, told
apart by 64 bits of a hash.  The impact of a term in a document is
``(1000000000*tf) div (1000*tf + 20*m)`` with ``m = 50 + (50*n*N) div L``; an item's
score of a document sums weight times impact over the item's terms.

``build_index`` writes one row for every document.  Level one is its terms and one
byte for each, the impact in steps of ``STEP`` rounded up; level two is the counts
and the length from which impacts come exactly.  ``search`` takes the items in
blocks of bounded size and reads the index three times for each, never shuffling it:
document frequencies of the block's terms; then bounds from the bytes alone, which
give each item's kth largest lower bound over all documents; then the bounds again,
where every document whose upper bound reaches that kth lower bound is scored
exactly in integers.  A document of the first k has a score of at least the kth
lower bound, so none is lost, nor one that ties with the last.

Defined results: a null or empty text has no terms, counts in neither N nor L and is
never returned; an item without terms has no rows; items that share an item_id
are one item with the terms of all, and null is an id like others; each row of documents is a
document, so rows that share a doc_id are ranked each for itself; equal scores go by
doc_id, null last; no documents or no items give an empty table; texts of any length
are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Appended, id_type, materialize
from .words import LOWER, NON_ALNUM, hash_spans, release, signed, slices, split_words, texts_of

#: Impacts stay below 1,000,000, so a byte counts steps of this size.
STEP = -(-1_000_000 // 255)
#: Items and (item, term) pairs of a block, on average; its matrix of weights is never dense.
BLOCK_ITEMS, BLOCK_PAIRS = 256, 1 << 14
#: Cells of the matrix of impacts (terms of the block by documents) held at once.
CELLS = 1 << 21


def _terms(column: pa.Array):
    """Texts, words and hashes of a slice; NON_ALNUM on lower-cased bytes leaves digits, letters and what is above ASCII."""
    texts = texts_of(column)
    data = LOWER[texts.data]
    words = split_words(texts, NON_ALNUM, data)
    return words, hash_spans(data, words.starts, words.ends)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Exact impacts of terms that occur tf times in documents of n terms."""
    m = 50 + 50 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Index:
    """Rows (id, n_terms, terms, bounds, counts) and the corpus totals N and L."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_column: str = "doc_id") -> Index:
    """Counts the corpus, then writes both levels of the index of every document."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_terms(part)[0].counts() for part in slices(batch.column(0))]
            found = np.concatenate([*sizes, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_pydict({"docs": [int((found > 0).sum())], "terms": [int(found.sum())]})

    total = rows.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, hashes = _terms(part.column(1))
                order = np.lexsort((hashes, words.owner))
                owner, h = words.owner[order], hashes[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(h)))
                owner, n = owner[first], words.counts()
                bounds = -(-impacts(tf, n[owner], n_docs, n_terms) // STEP)
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                packed = [_packed(x, cut) for x in (signed(h[first]), bounds.astype(np.uint8), tf.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *packed], names=["id", "n_terms", "terms", "bounds", "counts"])

    schema = f"id {id_type(rows, 'id')}, n_terms long, terms binary, bounds binary, counts binary"
    return Index(materialize(rows.mapInArrow(index, schema)), n_docs, n_terms)


def _packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """One binary value of packed numbers for each document."""
    offsets = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all documents of a slice, and where each document's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return values, (offsets - offsets[0]) // size


class Block:
    """Items of one block: its terms, sorted, the terms and weights of each item, and kth lower bounds."""

    def __init__(self, terms: np.ndarray, of_item: list[np.ndarray]):
        self.terms, self.of_item = terms, of_item
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[terms & 0xFFFFF] = True
        self.rows = max(1, min(2048, CELLS // max(1, len(terms))))
        self.weights: list[np.ndarray] = []
        self.reach: np.ndarray | None = None
        self.kind = np.float64

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        self.weights = [weight[x] for x in self.of_item]
        if max((int(w.sum()) for w in self.weights), default=0) * 255 * STEP >= 1 << 53:
            self.kind = np.int64  # doubles would round
        self.weights = [w.astype(self.kind) for w in self.weights]

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose term is one of the block's, and which."""
        maybe = np.flatnonzero(self.low[terms & 0xFFFFF])
        near = np.minimum(np.searchsorted(self.terms, terms[maybe]), len(self.terms) - 1)
        same = self.terms[near] == terms[maybe]
        return maybe[same], near[same]

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of a batch: (rows, positions, their terms, their document in the slice)."""
        for at in range(0, len(batch), self.rows):
            part = batch.slice(at, self.rows)
            terms, cut = _unpacked(part.column(part.schema.get_field_index("terms")), "<i8")
            where, which = self.known(terms)
            yield part, where, which, np.searchsorted(cut, where, "right") - 1

    def bounds(self, part: pa.RecordBatch, where: np.ndarray, which: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every item, lower and upper bounds of the slice's documents."""
        steps = _unpacked(part.column(part.schema.get_field_index("bounds")), "u1")[0][where]
        matrix = np.zeros((2, len(self.terms), len(part)), dtype=self.kind)
        matrix[0, which, owner] = steps
        matrix[1, which, owner] = steps > 0
        for terms, weights in zip(self.of_item, self.weights):
            upper = weights @ matrix[0, terms]
            yield (upper - weights @ matrix[1, terms]) * STEP, upper * STEP


def search(index: Index, items: DataFrame, k: int = 50, id_column: str = "item_id") -> DataFrame:
    """The first k documents of every item as (item_id, rank, id, score)."""
    pairs = _item_terms(items, id_column)
    sizes = pairs.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item"))).first()
    blocks = max(1, -(-sizes[0] // BLOCK_PAIRS), -(-sizes[1] // BLOCK_ITEMS))
    spark, kind = items.sparkSession, id_type(pairs, "item")
    out = Appended(spark, f"item {kind}, rank int, id {id_type(index.rows, 'id')}, score long")
    for b in range(blocks if sizes[0] else 0):
        ids, block = _read_block(pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b))
        if ids:
            found = _search_block(index, block, k)
            names = spark.createDataFrame(list(enumerate(ids)), f"i int, item {kind}")
            out.add(found.join(F.broadcast(names), "i").select("item", "rank", "id", "score"))
    return out.read().withColumnRenamed("item", "item_id")


def _item_terms(items: DataFrame, id_column: str) -> DataFrame:
    """Distinct (item, term) of all items."""
    rows = items.select(F.col(f"`{id_column}`").alias("item"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, hashes = _terms(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(words.owner)), pa.array(signed(hashes))], names=["item", "term"])

    return materialize(rows.mapInArrow(cut, f"item {id_type(rows, 'item')}, term long").distinct())


def _read_block(pairs: DataFrame) -> tuple[list, Block]:
    """A block's items and terms; their number is bounded by the number of blocks."""
    table = pairs.toArrow()
    items = table.column("item").combine_chunks().dictionary_encode("encode")
    ids = items.dictionary.to_pylist()
    terms, which = np.unique(table.column("term").to_numpy(), return_inverse=True)
    of = items.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    return ids, Block(terms, np.split(which[order], np.flatnonzero(np.diff(of[order])) + 1) if len(of) else [])


def _search_block(index: Index, block: Block, k: int) -> DataFrame:
    """(i, rank, id, score) of the block's items."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value.terms), np.int64)
        for batch in batches:
            for _, _, which, _ in sent.value.parts(batch):
                df += np.bincount(which, minlength=len(df))
            release()
        yield pa.RecordBatch.from_pydict({"v": np.flatnonzero(df).astype(np.int32), "n": df[df > 0]})

    counted = index.rows.select("terms").mapInArrow(frequencies, "v int, n long").groupBy("v").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(block.terms), np.int64)
    df[counted.column("v").to_numpy()] = counted.column("n").to_numpy()
    block.weigh(df, index.n_docs)
    weighed = spark.sparkContext.broadcast(block)

    def lower_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(weighed.value.of_item), k), np.int64)
        for batch in batches:
            for part, *hits in weighed.value.parts(batch):
                for i, (lower, _) in enumerate(weighed.value.bounds(part, *hits)):
                    more = lower[lower > best[i].min()]
                    if len(more):
                        best[i] = np.sort(np.concatenate([best[i], more.astype(np.int64)]))[-k:]
            release()
        i, j = np.nonzero(best)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "low": best[i, j]})

    lows = index.rows.select("terms", "bounds").mapInArrow(lower_bounds, "i int, low long")
    kth = lows.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("low")))).where(F.col("place") == k)
    block.reach = np.ones(len(block.of_item), np.int64)  # fewer than k lower bounds: all with a score
    for i, low in kth.select("i", "low").collect():
        block.reach[i] = low
    reached = spark.sparkContext.broadcast(block)
    n_docs, n_terms = index.n_docs, index.n_terms

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reached.value
        for batch in batches:
            for part, where, which, owner in known.parts(batch):
                upper = [np.flatnonzero(high >= reach) for (_, high), reach in zip(known.bounds(part, where, which, owner), known.reach)]
                docs = np.unique(np.concatenate([*upper, np.zeros(0, np.int64)]))
                inside = np.isin(owner, docs)
                tf = _unpacked(part.column(4), "<i4")[0][where[inside]].astype(np.int64)
                n = part.column(1).to_numpy(zero_copy_only=False)[owner[inside]]
                exact = np.zeros((len(known.terms), len(docs)), dtype=known.kind)
                exact[which[inside], np.searchsorted(docs, owner[inside])] = impacts(tf, n, n_docs, n_terms)
                scores = [w @ exact[t][:, np.searchsorted(docs, rows)] for t, w, rows in zip(known.of_item, known.weights, upper)]
                i = np.repeat(np.arange(len(upper), dtype=np.int32), [len(x) for x in upper])
                rows = np.concatenate([*upper, np.zeros(0, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(i), part.column(0).take(pa.array(rows)), pa.array(np.concatenate([*scores, np.zeros(0)]).astype(np.int64))], names=["i", "id", "score"])
            release()

    scored = index.rows.select("id", "n_terms", "terms", "bounds", "counts").mapInArrow(rescore, f"i int, id {id_type(index.rows, 'id')}, score long")
    order = Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nt FROM docs WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, nd),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
