"""Substring dedup on sentence spans.

A sentence ends at ``.``, ``!`` or ``?`` before white space, at a newline, and, so
that prose without such marks has spans too, after the word with the smallest hash
of every ``WINDOW`` words that hold no such end (winnowing).  So any ``WINDOW``
words hold an end, and ends depend on less than ``WINDOW`` words to either side:
two copies of 3 ``WINDOW`` + ``min_words`` - 2 words (51) share a run, whatever
stands around them.  From every sentence on, the run
of at least ``min_sentences`` sentences and ``min_words`` words is hashed (96 bits,
of its words lower-cased in A-Z).  A global aggregation finds the runs that occur
more than once and their first place (smallest doc_id, then position); a join
brings them back to all other places, and every sentence that such a non-first
run covers is removed.  That join keeps an exchange on either side, so adaptive
execution can split a run that a third of all documents share.

Defined results: null and empty texts have no sentence and stay as they are;
rows with a null doc_id have no spans; rows that share doc_id and text are one
place; ties cannot occur (a place is doc_id, hash of text, sentence); doc_id may be
of any type that has an order; texts of any length are cut whole, slice by slice;
an empty table gives an empty one; other columns of any name pass through, but for
``n_sentences`` and ``n_removed``, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, id_type, materialize
from .words import LOWER, SPACES, Texts, hash_spans, mix, signed, slices, split_words, texts_of

WINDOW = 11
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?")] = True


def winnowed(hashes: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Of every WINDOW words without a close, the last of those with the smallest hash."""
    m = len(hashes) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, WINDOW):
        at[hashes[j : j + m] <= best] = j
        np.minimum(best, hashes[j : j + m], out=best)
    before = np.concatenate([[0], np.cumsum(closes)])
    open_ = np.flatnonzero(before[WINDOW:] == before[:m])
    return open_ + at[open_]


class Sentences:
    """Sentences of a slice as word ranges, and for each the end (in sentences) of the run that starts there."""

    def __init__(self, texts: Texts, min_sentences: int, min_words: int):
        data = LOWER[texts.data]
        words = split_words(texts, SPACES, data)
        self.words, n = words, len(words.starts)
        self.hashes = hash_spans(data, words.starts, words.ends)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        closes = np.zeros(n, dtype=bool)
        if n:
            closes |= _STOPS[data[words.ends - 1]]
            closes[:-1] |= lines[words.starts[1:]] > lines[words.ends[:-1]]
            closes[words.first[1:][words.first[1:] > 0] - 1] = True
            closes[winnowed(self.hashes, closes)] = True
        self.stop = np.flatnonzero(closes) + 1  # word after each sentence
        self.start = np.concatenate([[0], self.stop[:-1]]).astype(np.int64)[: len(self.stop)]
        self.first = np.searchsorted(self.start, words.first)  # first sentence of each text
        self.owner = words.owner[self.start] if n else np.zeros(0, np.int64)
        m = len(self.stop)
        by_words = np.searchsorted(self.stop, self.start + min_words)
        self.run_end = np.maximum(np.arange(m) + min_sentences, by_words + 1)  # sentence after the run
        self.whole = self.run_end <= (self.first[self.owner + 1] if m else 0)

    def run_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentences at which a whole run starts, and two hashes of each run's words."""
        at = np.flatnonzero(self.whole)
        low, high = self.start[at], self.stop[self.run_end[at] - 1]
        base, inverse = 0xA0761D6478BD642F, pow(0xA0761D6478BD642F, -1, 1 << 64)
        power, back = (np.full(len(self.hashes) + 1, b, dtype=np.uint64) for b in (base, inverse))
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        out = []
        for values in (self.hashes, mix(self.hashes + np.uint64(1))):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)])
            out.append(mix((running[high] - running[low]) * back[low] + (high - low).astype(np.uint64)))
        return at, out[0], out[1]


def _spans(min_sentences: int, min_words: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sentences(texts_of(part.column(1)), min_sentences, min_words)
                at, one, two = s.run_hashes()
                owner = s.owner[at]
                place = part.column(2).to_numpy()[owner] << 32 | (at - s.first[owner])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(one)), pa.array((two >> np.uint64(33)).astype(np.int32)), part.column(0).take(pa.array(owner)), pa.array(place)],
                    names=["h1", "h2", "doc_id", "place"],
                )

    return spans


def _cut(min_sentences: int, min_words: int):
    """Removes the sentences that the runs starting at the given places cover, with the white space after them."""

    def cut(column: pa.Array, places: pa.Array) -> pa.Array:
        kept, total, gone = [], [], []
        begin = 0
        for part in slices(column):
            texts = texts_of(part)
            s = Sentences(texts, min_sentences, min_words)
            total.append(np.diff(s.first))
            for i, original in enumerate(part):
                starts = places[begin + i].as_py()
                if not starts:
                    kept.append(original.as_py())
                    gone.append(0)
                    continue
                low, high = int(s.first[i]), int(s.first[i + 1])
                covered = np.zeros(high - low + 1, dtype=np.int64)
                for p in starts:
                    p &= 0xFFFFFFFF
                    covered[p] += 1
                    covered[s.run_end[low + p] - low] -= 1
                drop = np.cumsum(covered)[:-1] > 0
                raw, base, out, at = texts.text(i), int(texts.offsets[i]), [], 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], drop, [0]])))
                for a, b in zip(turns[0::2], turns[1::2]):
                    out.append(raw[at : s.words.starts[s.start[low + a]] - base])
                    last = low + b == high
                    at = len(raw) if last else int(s.words.starts[s.start[low + b]]) - base
                kept.append(b"".join([*out, raw[at:]]).decode())
                gone.append(int(drop.sum()))
            begin += len(part)
        arrays = [
            pa.array(kept, pa.string()),
            pa.array(np.concatenate(total or [np.zeros(0, np.int64)])),
            pa.array(gone, pa.int64()),
        ]
        return pa.StructArray.from_arrays(arrays, ["text", "n_sentences", "n_removed"])

    return cut


def repeated_spans(docs: DataFrame, min_sentences: int = 2, min_words: int = 20) -> DataFrame:
    """(doc_id, place) of every run that occurred before; place packs 32 bits of the text's hash and the first sentence."""
    mark = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).alias("mark")
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", mark)
    runs = rows.mapInArrow(_spans(min_sentences, min_words), f"h1 long, h2 int, doc_id {id_type(docs)}, place long")
    seen = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first"))
    first = materialize(seen.where("n > 1").select("h1", "h2", F.col("first.doc_id").alias("d"), F.col("first.place").alias("p")))
    return runs.join(first, ["h1", "h2"]).where("doc_id <> d OR place <> p").select("doc_id", "place")


def dedup_substrings(docs: DataFrame, min_sentences: int = 2, min_words: int = 20) -> DataFrame:
    """Documents without the sentences of repeated runs; adds n_sentences (before) and n_removed."""
    doc, own_mark, places, out = (free_name(docs, name) for name in ("span_doc", "span_mark", "span_places", "cut"))
    spans = repeated_spans(docs, min_sentences, min_words)
    mark = F.col("place").bitwiseAND(F.lit(~0xFFFFFFFF))
    gone = spans.groupBy(F.col("doc_id").alias(doc), mark.alias(own_mark)).agg(F.collect_set("place").alias(places))
    own = F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)), 32)
    on = (F.col("doc_id") == F.col(doc)) & (own == F.col(own_mark))
    cut = F.arrow_udf(_cut(min_sentences, min_words), "text string, n_sentences long, n_removed long")
    names = [c for c in docs.columns if c not in {"n_sentences", "n_removed"}]
    joined = docs.join(gone.hint("shuffle_hash"), on, "left").withColumn(out, cut("text", places))
    return joined.select(*[F.col(f"{out}.text" if c == "text" else f"`{c}`") for c in names], f"{out}.n_sentences", f"{out}.n_removed")
