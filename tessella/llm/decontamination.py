"""Benchmark decontamination: a broadcast hash set of test n-grams against training token windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text lower-cased in A-Z.
A benchmark window is ``n`` consecutive words of an item (all words of a shorter
one).  The windows' hashes go to the executors in blocks of at most
``block_windows`` windows; a benchmark with more is scanned in several passes
over the documents' words, each with a bounded broadcast, so neither the size of
the benchmark nor that of the corpus changes the result.  Every hash hit is
verified on the words themselves.  The plan has no shuffle of documents.

Defined results: null and empty texts have no words; repeated items and windows
count once; an item with a null item_id marks words but is not listed; an empty
benchmark hits nothing; empty documents give an empty table; texts of any length
are scanned whole, slice by slice; repeated rows are scanned each for itself; other
columns of any name pass through, but for those named like an output (``n_words``,
``n_hit``, ``hit_runs``, ``hit_items``), which ``scan_benchmark`` replaces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize
from .words import LOWER, NON_ALNUM, hash_spans, slices, split_words, text_windows, texts_of

_SCAN = "n_words long, runs array<struct<start: int, stop: int>>, items array<string>"


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows as (window, length, items): words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                k = min(n, len(words))
                rows += [(b" ".join(words[i : i + k]).decode(), k, item) for i in range(len(words) - k + 1) if k]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], names=["window", "length", "item"]
            )

    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "window string, length int, item string")
    return rows.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


def words_of(text: str | None) -> list[bytes]:
    """The plain word rule for one text."""
    texts = texts_of(pa.array([text], pa.string()))
    data = LOWER[texts.data]
    words = split_words(texts, NON_ALNUM, data)
    return [data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]


class WindowSet:
    """Sorted window hashes by length; built once per task from the broadcast windows."""

    def __init__(self, windows: list[tuple[str, int, list[str]]]):
        by_length = defaultdict(list)
        for window, length, items in windows:
            by_length[length].append((window.encode(), items))
        self.sets = []
        for k, rows in sorted(by_length.items()):
            texts = texts_of(pa.array([w.decode() for w, _ in rows], pa.string()))
            words = split_words(texts, NON_ALNUM)
            at, h = text_windows(words, hash_spans(texts.data, words.starts, words.ends), k)
            order = np.argsort(h, kind="stable")
            items = defaultdict(dict)
            for i in order:
                items[int(h[i])][rows[words.owner[at[i]]][0]] = rows[words.owner[at[i]]][1]
            low = np.zeros(1 << 20, dtype=bool)
            low[h & np.uint64((1 << 20) - 1)] = True
            self.sets.append((k, np.unique(h), low, dict(items)))

    def scan(self, data: np.ndarray, words, hashes: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Words inside verified windows, and the items hit by text."""
        hit = np.zeros(len(hashes) + 1, dtype=np.int64)
        items: dict[int, set] = defaultdict(set)
        for k, known, low, by_hash in self.sets:
            at, h = text_windows(words, hashes, k)
            maybe = np.flatnonzero(low[h & np.uint64((1 << 20) - 1)])
            near = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            for i in maybe[known[near] == h[maybe]]:
                w = int(at[i])
                window = b" ".join(data[words.starts[j] : words.ends[j]].tobytes() for j in range(w, w + k))
                found = by_hash[int(h[i])].get(window)
                if found is not None:  # the words agree, not only their hash
                    hit[w] += 1
                    hit[w + k] -= 1
                    items[int(words.owner[w])].update(found)
        return np.cumsum(hit)[:-1] > 0, items


def _scanner(windows):
    def scan(column: pa.Array) -> pa.Array:
        known = WindowSet(windows.value)
        n_words, runs, items = [], [], []
        for part in slices(column):
            texts = texts_of(part)
            data = LOWER[texts.data]
            words = split_words(texts, NON_ALNUM, data)
            hit, found = known.scan(data, words, hash_spans(data, words.starts, words.ends))
            n_words.append(words.counts())
            for i in range(len(texts)):
                listed = found.get(i)
                low, high = words.first[i], words.first[i + 1]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], hit[low:high], [0]]))) if listed is not None else []
                runs.append([{"start": int(a), "stop": int(b)} for a, b in zip(turns[0::2], turns[1::2])])
                items.append(sorted(listed) if listed else [])
        arrays = [
            pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)])),
            pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            pa.array(items, pa.list_(pa.string())),
        ]
        return pa.StructArray.from_arrays(arrays, ["n_words", "runs", "items"])

    return scan


def _remove_runs(column: pa.Array, runs: pa.Array) -> pa.Array:
    """Texts without the words of their runs and what separates those words."""
    out = []  # texts without a run stay in Arrow
    hit = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(runs), 0), False).to_numpy(zero_copy_only=False))
    for i in hit:
        text, cuts = column[int(i)].as_py(), runs[int(i)].as_py()
        if cuts:
            texts = texts_of(pa.array([text]))
            words = split_words(texts, NON_ALNUM, LOWER[texts.data])
            raw, parts, at = texts.text(0), [], 0
            for stop, start in merged((c["start"], c["stop"]) for c in cuts):
                parts.append(raw[at : words.starts[start]])
                at = words.ends[stop - 1]
            text = b"".join([*parts, raw[at:]]).decode()
        out.append(text)
    mask = np.zeros(len(column), bool)
    mask[hit] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(out, column.type))


def merged(cuts) -> Iterator[tuple[int, int]]:
    """(stop, start) of the union of the half-open ranges, in order."""
    open_start = open_stop = None
    for start, stop in sorted(cuts):
        if open_stop is not None and start <= open_stop:
            open_stop = max(open_stop, stop)
            continue
        if open_stop is not None:
            yield open_stop, open_start
        open_start, open_stop = start, stop
    if open_stop is not None:
        yield open_stop, open_start


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = 200_000) -> DataFrame:
    """Adds n_words, hit_runs (word ranges inside benchmark windows), n_hit (their words) and hit_items (ids, sorted as strings).

    The windows are read in blocks of at most ``block_windows``; each block is
    broadcast and scanned in a pass of its own, so a broadcast stays bounded.
    """
    windows = benchmark_windows(benchmark, n)
    parts = max(1, -(-windows.count() // block_windows))
    names = ["n_words", "n_hit", "hit_runs", "hit_items"]
    name = free_name(docs, "found")
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    out, runs, items = docs.select(*plain), F.array(), F.array()
    for p in range(parts):
        share = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p)
        block = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in share.collect()])
        if p:
            out = materialize(out)
            runs, items = F.col("hit_runs"), F.col("hit_items")
        found = F.arrow_udf(_scanner(block), _SCAN)
        out = out.withColumn(name, found("text")).select(
            *plain,
            F.col(f"{name}.n_words").alias("n_words"),
            (F.concat(runs, f"{name}.runs") if p else F.col(f"{name}.runs")).alias("hit_runs"),
            F.array_sort(F.array_union(items, f"{name}.items") if p else F.col(f"{name}.items")).alias("hit_items"),
        )
    # runs of one pass are disjoint; those of several may overlap
    spelled = F.array_distinct(F.flatten(F.transform("hit_runs", lambda r: F.sequence(r["start"], r["stop"] - 1))))
    return out.select(*plain, "n_words", F.size(spelled).cast("long").alias("n_hit"), "hit_runs", "hit_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = 10) -> DataFrame:
    """Documents without the benchmark's windows: ``spans`` cuts the hit words, ``documents`` drops what holds any."""
    scanned = scan_benchmark(docs, benchmark, n)
    if remove == "documents":
        scanned = scanned.where("n_hit = 0")
    elif remove == "spans":
        scanned = scanned.withColumn("text", F.arrow_udf(_remove_runs, "string")("text", "hit_runs"))
    else:
        raise ValueError("remove is 'spans' or 'documents'")
    return scanned.select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT k FROM windows),
seen AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words CROSS JOIN lengths WHERE len(w) >= k)),
hits AS (SELECT s.doc_id, s.k, s.i, x.item_id FROM seen s JOIN windows x USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM words d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""
