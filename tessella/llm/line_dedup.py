"""Line dedup by range-partitioned hashes with secondary sort.

Each document emits 128-bit hashes of its long line keys.  The rows are range
partitioned and sorted by (hash, doc_id descending, position), so the line of
the largest doc_id comes first in its run and stays, and one streaming pass
decides each run while holding only the rows of ``min_docs - 1`` documents.  The
range includes doc_id and position, so a line found in a third of all documents
is spread over many tasks; a run that touches the edge of a partition is left
undecided, its pieces are counted per hash (at most two hashes a partition,
which bounds the broadcast), and its rows are decided by that count.  Texts
never enter that shuffle: dropped positions become one keep bitmap a document.

Defined results: a null or empty text is one empty line; keys compare by hash
of 128 bits; rows that share doc_id count as one document, each with a bitmap of
its own (told apart by a hash of the text), so repeated rows lose the same lines;
rows with a null doc_id hold no line and lose none; doc_id may be of any type
that has an order; texts of any length count whole, slice by slice; an empty
table gives an empty one; other columns of any name pass through, but for
``n_lines`` and ``n_dropped``, which the results replace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, id_type, materialize
from .words import LOWER, SPACES, Texts, hash_spans, signed, slices, texts_of

#: Kinds of streamed rows: dropped for certain, undecided, and the count of a run's piece at a partition's edge.
DROPPED, UNDECIDED, PIECE = 0, 1, 2


def line_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of every text and the text that each belongs to."""
    data, offsets = texts.data, texts.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per_text = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    return starts, ends, np.repeat(np.arange(len(texts)), per_text)


def strip_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without [\\x20\\x09-\\x0D] at both ends; blank spans become empty."""
    solid = np.flatnonzero(~SPACES[data])
    if not len(solid):
        return starts, starts
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    blank = low == high
    s = np.where(blank, starts, solid[np.minimum(low, len(solid) - 1)])
    e = np.where(blank, starts, solid[np.maximum(high - 1, 0)] + 1)
    return s, e


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return heads[ends] - heads[starts]


def _line_keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column(1))
                data = LOWER[texts.data]
                starts, ends, owner = line_spans(texts)
                first = np.searchsorted(owner, np.arange(len(texts)))
                s, e = strip_spans(data, starts, ends)
                long = np.flatnonzero(code_points(data, s, e) >= min_chars)
                s, e, owner = s[long], e[long], owner[long]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(hash_spans(data, s, e, 0))),
                        pa.array(signed(hash_spans(data, s, e, 1))),
                        part.column(0).take(pa.array(owner)),
                        part.column(2).take(pa.array(owner)),
                        pa.array((long - first[owner]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "fp", "pos"],
                )

    return keys


class _Run:
    """The open run: distinct documents so far, the first (largest) doc_id, and rows held while undecided."""

    def __init__(self, edge: bool):
        self.edge, self.docs, self.largest, self.last, self.held = edge, 0, None, None, []

    def extend(self, piece: pa.RecordBatch, ids: np.ndarray, min_docs: int) -> Iterator[pa.RecordBatch]:
        if self.largest is None:
            self.largest, self.key = ids[0], piece.slice(0, 1)
        self.docs += int(ids[0] != self.last or self.docs == 0) + int(np.count_nonzero(ids[1:] != ids[:-1]))
        self.last = ids[-1]
        if self.edge:
            yield _row(piece, UNDECIDED)
            return
        self.held.append(piece)
        if self.docs >= min_docs:
            for p in self.held:
                yield _row(p.filter(pc.not_equal(p.column(2), pa.scalar(self.largest, p.column(2).type))), DROPPED)
            self.held = []

    def close(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.edge or at_end:
            yield from (_row(p, UNDECIDED) for p in self.held)
            yield _row(self.key, PIECE, self.docs)


def _row(rows: pa.RecordBatch, kind: int, docs: int = 0) -> pa.RecordBatch:
    n = len(rows)
    more = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, docs, np.int64))]
    return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "kind", "docs"])


def _stream_runs(min_docs: int):
    """Streams rows sorted by (h1, h2, doc_id desc): first occurrences stay, later ones come out as DROPPED."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, key = None, None
        for batch in batches:
            if not len(batch):
                continue
            h1, h2, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1, [len(batch)]])
            at = 0
            if run is None or key == (h1[0], h2[0]):
                run = run or _Run(edge=True)
                yield from run.extend(batch.slice(0, int(cut[1])), doc[: cut[1]], min_docs)
                at = 1
            key = (h1[-1], h2[-1])
            if at == len(cut) - 1:
                continue
            yield from run.close(at_end=False)
            low, high = int(cut[at]), int(cut[-2])
            if high > low:  # runs that lie within the batch
                starts, ids = cut[at:-2] - low, doc[low:high]
                step = np.concatenate([[1], ids[1:] != ids[:-1]]).astype(np.int64)
                step[starts] = 1
                docs = np.add.reduceat(step, starts)
                size = np.diff(np.concatenate([starts, [high - low]]))
                drop = np.repeat(docs >= min_docs, size) & (ids != np.repeat(ids[starts], size))
                if drop.any():
                    yield _row(batch.slice(low, high - low).filter(pa.array(drop)), DROPPED)
            run = _Run(edge=False)
            yield from run.extend(batch.slice(high), doc[high:], min_docs)
        if run is not None:
            yield from run.close(at_end=True)

    return stream


def keep_bitmap(dropped: list[int]) -> bytes:
    """Compressed bitmap, one bit a line (1: kept); lines beyond its end are kept."""
    bits = np.ones(-(-(max(dropped) + 1) // 8) * 8, dtype=np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def line_bitmaps(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc_id, fp, keep): the keep bitmap of every document that loses a line; fp is xxhash64 of its text."""
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("fp"))
    shape = f"h1 long, h2 long, doc_id {id_type(docs)}, fp long, pos int"
    keys = materialize(keyed.mapInArrow(_line_keys(min_chars), shape))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    # the hash and doc_id, not the position: lines of one document stay together, so distinct documents add up
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order, "fp", "pos")
    rows = materialize(ranged.mapInArrow(_stream_runs(min_docs), f"{shape}, kind int, docs long"))
    # at most two hashes a partition touch its edges: the bound of this broadcast
    totals = rows.where(F.col("kind") == PIECE).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("largest"))
    late = rows.where(F.col("kind") == UNDECIDED).join(F.broadcast(totals.where(F.col("n") >= min_docs)), ["h1", "h2"])
    dropped = rows.where(F.col("kind") == DROPPED).select("doc_id", "fp", "pos").unionAll(
        late.where("doc_id < largest").select("doc_id", "fp", "pos")
    )
    bitmap = F.arrow_udf(lambda a: pa.array([keep_bitmap(x) for x in a.to_pylist()], pa.binary()), "binary")
    return dropped.groupBy("doc_id", "fp").agg(F.collect_list("pos").alias("gone")).select("doc_id", "fp", bitmap("gone").alias("keep"))


def _without_lines(text: str, keep: bytes) -> tuple[str, int, int]:
    """The text without the lines that the bitmap drops, its lines before, and how many went."""
    parts = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(parts)]
    left = [p for p, b in zip(parts, bits) if b] + parts[len(bits) :]
    return "\n".join(left), len(parts), len(parts) - len(left)


def _apply_bitmaps(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    parts, begin = [], 0
    for part in slices(texts):  # only one slice at a time is Python text
        lines = pc.add(pc.count_substring(pc.fill_null(part, ""), "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        kept, gone, keep = pc.fill_null(part, ""), np.zeros(len(part), np.int64), bitmaps.slice(begin, len(part))
        hit = np.flatnonzero(keep.is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            changed = [_without_lines(kept[int(i)].as_py(), keep[int(i)].as_py()) for i in hit]
            gone[hit] = [c[2] for c in changed]
            mask = np.zeros(len(part), bool)
            mask[hit] = True
            kept = pc.replace_with_mask(kept, pa.array(mask), pa.array([c[0] for c in changed], kept.type))
        parts.append(pa.StructArray.from_arrays([kept.cast(pa.string()), pa.array(lines), pa.array(gone)], ["text", "n_lines", "n_dropped"]))
        begin += len(part)
    empty = pa.array([], pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))
    return pa.concat_arrays([empty, *parts])


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Documents with repeated lines removed from ``text``, plus n_lines (before) and n_dropped.

    A key is a line stripped of ASCII white space and lower-cased in A-Z; keys of
    ``min_chars`` code points or more found in ``min_docs`` documents or more stay
    only in the largest doc_id that holds them.
    """
    doc, fp, bits, out = (free_name(docs, name) for name in ("kept_doc", "kept_fp", "kept_bits", "deduped"))
    keep = line_bitmaps(docs, min_docs, min_chars).withColumnsRenamed({"doc_id": doc, "fp": fp, "keep": bits})
    on = (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(fp))
    apply = F.arrow_udf(_apply_bitmaps, "text string, n_lines long, n_dropped long")
    joined = docs.join(keep.hint("shuffle_hash"), on, "left").withColumn(out, apply("text", bits))
    plain = [F.col(f"{out}.text" if c == "text" else f"`{c}`") for c in docs.columns if c not in {"n_lines", "n_dropped"}]
    return joined.select(*plain, f"{out}.n_lines", f"{out}.n_dropped")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, line, pos, c.key IS NOT NULL AND doc_id < largest AS gone FROM keyed LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
