"""Quality rules: base counts, then a calibrated logistic regression on hashed word and character n-grams.

Counts and features are taken from whole texts by byte-level numpy in Arrow
batches.  Features are relative frequencies of hashed words, of character
3-grams and of 4-grams (on bytes), so a score is a mean of learned weights; the
model is a weight vector of ``2 ** BITS`` floats, trained in numpy on at most
``max_rows`` labelled documents (those with the smallest hash of their id) and
calibrated by Platt scaling on a part that training has not seen.

Defined results: a null or empty text has no words and fails the base rule; an
untrainable label table (empty, or of one class) gives the model that keeps all;
documents need no label to be scored; repeated labels of a document all count, as
do repeated rows; of labels that tie at the bound those with the smaller doc_id and
label are taken; texts of any length count whole, slice by slice; an empty table
gives an empty one; other columns of any name pass through, but for those named
like an output, which the output replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .words import LOWER, SPACES, Texts, hash_spans, slices, split_words, text_windows, texts_of

BITS = 18
GRAMS = (3, 4)
#: Documents with at least this calibrated probability of good quality are kept.
KEEP_AT = 0.5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated_in_text(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks values that occur twice or more with the same owner."""
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def base_counts(texts: Texts) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = texts.data, texts.offsets
    words = split_words(texts, SPACES)
    n = len(texts)
    heads = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACES[data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    hashes = hash_spans(data, words.starts, words.ends)

    at, grams = text_windows(words, hashes, 3)
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    hit = at[repeated_in_text(words.owner[at], grams)]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1) if len(hit) else None
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    owner = np.repeat(np.arange(n), 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]))
    full = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends, owner = starts[full], ends[full], owner[full]
    line = hash_spans(data, starts, ends)
    order = np.lexsort((line, owner))
    again = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    dup_lines = np.bincount(owner[order][1:][again], minlength=n)
    return (words.counts(), heads[offsets[1:]] - heads[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines, covered[words.first[1:]] - covered[words.first[:-1]])


def features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of features: bucket of every occurrence, and where each text's occurrences begin."""
    data = LOWER[texts.data]
    words = split_words(texts, SPACES, data)
    mask = np.uint64((1 << BITS) - 1)
    yield (hash_spans(data, words.starts, words.ends) & mask).astype(np.int64), words.first
    for k in GRAMS:
        n = len(data) - k + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        code = np.zeros(n, dtype=np.uint32)
        for j in range(k):
            code = (code << np.uint32(8)) | data[j : j + n]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        bucket = (code ^ (code >> np.uint32(13))) & np.uint32((1 << BITS) - 1)
        # grams that reach into the next text are left out by where a text's grams end
        edges = np.minimum(texts.offsets, n)
        inside = np.ones(n, dtype=bool)
        for j in range(1, k):
            inside[np.clip(texts.offsets[1:-1] - j, 0, n - 1)] = False
        gone = np.concatenate([[0], np.cumsum(~inside)])
        yield bucket[inside].astype(np.int64), edges - gone[edges]


class LinearText:
    """Bias and a weight a bucket and group; the score is a sum over groups of mean weights."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, texts: Texts) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for group, (bucket, first) in enumerate(features(texts)):
            running = np.concatenate([[0.0], np.cumsum(self.weights[group][bucket], dtype=np.float64)])
            size = np.diff(first)
            total += (running[first[1:]] - running[first[:-1]]) / np.maximum(size, 1)
        return total

    def probability(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(texts) + self.shift, -40, 40)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.3, seed: int = 5) -> LinearText:
    """Logistic regression by AdaGrad on single documents; a fifth of them calibrates."""
    groups = 1 + len(GRAMS)
    if not len(labels) or labels.min() == labels.max():
        return LinearText(np.zeros((groups, 1 << BITS), np.float32), 0.0, 1.0, 4.0)
    rows = []
    for text in texts:
        sparse = []
        for group, (bucket, _) in enumerate(features(texts_of(pa.array([text])))):
            at, count = np.unique(bucket, return_counts=True)
            sparse.append((group, at, (count / max(1, len(bucket))).astype(np.float32)))
        rows.append(sparse)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    weights, gains, bias = np.zeros((groups, 1 << BITS), np.float32), np.full((groups, 1 << BITS), 1e-8, np.float32), 0.0
    margin = lambda i: bias + sum(float(weights[g, at] @ x) for g, at, x in rows[i])
    for _ in range(epochs):
        for i in rng.permutation(fit):
            error = 1 / (1 + np.exp(-np.clip(margin(i), -40, 40))) - labels[i]
            bias -= 0.01 * error
            for g, at, x in rows[i]:
                step = error * x
                gains[g, at] += step * step
                weights[g, at] -= rate * step / np.sqrt(gains[g, at])
    m = np.array([margin(i) for i in (held if len(set(labels[held])) > 1 else order)])
    y = labels[held if len(set(labels[held])) > 1 else order]
    slope, shift = platt(m, y)
    return LinearText(weights, bias, slope, shift)


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, by Newton's method."""
    positive = labels.sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    scale = max(1e-6, float(np.abs(margins).max()))
    x = np.stack([margins / scale, np.ones(len(margins))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-4 * np.eye(2)
        w -= np.linalg.solve(hessian, x @ (p - target) + 1e-4 * w)
    return max(float(w[0]), 1e-3) / scale, float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> list:
    """(text, label) of at most max_rows labelled documents, those whose id hashes lowest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("the_label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "the_label").limit(max_rows)
    return docs.select("doc_id", "text").join(picked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "the_label", "text").select("text", "the_label").collect()


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> LinearText:
    """The model from labels.quality (1: good) of at most ``max_rows`` labelled documents."""
    rows = labelled_sample(docs, labels, "quality", max_rows)
    return train([r[0] or "" for r in rows], np.array([float(r[1] > 0) for r in rows]))


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def score_quality(docs: DataFrame, model: LinearText, keep_at: float = KEEP_AT) -> DataFrame:
    """Adds the base counts, base_failed, probability and kept (false where the base failed or the model says so)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(column: pa.Array) -> pa.Array:
        parts = []
        for part in slices(column):
            texts = texts_of(part)
            parts.append([*base_counts(texts), held.value.probability(texts)])
        names = [f.split()[0] for f in _OUT.split(", ")]
        kinds = [np.int64] * 5 + [np.float64]
        arrays = [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(kind)) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(arrays, names)

    names = [f.split()[0] for f in _OUT.split(", ")] + ["base_failed", "kept"]
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    out = free_name(docs, "counted")
    scored = docs.withColumn(out, F.arrow_udf(score, _OUT)("text")).select(*plain, f"{out}.*")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= keep_at))
