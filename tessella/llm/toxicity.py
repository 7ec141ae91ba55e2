"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of three hashed rows (the word, and its first four
and five bytes, lower-cased in A-Z).  Filters of several widths slide over the
words, the largest answer of each filter in the whole text is kept, and of the
filters of one word also the sum of their answers (as a logarithm), so that a word
seen once and a word seen often differ; a logistic layer turns these into a
score, which is calibrated on labelled rows that training has not seen.  Thresholds are calibrated by language on the same
rows.  Only the text enters a score.  Training is on the driver, on at most
``max_rows`` labelled documents (those with the smallest hash of their id), whole
texts; scoring runs in Arrow batches without a shuffle.

Defined results: a null or empty text gets the score of no evidence; a label
table that is empty or of one class gives the score 0 for all; a language
without enough labelled rows, or null, uses the threshold of all; repeated rows are
scored each for itself and repeated labels all count; of labels that tie at the
bound those with the smaller doc_id and label are taken; texts of any length are
scored whole, slice by slice; an empty table gives an empty one; other columns of
any name pass through, but for ``score``, ``threshold`` and ``flagged``, which the
results replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import platt
from .shared import bucket_of
from .words import LOWER, SPACES, hash_spans, release, slices, split_words, texts_of

BITS, DIM = 18, 8
WIDTHS, FILTERS = (1, 2, 3), 8
PREFIXES = (4, 5)
DEFAULT_THRESHOLD = 0.3


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (words x 3) of a slice and the first word of each text."""
    texts = texts_of(column)
    data = LOWER[texts.data]
    words = split_words(texts, SPACES, data)
    mask = np.uint64((1 << BITS) - 1)
    rows = [hash_spans(data, words.starts, words.ends)]
    for k in PREFIXES:
        ends = np.minimum(words.ends, words.starts + k)
        rows.append(hash_spans(data, words.starts, ends) + np.uint64(k))
    return np.stack([(r & mask).astype(np.int32) for r in rows], axis=1), words.first


class ConvText:
    """Embeddings, filters and output layer; ``score`` gives calibrated probabilities."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((1 << BITS, DIM)) * 0.02).astype(np.float32)
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.4).astype(np.float32) for w in WIDTHS]
        self.shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * (len(WIDTHS) + 1)) * 0.3).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.slope, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.threshold, self.trained = DEFAULT_THRESHOLD, False

    def answers(self, x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Of each width, the filters' answers at every word; below zero where a window leaves its text."""
        out = []
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for w, filters, shift in zip(WIDTHS, self.filters, self.shifts):
            a = x @ filters[0] + shift
            for j in range(1, w):
                a[:-j] += x[j:] @ filters[j]
            if w > 1:
                crossing = np.ones(len(x), dtype=bool)
                crossing[: len(x) - w + 1] = owner[: len(x) - w + 1] != owner[w - 1 :]
                a[crossing] = -1
            out.append(a)
        return out

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(first))
        best = np.zeros((len(first) - 1, FILTERS * (len(WIDTHS) + 1)), np.float32)
        if len(full):
            answers = self.answers(self.table[rows].sum(axis=1), first)
            tops = [np.maximum.reduceat(a, first[full], axis=0) for a in answers]
            total = np.add.reduceat(np.maximum(answers[0], 0), first[full], axis=0)
            best[full] = np.concatenate([np.maximum(np.concatenate(tops, axis=1), 0), np.log1p(total)], axis=1)
        return best

    def margin(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first).astype(np.float64) @ self.out + self.bias

    def score(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(rows, first) + self.shift, -40, 40)))

    def fit(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 1400, batch: int = 32, rate: float = 0.05, seed: int = 3, texts: np.ndarray | None = None) -> None:
        """``steps`` batches (of all texts, or those numbered) of AdaGrad on the logistic loss; a gradient flows through the word where a filter answered most, and through all words that a sum counts."""
        rng = np.random.default_rng(seed)
        gains = {id(p): np.full_like(p, 1e-6) for p in [*self.filters, *self.shifts, self.out]}
        row_gain = np.full((1 << BITS, 1), 1e-4, np.float32)
        texts = np.arange(len(labels)) if texts is None else texts
        toxic = labels[texts].sum()
        heavy = np.sqrt(max(1.0, (len(texts) - toxic) / max(1.0, toxic)))

        def step(p: np.ndarray, g: np.ndarray) -> None:
            gains[id(p)] += g * g
            p -= rate * g / np.sqrt(gains[id(p)])

        for _ in range(-(-steps * batch // len(texts))):
            order = texts[rng.permutation(len(texts))]
            for low in range(0, len(order), batch):
                pick = order[low : low + batch]
                pick = pick[first[pick + 1] > first[pick]]
                if not len(pick):
                    continue
                part = np.concatenate([rows[first[i] : first[i + 1]] for i in pick])
                ends = np.concatenate([[0], np.cumsum(first[pick + 1] - first[pick])])
                x = self.table[part].sum(axis=1)
                answers = self.answers(x, ends)
                tops = [np.stack([a[s:e].argmax(axis=0) + s for s, e in zip(ends, ends[1:])]) for a in answers]
                best = np.concatenate([np.take_along_axis(a, t, 0) for a, t in zip(answers, tops)], axis=1)
                live = best > 0
                said = np.maximum(answers[0], 0)
                total = np.add.reduceat(said, ends[:-1], axis=0)
                best = np.concatenate([np.where(live, best, 0), np.log1p(total)], axis=1)
                y = labels[pick]
                error = (1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30))) - y) * np.where(y > 0, heavy, 1) / len(pick)
                back = error[:, None] * self.out[None, :]
                spread = np.repeat(back[:, len(WIDTHS) * FILTERS :] / (1 + total), np.diff(ends), axis=0) * (said > 0)
                back = back[:, : len(WIDTHS) * FILTERS] * live
                step(self.out, (best.T @ error + 1e-4 * self.out).astype(np.float32))
                self.bias -= np.float32(rate * error.sum())
                touched, pulls = [], []
                for k, (w, top) in enumerate(zip(WIDTHS, tops)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grad = np.zeros_like(self.filters[k])
                    for j in range(w):
                        at = np.minimum(top + j, len(x) - 1)
                        grad[j] = np.einsum("df,dfe->ef", g, x[at])
                        touched.append(at.ravel())
                        pulls.append((g[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIM))
                    if k == 0:
                        grad[0] += x.T @ spread
                        touched.append(np.arange(len(x)))
                        pulls.append(spread @ self.filters[0][0].T)
                    step(self.filters[k], grad + 1e-4 * self.filters[k])
                    step(self.shifts[k], (g.sum(axis=0) + (spread.sum(axis=0) if k == 0 else 0)).astype(np.float32))
                touched, pulls = np.concatenate(touched), np.concatenate(pulls)
                for c in range(part.shape[1]):
                    ids, place = np.unique(part[touched, c], return_inverse=True)
                    pull = np.stack([np.bincount(place, pulls[:, d], len(ids)) for d in range(DIM)], axis=1).astype(np.float32)
                    row_gain[ids, 0] += (pull**2).mean(axis=1)
                    self.table[ids] -= rate * 4 * pull / np.sqrt(row_gain[ids])
        self.trained = True

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, langs: list) -> None:
        """Platt scaling of all rows, then a threshold for all and for each language with rows of both classes."""
        self.slope, self.shift = platt(margins, labels)
        p = 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))
        self.threshold = best_threshold(p, labels)
        for lang in sorted({x for x in langs if x is not None}):
            mine = np.array([x == lang for x in langs])
            if labels[mine].sum() >= 10 and (1 - labels[mine]).sum() >= 10:
                self.thresholds[lang] = best_threshold(p[mine], labels[mine])


def best_threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the cuts with the best F1, between 0.1 and 0.9."""
    cuts = np.linspace(0.1, 0.9, 81)
    f1 = []
    for cut in cuts:
        said = p >= cut
        hit = float((said & (labels > 0)).sum())
        f1.append(2 * hit / max(1.0, said.sum() + labels.sum()))
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    return float(cuts[best[len(best) // 2]])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, holdout: bool = True) -> ConvText:
    """The model from labels.toxic of at most max_rows documents, without those of ``held_out`` rows."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    if holdout:
        known = known.where(bucket_of(F.col("doc_id"), 4) != 2)
    key = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    picked = known.select("doc_id", "toxic").orderBy(*key).limit(max_rows)
    sample = docs.select("doc_id", "text", "lang").join(picked, "doc_id").orderBy(*key, "text").select("text", "lang", F.col("toxic").cast("int")).toArrow()
    model = ConvText()
    y = (sample["toxic"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return model
    langs = sample["lang"].to_pylist()
    parts = [word_rows(part) for chunk in sample["text"].chunks for part in slices(chunk)]
    del sample
    rows = np.concatenate([r for r, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    del parts
    order = np.random.default_rng(1).permutation(len(y))
    kept, fit = np.sort(order[: len(y) // 4]), np.sort(order[len(y) // 4 :])

    def subset(pick):
        return np.concatenate([rows[first[i] : first[i + 1]] for i in pick]), np.concatenate([[0], np.cumsum(first[pick + 1] - first[pick])])

    model.fit(rows, first, y, texts=fit)
    check = kept if 0 < y[kept].sum() < len(kept) else order
    margins = np.concatenate([model.margin(*subset(check[low : low + 100])) for low in range(0, len(check), 100)])
    model.calibrate(margins, y[check], [langs[i] for i in check])
    release()
    return model


def score_toxicity(docs: DataFrame, model: ConvText) -> DataFrame:
    """Adds score, threshold (of the row's lang, else of all) and flagged (score at or over it)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(column: pa.Array) -> pa.Array:
        parts = [held.value.score(*word_rows(part)) for part in slices(column)]
        return pa.array(np.concatenate(parts or [np.zeros(0)]), pa.float64())

    threshold = F.lit(model.threshold)
    for lang, cut in model.thresholds.items():
        threshold = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(threshold)
    names = {"score", "threshold", "flagged"}
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    scored = docs.withColumn("score", F.arrow_udf(score, "double")("text"))
    return scored.select(*plain, "score", threshold.alias("threshold")).withColumn("flagged", F.col("score") >= F.col("threshold"))
