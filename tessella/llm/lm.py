"""LM scoring by a hierarchical Pitman-Yor model.

The word before chooses one of ``2 ** CONTEXT_BITS`` context restaurants, whose
dishes are words; all have the root restaurant as parent, whose base is uniform
over the vocabulary and one unknown word.  Seatings are sampled in sweeps: the
customers of every dish get up and are seated again one after another, given the
seating of all others: the tables of a dish are the root's customers of that
word, and are taken out of the root while the dish is seated.  The seating stays
in the shard's row from sweep to sweep.  What restaurants share (their numbers of
tables) is renewed by an exchange after every sweep of the burn-in and once before
the ``SAMPLES`` sweeps whose predictive probabilities are averaged, and all dishes
move at once, which is the usual approximation of a distributed sampler.

A dish's customers are seated forward with the weight of a new table held as it is when
the dish is empty; the tables that the dish opens do not raise it, so it has fewer tables
than under the restaurant's full law (README, choices).  Random numbers are hashes of (context and word, sweep, customer or step), so a score does not depend
on shards, partitions or file splits.

How it runs.  Texts are cut into blocks (by file split, then by hash of doc_id,
``BLOCK_BYTES`` each).  Each block sends its distinct (word, context) pairs with
their counts in training texts, as sorted arrays, to shards by range of the
word's hash; a frequent word or context is one entry a block, so no key is hot.
A shard merges the arrays to its part of the model.  Between exchanges only the
restaurants' sums meet, an array of fixed length.  Last, every shard answers the
blocks in the order they asked, and a cogroup brings a block's texts and answers
together.  A model of any size is spread over the shards; none is broadcast.

Defined results: a null text is empty and has the end token only; a null doc_id
is a training row; repeated rows are learnt and scored each for itself; texts of
any length count whole, slice by slice; an empty table gives an empty one; doc_id
may be of any type; other columns are dropped, whatever their names.  Words are
told apart by 48 bits of hash.  Without training rows every probability is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucket_of, id_type, materialize
from .words import LOWER, SPACES, hash_spans, mix, slices, split_words, texts_of

CONTEXT_BITS = 16
CONTEXTS = 1 << CONTEXT_BITS
#: Restaurants' sums meet in pieces of this many.
PIECE = 4096
BLOCK_BYTES = 20 << 20
#: Sweeps before the first sample (each with an exchange of sums), and samples, sweeps of the last exchange.
BURN_IN, SAMPLES = 1, 2
#: Customers seated in one step; and how many times its weight a dish has seated when waits are drawn instead.
SEATED_AT_ONCE, RARE = 1 << 19, 4096
STRENGTHS = (1.0, 5.0)  # of the root and of a context
_END = np.uint64(0x51ED270B3A5C9F00)
_CONTEXT = np.uint64(CONTEXTS - 1)
_SHIFT = np.uint64(CONTEXT_BITS)


def token_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of every token (48 bits of the word's hash, 16 of the word before) and where each text's tokens begin."""
    texts = texts_of(column)
    data = LOWER[texts.data]
    words = split_words(texts, SPACES, data)
    n, m = len(words.starts), len(texts)
    hashes = hash_spans(data, words.starts, words.ends)
    place = np.arange(n) + words.owner
    tokens = np.full(n + m, _END, dtype=np.uint64)
    tokens[place] = hashes
    context = np.zeros(n + m + 1, dtype=np.uint64)  # context 0: at the begin of a text
    context[place + 1] = np.uint64(1) + mix(hashes) % _CONTEXT
    return tokens & ~_CONTEXT | context[:-1], words.first + np.arange(m + 1)


def pack(values: np.ndarray) -> bytes:
    """64-bit values as differences, byte by byte, compressed: sorted codes and small counts get short."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their counts summed."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _shard_cuts(codes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's codes begin: shards are ranges of the codes' upper half."""
    bounds = [np.uint64(-(-(s << 32) // shards) << 32) for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(codes, np.array(bounds, np.uint64)), [len(codes)]]).astype(np.int64)


_ASKED = "shard int, block long, codes binary, counts binary"


def _ask(shards: int):
    """Per block, its distinct codes and training counts, cut by shard."""

    def send(block: int, parts: list) -> pa.RecordBatch:
        codes, counts = _merge(parts)
        cuts = _shard_cuts(codes, shards)
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                pa.array(np.full(len(full), block, np.int64)),
                pa.array([pack(codes[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
                pa.array([pack(counts[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
            ],
            names=["shard", "block", "codes", "counts"],
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            order = np.argsort(blocks, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(blocks[order])) + 1), len(order)] if len(order) else [0]
            for low, high in zip(cuts, cuts[1:]):
                mine = batch.take(pa.array(order[low:high]))
                held = parts.setdefault(int(blocks[order[low]]), [])
                for part in slices(mine, "text"):
                    codes, first = token_codes(part.column(1))
                    learn = part.column(2).to_numpy(zero_copy_only=False)
                    distinct, inverse = np.unique(codes, return_inverse=True)
                    weight = np.repeat(learn.astype(np.float64), np.diff(first))
                    held.append((distinct, np.bincount(inverse, weight, len(distinct)).astype(np.int64)))
                    if len(held) >= 8:
                        held[:] = [_merge(held)]
        for block in list(parts):
            yield send(block, parts.pop(block))

    return ask


_SHARD = "shard int, codes binary, counts binary, blocks array<long>, asked array<binary>"


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """One row a shard: its codes and counts, and for each block the places of the codes it asked for."""
    asked = [unpack(x.as_py()) for x in table["codes"]]
    counts = [unpack(x.as_py()).astype(np.int64) for x in table["counts"]]
    codes, total = _merge(list(zip(asked, counts)))
    places = [pack(np.searchsorted(codes, a)) for a in asked]
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int32()),
            "codes": pa.array([pack(codes)], pa.binary()),
            "counts": pa.array([pack(total)], pa.binary()),
            "blocks": pa.array([table["block"].to_pylist()], pa.list_(pa.int64())),
            "asked": pa.array([places], pa.list_(pa.binary())),
        }
    )


def uniform(codes: np.ndarray, *stream: int) -> np.ndarray:
    """A number between 0 and 1 for every code, the same wherever it is drawn."""
    key = np.zeros(1, np.uint64)
    for part in stream:
        key = mix(key + np.uint64(0x9E3779B97F4A7C15) + np.uint64(part))
    return ((mix(codes ^ key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def log_gamma_draw(shape: np.ndarray, codes: np.ndarray, *stream: int) -> np.ndarray:
    """Logarithm of a gamma variate for every shape (Marsaglia and Tsang; shapes under 1 by a power of one at shape + 1)."""
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    scale = 1 / np.sqrt(9 * d)
    out, open_, attempt = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(open_):
        own = codes[open_]
        radius = np.sqrt(-2 * np.log(uniform(own, *stream, attempt, 0)))
        normal = radius * np.cos(2 * np.pi * uniform(own, *stream, attempt, 1))
        v = (1 + scale[open_] * normal) ** 3
        logv = np.log(np.maximum(v, 1e-300))
        accept = (v > 0) & (np.log(uniform(own, *stream, attempt, 2)) < normal**2 / 2 + d[open_] * (1 - v + logv))
        out[open_[accept]] = np.log(d[open_[accept]]) + logv[accept]
        open_ = open_[~accept]
        attempt += 1
    power = np.log(uniform(codes, *stream, -1 & 0xFFFF)) / np.maximum(shape, 1e-300)
    return out + np.where(small, power, 0)


def _seat_one_by_one(tables: np.ndarray, seated: np.ndarray, upto: np.ndarray, weight: np.ndarray, discount: float, codes: np.ndarray, stream: tuple) -> None:
    """Seats each dish's customers from seated to upto, adding to tables; all customers of a piece at once.

    Whether a customer opens a table depends on the tables opened before, and more tables only make that likelier,
    so repeating the comparison from the fewest tables on rises to the one outcome of seating them in turn.
    """
    ends = np.cumsum(upto - seated)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, SEATED_AT_ONCE):
        flat = np.arange(low, min(total, low + SEATED_AT_ONCE))
        dish = np.searchsorted(ends, flat, "right")
        place = upto[dish] - (ends[dish] - flat)
        a, before = weight[dish], tables[dish]
        u = uniform(codes[dish] + mix(place.astype(np.uint64)), *stream)
        starts = np.flatnonzero(np.concatenate([[True], dish[1:] != dish[:-1]]))
        length = np.diff(np.concatenate([starts, [len(flat)]]))
        opens = np.zeros(len(flat), bool)
        while True:
            run = np.cumsum(opens) - opens
            now = u * (a + place - discount * (before + run - np.repeat(run[starts], length))) < a
            if (now == opens).all():
                break
            opens = now
        tables[dish[starts]] += np.add.reduceat(opens.astype(np.int64), starts)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, codes: np.ndarray, *stream: int) -> np.ndarray:
    """Tables of each dish after its customers are seated one after another; weight: of a new table.

    With i seated at t tables the next opens one with probability a / (a + i - d t).  Where tables open often that is
    done customer by customer; where they are rare (from ``RARE`` a customers on) the wait for the next one is drawn:
    while none opens only i grows, so it is geometric with a probability drawn from beta(a, i - d t).  Both are exact.
    """
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    turn = np.minimum(customers[live], np.maximum(64, np.minimum(RARE * weight[live], 2.0**62))).astype(np.int64)
    own_tables = tables[live]
    _seat_one_by_one(own_tables, np.ones(len(live), np.int64), turn, weight[live], discount, codes[live], stream)
    tables[live] = own_tables
    on = turn < customers[live]
    live, seated, step = live[on], turn[on].astype(np.float64), 0
    while len(live):
        a, own = weight[live], codes[live]
        old = seated - discount * tables[live]
        log_odds = log_gamma_draw(a, own, *stream, step, 1) - log_gamma_draw(old, own, *stream, step, 2)
        log_stay = -np.logaddexp(0, log_odds)  # log(1 - p) for p = x / (x + y)
        wait = np.log(uniform(own, *stream, step, 3)) / np.minimum(log_stay, -1e-300)
        seated = seated + np.floor(np.minimum(wait, 2.0**53))
        more = seated < customers[live]
        live, seated = live[more], seated[more] + 1
        tables[live] += 1
        on = seated < customers[live]
        live, seated = live[on], seated[on]
        step += 1
    return tables


class Totals:
    """What restaurants share: customers and tables of each context, tables of the root, vocabulary, discounts."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, root_tables: float, words: float, discounts: tuple[float, float]):
        self.customers, self.tables, self.root_tables, self.words, self.discounts = customers, tables, root_tables, words, discounts

    def root_new(self) -> float:
        """Weight of a new table of one word at the root."""
        return (STRENGTHS[0] + self.discounts[0] * self.root_tables) / (self.words + 1)

    def root(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """The root's probability of words with c0 customers at t0 tables."""
        return (np.maximum(c0 - self.discounts[0] * t0, 0) + self.root_new()) / (STRENGTHS[0] + self.tables.sum())


class Shard:
    """The restaurants' part of one shard: every word of it with all its contexts, and the tables of each dish."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, tables: np.ndarray | None = None):
        self.codes, self.c = codes, counts
        self.t = (counts > 0).astype(np.int64) if tables is None else tables
        self.context = (codes & _CONTEXT).astype(np.int64)
        word = codes >> _SHIFT
        self.first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.words = codes[self.first] | _CONTEXT
        self.word = np.repeat(np.arange(len(self.first)), np.diff(np.concatenate([self.first, [len(word)]])))
        self.count = self.per_word(self.c)

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0, x.dtype)

    def seat_root(self, totals: Totals, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """The root's customers and tables of each word."""
        c0 = self.per_word(self.t)
        return c0, seat(c0, np.full(len(c0), totals.root_new()), totals.discounts[0], self.words, sweep, 0)

    def sweep(self, totals: Totals, sweep: int) -> None:
        """Seats every dish again, given the seating of the others."""
        c0, t0 = self.seat_root(totals, sweep)
        others = c0[self.word] - self.t  # the root without this dish's own customers
        parent = totals.root(others, np.minimum(t0[self.word], others))
        d, theta = totals.discounts[1], STRENGTHS[1]
        weight = (theta + d * (totals.tables[self.context] - self.t)) * parent
        self.t = seat(self.c, weight, d, self.codes, sweep, 1)

    def predict(self, before: Totals, after: Totals, sweep: int) -> np.ndarray:
        """Probability of each pair's word in its context; after: the totals that count this seating."""
        c0, t0 = self.seat_root(before, sweep)
        d, theta = after.discounts[1], STRENGTHS[1]
        size = theta + after.customers[self.context]
        rest = (theta + d * after.tables[self.context]) / size
        return np.maximum(self.c - d * self.t, 0) / size + rest * after.root(c0, t0)[self.word]

    def sums(self, totals: Totals, sweep: int) -> tuple[np.ndarray, int]:
        """Tables of each context, and of the root."""
        return np.bincount(self.context, self.t, CONTEXTS).astype(np.int64), int(self.seat_root(totals, sweep)[1].sum())


_STATE = "codes binary, counts binary, blocks array<long>, asked array<binary>, seatings array<binary>"
_SUMS = "name string, piece int, part array<long>"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list]]:
    """Each row's shard with its last seating, and the row's columns as they are stored."""
    for batch in batches:
        for row in range(len(batch)):
            stored = [batch.column(k)[row] for k in range(batch.num_columns)]
            seatings = stored[-1].as_py() if pa.types.is_list(stored[-1].type) else []
            last = unpack(seatings[-1]).astype(np.int64) if seatings else None
            yield Shard(unpack(stored[0].as_py()), unpack(stored[1].as_py()).astype(np.int64), last), stored


def _move(totals: Totals, first: int, count: int):
    """Sweeps first to first + count - 1; their seatings replace those of before."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for s, stored in _moved(batches):
                seatings = []
                for k in range(first, first + count):
                    s.sweep(totals, k)
                    seatings.append(pack(s.t))
                arrays = [*(pa.array([x.as_py()], x.type) for x in stored[:4]), pa.array([seatings], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["codes", "counts", "blocks", "asked", "seatings"])

    return move


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list]]:
    """As ``_states``, for rows (codes, counts, blocks, asked[, seatings])."""
    for batch in batches:
        for row in range(len(batch)):
            part = batch.slice(row, 1)
            seen = part.select([0, 1, *range(4, part.num_columns)])
            for s, _ in _states(iter([seen])):
                yield s, [part.column(k)[0] for k in range(4)]


def _add(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, values in sums.items():
        parts = [values[low : low + PIECE] for low in range(0, len(values), PIECE)]
        arrays = [pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["name", "piece", "part"])


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums that start the sampler, over all shards of a task."""
    sums = {"customers": np.zeros(CONTEXTS, np.int64), "tables": np.zeros(CONTEXTS, np.int64), "shape": np.zeros(5, np.int64)}
    for s, _ in _states(batches):
        contexts = s.per_word(s.t)
        sums["customers"] += np.bincount(s.context, s.c, CONTEXTS).astype(np.int64)
        sums["tables"] += np.bincount(s.context, s.t, CONTEXTS).astype(np.int64)
        sums["shape"] += [(s.count > 0).sum(), (s.c == 1).sum(), (s.c == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum()]
    yield from _add(sums)


def _later_sums(totals: Totals, first: int):
    """Tables of the contexts and of the root for each seating kept."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, np.ndarray] = {}
        with np.errstate(over="ignore"):
            for s, stored in _states(batches):
                for k, seating in enumerate(stored[2].as_py()):
                    s.t = unpack(seating).astype(np.int64)
                    tables, root = s.sums(totals, first + k)
                    out[f"tables{k}"] = out.get(f"tables{k}", 0) + tables
                    out[f"root{k}"] = out.get(f"root{k}", 0) + np.array([root], np.int64)
        yield from _add(out)

    return sums


def _sum_parts(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(x.values.to_numpy() for x in table["part"])
    return pa.table({"name": [key[0].as_py()], "piece": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total], pa.list_(pa.int64()))})


def _collect_sums(shards: DataFrame, sums) -> dict[str, np.ndarray]:
    """The sums of all shards; their length is fixed, whatever the corpus."""
    rows = shards.mapInArrow(sums, _SUMS).groupBy("name", "piece").applyInArrow(_sum_parts, _SUMS).collect()
    rows.sort(key=lambda r: (r["name"], r["piece"]))
    return {name: np.array([v for r in rows if r["name"] == name for v in r["part"]], dtype=np.float64) for name in {r["name"] for r in rows}}


def _answer(before: Totals, after: list[Totals], first: int):
    """Log10 probability (averaged over the seatings) and training count of every code a block asked for."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                codes, counts, blocks, asked, seatings = (batch.column(k)[row].as_py() for k in range(5))
                s = Shard(unpack(codes), unpack(counts).astype(np.int64))
                p = np.zeros(len(s.codes))
                with np.errstate(over="ignore"):
                    for k, seating in enumerate(seatings):
                        s.t = unpack(seating).astype(np.int64)
                        p += s.predict(before, after[k], first + k) / len(seatings)
                log, count = np.log10(p).astype(np.float32), s.count[s.word]
                begin = int(s.codes[0] >> np.uint64(32)) if len(s.codes) else 0
                for block, packed in zip(blocks, asked):
                    places = unpack(packed).astype(np.int64)
                    arrays = [pa.array([block], pa.int64()), pa.array([begin], pa.int64()), pa.array([log[places].tobytes()], pa.binary()), pa.array([pack(count[places])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["block", "first", "log", "count"])

    return answer


def _score(train_tokens: int, vocabulary: int):
    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["first"].to_numpy(), kind="stable")  # shards are ranges of codes
        log = np.frombuffer(b"".join(answers["log"][int(i)].as_py() for i in order), np.float32)
        count = np.concatenate([np.zeros(0, np.int64), *(unpack(answers["count"][int(i)].as_py()).astype(np.int64) for i in order)])
        base = np.log10((count + 1.0) / (train_tokens + vocabulary + 1))
        columns: list[list] = [[], [], [], [], [], []]
        parts = [p for batch in docs.combine_chunks().to_batches() for p in slices(batch, "text")]
        tokens = [token_codes(part["text"]) for part in parts]
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(codes) for codes, _ in tokens)]))
        if len(known) != len(log):
            raise RuntimeError("a block's texts are not those that asked: the input's file splits changed during the job")
        for part, (codes, first) in zip(parts, tokens):
            at = np.searchsorted(known, codes)
            sums = [np.add.reduceat(x[at].astype(np.float64), first[:-1]) for x in (count > 0, base, log)]
            for column, values in zip(columns, (part["doc_id"], part["held_out"], pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]))):
                column.append(values)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table({k: pa.chunked_array(v) for k, v in zip(names, columns)})

    return score


def _in_splits(docs: DataFrame, hold_modulus: int, hold: int) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), hold_modulus) == hold
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    return docs.select("doc_id", "text", held_out.alias("held_out"), split.alias("split"))


def score_documents(docs: DataFrame, hold_modulus: int = 7, hold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the model's), both log10."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if not docs.inputFiles():
        docs = materialize(docs)
    try:
        rows = _in_splits(docs, hold_modulus, hold)
        rows.schema  # noqa: B018  rows of several sources have no file split
    except AnalysisException:
        rows = _in_splits(materialize(docs), hold_modulus, hold)
    sizes = rows.groupBy("split").agg(F.sum(F.octet_length("text")).alias("size")).agg(F.max("size"), F.sum("size")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    parts = max(1, -(-largest // BLOCK_BYTES))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    block = F.when(F.lit(parts) == 1, F.col("split")).otherwise(F.xxhash64("split", F.pmod(F.xxhash64("doc_id"), F.lit(parts))))
    rows = rows.withColumn("block", block).drop("split")

    asking = rows.select("block", "text", (~F.col("held_out")).alias("learn"))
    model = materialize(asking.mapInArrow(_ask(shards), _ASKED).groupBy("shard").applyInArrow(_gather, _SHARD))

    state = model.select("codes", "counts", "blocks", "asked")
    begin = {"customers": np.zeros(CONTEXTS), "tables": np.zeros(CONTEXTS), "shape": np.zeros(5)} | _collect_sums(model.select("codes", "counts"), _first_sums)
    words, n1, n2, m1, m2 = begin["shape"]
    discount = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5
    last = Totals(begin["customers"], begin["tables"], words, words, (discount(m1, m2), discount(n1, n2)))
    for sweep, count in [*((k, 1) for k in range(BURN_IN)), (BURN_IN, SAMPLES)]:
        state = materialize(state.mapInArrow(_move(last, sweep, count), _STATE))
        sums = _collect_sums(state.select("codes", "counts", "seatings"), _later_sums(last, sweep + 1))
        before, after = last, [Totals(last.customers, sums[f"tables{k}"], float(sums[f"root{k}"][0]), words, last.discounts) for k in range(count) if sums]
        last = after[-1] if after else last

    answers = state.mapInArrow(_answer(before, after, BURN_IN + 1), "block long, first long, log binary, count binary")
    train_tokens = int(begin["customers"].sum())
    schema = f"doc_id {id_type(docs)}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(train_tokens, int(words)), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
