"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The merges are compiled to a transducer over bytes.  A token may start at any
byte, which makes the automaton nondeterministic; its determinised state is the
set of open starts (those from which the bytes read are a prefix of a token), and
states and transitions are made when first met, in tables bounded by
``max_states``.  The encoding of every prefix ends in exactly one token: the one
that ends there and is *compatible* with the token before it (merging the bytes
of both gives these two back).  What the paths to all open starts share is
certain and is emitted, so a piece of any length needs ``window`` bytes of
memory and lookahead is bounded by the longest token.

Decoding goes through an incremental UTF-8 state machine, so text can be handed
on while tokens arrive.

Defined results: a null or empty text has no tokens; ids that decode to invalid
UTF-8 give U+FFFD in text and are exact in bytes; a text of any length is encoded
whole; repeated rows are encoded each for itself; an empty table gives an empty
one; other columns pass through, but for those of the results' names (``ids``,
``decoded``, ``round_trip``), which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .shared import id_type
from .words import release, slices

#: Ids that the decoder turns into bytes at once.
DECODE_IDS = 4096


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


_NEVER = 1 << 60


class BpeTransducer:
    """Encodes one piece (a match of the split pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pieces: int = 50_000, window: int = 1024):
        self.ranks, self.max_states, self.max_pieces, self.window = ranks, max_states, max_pieces, window
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self.reachable: dict[bytes, int | None] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._clear()

    def _clear(self) -> None:
        # a state is the set of open token starts, which its longest open suffix determines
        self.opens: list[bytes] = [b""]
        self.states: dict[bytes, int] = {b"": 0}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.moves: list[dict[int, int]] = [{}]
        self.compatible: dict[int, bool] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes, below: int = _NEVER) -> list[int]:
        """Merges of ranks under ``below`` from single bytes on: the definition, used on one token at most."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < below:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
        return [ranks[p] for p in parts]

    def token(self, raw: bytes) -> int | None:
        """The token of these bytes, if merges lead to it."""
        if raw not in self.reachable:
            known = self.ranks.get(raw)
            self.reachable[raw] = known if known is not None and self.merged(raw) == [known] else None
        return self.reachable[raw]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one; a byte, or what no merge reaches, is its own half."""
        held = self.halves.get(token)
        if held is None:
            raw, held = self.bytes_of[token], (token, token)
            if len(raw) > 1 and self.token(raw) is not None:
                left, right = self.merged(raw, token)
                held = left, right
            self.halves[token] = held
        return held

    def may_follow(self, pair: int) -> bool:
        """Whether the tokens of ``left << 20 | right`` stay as they are side by side.

        They do not if two tokens that meet at their border, while both are being merged, have a merge of a
        lower rank than the next one of either.  These are met from the last merges back to single bytes.
        """
        left, right = pair >> 20, pair & 0xFFFFF
        ranks, bytes_of, limit, ok = self.ranks, self.bytes_of, _NEVER, True
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], _NEVER) < limit:
                ok = False
                break
            # the later merge is undone; of two equal ones the left one was made first
            inner_left, inner_right = self.split(left)[1], self.split(right)[0]
            if inner_left == left and inner_right == right:
                break
            if inner_right == right or inner_left != left and left > right:
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right
        self.compatible[pair] = ok
        return ok

    def move(self, state: int, byte: int) -> int:
        """The transition, made when first met: the open starts that the byte leaves, and the tokens that end here."""
        raw = self.opens[state] + bytes((byte,))
        low = 0
        while raw[low:] not in self.prefixes:
            low += 1
        key = raw[low:]
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.opens)
            self.opens.append(key)
            self.moves.append({})
            ended = ((len(key) - k, self.token(key[k:])) for k in range(len(key)))
            self.ends.append(tuple((n, t) for n, t in ended if t is not None))
        self.moves[state][byte] = target
        return target

    def _certain(self, last: list[int], state: int) -> int:
        """The end position up to which every path that is still open agrees."""
        key, at = self.opens[state], len(last) - 1
        open_at = {at - len(key) + k for k in range(len(key) + 1) if key[k:] in self.prefixes}
        while len(open_at) > 1:
            furthest = max(open_at)
            open_at.remove(furthest)
            open_at.add(furthest - self.length[last[furthest]])
        return open_at.pop()

    def _path(self, last: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        return out[::-1]

    def run(self, piece: bytes) -> list[int]:
        """The transducer: last[i] is the token in which the encoding of the first i open bytes ends."""
        moves, ends, compatible = self.moves, self.ends, self.compatible
        out: list[int] = []
        last, state, at, window = [-1], 0, 0, self.window
        for byte in piece:
            follow = moves[state].get(byte)
            state = self.move(state, byte) if follow is None else follow
            for n, token in ends[state]:
                before = last[-n]
                if before < 0:
                    break
                pair = before << 20 | token
                ok = compatible.get(pair)
                if self.may_follow(pair) if ok is None else ok:
                    break
            last.append(token)
            at += 1
            if at >= window and (sure := self._certain(last, state)):
                done = self._path(last, sure)
                out += done
                last, at = [done[-1], *last[sure + 1 :]], at - sure
        if out:
            return out + self._path(last, at)
        return self._path(last, at)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        known = self.pieces.get(piece)
        if known is not None:
            return known
        if piece in self.ranks:  # as the merges would give, or a token that no merge reaches
            out = (self.ranks[piece],)
        else:
            if len(self.opens) > self.max_states or len(self.compatible) > 4 * self.max_states:
                self._clear()
            out = tuple(self.run(piece))
        if len(piece) <= 64:
            if len(self.pieces) >= self.max_pieces:
                self.pieces.clear()
            self.pieces[piece] = out
        return out


class Utf8Stream:
    """Incremental UTF-8: hands on whole characters and keeps the state of an open one."""

    def __init__(self):
        self.open = b""

    def feed(self, chunk: bytes) -> str:
        raw = self.open + chunk
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead & 0xC0 == 0x80:
                continue  # a continuation byte: look further back for its lead
            need = 1 if lead >= 0xF8 else 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            if need > back:
                cut = len(raw) - back
            break
        self.open = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterator[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text piece by piece as tokens arrive."""
    stream = Utf8Stream()
    for i in ids:
        yield stream.feed(bytes_of[i])
    yield stream.close()


class Tokenizer:
    """Split pattern and transducer of one vocabulary; made once per task's Python worker."""

    held: dict[str, "Tokenizer"] = {}

    def __init__(self, raw: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        # letters after a space at most are one match, if only contractions are tried before
        first, found, _ = f"|{pattern}|".partition(r"| ?\p{L}+|")
        self.letters_match = bool(found) and all(x.startswith("'") for x in first.split("|")[1:])
        self.bpe = BpeTransducer(read_ranks(raw))
        self.decimal = {i: str(i) for i in self.bpe.bytes_of}
        # chunks seen lately, in two generations so that frequent ones stay
        self.max_chunks, self.young, self.old = 200_000, {}, {}

    @classmethod
    def of(cls, vocabulary, pattern: str) -> "Tokenizer":
        key = hashlib.sha256(vocabulary.value + pattern.encode()).hexdigest()
        if key not in cls.held:
            cls.held[key] = cls(vocabulary.value, pattern)
        return cls.held[key]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text.

        No match of the pattern runs from a character that is not white space
        into a space, so a text may be cut before every such space: what follows
        is looked up as one chunk, and matched and encoded if it is new.
        """
        out: list[int] = []
        if not text:
            return out
        chunks = iter(text.split(" "))
        chunk, space = next(chunks), ""
        young, old = self.young, self.old
        for following in (*chunks, None):
            if following is not None and (not chunk or chunk[-1].isspace()):
                chunk = f"{chunk} {following}"  # white space goes on: no cut here
                continue
            ids = young.get(chunk) if space else None
            if ids is None:
                ids = old.get(chunk) if space else None
                if ids is None:
                    ids = self._encode_chunk(space + chunk)
                if space and len(chunk) <= 64:
                    if len(young) >= self.max_chunks:
                        old = self.old = young
                        young = self.young = {}
                    young[chunk] = ids
            out += ids
            chunk, space = following, " "
        return out

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if self.letters_match and chunk.isascii() and chunk.removeprefix(" ").isalpha():
            return self.bpe.encode_piece(chunk.encode())
        out: list[int] = []
        for piece in self.pattern.findall(chunk):
            out += self.bpe.encode_piece(piece.encode())
        return tuple(out)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids))


def load_vocabulary(spark, path: str):
    """Broadcasts a vocabulary file of fixed size, read where the driver runs."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _ids_array(tokenizer: Tokenizer, texts: pa.Array) -> pa.Array:
    """Ids of every text; only one text at a time is a list of Python numbers."""
    rows = [np.array(tokenizer.encode(t), np.int32) for t in _each(texts)]
    ends = np.cumsum([0, *map(len, rows)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("more than 2^31 tokens in one Arrow batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def decode_text(tokenizer: Tokenizer, ids: np.ndarray) -> str:
    """The text of ids, ``DECODE_IDS`` at a time through the UTF-8 machine."""
    stream = Utf8Stream()
    parts = [stream.feed(tokenizer.decode_bytes(ids[low : low + DECODE_IDS].tolist())) for low in range(0, len(ids), DECODE_IDS)]
    return "".join([*parts, stream.close()])


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Every list of ids as an array; a null list is empty."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[ends[i] : ends[i + 1]] if valid[i] else values[:0]


def encode_texts(docs: DataFrame, vocabulary, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) for every whole text; a column of that name is replaced."""

    def encode(column: pa.Array) -> pa.Array:
        return _ids_array(Tokenizer.of(vocabulary, pattern), column)

    return docs.withColumn("ids", F.arrow_udf(encode, "array<int>")(text))


def decode_ids(docs: DataFrame, vocabulary, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (text, by the streaming decoder) for every array of ids; a column of that name is replaced."""

    def decode(column: pa.Array) -> pa.Array:
        tokenizer = Tokenizer.of(vocabulary, pattern)
        return pa.array((decode_text(tokenizer, x) for x in _lists(column)), pa.string())

    return docs.withColumn("decoded", F.arrow_udf(decode, "string")(ids))


def _per_task(vocabulary, pattern: str, code, text: str = "text"):
    """A function of batches that codes each with a tokenizer, which goes with all that it has cached at the task's end.

    Workers live on from task to task and stage to stage, and would hold it beside whatever runs next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.of(vocabulary, pattern)
        try:
            for batch in batches:
                for part in slices(batch, text):
                    yield code(tokenizer, part)
        finally:
            del tokenizer
            Tokenizer.held.clear()
            release()

    return run


def code_texts(docs: DataFrame, vocabulary, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``round_trip`` (decoding gives the text back) in one pass; columns of these names are replaced."""

    def code(tokenizer: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text))
        ids = _ids_array(tokenizer, column)
        same = pa.array((decode_text(tokenizer, x) == (t or "") for x, t in zip(_lists(ids), _each(column))), pa.bool_())
        return pa.RecordBatch.from_arrays([*batch.columns, ids, same], names=[*batch.schema.names, "ids", "round_trip"])

    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {"ids", "round_trip"}])
    schema = StructType([*plain.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    return plain.mapInArrow(_per_task(vocabulary, pattern, code, text), schema)


def _each(column: pa.Array) -> Iterator:
    """Values one at a time, so that only one text is a Python object at once."""
    return (value.as_py() for value in column)


def round_trip(docs: DataFrame, vocabulary, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids (decimal, joined by commas) and of the decoded bytes."""

    def digest(tokenizer: Tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in _each(batch.column(1)):
            ids = tokenizer.encode(text)
            decoded = hashlib.sha256()
            stream = Utf8Stream()
            for low in range(0, len(ids), DECODE_IDS):
                decoded.update(stream.feed(tokenizer.decode_bytes(ids[low : low + DECODE_IDS])).encode())
            decoded.update(stream.close().encode())
            rows.append((len(ids), hashlib.sha256(",".join(map(tokenizer.decimal.__getitem__, ids)).encode()).hexdigest(), decoded.hexdigest()))
        columns = list(zip(*rows)) or [(), (), ()]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    shape = f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_per_task(vocabulary, pattern, digest), shape)
