"""The transducer's shortcuts beside the definition, and what a task leaves behind."""

import random
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from tessella.llm import bpe
from tessella.llm.queries import VOCABULARY

with open(public_tokenizers.path(VOCABULARY), "rb") as f:
    RAW = f.read()


def test_tokens_side_by_side_stay_as_they_are_just_when_merging_gives_them_back():
    coder, rng = bpe.BpeTransducer(bpe.read_ranks(RAW)), random.Random(3)
    tokens, seen = sorted(coder.bytes_of), set()
    for _ in range(20_000):
        left, right = rng.choice(tokens[:600]), rng.choice(tokens[: rng.choice([600, len(tokens)])])
        want = coder.merged(coder.bytes_of[left] + coder.bytes_of[right]) == [left, right]
        assert coder.may_follow(left << 20 | right) == want
        seen.add(want)
    assert seen == {True, False}
    assert all(coder.bytes_of[a] + coder.bytes_of[b] == coder.bytes_of[t] for t in tokens[300:900] for a, b in [coder.split(t)])


def test_a_task_leaves_no_tokenizer_in_its_worker():
    code = bpe._per_task(SimpleNamespace(value=RAW), public_tokenizers.PATTERN, lambda tokenizer, batch: tokenizer.encode(batch.column(0)[0].as_py()))
    assert len(list(code(iter([pa.record_batch({"text": ["some words, and more"]})])))) == 1
    assert not bpe.Tokenizer.held
