"""URL filters: glob rules packed into multiword Shift-And masks.

A rule ``(action, host, path)`` fits a host, all its subdomains and every path
that starts with the rule's.  It is compiled to the two anchored globs
``{host}{path}**`` and ``*.{host}{path}**`` over the canonical form
``host + path`` (``*``: any run without ``/``, ``**``: any run).  All globs sit
side by side in a vector of 64-bit words, and one pass over the bytes of a
batch of URLs moves every glob of every URL at once:

    D = ((D << 1) & follow[byte]) | (D & loop[byte])

The plan has no shuffle; memory is slice x words of state.

Defined results: a null URL or one without ``://`` has empty host and path and
gets the default verdict; repeated rows are judged each for itself; an empty
table stays empty; all other columns pass through unless named like an output
(``host``, ``path``, ``rule``, ``verdict``), which the output replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, free_name
from .words import slices, texts_of

#: Fixed values of the contract: (action, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


class GlobAutomaton:
    """All globs as one bit vector; ``matches`` runs them over many strings."""

    def __init__(self, globs: Sequence[str]):
        starts, accepts, follow, loop = [], [], [], []  # bit positions; (bit, byte); (bit, crosses slash)
        bit = 0
        for glob in globs:
            starts.append(bit)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    crosses = raw[i : i + 2] == b"**"
                    loop.append((bit, crosses))
                    i += 2 if crosses else 1
                else:
                    bit += 1
                    follow.append((bit, raw[i]))
                    i += 1
            accepts.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start = self._mask(starts)
        self.accept = [divmod(b, 64) for b in accepts]
        self.follow = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros((256, self.words), dtype=np.uint64)
        for b, byte in follow:
            self.follow[byte, b // 64] |= np.uint64(1 << (b % 64))
        for b, crosses in loop:
            self.loop[:, b // 64] |= np.uint64(1 << (b % 64))
            if not crosses:
                self.loop[ord("/"), b // 64] &= ~np.uint64(1 << (b % 64))

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1 << (b % 64))
        return mask

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix strings x globs."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][order], length[order]
        state = np.repeat(self.start[:, None], len(order), axis=1)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, "left"))  # strings longer than i
            byte = data[begin[:live] + i]
            now = state[:, :live]
            moved = now << one
            moved[1:] |= now[:-1] >> top
            state[:, :live] = (moved & self.follow[byte].T) | (now & self.loop[byte].T)
        hit = np.empty((len(order), len(self.accept)), dtype=bool)
        for g, (word, b) in enumerate(self.accept):
            hit[order, g] = (state[word] >> np.uint64(b)) & one
        return hit


def rule_text(rule: tuple[str, str, str]) -> str:
    """``net`` and ``/`` as ``net/``: the rule as it is written."""
    return rule[1] + rule[2]


def _judge(rules: Sequence[tuple[str, str, str]], default: str):
    ranked = sorted(rules, key=lambda r: -len(rule_text(r)))  # the longest first; ties as listed
    globs = [g for _, host, path in ranked for g in (f"{host}{path}**", f"*.{host}{path}**")]
    names = pa.array([rule_text(r) for r in ranked] + [None], pa.string())
    actions = pa.array([r[0] for r in ranked] + [default], pa.string())

    def judge(urls: pa.Array) -> pa.Array:
        automaton = GlobAutomaton(globs)
        parts = []
        for part in slices(urls):
            texts = texts_of(part)
            hit = automaton.matches(texts.data, texts.offsets)
            hit = hit[:, 0::2] | hit[:, 1::2]
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(texts), int)
            at = pa.array(first)
            parts.append(pa.StructArray.from_arrays([names.take(at), actions.take(at)], ["rule", "verdict"]))
        empty = pa.array([], pa.struct([("rule", pa.string()), ("verdict", pa.string())]))
        return pa.concat_arrays([empty, *parts])

    return judge


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (of the longest fitting rule, else null) and verdict (the rule's, else ``default``)."""
    judge = F.arrow_udf(_judge(tuple(rules), default), "rule string, verdict string")
    after = r"(?s)^.*?://"
    host = F.coalesce(ascii_lower(F.regexp_extract(url, after + r"([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, after + r"[^/?#]*([^?#]*)", 1), F.lit(""))
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    out = free_name(parsed, "judged")
    judged = parsed.withColumn(out, judge(F.concat("host", "path")))
    return judged.select(*[f"`{c}`" for c in parsed.columns], f"{out}.rule", f"{out}.verdict")


ORACLE = r"""
WITH rules(action, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
numbered AS (SELECT *, row_number() OVER () AS n FROM parsed),
fits AS (
  SELECT n, r.host || r.path AS rule, action,
    row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC) AS k
  FROM numbered p JOIN rules r
    ON starts_with(p.path, r.path) AND (p.host = r.host OR ends_with(p.host, '.' || r.host)))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN fits ON numbered.n = fits.n AND fits.k = 1
"""
