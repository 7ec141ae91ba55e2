"""The corpus operators against brute force on small rows, with nulls, empties, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import bpe, chat_format, decontamination, line_dedup, lm, near_dedup, quality, queries, substring_dedup, toxicity, url_filter
from tessella.llm.words import NON_ALNUM, SPACES, hash_spans, split_words, texts_of

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(4)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Été", "straße", "x"]


def prose(n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_words_follow_the_patterns():
    texts = ["a  b\tc\u00a0d\n", "", None, "Zé-9\x0b!", "x" * 3000000 + " y"]
    data = texts_of(pa.array(texts, pa.string()))
    for table, pattern in ((SPACES, r"[^\x20\x09-\x0D]+"), (NON_ALNUM, r"[^\x00-\x2F\x3A-\x40\x41-\x60\x7B-\x7F]+")):
        words = split_words(data, table)
        got = [data.data[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends)]
        assert got == [w for t in texts for w in re.findall(pattern, t or "")]
        assert list(words.counts()) == [len(re.findall(pattern, t or "")) for t in texts]
        h = hash_spans(data.data, words.starts, words.ends)
        assert len({(w, int(x)) for w, x in zip(got, h)}) == len(set(got)) == len(set(h.tolist()))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7?q", "http://example.com/en/8", "http://notexample.net/de/8", "http://example.net/de/81#x", "http://x.org/EN/es/", "http://org/es/", "http://x.com.org/en/", "http://a.com//x.com/en/", "x://://com/en/"]
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, rule string")

    def brute(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES if path.startswith(r[2]) and (host == r[1] or host.endswith("." + r[1]))]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, best and best[1] + best[2], best[0] if best else "allow"

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows).collect()}
    assert got == {i: brute(u) for i, u in enumerate([*urls, urls[3]])}
    assert url_filter.filter_urls(rows.where("false")).count() == 0
    many = url_filter.GlobAutomaton([f"*.h{i}.org/**" for i in range(40)])
    texts = texts_of(pa.array(["a.h7.org/x", "a/b.h7.org/x", "", "h7.org/"]))
    assert many.words > 1 and many.matches(texts.data, texts.offsets).any(axis=1).tolist() == [True, False, False, False]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup_equals_brute_force(spark):
    base = [prose(60) for _ in range(12)]
    texts = [None, "", " \n", "a b", "A  b", "one two three four five"]
    for b in base:
        texts += [b, b.upper()]
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in near_dedup.link_documents(docs_of(spark, texts)).collect()}
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}
    kept = near_dedup.drop_near_copies(docs_of(spark, texts))
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").split(", ") and kept.count() == len({root(i) for i in range(len(texts))})
    assert near_dedup.link_documents(docs_of(spark, texts).where("false")).count() == 0
    null_id = spark.createDataFrame([(None, "a b c d e f", "", "", 0), (3, "a b c d e f", "", "", 0), (3, "a b c d e f", "", "", 0)], DOC)
    assert sorted(str((r["component_id"], r["kept"])) for r in near_dedup.link_documents(null_id).collect()) == ["(3, True)", "(3, True)", "(None, True)"]


def test_line_dedup_equals_brute_force(spark):
    common = [f"{'Line'} {i} " + "é" * 36 for i in range(4)]
    texts = [None, "", "\n", common[0]]
    for i in range(40):
        lines = [rng.choice([*common, "short", prose(9), " \t" + common[1].upper() + "\x0b", ""]) for _ in range(rng.randint(1, 8))]
        texts.append("\n".join(lines))
    key = lambda line: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and i != max(holders[key(line)])
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs_of(spark, texts).repartition(3)).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [x for x in lines if not gone(i, x)]
        assert got[i] == ("\n".join(left), len(lines), len(lines) - len(left)), i
    assert line_dedup.dedup_lines(docs_of(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("cuts", [(), (3,), (1, 2, 9), tuple(range(1, 40))])
def test_line_runs_over_partition_edges(cuts):
    """Any cut of the sorted rows into partitions and batches gives the same drops."""
    rows = sorted([(h, 0, d, 0, p) for h, n in ((1, 3), (2, 12), (3, 5), (4, 1), (5, 9)) for d in range(n) for p in range(1 + d % 2)], key=lambda r: (r[0], -r[2], r[4]))
    names = ["h1", "h2", "doc_id", "fp", "pos"]
    out = []
    bounds = [0, *[c for c in cuts if c < len(rows) and rows[c - 1][:3] != rows[c][:3]], len(rows)]
    for low, high in zip(bounds, bounds[1:]):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : min(i + 4, high)]], pa.int64()) for k in range(5)], names=names) for i in range(low, high, 4)]
        out += [tuple(r.values()) for b in line_dedup._stream_runs(5)(iter(batches)) for r in b.to_pylist()]
    total, largest = Counter(), {}
    for h1, _, d, _, _, kind, docs in out:
        if kind == line_dedup.PIECE:
            total[h1] += docs
            largest[h1] = max(d, largest.get(h1, d))
    dropped = [r[:5] for r in out if r[5] == 0] + [r[:5] for r in out if r[5] == 1 and total[r[0]] >= 5 and r[2] < largest[r[0]]]
    size = Counter(h for h, *_ in {(r[0], r[2]) for r in rows})
    assert sorted(dropped) == sorted(r for r in rows if size[r[0]] >= 5 and r[2] != size[r[0]] - 1)


def test_decontamination_equals_brute_force(spark):
    items = ["one two three", prose(25), "", None, "Zig-zag, ZIG zag!", prose(10)]
    bench = spark.createDataFrame([*[(i, t) for i, t in enumerate(items)], (11, items[1]), (None, "null item here")], "item_id long, text string")
    texts = [None, "", "x one TWO  three y", prose(30) + " " + items[1] + " " + prose(5), "pre " + items[5].replace("a", "A"), "zig zag zig zag zig zag", "a null item here b", prose(40)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    for block in (200_000, 4):
        got = {r["doc_id"]: r for r in decontamination.scan_benchmark(docs_of(spark, texts), bench, block_windows=block).collect()}
        for i, t in enumerate(texts):
            w, hit, listed = words(t), set(), set()
            for item, text in [*enumerate(items), (11, items[1]), (None, "null item here")]:
                v = words(text)
                k = min(10, len(v))
                for a in range(len(v) - k + 1) if k else ():
                    for b in range(len(w) - k + 1):
                        if w[b : b + k] == v[a : a + k]:
                            hit |= set(range(b, b + k))
                            listed |= {str(item)} - {"None"}
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["hit_items"]) == (len(w), len(hit), sorted(listed)), (block, i)
    clean = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs_of(spark, texts), bench).collect()}
    assert clean[2] == "x  y" and clean[7] == texts[7] and clean[0] is None
    assert decontamination.decontaminate(docs_of(spark, texts), bench, remove="documents").count() == 3
    assert decontamination.scan_benchmark(docs_of(spark, texts), bench.where("false")).where("n_hit > 0").count() == 0


def test_substring_dedup(spark):
    passage = "Here is a first sentence of some words. Then another one that goes on for a while! Does the third ask anything at all? It ends with a fourth sentence here now."
    texts = [None, "", prose(40) + ". " + passage + " " + prose(30) + ".", "Lead in words here. " + passage + " Tail of another kind.", prose(50), passage, passage]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs_of(spark, texts)).collect()}
    assert [got[i]["n_removed"] for i in range(7)] == [0, 0, 0, 4, 0, 4, 4]
    assert got[3]["text"] == "Lead in words here. Tail of another kind." and got[5]["text"] == "" and got[2]["text"] == texts[2]
    assert substring_dedup.dedup_substrings(docs_of(spark, texts).where("false")).count() == 0


def test_substring_dedup_without_marks(spark):
    """Passages of 51 words without marks, with marks, and with one mark, in different surroundings."""
    draw = random.Random(8)
    some = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    texts = []
    for i in range(60):
        passage = some(51)
        if i % 3:
            passage[25] += "."
        if i % 3 == 2:
            passage[8] += "?"
        for edge in ("", "."):
            texts.append(" ".join([*some(draw.randrange(1, 80)), "edge" + edge, *passage, *some(draw.randrange(1, 80))]))
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs_of(spark, texts)).collect()}
    for i in range(0, 120, 2):
        assert got[i]["n_removed"] == 0 and got[i]["text"] == texts[i]
        kept, held = got[i + 1]["text"].split(" "), set(texts[i].split(" "))
        gone = [w for w in texts[i + 1].split(" ") if w not in kept]
        assert got[i + 1]["n_removed"] > 0 and len(gone) >= 20 and set(gone) <= held, i


def test_substring_dedup_equals_brute_force(spark):
    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    some = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", "", "", "", "", ".", "!", ".\n"]) for _ in range(n))
    planted = [some(draw.randrange(15, 70)) for _ in range(12)] + ["v1 " * 30, " ".join(vocabulary[:60])]
    texts = [None, "", *[" ".join([some(draw.randrange(1, 50)), draw.choice(planted), some(draw.randrange(1, 50)), draw.choice(planted)]) for _ in range(60)]]
    pieces = {}
    for i, t in enumerate(texts):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", t or ""))
        ends = [k + 1 == len(words) or w[0][-1] in ".!?" or "\n" in t[w.end() : words[k + 1].start()] for k, w in enumerate(words)]
        data = texts_of(pa.array([lower(t or "")]))
        spans = split_words(data, SPACES, data.data)
        hashes = hash_spans(data.data, spans.starts, spans.ends).tolist()
        marks = {k for k, e in enumerate(ends) if e}
        for k in range(len(words) - 10):
            if not any(ends[k : k + 11]):
                marks.add(min(range(k, k + 11), key=lambda x: (hashes[x], -x)))
        stops = [k + 1 for k in sorted(marks)]
        pieces[i] = (words, list(zip([0, *stops], stops)))
    first, runs = {}, []
    for i, (words, cut) in pieces.items():
        for a in range(len(cut)):
            b = next((b for b in range(a + 1, len(cut)) if cut[b][1] - cut[a][0] >= 20), None)
            if b is not None:
                key = tuple(lower(w[0]) for w in words[cut[a][0] : cut[b][1]])
                runs.append((key, i, a, b))
                first.setdefault(key, (i, a))
    gone = {i: set() for i in pieces}
    for key, i, a, b in runs:
        if first[key] != (i, a):
            gone[i] |= set(range(a, b + 1))
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs_of(spark, texts)).collect()}
    assert sum(map(len, gone.values())) > 100
    for i, (words, cut) in pieces.items():
        kept = [words[k][0] for c, (a, b) in enumerate(cut) if c not in gone[i] for k in range(a, b)]
        assert (got[i]["n_sentences"], got[i]["n_removed"], (got[i]["text"] or "").split()) == (len(cut), len(gone[i]), kept), i


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_equal_brute_force(spark):
    texts = [None, "", "a b c a b c", "x\nx\n x\n\n\n", "é|é #1 <b>", *[prose(rng.randint(1, 80)).replace(" ", "\n", 3) for _ in range(20)], "Las " * 90, "a" * 50000]
    model = quality.train([], np.zeros(0))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.score_quality(docs_of(spark, texts), model).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_quality_and_toxicity_learn(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id")
    right = scored.where("NOT base_failed").agg(F.avg(((F.col("probability") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(big, known)
    held = toxicity.score_toxicity(big.join(known, "doc_id"), model).where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2")
    hit, said, real = held.agg(F.expr("count_if(toxic = 1 AND score >= 0.3)"), F.expr("count_if(score >= 0.3)"), F.expr("count_if(toxic = 1)")).first()
    assert hit / real > 0.8 and hit / said > 0.8
    odd = toxicity.score_toxicity(docs_of(spark, [None, "", "word"]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    assert toxicity.score_toxicity(docs_of(spark, ["a"]), toxicity.fit_toxicity(docs, labels.where("false"))).first()["score"] == 0


def test_toxicity_counts_words():
    """A word that is harmless once and toxic five times, each time with another ending."""
    draw = random.Random(5)
    labels = np.array([i % 2 for i in range(400)], dtype=float)
    texts = []
    for y in labels:
        words = [f"plain{draw.randrange(50)}" for _ in range(40)] + [f"insult{draw.randrange(10**6)}" for _ in range(5 if y else 1)]
        draw.shuffle(words)
        texts.append(" ".join(words))
    model = toxicity.ConvText()
    model.fit(*toxicity.word_rows(pa.array(texts[:300])), labels[:300], steps=300)
    margins = model.margin(*toxicity.word_rows(pa.array(texts[300:])))
    assert ((margins > np.median(margins)) == (labels[300:] > 0)).mean() > 0.95


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\b </s> <\\s> [INST]"), (1, 1, "assistant", None), (1, 2, "assistant", "[/INST]\\\\<s>"), (1, 2, "assistant", "[/INST]\\\\<s>"), (None, 0, None, "x"), (2, 200, "role\nnew", "été\n"), (2, 3, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for out in (chat_format.format_conversations(chat_format.as_events(table)),):
        back = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["formatted"], r["loss"]) for r in out.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert back[1][0] == [("user", "a\\b </s> <\\s> [INST]"), ("assistant", ""), ("assistant", "[/INST]\\\\<s>"), ("assistant", "[/INST]\\\\<s>")]
    assert back[None][0] == [("", "x")] and back[2][0] == [("user", ""), ("role\nnew", "été\n")]
    text, loss = back[1][1], back[1][2]
    assert [text[m["start"] - 1 : m["start"] - 1 + m["size"]] for m in loss] == ["", "[\\/INST]\\\\\\\\<\\s>", "[\\/INST]\\\\\\\\<\\s>"]
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_blocks(chat_format.as_events(table))).collect()}
    said = "".join(f"{r}\n{t}\n" for r, t in back[1][0])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 4 and got[1]["formatted_chars"] == len(text)
    assert chat_format.digest(chat_format.format_blocks(chat_format.as_events(table.where("false")))).count() == 0


def test_chat_folds_events(spark):
    log = [(1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", ""), (1, 2, "delta", 1, None, "Hel"), (1, 3, "delta", 1, None, "lo"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "Hey"), (1, 6, "edit", 0, None, "hi!"), (1, 7, "message", None, "user", "x"), (1, 8, "delete", 7, None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, op string, ref long, role string, text string")
    row = chat_format.format_conversations(events).select(chat_format.read_back(F.col("formatted")).alias("t")).first()
    assert [(t["role"], t["text"]) for t in row["t"]] == [("user", "hi!"), ("assistant", "Hey")]


def test_lm_base_equals_brute_force_and_model_is_a_distribution(spark, tmp_path):
    texts = [None, "", *[prose(rng.randint(1, 60)) for _ in range(60)]]
    rows = spark.createDataFrame([*[(i, t) for i, t in enumerate(texts)], (2, texts[2])], "doc_id long, text string")
    got = sorted((r.asDict() for r in lm.score_documents(rows).collect()), key=lambda r: r["doc_id"])
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None]
    everything = [*enumerate(texts), (2, texts[2])]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in everything if not out(i) for w in tokens(t))
    n = sum(c.values())
    for r in got:
        t = tokens(texts[r["doc_id"]])
        base = sum(np.log10((c[w] + 1) / (n + len(c) + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert lm.score_documents(rows.where("false")).count() == 0


def small_shard(seed=0):
    draw = np.random.default_rng(seed)
    words = np.sort(draw.choice(1 << 40, 900, replace=False).astype(np.uint64)) << np.uint64(20)
    codes = np.unique(np.concatenate([words | np.uint64(k) for k in (1, 2)]))
    seen = np.where(np.arange(len(codes)) % 3, draw.integers(0, 40, len(codes)), 0)
    seen[5] = 30000
    shard = lm.Shard(codes, seen)
    keep = np.repeat(shard.count > 0, np.diff([*shard.first, len(codes)]))
    shard = lm.Shard(codes[keep], seen[keep])
    size = np.bincount(shard.context, shard.c, lm.CONTEXTS)
    return shard, lm.Totals(size, np.bincount(shard.context, shard.t, lm.CONTEXTS), len(shard.first), len(shard.first), (0.5, 0.6))


def test_lm_probabilities_add_up():
    """All words and one unknown word, in every context."""
    shard, before = small_shard()
    shard.sweep(before, 0)
    assert ((shard.t <= shard.c) & ((shard.t > 0) == (shard.c > 0))).all()
    tables, root = shard.sums(before, 1)
    after = lm.Totals(before.customers, tables, root, before.words, before.discounts)
    p, base = shard.predict(before, after, 1), after.root(*shard.seat_root(before, 1))
    unknown = after.root(np.zeros(1), np.zeros(1))[0]
    for k in (1, 2):
        rest = (lm.STRENGTHS[1] + 0.6 * after.tables[k]) / (lm.STRENGTHS[1] + before.customers[k])
        mine = shard.context == k
        missing = np.setdiff1d(np.arange(len(base)), shard.word[mine])
        assert p[mine].sum() + rest * (base[missing].sum() + unknown) == pytest.approx(1, abs=1e-9)


def test_lm_seating_is_that_of_the_restaurant():
    """Against customers seated one by one, at small and large dishes; and the same for any part of the dishes."""
    draw = np.random.default_rng(3)
    for customers, weight, discount in ((2, 0.7, 0.4), (7, 2.5, 0.6), (60, 0.05, 0.3), (900, 12.0, 0.8), (20000, 0.9, 0.5)):
        n = 2000
        own = lm.seat(np.full(n, customers), np.full(n, weight), discount, np.arange(n, dtype=np.uint64) * np.uint64(65537), 3, 1)
        t = np.ones(n)
        for i in range(1, customers):
            t += draw.random(n) < weight / (weight + i - discount * t)
        assert abs(own.mean() - t.mean()) < 4.5 * np.sqrt((own.var() + t.var()) / n) + 1e-9
        assert abs(own.std() - t.std()) < 0.08 * t.std() + 0.02
    c, codes = draw.integers(0, 500, 300), draw.integers(0, 1 << 60, 300).astype(np.uint64)
    whole = lm.seat(c, np.full(300, 3.0), 0.5, codes, 1, 1)
    assert (whole[100:150] == lm.seat(c[100:150], np.full(50, 3.0), 0.5, codes[100:150], 1, 1)).all()
    packed = np.array([5, 5, 2**63, 1, 0], np.uint64)
    assert (lm.unpack(lm.pack(packed)) == packed).all() and len(lm.unpack(lm.pack(packed[:0]))) == 0


def test_lm_scores_do_not_depend_on_settings(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs.repartition(5).write.parquet(str(tmp_path / "cut"))
    cut = spark.read.parquet(str(tmp_path / "cut"))
    both = cut.where("doc_id % 2 = 0").join(docs.select("doc_id"), "doc_id").unionByName(docs.where("doc_id % 2 = 1"))
    runs, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for rows, partitions in ((docs, "4"), (cut, "13"), (both, "3")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            runs.append({r["doc_id"]: r["score"] for r in lm.score_documents(rows).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 100


def test_lm_beats_the_base_on_held_out_text(spark):
    sums = queries.op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


@pytest.fixture(scope="module")
def tokenizers():
    raw = open(public_tokenizers.path(queries.VOCABULARY), "rb").read()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    return bpe.Tokenizer(raw, public_tokenizers.PATTERN), other


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "\n", " \n", "é", "中文", "😀", "12", "'s", "!!", "\u00a0", "e\u0301", "\x00", "ñ"]), max_size=30).map("".join))
def test_bpe_equals_the_library(tokenizers, text):
    own, other = tokenizers
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert "".join(bpe.decode_stream(iter(ids), own.bpe.bytes_of)) == text


def test_bpe_long_pieces_and_small_tables(tokenizers):
    own, other = tokenizers
    small = bpe.BpeTransducer(own.bpe.ranks, max_states=20, max_pieces=5, window=16)
    for n in (1, 15, 16, 17, 700, 20000):
        piece = "".join(rng.choice(["a", "th", "é", "zz", "ing"]) for _ in range(n))
        assert small.run(piece.encode()) == own.bpe.run(piece.encode()) == other.encode_ordinary(piece) or n == 1
    stream = bpe.Utf8Stream()
    assert "".join(stream.feed(bytes([b])) for b in "é😀中a".encode()) + stream.close() == "é😀中a"
    assert bpe.Utf8Stream().feed(b"\xff") == "\ufffd"


def test_bpe_query_shape(spark):
    raw = open(public_tokenizers.path(queries.VOCABULARY), "rb").read()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    rows = {r["doc_id"]: r for r in queries.op10_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert all(rows[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest() for d in docs)
    for d in docs:
        ids = other.encode_ordinary(d["text"] or "")
        assert (rows[d["doc_id"]]["n_tokens"], rows[d["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(queries.VOCABULARY))
    odd = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (3, "a é\n", 7)], "doc_id int, text string, ids int")
    back = bpe.code_texts(odd, vocabulary, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r["ids"] for r in back] == [[], [], [], other.encode_ordinary("a é\n")] and all(r["round_trip"] for r in back)
    assert bpe.round_trip(odd.where("false"), vocabulary, public_tokenizers.PATTERN).count() == 0
    assert [r["decoded"] for r in bpe.decode_ids(bpe.encode_texts(odd, vocabulary, public_tokenizers.PATTERN), vocabulary, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == ["", "", "", "a é\n"]


def test_clashing_columns_and_id_types(spark):
    """Columns named like helpers stay, and text ids work, in every operator that passes columns through."""
    helpers = ["__doc", "__mark", "__places", "__out", "__fp", "__keep", "__found", "__q", "kept_doc", "Kept_Bits", "deduped", "span_doc", "cut", "found", "counted", "coded", "key", "part", "rep"]
    line = "A line of more than forty characters that five documents hold."
    texts = [None, "", *[f"{prose(30)}.\n{line}\n{prose(25)}" for _ in range(6)]]
    rows = spark.createDataFrame([(f"d{i}", t, "en", *range(len(helpers))) for i, t in enumerate([*texts, texts[2], texts[2]])], "doc_id string, text string, lang string, " + ", ".join(f"`{h}` int" for h in helpers))
    bench = spark.createDataFrame([(1, "never found in here")], "item_id long, text string")
    labels = spark.createDataFrame([("d2", 1, 0)], "doc_id string, quality int, toxic int")
    outs = {
        "lines": line_dedup.dedup_lines(rows),
        "spans": substring_dedup.dedup_substrings(rows),
        "near": near_dedup.drop_near_copies(rows),
        "leaks": decontamination.scan_benchmark(rows, bench),
        "quality": quality.score_quality(rows, quality.fit_quality(rows, labels)),
        "toxic": toxicity.score_toxicity(rows, toxicity.fit_toxicity(rows, labels)),
    }
    for name, out in outs.items():
        got = out.collect()
        assert all([r[h] for h in helpers] == list(range(len(helpers))) for r in got), name
        assert len(got) == (8 if name == "near" else 10), name
    assert sorted(r["doc_id"] for r in outs["lines"].where("n_dropped = 0").collect()) == ["d0", "d1", "d9"]
    assert {r["component_id"] for r in near_dedup.link_documents(rows).collect()} == {f"d{i}" for i in range(8)}


def test_pipeline_stages(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL)
    assert got.where("NOT round_trip").count() == 0 and 0 < got.count() <= spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "bpe"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Lines, near copies, benchmark words and token ids of the whole run against plain Python, on documents with planted cases."""
    import corpus_pipeline

    own = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bodies, shared = [prose(60) for _ in range(8)], "A line that is found in many of these documents, " + prose(4)
    planted = [b for b in bodies for _ in range(2)] + [b.replace(" x", " y", 1) + " and one more" for b in bodies[:4]]
    planted += [prose(45) + "\n" + shared + "\n" + prose(30) for _ in range(7)] + [prose(20) + " " + items[k] + ", " + prose(20) for k in (0, 1, 2)] + [None, "", "two words", "two words", "e" * 5000]
    rows = own + [(100_000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(planted)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit_toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), holdout=False)
    scored = toxicity.score_toxicity(docs, model).select("doc_id", "text", "flagged").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in scored if not r["flagged"]}
    assert 0 < len(texts) < len(rows)

    strip = lambda line: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(strip(line), set()).add(i)
    gone = lambda i, line: len(strip(line)) >= 40 and len(holders[strip(line)]) >= 5 and i != max(holders[strip(line)])
    texts = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    best = {i: i for i in texts}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                best[high] = low
    kept = {i: t for i, t in texts.items() if root(i) == i}
    assert len(texts) - len(kept) >= 9  # the planted copies at least

    found = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")))
    windows = {}
    for t in items:
        w = [m[0] for m in found(t)]
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(min(10, len(w)), set()).add(tuple(w[k : k + 10]))
    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path(queries.VOCABULARY), "rb").read()), special_tokens={})
    want, cut = {}, 0
    for i, t in kept.items():
        w = found(t)
        hit = {k + j for n, known in windows.items() for k in range(len(w) - n + 1) if tuple(m[0] for m in w[k : k + n]) in known for j in range(n)}
        cut += bool(hit)
        for k in sorted(hit, reverse=True):
            t = t[: w[k].start()] + t[w[k + 1].start() if k + 1 in hit else w[k].end() :]
        want[i] = encoding.encode_ordinary(t)
    assert cut >= 3
    got = {r["doc_id"]: (r["ids"], r["n_tokens"], r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(want)
    assert all(got[i] == (ids, len(ids), True) for i, ids in want.items())
