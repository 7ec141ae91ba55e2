"""Search, page extraction and hard negatives against brute force on small rows, with nulls, empties, ties, repeats, empty tables and clashing columns."""

import html
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import html_text, negatives, queries, search

SMALL = "/root/testdata/sf0.001"
rng = random.Random(11)


# --- op11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    n_of = [(d, Counter(terms(t))) for d, t in docs]
    n_of = [(d, c) for d, c in n_of if c]
    nd, nt, df = len(n_of), sum(sum(c.values()) for _, c in n_of), Counter(t for _, c in n_of for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = {}
    for i, ts in wanted.items():
        scores = []
        for d, c in n_of:
            m = 50 + 50 * sum(c.values()) * nd // nt
            s = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        for r, (s, _, d) in enumerate(sorted(scores)[:k]):
            out[i, r + 1] = (d, -s)
    return out


def found(df):
    return {(r["item_id"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}


def test_search_equals_brute_force(spark, monkeypatch):
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "straße", "x9"]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(63)], k=rng.randint(1, 80))) for _ in range(300)]
    texts += [texts[0]] * 40 + [None, "", " .,-", "rare", "RARE", "rare " * 500, "y" * 200_000, " ".join(f"u{i}" for i in range(120_000)) + " w1"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, "w1 w2"), (None, "w3 rare")]
    items = [(1, "w1 W2, w50 w50"), (1, "w3"), (2, "rare u7"), (3, None), (4, ""), (5, "absent"), (6, "w0"), (None, "w5 x9"), (7, texts[0]), (8, "ÉTÉ été Été")]
    d = spark.createDataFrame([(i, t, "mine", 3) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    q = spark.createDataFrame([(i, t, "mine") for i, t in items], "item_id long, text string, id string")
    want = {k: brute_search(docs, items, k) for k in (3, 50)}
    index = search.build_index(d)
    assert (index.n_docs, index.rows.count()) == (347, len(docs))
    for k in (3, 50):
        assert found(search.search(index, q, k)) == want[k]
    monkeypatch.setattr(search, "BLOCK_ITEMS", 2)  # several blocks, several chunks of documents
    monkeypatch.setattr(search, "CELLS", 200)
    assert found(search.search(index, q, 50)) == want[50]
    for low, high in ((d, q.where("false")), (d.where("false"), q), (d.where("text IS NULL"), q)):
        out = search.search(search.build_index(low), high)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "id", "score"]


def test_search_takes_string_ids(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    q = spark.createDataFrame([("i", "two one")], "item_id string, text string")
    got = found(search.search(search.build_index(d), q))
    assert got == brute_search([("b", "one two"), ("a", "one two")], [("i", "two one")], 50) and [got["i", r][0] for r in (1, 2)] == ["a", "b"]


def test_bytes_bound_impacts_from_above():
    tf = np.array([rng.choice([1, 2, 7, 1000, 10**6]) for _ in range(2000)])
    n = np.array([rng.choice([1, 10, 300, 10**5, 10**7]) for _ in range(2000)])
    exact = search.impacts(tf, n, 1000, 300_000)
    steps = -(-exact // search.STEP)
    assert (steps <= 255).all() and (steps * search.STEP >= exact).all() and ((steps - 1) * search.STEP < exact).all()


# --- op12


class Plain(HTMLParser):
    """The text of the article of a page that says where it is, by the library's parser."""

    blocks = {"p", "h1", "h2", "li", "ul", "div", "article", "nav", "footer", "header", "section", "br_"}

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in self.blocks:
            self.out.append("")
        elif tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.blocks:
            self.out.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.out[-1] += data


def brute_article(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    return "\n".join(x for x in (" ".join(t.split()) for t in parser.out) if x)


def test_articles_of_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    want = {r["page_id"]: (r["url"], t := brute_article(r["html"]), len(t)) for r in rows}
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op12_html_text(spark, SMALL).collect()}
    assert got == want and any(t for _, t, _ in want.values())


LONG = "A sentence that is long enough to be taken for running text, with commas, and with some more words at its end. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain text without any markup", "plain text without any markup"),
        ("<p>a &lt;b&gt; &amp;amp; &eacute;&#x20AC;&nbsp;z</p>", "a <b> &amp; é€ z"),
        ("<article>a<br>b <i>c</i>\n\n d<p>e<p>f</article> g", "a b c d\ne\nf"),
        ("<article><h1>T</h1><nav>m</nav><p>x</p><div class='share-buttons'>s</div><p>y <span class=ad>buy</span>z</p><aside>q</aside></article>", "T\nx\ny z"),
        ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>x</p></main><section id=comments><article class=comment>c</article></section>", "T\nx"),
        ("<article><p>x</p><form>f<button>b</button></form><script>if (a</b) '</p>'</script><style>p{}</style><!-- n --><p>y</article>", "x\ny"),
        ("<article></article><footer>foot</footer><div>rest</div>", ""),
        ("<article>un<b>closed <p>end", "unclosed\nend"),
        ("<article>a < b and c > d <p class=\"x>y\">e</p></article>", "a < b and c > d\ne"),
        ("<article>x<!-- never closed </article>", "x"),
        ("<div class='has-sidebar'><article><p>x</p></article><div class='sidebar'>s</div></div>", "x"),
        (f"<div><a href=/>home</a></div><div><a href=/b>news</a></div><div><h2>Title</h2><p>{LONG * 2}</p><p>short</p><p>{LONG}</p></div>"
         "<ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li><li><a href=/3>three</a></li></ul><div>© 2020 host, all rights</div>", None),
    ],
)
def test_pages(page, text):
    if text is None:
        text = "\n".join(["Title", (LONG * 2).strip(), "short", LONG.strip()])
    assert html_text.main_text(page) == text


def test_surges_and_dives():
    w = html_text.WINDOW
    assert html_text.surges([], 1) == [] and html_text.surges([0] * 9, 1) == []
    assert html_text.surges([0, 5, 100, 0, 0, 70, 0, 0, 0, 0, 30, 90], 86) == [(1, 6), (10, 12)]  # gaps shorter than the window stay inside
    lengths = [rng.choice([0, 0, 0, 10, 60, 120]) for _ in range(500)]
    inside = {i for a, b in html_text.surges(lengths, 1) for i in range(a, b)}
    assert all((x == 0) or (i in inside) for i, x in enumerate(lengths)) and all(sum(lengths[i : i + w]) for i in inside)


def test_pages_pass_through_spark(spark):
    rows = [(1, "u", "<article>x</article>", "mine"), (1, "u", "<article>x</article>", "mine"), (None, None, None, None), (3, "v", "<article>" + "<p>word &amp; word" * 100_000 + "</article>", "t")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = html_text.extract_text(d).collect()
    assert [c for c in html_text.extract_text(d).columns] == ["page_id", "url", "html", "text"]
    assert sorted(len(r["text"]) for r in got) == [0, 1, 1, 100_000 * 12 - 1]
    assert html_text.extract_text(d.where("false")).count() == 0
    assert html.unescape("&amp;amp;") == "&amp;"  # references are decoded once


# --- op13


def brute_negatives(rows, n=5, k=10):
    taken = [(v, (label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * x) for x in e]) for v, label, e in rows if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    anchors = {}
    for v, label, e in sorted(taken):
        if v % 100 == 0:
            anchors.setdefault(v, (label, e))
    for a, (la, ea) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(ea, e)), v, label) for v, label, e in taken if v != a)
        for s, p, _ in [x for x in scored if x[2] == la][:n]:
            fits = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out |= {(a, p, r + 1, v, -s, -t) for r, (t, v, _) in enumerate(fits)}
    return out


def mined(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


VECTORS = "vec_id long, label int, embedding array<float>, score string"


def test_negatives_equal_brute_force(spark, monkeypatch):
    gen = np.random.default_rng(3)
    rows = []
    for i in range(900):
        e = (gen.normal(size=6) * gen.choice([0.1, 1, 4])).astype(np.float32).tolist()
        rows.append((i, int(gen.integers(4)), e, "mine"))
    same = rows[17][2]
    rows += [(1000 + i, 1, same, None) for i in range(300)] + [(2000, 1, same, None), (2100, None, same, None), (2200, 1, None, None), (2300, 1, [float("nan")] * 6, None), (2301, 2, [None, 1.0], None), (2302, 2, [float("inf")] * 6, None), (None, 1, same, None)]
    rows += [(2400, 2, [], None), (2401, 1, [3.0], None), (2500, 9, [1.0] * 6, None), (2600, 3, [0.5, -0.25], None)]
    d = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = brute_negatives([r[:3] for r in rows])
    anchor = F.col("vec_id") % 100 == 0
    assert len(want) > 500
    assert mined(negatives.hard_negatives(negatives.integer_vectors(d), anchor)) == want
    for name, value in (("BLOCK_CELLS", 30), ("TILE", 64), ("CHUNK", 16), ("BUCKET_ROWS", 40)):  # several blocks, tiles, chunks and buckets
        monkeypatch.setattr(negatives, name, value)
    assert mined(negatives.hard_negatives(negatives.integer_vectors(d.where("vec_id < 700 OR vec_id >= 2000")), anchor)) == brute_negatives([r[:3] for r in rows if r[0] is not None and (r[0] < 700 or r[0] >= 2000)])


def test_negatives_of_empty_and_repeated_rows(spark):
    anchor = F.col("vec_id") % 100 == 0
    d = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(negatives.integer_vectors(d), anchor).count() == 0
    rows = [(100, 1, [1.0, 0.0], None)] * 2 + [(1, 1, [1.0, 0.0], None)] * 2 + [(2, 2, [0.5, 0.0], None)] * 2
    out = negatives.hard_negatives(negatives.integer_vectors(spark.createDataFrame(rows, VECTORS)), anchor)
    assert sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id").collect()) == [(100, 1, r, 2) for r in (1, 1, 2, 2)]
    big = spark.createDataFrame([(100, 1, [3e38], None)], VECTORS)
    with pytest.raises(Exception, match="31 bits"):
        negatives.integer_vectors(big).collect()


def test_chunks_beyond_a_window_are_not_scored(monkeypatch):
    import pyarrow as pa

    def batch(ids, norm):
        n = len(ids)
        return pa.RecordBatch.from_pydict({"vec_id": ids, "label": [2] * n, "v": [[int(norm), 0]] * n, "norm2": [norm**2] * n})

    rows = pa.table({"vec_id": [100], "label": [2], "v": [[10, 0]]})
    seen = []
    exact = negatives._exact
    monkeypatch.setattr(negatives, "_exact", lambda a, b: seen.append(len(b)) or exact(a, b))
    anchors = negatives.Anchors(rows, 2, 2, True)
    out = pa.Table.from_batches(anchors.search(iter([batch([1, 2, 3], 9.0), batch([4], 2.0), batch([5], 9.0)])))
    assert out.column("vec_id").to_pylist() == [1, 2] and seen == [3, 1]  # the short vector's bound is below the second score
