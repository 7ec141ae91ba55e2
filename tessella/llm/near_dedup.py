"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

1. A document's set is its distinct five-word shingles.  Equal sets are grouped
   (with map-side aggregation), and one document stands for each group.
2. Each set gets ``CHUNKS * CHUNK`` minhashes of 16 bits.  By pigeonhole, two
   signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` places agree in
   some chunk up to ERRORS places; those errors are enumerated by keys that leave
   one place of the chunk out.  A pair at the similarity 0.75 is missed with
   probability below 2e-7, more similar ones with less.
3. In each bucket all members are compared with one leader, which differs from
   bucket to bucket.  Links are confirmed on the full sets, and components found.
4. Members of one bucket that are in different components after that may still be
   linked.  Each such set x outside the bucket's largest component is compared with
   one reference r of that component.  Whatever else x is linked with, say y, shares
   at most ``|x & r|`` shingles inside r, so if that is too few, x and y must share
   shingles outside r.  If they need k of those, the rarest that they share has k - 1
   shared ones after it in both sets, so an equi-join on the shingles that stand early
   enough, rarest first, finds the pairs, and the sets count them; shingles that very
   many sets hold stand last and make no rows.  A shingle held inside one component
   only cannot link it to another and is left out.
   Where ``|x & r|`` leaves room for a (smaller) partner, the bucket's members are
   compared, sizes, bounds and sketches first.  A group of near copies of which many
   fall short of the threshold thus costs its size and not its square, while no link
   between components is lost.
5. Of the pairs left between two components the nearest is confirmed first; what it
   does not merge is confirmed whole.

A link is missed with probability below 2e-7 at similarity 0.75 (buckets) plus
1e-8 (sketches), and with less above; links found are exact.

Defined results: a document without words is linked with nothing and is its own
component; a null doc_id is never linked and always kept; rows that share a
doc_id count as one document; the smallest doc_id of a component is kept; doc_id
may be of any type that has an order; a text of any length counts whole; an empty
table gives an empty one; other columns of any name pass ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_type, materialize
from .words import LOWER, SPACES, hash_spans, mix, signed, slices, split_words, text_windows, texts_of

SHINGLE = 5
CHUNKS, CHUNK, ERRORS = 16, 5, 1
PLACES = CHUNKS * CHUNK
#: More minhashes, of which BITS bits each serve to tell near from far before sets are compared.
SKETCH, BITS = 512, 2
#: Places of the sketch in which linked sets may differ: 5.6 standard deviations beyond the mean at 0.75.
FAR = 146
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, size=SKETCH, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, size=SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence as one where words are few."""
    for part in slices(column):
        texts = texts_of(part)
        data = LOWER[texts.data]
        words = split_words(texts, SPACES, data)
        hashes = hash_spans(data, words.starts, words.ends)
        at, grams = text_windows(words, hashes, SHINGLE)
        first = np.searchsorted(at, words.first)
        counts = words.counts()
        for i in range(len(texts)):
            if counts[i] >= SHINGLE:
                yield np.unique(grams[first[i] : first[i + 1]])
            elif counts[i]:
                few = hashes[words.first[i] : words.first[i + 1]]
                yield text_windows_of(few)
            else:
                yield np.zeros(0, np.uint64)


def text_windows_of(hashes: np.ndarray) -> np.ndarray:
    """The whole short sequence as one shingle."""
    total = np.uint64(len(hashes))
    for h in hashes:
        total = mix(np.array([total * np.uint64(0x9E3779B97F4A7C15) + h], dtype=np.uint64))[0]
    return np.array([total], dtype=np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """16 bits of the first PLACES minhashes; then BITS bits of all SKETCH, for each 64 of them one word of 64 bits a bit."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(items), 1024):
        part = (items[low : low + 1024][None, :] ^ _XOR[:, None]) * _ODD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    least = mix(least)
    planes = [np.packbits((least >> np.uint64(k) & np.uint64(1)).astype(np.uint8)).view(np.uint64) for k in range(BITS)]
    return np.concatenate([(least[:PLACES] >> np.uint64(48)).astype(np.uint16).view(np.uint8), np.stack(planes, axis=1).ravel().view(np.uint8)])


def _signed_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            size, one, two, signs = [], [], [], []
            for items in shingle_sets(batch.column(1)):
                size.append(len(items))
                one.append(int(items.sum(dtype=np.uint64)))
                two.append(int(mix(items + np.uint64(1)).sum(dtype=np.uint64)))
                signs.append(signature(items) if len(items) else None)
            columns = [
                batch.column(0),
                pa.array(size, pa.int64()),
                pa.array(signed(np.array(one, np.uint64))),
                pa.array(signed(np.array(two, np.uint64))),
                pa.array([x if x is None else x[: 2 * PLACES].tobytes() for x in signs], pa.binary()),
                pa.array([x if x is None else x[2 * PLACES :].view(np.int64) for x in signs], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "sig", "sketch"])


def _bucket_keys(column: pa.Array) -> pa.Array:
    """The keys of each signature: every chunk with every one of its places left out."""
    signs = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    keys = []
    for out in range(CHUNK):
        kept = [p for p in range(CHUNK) if p != out]
        packed = np.zeros(signs.shape[:2], np.uint64)
        for p in kept:
            packed = (packed << np.uint64(16)) | signs[:, :, p]
        index = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out + 1))[None, :]
        keys.append(mix(packed + mix(index)))
    flat = signed(np.concatenate(keys, axis=1).ravel())
    width = CHUNKS * CHUNK
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _apart(x: Column, y: Column) -> Column:
    """In how many places two sketches (arrays of long) differ; unrolled, and short enough to be compiled."""
    differing = [[F.get(x, F.lit(at + k)).bitwiseXOR(F.get(y, F.lit(at + k))) for k in range(BITS)] for at in range(0, SKETCH // 64 * BITS, BITS)]
    return reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, bits)) for bits in differing])


def _set_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            items = [signed(s) for s in shingle_sets(part.column(1))]
            flat = pa.array(np.concatenate(items))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "items"])


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, items): the shingle sets of the documents that ids (doc_id, distinct) names."""
    wanted = texts.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text")
    return wanted.mapInArrow(_set_arrays, f"doc_id {id_type(texts)}, items array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of 0.75 or more."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    sets = materialize(_sets_of(texts, ids))
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    linked = (100 * shared) >= 75 * (F.size("x") + F.size("y") - shared)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b").distinct()


def _thinned(links: DataFrame) -> DataFrame:
    """Of links (a, b), a above b, those that join the same nodes: two ends with one smallest neighbour are joined by it."""
    both = links.unionAll(links.select("b", "a"))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    ends = links.join(least.withColumnRenamed("m", "ma"), "a", "left").join(least.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b", "left")
    return materialize(ends.where("ma <> mb OR b = ma").select("a", "b"))


def _cross_shingles(held: DataFrame) -> DataFrame:
    """(rep, part, item, seen) of held (rep, part, items): the shingles that several components hold, and in how many sets."""
    each = held.select("rep", "part", F.explode("items").alias("item"))
    several = each.groupBy("item").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("seen")).where("lo < hi").select("item", "seen")
    return each.join(several.hint("shuffle_hash"), "item").select("rep", "part", "item", "seen")


def _placed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, part, main, ref) of the buckets that several components meet in; ref belongs to main, the largest of them."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    labels = materialize(labels.join(sizes, "component"))
    placed = buckets.join(labels, buckets["rep"] == labels["node"], "left")
    placed = materialize(placed.select("key", "rep", F.coalesce("component", "rep").alias("part"), F.coalesce("size", F.lit(1)).alias("size")))
    most = F.max(F.struct("size", "part", "rep")).alias("most")
    split = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), most).where("lo < hi")
    split = materialize(split.select("key", F.col("most.part").alias("main"), F.col("most.rep").alias("ref")))
    return materialize(placed.join(split, "key").select("key", "rep", "part", "main", "ref"))


def _open_pairs(rest: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, pa, pb, room): pairs across components that bounds cannot rule out; room: by how much the bound exceeds the need.

    A link of sets of n and m shingles needs 7 * shared >= 3 * (n + m).
    """
    # the smallest doc_id of a component is often what the others copy: a reference beside the one in the bucket
    refs = rest.where("part <> main").select("rep", F.explode(F.array("ref", "main")).alias("ref")).distinct()
    around = rest.select("rep", "part").unionAll(rest.select(F.col("main").alias("rep"), F.col("main").alias("part")))
    around = materialize(around.distinct())
    sets = _sets_of(texts, around.select(F.col("rep").alias("doc_id")))
    held = materialize(sets.join(around, sets["doc_id"] == around["rep"]).select("rep", "part", "items"))
    cross = materialize(_cross_shingles(held))
    bounds = cross.groupBy("rep").agg(F.count("*").alias("c")).join(held.select("rep", "part", F.size("items").alias("n")), "rep")
    bounds = materialize(bounds.where("4 * c >= 3 * n"))  # others are linked with nothing outside their component

    # of the references of a set outside the main component, the one with which it shares most
    met = refs.join(bounds.select("rep", "n", "c"), "rep")
    met = met.join(held.select("rep", F.col("part").alias("pa"), F.col("items").alias("x")), "rep").join(held.select(F.col("rep").alias("ref"), F.col("items").alias("y")), "ref")
    inside = F.size(F.array_intersect("x", "y"))
    met = met.select(F.col("rep").alias("ra"), "pa", F.col("n").alias("na"), F.col("c").alias("ca"), inside.alias("inside"), F.array_except("x", "y").alias("outside"))
    most = met.groupBy("ra").agg(F.max_by(F.struct("pa", "na", "ca", "inside", "outside"), F.col("inside")).alias("m"))
    outer = materialize(most.select("ra", "m.*"))

    sized = F.expr("pa <> pb AND 4 * least(na, nb) >= 3 * greatest(na, nb) AND 3 * (na + nb) <= 7 * least(ca, cb)")
    # pairs that must share shingles outside the reference, `need` at least: of those the rarest has need - 1 after it on
    # both sides, so only pairs that share a shingle that early can qualify, and a common shingle, late in all sets, makes none
    b = bounds.select(F.col("rep").alias("rb"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    rarest = [F.col("seen"), F.col("item")]
    index = cross.select(F.col("rep").alias("rb"), "item", "seen").join(b, "rb").withColumn("at_b", F.row_number().over(Window.partitionBy("rb").orderBy(*rarest)))
    outs = outer.select("ra", F.explode("outside").alias("item")).join(cross.select(F.col("rep").alias("ra"), "item", "seen"), ["ra", "item"])
    outs = outs.withColumn("at_a", F.row_number().over(Window.partitionBy("ra").orderBy(*rarest))).withColumn("out_a", F.count("*").over(Window.partitionBy("ra")))
    outs = outs.drop("seen").join(outer.drop("outside"), "ra")
    need = "CAST(ceil((3 * (na + nb) - 7 * inside) / 7) AS INT)"
    early = F.expr(f"at_a <= out_a - {need} + 1 AND at_b <= cb - {need} + 1")
    short = F.expr("3 * (na + nb) > 7 * inside")  # the others are found below, in their buckets
    by_item = outs.join(index.drop("seen"), "item").where(sized).where(short).where(early).select("ra", "rb", "pa", "pb", "na", "nb", "inside").distinct()
    by_item = by_item.join(outer.select("ra", "outside"), "ra").join(held.select(F.col("rep").alias("rb"), "items"), "rb").withColumn("k", F.size(F.array_intersect("outside", "items")))
    pairs = by_item.withColumn("room", F.expr("7 * (inside + k) - 3 * (na + nb)")).where("room >= 0").select("ra", "rb", "pa", "pb", "room")

    # pairs that need not: the partner is small enough for what is shared inside
    least = rest.join(b.select(F.col("rb").alias("rep"), "nb"), "rep").groupBy("key").agg(F.min("nb").alias("least_n"))
    p = rest.where("part <> main").select("key", "main", F.col("rep").alias("ra")).join(outer.drop("outside"), "ra").join(least, "key")
    p = materialize(p.where("3 * (na + least_n) <= 7 * least(inside, ca)").drop("least_n").join(reps.select(F.col("rep").alias("ra"), F.col("sketch").alias("x")), "ra"))
    q = rest.select("key", F.col("rep").alias("rb")).join(p.select("key").distinct(), "key", "left_semi").join(b, "rb")
    q = q.join(reps.select(F.col("rep").alias("rb"), F.col("sketch").alias("y")), "rb").withColumnRenamed("key", "kb")
    # two sets that meet in many buckets are compared in the first: there b belongs to main, or neither does and the smaller part leads
    p = p.withColumn("keys_a", F.collect_list("key").over(Window.partitionBy("ra")))
    q = q.withColumn("keys_b", F.collect_list("kb").over(Window.partitionBy("rb")))
    near = _apart(F.col("x"), F.col("y")) <= FAR
    first = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    fits = (F.col("key") == F.col("kb")) & F.expr("pb = main OR pa < pb") & sized & F.expr("3 * (na + nb) <= 7 * inside") & near & first
    room = F.expr("7 * least(inside, cb) - 3 * (na + nb)").alias("room")
    pairs = pairs.unionByName(p.join(q, fits).select("ra", "rb", "pa", "pb", room))
    ends = F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"), F.greatest("pa", "pb").alias("pa"), F.least("pa", "pb").alias("pb")
    return pairs.select(*ends, "room").groupBy("a", "b", "pa", "pb").agg(F.max("room").alias("room"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of undirected edges (a, b), with the smallest node that it reaches.

    Large-star and small-star rounds on tables in the shared folder, until the stars stay as they are.
    """

    def stars(pairs: DataFrame, both: bool) -> DataFrame:
        near = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
        least = materialize(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        joined = near.join(least, "a")
        if both:  # larger neighbours of a node hang on its smallest one
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a node and its smaller neighbours hang on the smallest of them
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = out.unionAll(least.select("a", F.col("m").alias("b")))
        return materialize(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(pairs: DataFrame):
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(pairs)
    while before[0]:
        pairs = stars(stars(pairs, True), False)
        now = mark(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    texts = docs.select("doc_id", "text")
    signs = materialize(texts.mapInArrow(_signed_docs, f"doc_id {id_type(texts)}, n long, s1 long, s2 long, sig binary, sketch array<long>"))
    nodes = signs.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(nodes.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))

    # buckets that hold two sets or more, each with a leader of its own choice
    keys = F.arrow_udf(_bucket_keys, "array<long>")
    members = reps.select("rep", F.explode(keys("sig")).alias("key"))
    # in every other bucket the smallest doc_id leads, for copies are often younger than what they copy; the others draw from
    # sixteen orders, so sets that share most buckets meet few leaders
    rank = F.struct(F.when(F.col("key") % 2 == 0, 0).otherwise(F.xxhash64(F.pmod("key", F.lit(32)), "rep")).alias("by"), "rep")
    leaders = materialize(members.groupBy("key").agg(F.min(rank).alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", "lead.rep"))
    buckets = materialize(members.join(leaders.withColumnRenamed("rep", "lead"), "key"))
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    sized = F.expr("4 * least(na, nb) >= 3 * greatest(na, nb)")
    apart = _apart(F.col("x"), F.col("y"))

    starred = buckets.where("rep <> lead").select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b")).distinct()
    tried = materialize(starred.join(a, "a").join(b, "b").where(sized).where(apart <= FAR).select("a", "b").distinct())
    links = materialize(_confirm(tried, texts))

    # what a leader did not join: members of a bucket that are still in different components
    labels = components(_thinned(links))
    others = materialize(_open_pairs(_placed(buckets, labels), reps, texts))
    nearest = others.groupBy("pa", "pb").agg(F.max_by(F.struct("a", "b"), F.struct("room", "a", "b")).alias("pair"))
    nearest = materialize(nearest.select("pair.a", "pair.b"))
    # a component is as well told by its star, which has an edge a member, as by all links found in it
    if not nearest.isEmpty():
        labels = components(labels.unionAll(_confirm(nearest, texts)).toDF("a", "b"))
    la, lb = (labels.select(F.col("node").alias(k), F.col("component").alias(f"l{k}")) for k in ("a", "b"))
    still = others.join(la, "a", "left").join(lb, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
    still = materialize(still.join(nearest, ["a", "b"], "left_anti"))
    if not still.isEmpty():
        labels = components(labels.unionAll(_confirm(still, texts)).toDF("a", "b"))

    place = reps.join(labels, reps["rep"] == labels["node"], "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    place = materialize(place)
    out = signs.join(place, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that are kept: the smallest doc_id of each component."""
    gone = link_documents(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, min(root) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY d.doc_id, n
"""
