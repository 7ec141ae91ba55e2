"""Near copies beside brute force where many sets share passages, fall just short of the threshold or just reach it."""

import random

from tessella.llm import near_dedup

DOC = "doc_id long, text string"
rng = random.Random(21)


def words(n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links += 1
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))], links


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), DOC)
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.link_documents(rows).collect()}
    return [out[i] for i in range(len(texts))]


def test_shared_passages_and_groups_short_of_the_threshold(spark):
    passage, base = words(60), words(120)
    texts = []
    for _ in range(60):  # a large group around one text, of which many members fall short of each other
        w = list(base)
        for at in rng.sample(range(len(w)), rng.choice([1, 2, 3, 4, 5])):
            w[at] = words(1)[0]
        texts.append(" ".join(w))
    texts += [" ".join(words(25) + passage + words(25)) for _ in range(40)]  # one passage in many unlike texts
    for _ in range(20):  # pairs that share a passage and are linked by what is their own, or just not
        own = words(30)
        texts += [" ".join(own + passage), " ".join(own[: rng.randrange(16, 30)] + passage)]
    for _ in range(20):  # copies of group members, cut short
        w = rng.choice(texts[:60]).split()
        texts.append(" ".join(w[: rng.randrange(88, 120)]))
    rng.shuffle(texts)
    want, links = classes(texts)
    assert links > 300 and len(set(want)) > 60
    assert found(spark, texts) == want


def test_every_pair_just_above_the_threshold_is_linked(spark):
    texts = []
    while len(texts) < 600:
        w = words(rng.randrange(60, 200))
        v = w[: round(len(w) * rng.uniform(0.74, 0.79))]
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        if 0.75 <= len(a & b) / len(a | b) <= 0.78:
            texts += [" ".join(w), " ".join(v)]
    want, links = classes(texts)
    assert links == 300
    assert found(spark, texts) == want  # 300 of 300, and nothing else


def test_one_very_long_document_and_its_copies(spark):
    long = words(200_000)
    texts = [" ".join(long), " ".join(long[:160_000]), " ".join(long[:140_000]), "a b c"]
    assert found(spark, texts) == [0, 0, 0, 3]  # the third reaches the first through the second


def test_links_that_say_nothing_new_are_left_out_before_components_are_found(spark):
    links = [(a, b) for a in range(30) for b in range(a)] + [(41, 40), (42, 41), (43, 42), (43, 41)]
    thin = near_dedup._thinned(spark.createDataFrame(links, "a long, b long"))
    assert thin.count() == 29 + 3  # one link a member, also where all are linked
    found = {r["node"]: r["component"] for r in near_dedup.components(thin).collect()}
    assert found == {n: 0 for n in range(1, 30)} | {n: 40 for n in (41, 42, 43)}
