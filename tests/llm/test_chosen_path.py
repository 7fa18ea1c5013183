import random

from docloom.llm.chosen_path import near_duplicates, one_of_each, repeats
from docloom.llm.similar import components, packed, roots, short, stream, unpacked
import numpy as np


def grams(text):
    w = text.encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def spec(docs):
    """(class, links) of each place by comparing all pairs."""
    s = [grams(t or "") for _, t in docs]
    links = [[j for j in range(len(s)) if j != i and s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])] for i in range(len(s))]
    out, seen = [None] * len(s), set()
    for i in range(len(s)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        ids = [docs[j][0] for j in group if docs[j][0] is not None]
        for j in group:
            out[j] = (min(ids, default=None), len(links[j]))
    return out


def corpus(r, n):
    docs = []
    for k in range(n):
        if docs and r.random() < 0.6:
            w = r.choice(docs[-40:])[1].split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = f"n{r.random()}"
            docs.append((k, " ".join(w)))
        else:
            docs.append((k, " ".join(f"v{r.randrange(3000)}" for _ in range(r.choice([1, 3, 8, 60, 120])))))
    return docs


def test_all_pairs(spark):
    docs = corpus(random.Random(1), 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for bucket in (1024, 8):  # 8: crowded buckets are split, then dealt out in blocks
        got = {r.id: (r.class_id, r.n_links) for r in near_duplicates(df, bucket=bucket).collect()}
        assert got == {i: x for (i, _), x in zip(docs, spec(docs))}


def test_hot_group(spark):
    """A group of copies with some edits each, far beyond what one block holds, has the links that all pairs tell; few sets of it are compared."""
    r = random.Random(3)
    template = [f"v{r.randrange(3000)}" for _ in range(300)]
    docs = corpus(r, 60)
    for k in range(60, 260):
        w = list(template)
        for _ in range(r.choice([0, 1, 1, 2, 3, 9])):
            w[r.randrange(len(w))] = f"n{r.random()}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.id: (x.class_id, x.n_links) for x in near_duplicates(df, bucket=16, group=8).collect()}
    assert got == {i: x for (i, _), x in zip(docs, spec(docs))}


def test_recall(spark):
    """On the whole table of sf0.01: classes and links of all pairs that share a shingle."""
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    s = [grams(t or "") for _, t in docs]
    where: dict = {}
    for k, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(k)
    pairs = {(i, j) for ks in where.values() if len(ks) > 1 for i in ks for j in ks if i < j}
    links = {(i, j) for i, j in pairs if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])}
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert links and sum(x.n_links for x in got.collect()) >= 0.999 * 2 * len(links)


def test_odd(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((r.id, r.class_id, r.n_links) for r in near_duplicates(odd).collect()), key=key)
    assert got == sorted(((i, *(x if grams(t or "") else (i, 0))) for (i, t), x in zip(docs, spec(docs))), key=key)
    kept = one_of_each(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "6", "7", "8", "8", "None", "None"]
    assert near_duplicates(none).count() == 0 and one_of_each(none).count() == 0


def test_parts(spark):
    assert repeats(0.8, 0.99) < repeats(0.8, 0.9999)
    s = short(stream(3, 50))
    assert (unpacked(packed(s)) == s).all()
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    label = roots(60, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.uid: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {n: int(label[n]) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
