import random

from docloom.llm.passages import bands, repeated_passages, without
from pyspark.sql import functions as F


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_planted(spark):
    r = random.Random(1)
    inline, whole, near = prose(r, 60), prose(r, 55), prose(r, 70).split()
    docs = [(k, prose(r, 120) + "\n" + prose(r, 30)) for k in range(40)]
    for k in (3, 9, 17):
        a = docs[k][1].split(" ")
        docs[k] = (k, " ".join(a[:50]) + " " + inline + " " + " ".join(a[50:]))
    for k in (5, 6):
        docs[k] = (k, docs[k][1] + "\n" + whole)
    for k in (20, 21):
        w = list(near)
        w[k] = "changed"
        docs[k] = (k, " ".join(w) + "\n" + docs[k][1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = repeated_passages(df)
    got = {x.id: x for x in found.collect()}
    assert sorted(k for k, x in got.items() if x.n_removed) == [6, 9, 17, 21]
    texts = dict(docs)
    cut = lambda k: [texts[k][s.start : s.end] for s in got[k].spans]
    assert cut(6) == [whole] and cut(21)[0].split()[0] == near[0] and len(cut(21)[0].split()) == 70
    assert all(len(cut(k)) == 1 and cut(k)[0] in inline for k in (9, 17))
    clean = found.join(df, F.col("id") == F.col("doc_id")).select("id", "n_removed", without(F.col("text"), F.col("spans")).alias("t")).collect()
    assert all(len(x.t) == len(texts[x.id]) - x.n_removed for x in clean)
    assert bands(0.8, 0.999) >= bands(0.9, 0.999)


def test_inline_to_the_last_word(spark):
    """Of planted passages inside lines no word stays, whatever their cuts, at the ends of lines and beside other white space; what stands around them does."""
    r = random.Random(2)
    docs, planted = [], {}
    for k in range(300):
        passage = prose(r, r.choice([51, 60, 100]))
        for j in range(2):
            a, b = (prose(r, n) for n in r.choice([(0, 40), (3, 40), (40, 40), (40, 3), (40, 0)]))
            inside = passage.replace(" ", "  ", 3) if j else passage
            docs.append((2 * k + j, " ".join(x for x in (a, inside, b) if x)))
            if j:
                planted[2 * k + j] = inside
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {x.id: x.spans for x in repeated_passages(df).collect()}
    texts = dict(docs)
    for k, inside in planted.items():
        assert [texts[k][s.start : s.end] for s in got[k]] == [inside]
    assert not any(got[k] for k in range(0, 600, 2))


def by_all_pairs(docs, least_words=20, least_chars=110):
    """Spans that go, from comparing every pair of paragraphs; for texts without lines of over 40 words."""
    lines = []
    for k, text in docs:
        at = 0
        for line in text.split("\n"):
            if line.split():
                lead = len(line) - len(line.lstrip())
                lines.append((k, at + lead, at + len(line.rstrip()), line.split()))
            at += len(line) + 1
    lines.sort(key=lambda x: x[:2])
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 and (len(w) >= least_words or b - a >= least_chars) else set() for _, a, b, w in lines]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if lines[i][3] == lines[j][3] or grams[i] and grams[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    spans: dict = {k: [] for k, _ in docs}
    for x, (k, a, b, _) in zip(label, lines):
        if lines[x][:2] != (k, a):
            if spans[k] and a <= spans[k][-1][1] + 2:
                spans[k][-1] = (spans[k][-1][0], b)
            else:
                spans[k].append((a, b))
    return {k: [x for x in v if x[1] - x[0] >= least_chars] for k, v in spans.items()}


def test_all_paragraph_pairs(spark):
    r = random.Random(4)
    pool = [prose(r, r.choice([3, 6, 14, 19, 25, 40])) for _ in range(60)]
    docs = []
    for k in range(90):
        lines = []
        for _ in range(r.randint(0, 7)):
            w = r.choice(pool).split()
            if r.random() < 0.5:
                w[r.choice([0, -1, r.randrange(len(w))])] = prose(r, 1)
            lines.append(r.choice(["", " "]) + " ".join(w) + r.choice(["", "  "]) if r.random() < 0.8 else prose(r, 30))
        docs.append((k, "\n".join(lines)))
    expected = by_all_pairs(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for bucket, group in ((1024, 1024), (8, 4)):  # 8 and 4: hot buckets and groups meet their least set first
        got = {x.id: [(y.start, y.end) for y in x.spans] for x in repeated_passages(df, bucket=bucket, group=group).collect()}
        assert got == expected
    assert sum(map(bool, expected.values())) > 30


def test_odd(odd, none):
    rows = repeated_passages(odd, least_words=5, least_chars=20).collect()
    assert len(rows) == odd.count() and repeated_passages(none).count() == 0
    assert sorted(r.n_removed > 0 for r in rows if r.id in (1, 2)) == [False, True, True]
    assert all(r.n_removed == 0 for r in rows if r.id in (3, 4, 5, 7, 8, None))
