import random
import re

from docloom.llm.lines import dedup_lines
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


def spec(docs, run):
    """Runs of lines seen before, in the order of ids, without overlap with their first place."""
    seen, out = {}, {}
    for i, text in sorted(docs):
        full = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")) for k, x in enumerate(text.split("\n"))]
        full = [(k, x) for k, x in full if x]
        gone = set()
        for j in range(len(full) - run + 1):
            w = tuple(x for _, x in full[j : j + run])
            if w not in seen:
                seen[w] = (i, j)
            elif seen[w][0] != i or seen[w][1] + run <= j:
                gone |= {k for k, _ in full[j : j + run]}
        out[i] = sorted(gone)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6), run=st.integers(1, 4))
def test_against_plain_search(spark, seed, run):
    r = random.Random(seed)
    docs = [(k, "\n".join(r.choice(["a", "b", " a ", "c c", "c  c", "", "d", f"u{r.random()}"]) for _ in range(r.randint(0, 25)))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dedup_lines(df, run=run).collect()
    assert {x.doc_id: list(x.removed) for x in got} == spec(docs, run)
    texts = dict(docs)
    assert all(x.text == "\n".join(line for k, line in enumerate(texts[x.doc_id].split("\n")) if k not in x.removed) for x in got)


def with_long_lines(docs, run, words):
    """Beside runs of lines, single lines of so many words that were seen before."""
    gone, seen = spec(docs, run), set()
    for i, text in sorted(docs):
        for k, x in enumerate(text.split("\n")):
            w = tuple(x.split())
            if len(w) >= words:
                gone[i] = sorted({*gone[i], k}) if w in seen else gone[i]
                seen.add(w)
    return gone


def test_long_lines(spark):
    r = random.Random(3)
    long = [" ".join(f"{k}{j}" for j in range(50)) for k in "abc"]
    docs = [(k, "\n".join(r.choice(["a", "b", *long, long[0].replace(" ", "  "), long[1][:-4], f"u{r.random()}", f"v{r.random()}"]) for _ in range(r.randint(1, 6)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for run in (2, 3):
        got = {x.doc_id: list(x.removed) for x in dedup_lines(df, run=run, words=50).collect()}
        assert got == with_long_lines(docs, run, 50) != spec(docs, run)
    twice = spark.createDataFrame([(1, long[0])] * 2 + [(2, "short")] * 2, "doc_id long, text string")
    assert sorted((x.doc_id, list(x.removed)) for x in dedup_lines(twice, words=50).collect()) == [(1, []), (1, [0]), (2, []), (2, [])]


def test_odd(odd, none):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count() and dedup_lines(none).count() == 0
    first, second = sorted((r for r in rows if r.doc_id == 1), key=lambda r: len(r.removed))
    assert list(first.removed) == [] and list(second.removed) == [0, 1, 2] and second.text == ""
    assert next(r for r in rows if r.doc_id == 2).text == "" and next(r for r in rows if r.doc_id == 3).text is None
    assert next(r for r in rows if r.doc_id == 5).text == " \n\t\n "
