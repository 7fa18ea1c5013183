import random

from docloom.llm.mixing import mix, mixed_documents, schedule, source_targets


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: (total - sum(full.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    r = random.Random(1)
    for n in (1, 2, 5, 12):
        sizes = {f"s{k}": r.choice([0, 10, 100, 3000, 20000]) + r.randint(1, 9) for k in range(n)} | ({None: 40} if n > 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {x.source: x.target for x in source_targets(df).collect()}
        assert all(abs(got[s] - t) < 1e-6 * max(1, t) for s, t in water(sizes).items())


def test_schedule(spark):
    targets = source_targets(spark.createDataFrame([("a", 5000), ("b", 900), ("c", 3), ("d", 100000)], "source string, size long"))
    slots = schedule(targets, 64).collect()
    quota = {x.sid: x.quota for x in targets.collect()}
    for sid, q in quota.items():
        mine = [x for x in slots if x.sid == sid]
        assert sum(x.tokens for x in mine) == q and all(0 < x.tokens <= 64 for x in mine)
        assert len({(x.epoch, x.block) for x in mine}) == len(mine)
    assert len({x.slot for x in slots}) == len(slots)
    # the largest source comes evenly: its share of every tenth of the schedule is about the same
    order = [x.sid for x in sorted(slots, key=lambda x: x.slot)]
    tenth = len(order) // 10
    shares = [sum(s == 3 for s in order[k * tenth : (k + 1) * tenth]) / tenth for k in range(9)]
    assert max(shares) - min(shares) < 0.1


def test_mix(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 50, 700])), r.choice(["a", "a", "a", "b", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mix(df, block=32)
    taken = m.taken.collect()
    assert len(taken) == 300
    for t in m.targets.collect():
        mine = [x for x in taken if x.source == t.source]
        assert sum(x.taken for x in mine) == t.quota and sum(x.size for x in mine) == t.source_size
        assert all(0 <= x.taken <= 3 * x.size for x in mine)
    again = {x.id: x.taken for x in mix(df.repartition(3), block=32).taken.collect()}
    assert again == {x.id: x.taken for x in taken}
    assert {x.id: x.taken for x in mix(df, block=1000).taken.collect()} == again


def test_documents(spark, odd, none):
    got = [r.doc_id for r in mixed_documents(odd).collect()]
    taken = mix(odd).taken.collect()
    assert len(taken) == odd.count() and all(x.taken == 0 for x in taken if x.size == 0)
    assert len(got) == sum(-(-x.taken // x.size) for x in taken if x.taken)
    assert mixed_documents(odd).columns == odd.columns
    assert mix(none).taken.count() == 0 and mixed_documents(none).count() == 0


def test_order(spark):
    """The mix comes in the order of its slots, and every stretch of it has the sources in their shares."""
    r = random.Random(4)
    rows = [(k, " ".join(["w"] * r.choice([5, 20, 60])), r.choice(["a", "a", "a", "b", "c"])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    m = mix(df, block=64)
    slot = {x.id: x.slot for x in m.taken.collect()}
    got = [x.doc_id for x in mixed_documents(df, block=64).collect()]
    at = [slot[k] for k in got]
    assert at == sorted(at) and None not in at and max(at) < m.slots
    assert [x.doc_id for x in mixed_documents(df.repartition(3), block=64).collect()] == got
    source = {k: s for k, _, s in rows}
    # slots, and with them words, are dealt evenly; documents follow them
    schedule = [x.sid for x in sorted(m.schedule.collect(), key=lambda x: x.slot)]
    for part in (schedule[: len(schedule) // 2], schedule[len(schedule) // 4 : len(schedule) // 2]):
        assert all(abs(part.count(s) / len(part) - schedule.count(s) / len(schedule)) < 0.03 for s in range(3))
    half = [source[k] for k in got[: len(got) // 2]]
    assert all(abs(half.count(s) / len(half) - sum(source[k] == s for k in got) / len(got)) < 0.1 for s in "abc")
