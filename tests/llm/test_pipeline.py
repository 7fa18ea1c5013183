"""Stages of the pipeline, each against a plain version on its own input."""

import corpus_pipeline as cp
import pytest
from docloom.llm.mixing import mix

from tests.llm.test_chosen_path import spec as classes
from tests.llm.test_lines import spec as lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        df = stage(spark, out[-1], SF).cache()
        if k < len(cp.STAGES) - 1:
            assert df.columns == docs.columns and df.schema.simpleString() == docs.schema.simpleString()
        out.append(df)
    return out


def test_quality(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    good = [r.doc_id for r in steps[0].collect() if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 50]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and all(labels.get(d) != 0 for d in kept)


def test_lines(steps):
    before, after = ({r.doc_id: r for r in x.collect()} for x in steps[1:3])
    gone = lines([(d, r.text) for d, r in before.items()], 2)
    assert {d: r.text for d, r in after.items()} == {d: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[d]) for d, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    keep = sorted({c for (d, t), (c, _) in zip(rows, classes(rows)) if t.split()} | {d for d, t in rows if not t.split()})
    assert sorted(r.doc_id for r in steps[3].collect()) == keep


def test_mix(steps):
    taken = mix(steps[3]).taken.collect()
    assert sorted(r.doc_id for r in steps[4].collect()) == sorted(x.id for x in taken for _ in range(-(-x.taken // x.size) if x.taken else 0))


def test_encoding(steps):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for r in steps[5].collect():
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in library.encode(r.text, add_bos=True, add_eos=True))


def test_decoding(spark, odd):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    plain = spark.createDataFrame([(90, "  two  spaces ▁ and\ta\nline é 漢 🙂 ", "en", "a", 30)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = cp.sentencepiece(spark, odd.select(*cp.COLUMNS).unionByName(plain), SF).collect()
    assert len(rows) == odd.count() + 1 and any(r.decoded not in ("", r.text) for r in rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids)


def test_odd(spark, odd, none):
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        stage(spark, odd, SF).count()
