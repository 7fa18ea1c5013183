import random

import numpy as np
import sentencepiece
from docloom.llm.pieces import PieceTable, utf8
from docloom.llm.sentencepiece_codec import encode_decode
from hypothesis import given, settings
from hypothesis import strategies as st

_tables = {}


def pair(model):
    if model not in _tables:
        _tables[model] = (PieceTable(model), sentencepiece.SentencePieceProcessor(model_file=model))
    return _tables[model]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeinorst ▁\n.,<0x>"))))
def test_any_text(text):
    import public_tokenizers

    own, library = pair(str(public_tokenizers.path("piece_bpe_32k.model")))
    ids = library.encode(text)
    assert own.encode(text) == ids
    both = [own.bos, *ids, own.eos]
    assert own.decode(both) == library.decode(both)


def test_prose(model):
    own, library = pair(model)
    r = random.Random(1)
    texts = [" ".join("".join(r.choice(["the", "tion", "er", "ß", "lich", "ing", "é", "x", "Q", "12", "'"]) for _ in range(r.randint(1, 5))) for _ in range(80)) for _ in range(60)]
    texts += ["a" * 5000, "  lead", "trail  ", "x" * 17 + " " * 40 + "y", "é" * 300]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)


def test_random_ids(model):
    own, library = pair(model)
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(3, 300) if r.random() < 0.5 else r.randrange(3, 32000) for _ in range(r.randint(1, 12))]
        assert own.decode(ids) == library.decode(ids)
    assert utf8(b"a\xff\xc3\xa9\xc3") == "a�é�"


def test_odd(odd, none, model):
    rows = encode_decode(odd, model).collect()
    assert len(rows) == odd.count() and encode_decode(none, model).count() == 0
    assert all(r.n_tokens == 2 and r.decoded == "" for r in rows if r.doc_id in (3, 4))
    library = pair(model)[1]
    for r, text in zip(sorted(rows, key=lambda r: len(r.ids)), sorted((x.text or "" for x in odd.collect()), key=lambda t: len(library.encode(t)))):
        assert len(np.frombuffer(r.ids, "<u4")) == len(library.encode(text)) + 2
