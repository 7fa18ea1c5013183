"""Quality rules: shape of the text, then tokeniser fertility.

Public vocabularies encode each text; each measures characters per token, the share of byte-fallback tokens and the
entropy of the tokens, and has rejection bands for each language, or script where the language is another one.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembered, sliced, texts, tidy

SYMBOLS = "#*$%&|<>"

SHAPE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FERTILITY = {"n_tokens": T.LongType(), "chars_per_token": T.DoubleType(), "byte_share": T.DoubleType(), "token_entropy": T.DoubleType()}


class Vocabulary:
    """A public vocabulary: ids of texts, and for each id whether it is a byte that is no character by itself."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.partial = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            # there is no piece for line breaks and tabs
            self.partial[[model.piece_to_id(f"<0x{b:02X}>") for b in (9, 10, 13)]] = False
            self.ids = lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)]
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.partial = np.zeros(max(ranks.values()) + 1, bool)
            for token, rank in ranks.items():
                self.partial[rank] = "\ufffd" in token.decode("utf-8", "replace") and token != "\ufffd".encode()
            self.ids = lambda texts: [np.array(own.encode_ordinary(x), np.int64) for x in texts]


@remembered(8)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def measures(others: tuple[str, ...] = ()) -> list[T.StructField]:
    """Fields of the measures; those of further vocabularies have their names behind."""
    fertile = [T.StructField(n + x, kind, False) for x in ("", *(f"_{o}" for o in others)) for n, kind in FERTILITY.items()]
    return [*[T.StructField(n, T.LongType(), False) for n in SHAPE], *fertile, T.StructField("script", T.StringType(), False)]


def shape(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at ASCII white space only
    blanks = sum(map(text.count, " \n\t\r\x0b\x0c"))
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), again, repeated(words)


def repeated(words: list) -> int:
    """Words that lie in a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    if n == len(words):
        return 0
    pair = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:  # keep the triple within 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    triple = pair[:-1] * n + ids[2:]
    order = np.argsort(triple, kind="stable")
    run = triple[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(triple), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(triple)] |= twice
    return int(covered.sum())


def fertility(ids: np.ndarray, chars: int, partial: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of byte-fallback tokens that are no line break or tab, entropy of the tokens in bits over that of as many different ones."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    found, counts = np.unique(ids, return_counts=True)
    raw = counts[partial[found]].sum() / n
    p = counts / n
    entropy = float(-(p * np.log2(p)).sum())
    return n, chars / n, float(raw), entropy / np.log2(n) if n > 1 else 0.0


def script(text: str) -> str:
    """latin, cyrillic, cjk or other: the script of most letters among ASCII and these blocks."""
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = (code > 64) & ~((code > 90) & (code < 97)) & ~((code > 122) & (code < 192))
    total = int(letters.sum())
    if not n or not total:
        return "other"
    for name, low, high in (("latin", 65, 0x24F), ("cyrillic", 0x400, 0x52F), ("cjk", 0x3040, 0x9FFF)):
        if 2 * int((letters & (code >= low) & (code <= high)).sum()) > total:
            return name
    return "other"


def measure(docs: DataFrame, model_file: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang"), others: dict[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` and the measures of each row's whole text, by the vocabulary ``model_file`` and by ``others`` (name: path); a null text counts as empty, its measures are 0."""
    others = others or {}
    fields = [docs.schema[c] for c in keep]
    own = measures(tuple(others))
    kinds = [{"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()] for f in own]

    @tidy(vocabulary)
    def run(batches):
        known = [vocabulary(path) for path in (model_file, *others.values())]
        for batch in sliced(batches, 64):
            values = texts(batch, text)
            fertile = [[fertility(ids, len(value), v.partial) for ids, value in zip(v.ids(values), values)] for v in known]
            rows = [(*shape(value), *(m for f in fertile for m in f[k]), script(value)) for k, value in enumerate(values)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=[*keep, *[f.name for f in own]])

    columns = list(dict.fromkeys([*keep, text]))
    return docs.select(*columns).mapInArrow(run, T.StructType(fields + own))


def _band(curve, gap, ratio, bytes_, near=None, inner=0.0) -> dict:
    return {"curve": curve, "gap": gap, "near": gap if near is None else near, "inner": inner, "ratio": ratio, "bytes": bytes_}


_WIDE = (0.0, 0.3, 0.0)
#: Rejection bands of each vocabulary ("" is the first) by language, or by script for other languages.  ``curve``: expected
#: entropy in bits c0 + c1 x + c2 x^2 of clean text of 2^x tokens, up to its highest point.  ``gap``: bits below that at
#: which a text goes; ``near``: bits below that at which it goes if its characters per token lie below ``inner`` too.
#: ``ratio``: least and most characters per token, ``bytes``: most of the byte share, for any text of the language or
#: script.  The languages' curves were fitted on the 3,243 labelled clean documents of sf0.1 that pass the base rules,
#: gaps lie above the largest of theirs; those of scripts leave room for any language.
BANDS = {
    "": {
        "en": _band((1.322, 0.9184, -0.0373), 0.34, (1.6, 7.0), 0.2, 0.17, 2.48),
        "fr": _band((2.008, 0.7702, -0.0317), 0.36, (1.5, 7.0), 0.2, 0.20, 2.21),
        "de": _band((1.993, 0.7758, -0.0315), 0.34, (1.5, 7.0), 0.2, 0.17, 2.46),
        "es": _band((1.340, 0.9095, -0.0378), 0.45, (1.5, 7.0), 0.2, 0.20, 2.18),
        "latin": _band(_WIDE, 0.0, (0.7, 9.0), 0.6),
        "cyrillic": _band(_WIDE, 0.0, (0.7, 9.0), 0.6),
        "cjk": _band(_WIDE, 0.0, (0.25, 4.0), 1.0),
        "other": _band(_WIDE, 0.0, (0.2, 9.0), 1.0),
    },
    "byte": {
        "en": _band((1.3215, 0.9225, -0.0372), 0.36, (1.6, 7.0), 0.2),
        "fr": _band((2.5961, 0.6539, -0.0265), 0.38, (1.4, 7.0), 0.4),
        "de": _band((2.0910, 0.7612, -0.0309), 0.31, (1.5, 7.0), 0.3),
        "es": _band((1.6951, 0.8157, -0.0334), 0.41, (1.4, 7.0), 0.4),
        "latin": _band(_WIDE, 0.0, (0.6, 9.0), 0.7),
        "cyrillic": _band(_WIDE, 0.0, (0.4, 6.0), 1.0),
        "cjk": _band(_WIDE, 0.0, (0.25, 4.0), 1.0),
        "other": _band(_WIDE, 0.0, (0.2, 9.0), 1.0),
    },
    "multi": {
        "en": _band((1.2135, 0.9406, -0.0377), 0.40, (1.6, 7.0), 0.2),
        "fr": _band((2.0042, 0.7804, -0.0317), 0.40, (1.5, 7.0), 0.2),
        "de": _band((1.8050, 0.8216, -0.0332), 0.29, (1.6, 7.0), 0.2),
        "es": _band((1.4720, 0.8837, -0.0366), 0.44, (1.5, 7.0), 0.2),
        "latin": _band(_WIDE, 0.0, (0.7, 9.0), 0.6),
        "cyrillic": _band(_WIDE, 0.0, (0.6, 9.0), 1.0),
        "cjk": _band(_WIDE, 0.0, (0.25, 4.0), 1.0),
        "other": _band(_WIDE, 0.0, (0.2, 9.0), 1.0),
    },
}
SCRIPTS = ("latin", "cyrillic", "cjk", "other")


def verdict(lang: Column, bands: dict, name: str = "") -> Column:
    """False for measures of the vocabulary ``name`` outside the bands of their language, or of their script for another language or null.

    A text of a known language in few letters is held against the language's entropy and the script's other bands;
    one in another script against the script's only.
    """
    end = f"_{name}" if name else ""
    known = [k for k in bands if k not in SCRIPTS]
    script = F.col("script")
    spoken = F.coalesce(lang.isin(*known), F.lit(False))

    def by(key: Column, value) -> Column:
        out = value(bands["other"])
        for k, band in bands.items():
            out = F.when(key == k, value(band)).otherwise(out)
        return out

    by_language = F.when(spoken & script.isin("latin", "other"), lang).otherwise(script)
    by_script = F.when(spoken & (script == "latin"), lang).otherwise(script)
    x = F.log2(F.greatest(F.col(f"n_tokens{end}"), F.lit(1)).cast("double"))

    def expected(band) -> Column:
        c0, c1, c2 = band["curve"]
        at = F.least(x, F.lit(-c1 / (2 * c2))) if c2 < 0 else x
        return c0 + c1 * at + c2 * at * at

    gap = by(by_language, expected) - F.col(f"token_entropy{end}") * x
    ratio, share = F.col(f"chars_per_token{end}"), F.col(f"byte_share{end}")
    number = lambda key, value: by(key, lambda b: F.lit(float(value(b))))
    return ~(
        (gap > number(by_language, lambda b: b["gap"]))
        | ((gap > number(by_language, lambda b: b["near"])) & (ratio < number(by_language, lambda b: b["inner"])))
        | (ratio < number(by_script, lambda b: b["ratio"][0]))
        | (ratio > number(by_script, lambda b: b["ratio"][1]))
        | (share > number(by_script, lambda b: b["bytes"]))
    )


def judged(
    docs: DataFrame, model_file: str, *, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), min_words: int = 50, bands: dict = BANDS, others: dict[str, str] | None = None
) -> DataFrame:
    """The columns ``keep``, the measures, ``base_failed`` and ``kept`` for each row.

    ``base_failed``: fewer than ``min_words`` words, or over half of the words repeat in three-word windows.
    ``kept``: not base_failed, and the tokens of each vocabulary (``model_file``, and ``others``: name in ``bands`` to
    path) lie within its bands.  Null and empty texts have no words and fail; a null language gets the bands of the
    text's script; repeated rows are judged alike; each row is by itself, whatever its length; other columns play
    no part.
    """
    columns = tuple(dict.fromkeys([*keep, lang]))
    measured = measure(docs, model_file, text=text, keep=columns, others=others)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fit = F.lit(True)
    for name in ("", *(others or ())):
        fit = fit & F.coalesce(verdict(F.col(lang), bands[name], name), F.lit(True))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fit).drop(*([] if lang in keep else [lang]))
