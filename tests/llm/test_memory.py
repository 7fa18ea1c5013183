"""What a Python worker holds: in a process of its own, with the functions that the operators give to mapInArrow."""

import os
import subprocess
import sys

import pytest

from tests.conftest import ROOT

WORKER = r"""
import random, re, sys
import pyarrow as pa
import public_tokenizers
from docloom.llm.quality import measure
from docloom.llm.sentencepiece_codec import encode_decode
from pyspark.sql import types as T

class Frame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

def batches(seed, n=3, rows=2000):
    r = random.Random(seed)
    for k in range(n):
        words = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 12))) for _ in range(60_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([" ".join(r.choices(words, k=400)) for _ in range(rows)]), pa.array(["en"] * rows)], names=["doc_id", "text", "lang"])

model = str(public_tokenizers.path("piece_bpe_32k.model"))
others = {"multi": str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))}
start = held()
rows = sum(x.num_rows for x in measure(Frame(), model, others=others)(batches(1, 1)))
quality, most = held() - start, 0
for seed in (2, 3):
    for x in encode_decode(Frame(), model)(batches(seed)):
        rows, most = rows + x.num_rows, max(most, held() - start)
print(rows, quality, most, held() - start)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_worker():
    """Quality's vocabularies are gone when texts are encoded, the memory of words is bounded, and a task ends without free memory."""
    said = subprocess.run([sys.executable, "-c", WORKER], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True).stdout
    rows, quality, most, left = map(int, said.split())
    assert rows == 2000 + 2 * 6000
    # before: 67, 219, 219 MB
    assert most < 180 and left < 165, (quality, most, left)
