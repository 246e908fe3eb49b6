import random

import numpy as np
import pytest

from tessera.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder.from_file(PATH)


@pytest.fixture(scope="module")
def reference(enc):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_equals_the_reference(enc, reference):
    r = random.Random(1)
    alphabet = "abc ABC  éãç 123 漢字 \n\t.,;-_'s<|>😀​"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(300)]
    texts += ["a" * 3000, " " * 2500, "ab" * 2000, "<|endoftext|>", "isn't it's WE'RE", "漢" * 900]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t)


def test_long_and_short_pieces_agree(enc):
    for p in (b"x" * 700, "çãé".encode() * 150, b"0123456789abcdef" * 40):
        assert enc._merge([p])[0] == enc._merge_long(p)


def test_pair_table(enc):
    t = enc.table
    a, b = enc.ranks[b"t"], enc.ranks[b"h"]
    assert t.get(np.array([a, -1]), np.array([b, b])).tolist() == [enc.ranks[b"th"], 2**62]


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df, PATH).collect())
    assert [k for k, _ in got] == [1, 1, 2, 3] and len(got[0][1]) == 2 and got[2][1] == [] and got[3][1] == []
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0
