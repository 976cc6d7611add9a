import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from newsfold.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


MERGES = bpe.Merges(open(PATH, "rb").read(), P.PATTERN, 1000)


def ids(text):
    packed = MERGES.encode([text])[0]
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_as_the_library(library, text):
    assert ids(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "\x1c\x1d x\x85y", "  \n\n x", "don't WE'LL 'S", "é" * 999, "１２３ ²", "\u3000x", "日本語" * 50])
def test_hard_texts(library, text):
    assert ids(text) == library.encode_ordinary(text)
    assert MERGES.decode(MERGES.encode([text])[0]) == text.encode()


def test_random_bytes_of_all_planes(library):
    draw = random.Random(4)
    text = "".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0xD7FF), draw.randrange(0xE000, 0x10FFFF)])) for _ in range(20_000))
    assert ids(text) == library.encode_ordinary(text)


def test_frame(spark, library):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, None), (3, "", "y"), (None, "zz " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string")
    got = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert len(got) == 5 and all(bytes(r.decoded).decode() == (r.text or "") for r in got)
    assert {r.token for r in got} == {"x", None, "y", "z"}
    told = bpe.digests(df, PATH, P.PATTERN).where("doc_id = 1").first()
    assert told.n_tokens == len(library.encode_ordinary("one two"))
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
    assert [bytes(r.decoded) for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()][0] == b"one two"
    with pytest.raises(ValueError):
        bpe.round_trip(df.withColumnRenamed("token", "ids_le"), PATH, P.PATTERN)
