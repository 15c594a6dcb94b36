from __future__ import annotations

import base64
import hashlib
import random
import string
import time

import public_tokenizers as P
import pytest
import tiktoken

from tidelens.llm import bpe, token_files
from tidelens.llm.bpe import decode, digests, encode, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    random.seed(9)
    letters = list("aZé日9 ½\n\t  '''sstredvlm!?.  ​\U0001f600é") + ["word", "ung", "ción ", "<|endoftext|>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["", None, " ", "\n\n", "aaaaaaaa" * 100, "ab" * 500, "word " * 3000, "日本語" * 100]
    return list(enumerate(texts))


def test_like_the_library(spark, rows):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    docs = spark.createDataFrame([(*r, 3) for r in rows] + [(None, "x y", 3)], "doc_id long, text string, n_tokens int").repartition(3)
    whole = {r.doc_id: r for r in encode(docs, PATH).collect()}
    short = {r.doc_id: r for r in digests(docs, PATH).collect()}
    assert len(whole) == len(short) == len(rows) + 1
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        assert whole[d].ids == ids and whole[d].n_tokens == short[d].n_tokens == len(ids)
        assert bytes(whole[d].decoded).decode() == (t or "")
        assert short[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def long_words(n):
    random.seed(4)
    return ["a" * n, "ab" * (n // 2), "".join(random.choices("etaoinshrdlu", k=n)), "".join(random.choices(string.ascii_letters, k=n)), "日本語" * (n // 9)]


def test_long_words():
    own, vocabulary = library(PATH), bpe.vocabulary(PATH)
    words = long_words(60_000)
    assert [x.tolist() for x in vocabulary.encode([w.encode() for w in words])] == [own.encode_ordinary(w) for w in words]


def test_a_word_of_a_megabyte():
    word = long_words(1 << 20)[2]
    began = time.perf_counter()
    (got,) = bpe.vocabulary(PATH).encode([word.encode()])
    took = time.perf_counter() - began
    assert got.tolist() == library(PATH).encode_ordinary(word)
    assert took < 120  # about 10 s on a quiet machine


def test_a_merge_that_makes_a_lower_pair(tmp_path):
    """Contracting all pairs of a rank at once would be wrong here: `ab` before `a` makes `aba`, which ranks lower."""
    tokens = [bytes([i]) for i in range(256)] + [b"xx", b"aba", b"ab", b"bab", b"abab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own, vocabulary = library(str(path)), bpe.vocabulary(str(path))
    words = ["ab" * 60, "ab" * 61 + "a", "xabab" * 40, "b" + "ab" * 70 + "xx" * 9]
    assert [x.tolist() for x in vocabulary.encode([w.encode() for w in words])] == [own.encode_ordinary(w) for w in words]


def test_decode(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    back = {r.doc_id: bytes(r.decoded).decode() for r in decode(encode(docs, PATH), PATH).collect()}
    assert back == {d: t or "" for d, t in rows}
    # Ids that token files hold, by the same vocabulary's ranks; the end id is this token.
    ranks = P.path("byte_bpe_50k.tiktoken")
    end = {v: k for k, v in read_ranks(ranks).items()}[2].decode()
    token_files.write_token_files(docs, str(tmp_path / "f"), P.path("byte_bpe_50k.json"), 2)
    ids = token_files.token_ids(token_files.read_token_files(spark, str(tmp_path / "f")))
    assert {r.doc_id: bytes(r.decoded).decode() for r in decode(ids, ranks).collect()} == {d: (t or "") + end for d, t in rows}
    odd = spark.createDataFrame([("a", [1, None, 2], 0), ("b", None, 0), ("c", [], 0), ("a", [1, None, 2], 0)], "key string, ids array<long>, decoded int")
    got = sorted((r.key, None if r.decoded is None else bytes(r.decoded)) for r in decode(odd, ranks, key="key").collect())
    assert got == [("a", b'"#'), ("a", b'"#'), ("b", None), ("c", b"")]
    assert decode(odd.limit(0), ranks, key="key").count() == 0
