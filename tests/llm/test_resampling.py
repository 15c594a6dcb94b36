from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidelens.llm.queries import oracle_sql, op11_importance_resampling
from tidelens.llm.resampling import carry_on, digests, draw, resample, word_crcs

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({ord(c): c.lower() for c in LETTERS}))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5):
    """doc_id -> (n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000))))
    out, eligible = {}, []
    for d, text in docs:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = [len(found), weight, score, None]
        if words >= 20:
            eligible.append((-score, d))
    for rank, (_, d) in enumerate(sorted(eligible)[: percent * len(eligible) // 100], 1):
        out[d][3] = rank
    return {d: tuple(x) for d, x in out.items()}


def corpus():
    random.seed(11)
    words = ["a", "Bb", "ÉÉ", "éé", "日本語", "x1", "9", "Zz-zz", "the", "of", "w" * 70, "ß" * 40, "\0q"]
    docs = [(i, random.choice([" ", "\n", ", "]).join(random.choice(words) for _ in range(random.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(50)] + [(2000, None), (2001, ""), (2002, "- . !"), (2003, "one two"), (2004, "y" * 100_000 + " z" * 5000)]
    target = [random.choice([" ", ". "]).join(random.choice(words[:6]) for _ in range(30)) for _ in range(20)] + [None, ""]
    return docs, target


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_against_brute_force(spark, percent):
    docs, target = corpus()
    texts, wanted = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(x,) for x in target], "text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in digests(texts, wanted, percent).collect()}
    assert got == brute(docs, target, percent)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    found = op11_importance_resampling(spark, sf_dir)
    theirs = con.execute(oracle_sql()["op11_importance_resampling"])
    assert [c[0] for c in theirs.description] == found.columns
    assert sorted(map(str, theirs.fetchall())) == sorted(str(tuple(r)) for r in found.collect())


def test_crcs():
    random.seed(2)
    words = [bytes(random.randrange(256) for _ in range(random.choice([0, 1, 3, 7, 63, 64, 65, 300, 70_000]))) for _ in range(60)]
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    crcs = word_crcs(data, np.cumsum(lengths) - lengths, lengths)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    assert (carry_on(crcs[:-1].copy(), lengths[1:]) ^ crcs[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_ties_and_ranges(spark):
    """Many rows of few scores over a wide range: ranks are those of a plain sort."""
    random.seed(4)
    rows = [(i, 30 if i % 7 else 3, 1, 1, random.choice([-9_000_000, 5, 6, 7, 8, 9, 10**12])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for percent in (1, 30, 71, 99):
        got = {r.doc_id: r["rank"] for r in draw(df, "doc_id", percent).collect()}
        assert len(got) == 2000
        assert {d: x for d, x in got.items() if x} == {r[0]: i for i, r in enumerate(order[: percent * len(order) // 100], 1)}


def test_odd_rows_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text, 1, "a"), *[(7, text, 2, "b")] * 3, (8, None, 3, "c"), *[(i, text + f" {i}", 4, None) for i in range(20, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, n_words string")
    target = spark.createDataFrame([(text,)], "text string")
    found = digests(docs, target, 50).collect()
    assert len(found) == len(rows)
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 22))
    assert [(r.score, r["rank"]) for r in found if r.doc_id is None] == [(None, None)]
    drawn = resample(docs, target, 50)
    assert drawn.columns == ["doc_id", "text", "n_words", "weight", "score", "rank"]
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in found if r["rank"]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    assert digests(none, none).count() == 0 and resample(none, some).count() == 0
    assert [tuple(r) for r in digests(some, none, 100).select("n_features", "rank").collect()] == [(267, 1)]
