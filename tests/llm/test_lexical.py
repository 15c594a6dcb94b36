from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidelens.llm.lexical import add, search, slices, top_places
from tidelens.llm.queries import op12_lexical_search, oracle_sql

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of all."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, own, _ in held for t in own)
    out = []
    for item, text in items:
        scores = []
        for d, own, length in held:
            m = 100 - 75 + (75 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * own[t]) // (1000 * own[t] + 8 * m)) for t in terms(text) if t in own)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus():
    random.seed(12)
    words = ["a", "Bb", "ÉÉ", "éé", "日本語", "x1", "9", "Zz-zz", "the", "of", "w" * 70, "rare1", "rare2"]
    weights = [5, 5, 3, 3, 2, 2, 1, 3, 30, 30, 1, 0.1, 0.1]
    draw = lambda n: random.choice([" ", "\n", ", "]).join(random.choices(words, weights, k=n))
    docs = [(i * 37 % 1000, draw(random.randint(0, 80))) for i in range(500)]
    docs += [(2000 + i, docs[5][1]) for i in range(40)] + [(3000, None), (3001, ""), (3002, "- . !"), (3003, "the " * 50_000), (None, draw(30)), (None, None)]
    items = [(i, draw(random.randint(1, 30))) for i in range(40)] + [(100, None), (101, "nowhere"), (102, "?"), (103, "the The THE of " * 40), (104, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("k, block, pairs", [(10, 16_384, 100_000), (3, 64, 100), (1000, 100, 60)])
def test_against_brute_force(spark, k, block, pairs):
    docs, items = corpus()
    found = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), k, block, pairs)
    assert sorted(map(tuple, found.collect())) == brute(docs, items, k)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    theirs = con.execute(oracle_sql()["op12_lexical_search"])
    found = op12_lexical_search(spark, sf_dir)
    assert [c[0] for c in theirs.description] == found.columns
    assert sorted(theirs.fetchall()) == sorted(map(tuple, found.collect()))


def test_slices_add_like_numbers():
    rng = np.random.default_rng(1)
    for _ in range(20):
        total, sums = [], np.zeros(192, np.int64)
        for _ in range(rng.integers(1, 12)):
            places = np.sort(rng.choice(192, rng.integers(0, 150), replace=False))
            impacts, shift = rng.integers(0, 1 << int(rng.integers(1, 36)), len(places)), int(rng.integers(0, 4))
            add(total, slices(places, impacts, 192), shift)
            sums[places] += impacts << shift
        for k in (1, 5, 100, 500):
            found, values = top_places(total, k)
            order = [i for i in np.lexsort((np.arange(192), -sums)) if sums[i] > 0][:k]
            assert sorted(found.tolist()) == sorted(order) and (values == sums[found]).all()


def test_repeated_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(5, "red fox", 1), (5, "red fox", 2), (3, "red fox", 3), (9, "hen", 4)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(1, "fox", "x"), (1, "red", "y"), (None, "hen", None)], "item_id long, text string, rank string")
    found = sorted((r.item_id or 0, r["rank"], r.doc_id) for r in search(docs, items).collect())
    assert found == [(0, 1, 9), (1, 1, 3), (1, 2, 5), (1, 3, 5)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert search(none, items).count() == 0
    assert search(spark.createDataFrame([(1, "fox")], "doc_id long, text string"), items.limit(0)).count() == 0
