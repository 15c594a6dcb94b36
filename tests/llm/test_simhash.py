from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidelens.llm.simhash import MANY_TASKS, TASK_CODES, _trie_links, components, deal_tasks, keep_one, links, near_components, trie_labels


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= budget:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def near_codes(n=400, seed=5):
    random.seed(seed)
    codes = [0, (1 << 64) - 1]
    while len(codes) < n:
        c = random.choice(codes) if random.random() < 0.6 else random.getrandbits(64)
        for _ in range(random.randint(0, 5)):
            c ^= 1 << random.randrange(64)
        codes.append(c)
    return sorted(set(codes))


def test_trie_alone():
    codes = near_codes(600)
    want = brute_components(dict(enumerate(codes)))
    got = trie_labels(np.array(codes, np.uint64), 0)
    assert {i: int(x) for i, x in enumerate(got)} == want
    assert (trie_labels(np.array(codes, np.uint64), 0, at_once=16) == got).all()


@pytest.mark.parametrize("hot", [4096, 2])
def test_dealt_links(spark, hot):
    codes = near_codes()
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    vertex = list(range(len(codes)))
    random.shuffle(vertex)
    df = spark.createDataFrame(list(zip(vertex, signed)), "vertex long, code long")
    roots = {r.vertex: r.root for r in components(links(df, hot=hot)).collect()}
    want = brute_components(dict(zip(vertex, codes)))
    assert {v: roots.get(v, v) for v in vertex} == want


def test_tasks_follow_the_rows_and_workers_hold_runs(spark):
    assert [deal_tasks(n) for n in (0, 1, 10 * TASK_CODES, 10 * TASK_CODES + 1)] == [1, 1, 10, 11]
    assert deal_tasks(10**12) == MANY_TASKS
    codes = np.sort(np.array(near_codes(900), np.uint64).view(np.int64))
    rows = [(deal, code, i) for deal in range(3) for i, code in enumerate(codes.tolist())]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("deal", "code", "vertex"), r)) for r in rows[at : at + 70]]) for at in range(0, len(rows), 70)]
    of = lambda n: sorted((a, b) for x in _trie_links(16, 3, n)(iter(batches)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist()))
    assert of(1) == of(500) == of(10**9) and len(of(1)) % 3 == 0 and of(1)


def test_documents(spark):
    random.seed(1)
    words = [str(i) for i in range(300)]
    base = [random.choice(words) for _ in range(400)]
    rows = [(i, " ".join(base)) for i in (7, 9, 11)]
    for i in range(20, 60):
        w = list(base)
        w[random.randrange(400)] = "changed"
        rows.append((i, " \n".join(w).upper()))
    rows += [(100 + i, " ".join(random.choice(words) for _ in range(random.randint(0, 9)))) for i in range(60)]
    rows += [(2, None), (3, ""), (4, " \t"), (5, "One"), (6, "oNE  tWO"), (300, "x " * 20000), (None, " ".join(base)), (7, " ".join(base))]
    random.shuffle(rows)
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    prints = {d: brute_print(t) for d, t in rows if d is not None}
    want = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            assert r.component_id == want[r.doc_id]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(want.values()) | {None}


def test_empty(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_row_is_judged_by_itself(spark):
    """A doc_id that two texts share links nothing, and its rows come and go one by one."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 0, 0), (2, a, 1, 1), (2, b, 2, 2), (3, b, 3, 3), (2, b, 2, 2), (None, b, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int, c0 int")
    assert sorted((r.doc_id or 0, r.component_id) for r in near_components(docs).collect()) == [(0, 2), (1, 1), (2, 1), (2, 2), (2, 2), (3, 2)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, a, 0, 0), (2, b, 2, 2), (None, b, 4, 4)]


def test_a_third_of_all_rows_alike(spark):
    rows = [(5, "one same text of some words", 1)] * 2000 + [(10 + i, " ".join(f"w{i}x{k}" for k in range(30)), 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(6)
    got = near_components(docs).groupBy("component_id").count().collect()
    assert sorted((r.component_id, r["count"]) for r in got) == [(5, 2000)] + [(10 + i, 1) for i in range(300)]
    assert keep_one(docs).count() == 301 and keep_one(docs.limit(0)).count() == 0
