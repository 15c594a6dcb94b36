from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidelens.llm import suffix_dedup
from tidelens.llm.suffix_dedup import _deal, _ranks, _runs, anchors, digests, remove_repeats, repeated_windows


def gone(rows, width):
    """doc_id -> set of byte positions that a string of a smaller doc_id covers."""
    least, out = {}, {d: set() for d, _ in rows}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - width + 1):
            key = t[i : i + width]
            least[key] = min(least.get(key, d), d)
    for d, t in texts:
        for i in range(len(t) - width + 1):
            if least[t[i : i + width]] < d:
                out[d].update(range(i, i + width))
    return out


def brute(rows, width):
    """doc_id -> (bytes, removed, runs, digest)."""
    found = {}
    for d, g in gone(rows, width).items():
        text = (dict(rows)[d] or "").encode()
        runs = sum(i in g and i - 1 not in g for i in range(len(text)))
        found[d] = (len(text), len(g), runs, hashlib.sha256(bytes(b for i, b in enumerate(text) if i not in g)).hexdigest())
    return found


def corpus(seed, n=150):
    random.seed(seed)
    words = ["a", "bb", "ccc", "é", "ü x", "日本", "word", "Word", "\n", "zzzz", "\0"]
    draw = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage, rows = draw(40), []
    for i in range(n):
        text = draw(random.randint(0, 60))
        if i % 3 == 0:
            cut = random.randint(0, len(text))
            text = text[:cut] + passage + text[cut:]
        if i % 10 == 1 and rows:
            text = rows[-1][1]
        rows.append((i * 7 % n, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 700), (n + 3, "x" * 300 + "y"), (n + 4, "ab" * 400), (n + 5, "ba" * 30), (n + 6, passage * 3), (-5, passage[:25])]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, key, bucket_bytes", [(50, 12, 24 << 20), (50, 16, 4000), (50, 12, 4000), (20, 8, 2000), (13, 11, 3000)])
def test_against_brute_force(spark, width, key, bucket_bytes):
    rows = corpus(width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(docs, width, key, bucket_bytes).collect()}
    assert got == brute(rows, width)


def test_bytes_and_odd_rows(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(60)) + "é" * 20
    rows = [(1, text, 5, None), (1, text + "!", 5, None), (2, "new" + text, 6, None), (None, text, 7, None), (3, None, 8, None), (4, text[1:51], 9, [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, spans array<int>")
    found = remove_repeats(docs)
    assert found.columns == ["doc_id", "text", "spans", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in found.collect())
    whole = text.encode()
    assert got == [(0, 100, 0, 0, whole), (1, 100, 0, 0, whole), (1, 101, 0, 0, whole + b"!"), (2, 103, 100, 1, b"new"), (3, 0, 0, 0, b""), (4, 50, 50, 1, b"")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digests(docs).count() == 0 and remove_repeats(docs).count() == 0
    assert digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_long_text_over_steps(spark, monkeypatch):
    random.seed(1)
    long = "".join(random.choice("abcdefgh ") for _ in range(900_000))
    rows = [(1, long), (2, long[500_000:500_400] + "#" + long[262_100:262_200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in digests(docs).collect()}
    assert got == {1: (900_000, 0, 0), 2: (501, 500, 2)}


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[1000:1400] = 120
    offsets = np.array([0, 0, 30, 700, 5000])
    first, last, anchor = anchors(data, offsets)
    of = {s: a - s for f, to, a in zip(first, last, anchor) for s in range(f, to + 1)}
    assert sorted(of) == [*range(30, 651), *range(700, 4951)]
    assert all(0 <= x <= 38 for x in of.values())
    alone = {}
    for s, distance in of.items():
        assert alone.setdefault(data[s : s + 50].tobytes(), distance) == distance


def test_a_key_over_several_buckets():
    """Segments of a key that is several splitters are cut by distance: every window stays, and equal windows meet."""
    splits = np.array([[5, 1], [7, 3], [7, 3], [7, 3], [9, 0]], np.uint64)
    high, low = np.array([7, 7, 4, 7, 9, 7], np.uint64), np.array([3, 3, 0, 2, 9, 4], np.uint64)
    assert _ranks(splits, high, low, True).tolist() == [4, 4, 0, 1, 5, 4]
    assert _ranks(splits, high, low, False).tolist() == [1, 1, 0, 1, 5, 4]
    anchor = np.array([100, 300, 500, 600, 700, 800])
    first, last = anchor - np.array([34, 20, 3, 3, 3, 3]), anchor - np.array([0, 5, 0, 0, 0, 0])
    index, a, b, bucket = _deal(splits, high, low, first, last, anchor, 35)
    assert sorted((i, s) for i, x, y in zip(index, a, b) for s in range(x, y + 1)) == sorted((i, s) for i in range(6) for s in range(first[i], last[i] + 1))
    where = {}
    for i, x, y, to in zip(index, a, b, bucket):
        if i < 2:
            for s in range(x, y + 1):
                assert where.setdefault(anchor[i] - s, to) == to
    assert set(where.values()) == {2, 3, 4}


def test_hot_key_taken_by_distance():
    """A key with more windows than are sorted at once gives the same as one sort."""
    rng = np.random.default_rng(5)
    body = [rng.integers(97, 99, 34).astype(np.uint8).tobytes() + b"k" * 16 + rng.integers(97, 99, 34).astype(np.uint8).tobytes() for _ in range(40)]
    body = [random.Random(i).choice(body) if i % 2 else body[i % 40] for i in range(300)]
    data = np.frombuffer(b"".join(body), np.uint8)
    offsets, docs = np.arange(301) * 84, rng.integers(0, 50, 300)
    whole = repeated_windows(data, offsets, np.full(300, 34), docs)
    parted = repeated_windows(data, offsets, np.full(300, 34), docs, most=500)
    assert len(whole[0]) and all((x == y).all() for x, y in zip(whole, parted))


def test_runs():
    docs, starts, lengths = _runs(np.array([2, 1, 1, 1, 2]), np.array([0, 5, 0, 3, 9]), np.array([4, 10, 50, 3, 1]))
    assert (docs.tolist(), starts.tolist(), lengths.tolist()) == ([1, 2, 2], [0, 0, 9], [50, 4, 1])


def test_copies_are_judged_where_they_are(spark, monkeypatch):
    rows = [(i, "The same long passage stands in each and every one of these documents, word by word. " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sent = docs.mapInArrow(suffix_dedup._send(50, 16, np.zeros((0, 2), np.uint64)), suffix_dedup._SENT)
    counts = sent.selectExpr("sum(if(data is null, 0, count)) sent", "sum(count) n").first()
    assert counts.sent < counts.n / 50
    assert digests(docs).filter("n_removed > 0").count() == 399
