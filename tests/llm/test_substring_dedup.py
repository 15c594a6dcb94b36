from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from tidelens.llm.substring_dedup import Seen, cut_repeats, remove_repeats


def brute(rows, width):
    """doc_id -> (words, removed, digest), by comparing word sequences."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen, gone = set(), {d: set() for d in words}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            key = tuple(words[d][i : i + width])
            if key in seen:
                gone[d].update(range(i, i + width))
            seen.add(key)
    return {d: (len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in words.items()}


def corpus(seed=3):
    random.seed(seed)
    vocabulary = ["a", "bb", "ccc", "é", "ü x", "日本", "word", "Word"]
    draw = lambda n: [random.choice(vocabulary) for _ in range(n)]
    passage, rows = draw(30), []
    for i in range(120):
        w = draw(random.randint(0, 60))
        if i % 3 == 0:
            w[random.randint(0, len(w)) : 0] = passage
        if i % 10 == 0 and rows:
            rows.append((i, rows[-1][1]))
        else:
            rows.append((i, random.choice(["", " ", "\n"]) + random.choice([" ", "\n\t", "\x0b "]).join(w) + random.choice(["", " "])))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "x " * 5000), (204, " ".join(passage * 3))]
    random.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8, with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, 8)
    assert len(got) == len(rows)


def test_text_and_odd_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text, 5, None), (1, text, 5, None), (2, f"new\n{text}  end", 6, None), (None, text, 7, None), (3, None, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, spans array<int>")
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in remove_repeats(docs).collect() if r.kept_text is not None)
    assert got == [(0, 0, text), (1, 0, text), (1, 0, text), (2, 30, "new end")]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), with_text=False).count() == 0


def test_columns_with_clashing_names(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text, [1], 5, 6, "x", 7, 99), (2, f"new\n{text}  end", [2], 8, 9, "y", 3, 99), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>, n_words int, n_removed int, kept_text string, c1 int, n_chars int")
    cut = cut_repeats(docs)
    assert cut.schema == docs.schema
    assert sorted(map(tuple, cut.collect()), key=str) == sorted([rows[0], (2, "new end", [2], 8, 9, "y", 3, 7), rows[2]], key=str)
    found = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert found[2].spans == [2] and found[2].c1 == 3 and found[2].text == rows[1][1] and (found[2].n_words, found[2].n_removed, found[2].kept_text) == (32, 30, "new end")


def test_windows_that_a_task_remembers():
    """In whatever order a task meets a window, all but the earliest position it has sent are later ones."""
    rng = np.random.default_rng(1)
    seen, first = Seen(64), {}
    for _ in range(60):
        n = 50
        hashes = np.concatenate([np.arange(20, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rng.integers(1, 1 << 60, n - 20).astype(np.uint64)])
        docs, starts = rng.integers(0, 1000, n), rng.integers(0, 50, n)
        later = seen.later(hashes, docs, starts)
        for h, d, s, x in zip(hashes.tolist(), docs.tolist(), starts.tolist(), later.tolist()):
            assert not x or first[h] < (d, s)
            first[h] = min(first.get(h, (d, s)), (d, s))
    assert later[:20].sum() >= 10


def test_a_hot_window_in_many_blocks(spark, monkeypatch):
    from tidelens.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "_BLOCK_BYTES", 600)
    random.seed(8)
    passage = [f"p{i}" for i in range(12)]
    rows = [(d, " ".join([*[random.choice("abcdef") + str(random.randint(0, 99)) for _ in range(random.randint(0, 20))], *passage, "end"])) for d in random.sample(range(10_000), 600)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, 8)
