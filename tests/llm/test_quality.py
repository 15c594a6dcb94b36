from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelens.llm import quality
from tidelens.llm.quality import accuracies, estimate, judged, keep_good, report

CLEAN = "The quick brown fox number one jumps over a lazy dog near river bank tonight while seven old men look on from their small wooden boat"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def corpus():
    random.seed(0)
    rows = [(i, "\n".join(" ".join(random.sample(CLEAN.split(), 20)) for _ in range(3))) for i in range(150)]
    rows += [(200 + i, " ".join(f"{x}##$$" for x in CLEAN.split()) + str(i)) for i in range(10)]
    rows += [(300 + i, CLEAN.upper() + "!!! " + "NOW!! " * 9 + str(i)) for i in range(10)]
    rows += [(400 + i, f"again é {i}\n" * 40) for i in range(10)]
    rows += [(500, None), (501, ""), (502, "short text"), (503, " \n\x0b\n "), (504, "a\n b\na\n b\n\n\na"), (505, "é日 " * 4000), (506, "x\ny z\nx\r\nx"), (507, "one two three four five six seven eight " * 2 + "tail")]
    return rows


def test_counts_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(4)
    got = {r.doc_id: r for r in report(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r, want = got[d], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert all(got[i].kept for i in range(150))
    assert not any(r.kept for d, r in got.items() if d >= 200)
    assert {r.doc_id for r in keep_good(docs).collect()} == set(range(150))
    assert keep_good(docs).columns == docs.columns


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    fire = np.array([0.7, 0.5, 0.4, 0.3])
    slip = np.array([0.002, 0.01, 0.005, 0.001])
    votes = np.where(rng.random((20_000, 4)) < np.where(truth[:, None], slip, fire), 0, 1)
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = estimate(patterns, counts)
    assert found["clean"] == pytest.approx(truth.mean(), abs=0.03)
    assert found["rates"][0, 0] == pytest.approx(fire, abs=0.06)
    assert ((found["posterior"][of.ravel()] > 0.5) == truth).mean() > 0.97


def test_odd_rows(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, CLEAN), (None, None)], "doc_id long, text string")
    assert len(judged(twice).collect()) == 4
    assert [tuple(r) for r in keep_good(twice).collect()] == [(None, CLEAN)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert judged(empty).count() == 0 and keep_good(empty).count() == 0


def plain_em(rows, steps=300):
    """EM straight from the words, one text at a time: start, belief and silence as documented."""
    start, rules = quality._START, len(rows[0])
    odds = {}
    for r in set(rows):
        x = math.log(start["clean"] / (1 - start["clean"]))
        for v in r:
            x += {0: math.log(start["slip"] / start["fire"]), 1: math.log((1 - start["slip"]) / (1 - start["fire"])), 2: 0}[v]
        odds[r] = 1 / (1 + math.exp(-x))
    for _ in range(steps):
        clean = sum(odds[r] for r in rows)
        others = len(rows) - clean
        rate = {}
        for k in range(rules):
            seen = {y: [0.5 + sum((odds[r] if y else 1 - odds[r]) for r in rows if r[k] == v) for v in range(3)] for y in (0, 1)}
            seen[0][0] += quality._BELIEF * others * start["fire"]
            seen[0][1] += quality._BELIEF * others * (1 - start["fire"])
            rate |= {(k, y, v): seen[y][v] / sum(seen[y]) for y in seen for v in range(3)}
        share = (clean + 1) / (len(rows) + 2)
        for r in odds:
            x = math.log(share / (1 - share)) + sum(math.log(rate[k, 1, v] / rate[k, 0, v]) for k, v in enumerate(r) if v < 2)
            odds[r] = 1 / (1 + math.exp(-x))
    return odds


def test_em_against_plain_em_on_all_patterns():
    random.seed(3)
    rows = [r for r in itertools.product(range(3), repeat=3) for _ in range(random.randint(1, 6))] + [(1, 1, 1)] * 60 + [(1, 2, 1)] * 30
    want = plain_em(rows)
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    found = estimate(patterns, counts)["posterior"]
    assert found == pytest.approx([want[tuple(p)] for p in patterns.tolist()], abs=1e-6)


def votes_of(n, slip, fire, abstain, seed):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.9
    votes = np.where(rng.random((n, len(slip))) < np.where(truth[:, None], slip, fire), 0, 1)
    return truth, np.where(rng.random(votes.shape) < abstain, 2, votes)


def test_a_noisy_rule_is_overruled():
    """A rule that fires on one clean text in ten loses its weight: texts that it alone votes against are kept."""
    truth, votes = votes_of(30_000, [0.002, 0.001, 0.003, 0.1], [0.6, 0.5, 0.4, 0.1], 0.1, 1)
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = estimate(patterns, counts)
    kept = found["posterior"][of.ravel()] >= 0.5
    alone = (votes[:, 3] == 0) & (votes[:, :3] == 1).all(1)
    assert alone.sum() > 1000 and kept[alone].all()
    assert not kept[(votes[:, 0] == 0) & (votes[:, 1] == 0)].any()
    assert (kept == truth).mean() > 0.95
    weight = np.log(found["rates"][0, 1] / found["rates"][0, 0])
    assert abs(weight[3]) < 1 < 3 < min(-weight[:3])


def test_abstentions_say_nothing():
    truth, votes = votes_of(5000, [0.01, 0.02], [0.6, 0.5], 0.3, 2)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = estimate(patterns, counts)
    at = {tuple(p): x for p, x in zip(patterns.tolist(), found["posterior"])}
    assert at[2, 2] == pytest.approx(found["clean"], abs=1e-6)


def test_accuracies(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], "doc_id long, text string, votes int")
    got = {r.rule: r for r in accuracies(docs).collect()}
    assert got.keys() == quality.votes().keys() and got["symbols"].accuracy > 0.9 and got["symbols"].fires_on_others > got["symbols"].fires_on_clean
    assert accuracies(docs.limit(0)).count() == 0


def test_a_rule_that_votes_one_way_is_not_estimated(spark):
    """Its votes move no posterior, and accuracies() says nothing of it."""
    _, votes = votes_of(5000, [0.01, 0.02], [0.6, 0.5], 0.1, 4)
    both = np.column_stack([votes, np.random.default_rng(1).choice([1, 2], len(votes))])
    of = lambda v: estimate(*np.unique(v, axis=0, return_counts=True))
    one, two = of(votes), of(both)
    assert two["clean"] == pytest.approx(one["clean"], abs=1e-6)
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(CLEAN.split(), 22)) + (" ## $$ ## $$ ##" if i % 9 == 0 else "")) for i in range(90)], "doc_id long, text string")
    got = {r.rule: r for r in accuracies(docs).collect()}
    assert got["symbols"].accuracy > 0.9 and got["shouts"].accuracy is None and got["shouts"].votes == 90


def test_votes_for_clean_decide_some_texts():
    """A text with one vote against it stays if the other rules praise it, and goes if they are silent."""
    truth, votes = votes_of(30_000, [0.004, 0.004, 0.01], [0.7, 0.6, 0.3], 0.3, 5)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    with_, without = estimate(patterns, counts)["posterior"] >= 0.5, quality.without_praise(patterns, counts) >= 0.5
    at = {tuple(p): i for i, p in enumerate(patterns.tolist())}
    assert with_[at[1, 1, 0]] and not without[at[1, 1, 0]] and not with_[at[2, 2, 0]]
