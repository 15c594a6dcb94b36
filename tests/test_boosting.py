"""The ranker against the same training in plain Python, row by row and pair by pair."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidelens.operators import boosting
from tidelens.operators.boosting import UNIT, Params, best_rounds, best_split, cut, importance, permuted, predict, train
from tidelens.plans import ranking

FEATURES = ["a", "b", "c"]


def panel(n_dates=8, n=40, seed=1, model="m"):
    random.seed(seed)
    rows = []
    for d in range(n_dates):
        for k in range(n + d):
            x = [random.randrange(6) for _ in FEATURES]
            grade = min(4, max(0, round((x[0] + (x[1] > 3) * 2) * 0.6 + random.gauss(0, 0.8))))
            rows.append((model, date(2020, 1, 1) + timedelta(days=d), k, x, grade))
    return rows


SCHEMA = "model string, date date, ticker int, x array<int>, grade int"


def plain(rows, allowed, params):
    """[(feature, last, gain, leaves)] of one model."""
    scores, forest = {(d, k): 0.0 for _, d, k, _, _ in rows}, []
    dates = defaultdict(list)
    for _, d, k, x, grade in rows:
        dates[d].append((k, x, grade))
    for _ in range(params.rounds):
        g, h = defaultdict(int), defaultdict(int)
        for d, own in dates.items():
            order = sorted(own, key=lambda r: (-scores[d, r[0]], r[0]))
            disc = {r[0]: 1 / math.log2(i + 2) if i < params.top else 0.0 for i, r in enumerate(order)}
            ideal = sum((2.0 ** r[2] - 1) / math.log2(i + 2) for i, r in enumerate(sorted(own, key=lambda r: -r[2])[: params.top]))
            for i in own:
                for j in own:
                    if i[2] > j[2] and (disc[i[0]] or disc[j[0]]):
                        change = (2.0 ** i[2] - 2.0 ** j[2]) * abs(disc[i[0]] - disc[j[0]]) / ideal
                        wrong = 1 / (1 + math.exp(scores[d, i[0]] - scores[d, j[0]]))
                        whole = lambda v: math.floor(v * UNIT + 0.5)
                        g[d, i[0]] += whole(wrong * change)
                        g[d, j[0]] -= whole(wrong * change)
                        for k in (i, j):
                            h[d, k[0]] += whole(wrong * (1 - wrong) * change)
        node, tree, leaves = {(d, k): 1 for _, d, k, _, _ in rows}, {}, []
        for level in range(params.depth):
            for at in range(1 << level, 2 << level):
                own = [(d, k, x) for _, d, k, x, _ in rows if node[d, k] == at]
                worth = lambda of: (sum(g[r[:2]] for r in of) / UNIT) ** 2 / (sum(h[r[:2]] for r in of) / UNIT + params.ridge)
                best = (allowed[0], 1 << 30, 0.0)
                for f in allowed:
                    for b in sorted({r[2][f - 1] for r in own}):
                        left, right = [r for r in own if r[2][f - 1] <= b], [r for r in own if r[2][f - 1] > b]
                        if min(len(left), len(right)) >= params.least and (gain := round(worth(left) + worth(right) - worth(own), 9)) > best[2]:
                            best = (f, b, gain)
                tree[at] = best
                for d, k, x in own:
                    node[d, k] = 2 * at + (x[best[0] - 1] > best[1])
        for at in range(1 << params.depth, 2 << params.depth):
            own = [key for key in node if node[key] == at]
            leaves.append(round(params.rate * (sum(g[k] for k in own) / UNIT) / (sum(h[k] for k in own) / UNIT + params.ridge), 9))
        for key, at in node.items():
            scores[key] = round(scores[key] + leaves[at - (1 << params.depth)], 9)
        forest.append(([tree[i][0] for i in sorted(tree)], [tree[i][1] for i in sorted(tree)], [tree[i][2] for i in sorted(tree)], leaves))
    return forest, scores


@pytest.mark.parametrize("top, depth", [(30, 2), (5, 3)])
def test_against_plain_python(spark, top, depth):
    params = Params(rounds=3, depth=depth, rate=0.3, top=top, least=7)
    rows = panel() + [("other", *r[1:]) for r in panel(4, 30, 2)]
    found = train(spark.createDataFrame(rows, SCHEMA).repartition(5), FEATURES, {"other": ["b", "c"]}, params)
    for model, allowed in (("m", [1, 2, 3]), ("other", [2, 3])):
        want, scores = plain([r for r in rows if r[0] == model], allowed, params)
        for tree, (feature, last, gain, leaves) in zip(found[model], want, strict=True):
            assert (tree.feature, tree.last) == (feature, last)
            assert tree.gain == pytest.approx(gain, abs=1e-6) and tree.leaves == pytest.approx(leaves, abs=1e-7)
        got = predict(spark.createDataFrame([r for r in rows if r[0] == model], SCHEMA), found, depth)
        assert {(r.date, r.ticker): r.score for r in got.collect()} == pytest.approx(scores, abs=1e-6)


def test_partitions_dont_matter(spark):
    params, rows = Params(rounds=2), panel(5, 60, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert train(df.coalesce(1), FEATURES, params=params) == train(df.repartition(7), FEATURES, params=params)


def test_learns_and_stops(spark):
    learn, check = spark.createDataFrame(panel(10, 50, 4), SCHEMA), spark.createDataFrame(panel(4, 50, 5), SCHEMA)
    params = Params(rounds=6, depth=2, rate=0.3)
    forest = train(learn, FEATURES, params=params)
    rounds = best_rounds(check, forest, 2)
    assert 1 <= rounds["m"] <= 6 and len(cut(forest, rounds)["m"]) == rounds["m"]
    scored = predict(check, forest, 2)
    assert scored.stat.corr("score", "grade") > 0.5
    gained = {r.feature: r.gain for r in importance(spark, forest, FEATURES).collect()}
    assert gained["a"] > gained["b"] > gained["c"]
    flat = spark.createDataFrame([(*r[:4], 2) for r in panel(3, 30, 6)], SCHEMA)
    early = train(flat, FEATURES, params=Params(rounds=5, patience=1), valid=flat)
    assert len(early["m"]) == 2 and all(set(t.leaves) == {0.0} and set(t.gain) == {0.0} for t in early["m"])


def test_pairs_are_by_class(spark, monkeypatch):
    """Rows of one date, grade and score are paired with the top once, not one by one; each has the gradient that pairing it by itself gives."""
    random.seed(7)
    rows = [("m", date(2020, 1, 1), k, [0, 0, 0], random.randrange(5), random.choice([0.0, 0.25, 0.5, 0.75])) for k in range(1500)]
    df, top, met = spark.createDataFrame(rows, SCHEMA + ", score double"), 30, []
    whole = boosting.pair_gradients
    monkeypatch.setattr(boosting, "pair_gradients", lambda *a: met.append(whole(*a)) or met[-1])
    best = boosting.ideal(df, "date", top)
    found, folders = boosting.gradients(df, best, "date", "ticker", top)
    got = {r.ticker: (r.g, r.h) for r in found.collect()}
    assert sum(m.count() for m in met) <= (5 * 4 + top) * top
    order = sorted(rows, key=lambda r: (-r[5], r[2]))
    disc = {r[2]: 1 / math.log2(i + 2) if i < top else 0.0 for i, r in enumerate(order)}
    full = sum((2.0 ** r[4] - 1) / math.log2(i + 2) for i, r in enumerate(sorted(rows, key=lambda r: -r[4])[:top]))
    g, h, unit = defaultdict(int), defaultdict(int), lambda v: math.floor(v * UNIT + 0.5)
    for n, t in enumerate(order[:top]):
        for r in order[n + 1 :]:
            if r[4] != t[4]:
                up, down = (r, t) if r[4] > t[4] else (t, r)
                change, wrong = (2.0 ** up[4] - 2.0 ** down[4]) * abs(disc[r[2]] - disc[t[2]]) / full, 1 / (1 + math.exp(up[5] - down[5]))
                g[up[2]] += unit(wrong * change)
                g[down[2]] -= unit(wrong * change)
                for k in (r[2], t[2]):
                    h[k] += unit(wrong * (1 - wrong) * change)
    # A unit for each pair whose engines differ in the last bit; the top has as many pairs as there are rows.
    assert all(abs(got[k][0] - g[k]) <= 30 and abs(got[k][1] - h[k]) <= 30 for k in range(1500))
    for folder in folders:
        boosting.delete(folder)


def _plans(monkeypatch):
    """The plans of what the rankers' queries write."""
    plans, whole = [], ranking.saved
    monkeypatch.setattr(ranking, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, name))
    return plans


def test_lines_are_grouped_once(spark, monkeypatch):
    plans = _plans(monkeypatch)
    assert ranking._panel(spark, "/root/testdata/sf0.001").count() > 0
    assert sum(line.strip(" +-:").startswith("Relation") and "l_suppkey" in line for p in plans for line in p.splitlines()) == 1


@pytest.mark.parametrize("name", ["ltr_placebo", "ltr_regimes"])
def test_what_rankers_read_is_made_once(spark, monkeypatch, name):
    """Shuffled grades and regimes are written, as training and test read them: no window is left in the rows."""
    seen = []

    class Seen(Exception):
        pass

    def trained(d, *_):
        seen.append(d._jdf.queryExecution().optimizedPlan().toString())
        raise Seen

    monkeypatch.setattr(ranking, "_trained", trained)
    with pytest.raises(Seen):
        ranking.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Window" not in seen[0]


def test_equal_gains_take_the_first():
    bins = {2: {0: (UNIT, UNIT, 10), 5: (-UNIT, UNIT, 10)}, 1: {1: (UNIT, UNIT, 10), 3: (-UNIT, UNIT, 10)}}
    assert best_split(bins, [1, 2], Params(least=5))[:2] == (1, 1)
    assert best_split(bins, [2], Params(least=5))[:2] == (2, 0)
    assert best_split(bins, [1, 2], Params(least=11)) is None


def test_shuffled_within_dates(spark):
    rows = [(d, k, k + 100 * d) for d in range(3) for k in range(50)]
    found = permuted(spark.createDataFrame(rows, "date int, ticker int, grade int"), [1, 2]).collect()
    for seed in (1, 2):
        own = [r for r in found if r.model == f"seed {seed}"]
        assert sorted((r.date, r.ticker) for r in own) == sorted(r[:2] for r in rows)
        assert all(r.grade // 100 == r.date for r in own) and sorted(r.grade for r in own) == sorted(r[2] for r in rows)
        assert sum(r.grade % 100 == r.ticker for r in own) < 15


def test_null_features_are_in_the_middle(spark):
    rows = [(1, i, None if i % 4 == 0 else float(i)) for i in range(20)]
    d = spark.createDataFrame(rows, "date int, ticker int, v double").select("ticker", boosting.rank_bins(["v"], "date", 4).alias("x"))
    got = {r.ticker: r.x[0] for r in d.collect()}
    assert {got[i] for i in range(0, 20, 4)} == {2} and got[1] == 0 and got[19] == 3
    assert d.filter(F.size("x") != 1).count() == 0
