from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from tidelens.llm import neighbours
from tidelens.llm.neighbours import search


def brute(ids, x, step, want):
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:want]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_recall(spark, monkeypatch, hot):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    if hot:
        x[rng.permutation(3000)[:1000]] = x[0]
    ids = rng.permutation(6000)[:3000]
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, list int").repartition(4)
    got, want = grouped(search(df)), brute(ids, x.astype(float), 20, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        vectors = dict(zip(ids.tolist(), x.astype(float)))
        assert np.allclose([s for _, _, s in rows], [vectors[v] @ vectors[q] for _, v, _ in rows], rtol=1e-12, atol=1e-12)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_few_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (1, [1.0, 0.0])]
    got = grouped(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {0: [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 20, 0.5)], 20: [(1, 0, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 2, 0.5)]}
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_query_that_reaches_too_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "probes_for", lambda *a: 1)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2000, 4)) + 9, rng.normal(size=(4, 4)) - 90])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = grouped(search(df))
    assert all(len(r) == 20 for r in got.values()) and len(got) == 101


def near_copies(n, width, noise, seed):
    """Random rows, a third of them one row with a little noise, and which they are."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    hot = np.zeros(n, bool)
    hot[rng.permutation(n)[: n // 3]] = True
    x[hot] = x[0] + noise * rng.normal(size=(hot.sum(), width))
    return x.astype(np.float32).astype(float), hot


@pytest.mark.parametrize("noise", [0.05, 0.005])
def test_recall_among_near_copies(spark, noise):
    x, hot = near_copies(12_000, 64, noise, 5)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got, want = grouped(search(df)), brute(ids, x, 20, 20)
    assert got.keys() == want.keys()
    hits = {q: len({v for _, v, _ in rows} & {v for v, _ in want[q]}) for q, rows in got.items()}
    recall = {where: sum(hits[q] for q in hits if hot[q] in of) / 20 / sum(hot[q] in of for q in hits) for where, of in (("group", (True,)), ("all", (True, False)))}
    print(noise, recall)
    assert min(recall.values()) >= 0.9


@pytest.mark.parametrize("noise", [0.5, 0.05, 0.005])
def test_a_block_is_searched_exactly(noise):
    x, _ = near_copies(2000, 64, noise, 6)
    ids = np.arange(len(x))
    model = neighbours.fit(x, 1)
    batch = pa.RecordBatch.from_pydict({"vec_id": ids, "embedding": pa.array(x.tolist())})
    table = pa.Table.from_batches(neighbours._assign(model)([batch])).append_column("block", pa.array(np.zeros(len(x), np.int32)))
    (row,) = neighbours._blocks(table).to_pylist()
    asked = ids[::20]
    pair = pa.RecordBatch.from_pylist([row | {"query_ids": asked.tolist(), "queries": x[asked].tolist()}])
    (found,) = neighbours._search(model, 20)([pair])
    got = {}
    for r in found.to_pylist():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [v for v, _ in rows] for q, rows in brute(ids, x, 20, 20).items()}


def test_a_query_whose_best_list_is_empty(spark, monkeypatch):
    fit = neighbours.fit

    def with_an_empty_list(*a):
        model = fit(*a)
        # Farther out than any row in the direction of half of them, and nearest to none.
        return model | {"centres": np.concatenate([model["centres"], 1000 * np.sign(model["centres"][:1])])}

    monkeypatch.setattr(neighbours, "fit", with_an_empty_list)
    monkeypatch.setattr(neighbours, "probes_for", lambda *a: 1)
    x = np.random.default_rng(7).normal(size=(2000, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = grouped(search(df))
    assert len(got) == 100 and all(len(r) == 20 for r in got.values())


def indexed(x, lists):
    """The model and the block rows of an index of x."""
    model = neighbours.fit(x, lists)
    batch = pa.RecordBatch.from_pydict({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist())})
    table = pa.Table.from_batches(neighbours._assign(model)([batch]))
    for k in sorted(set(table.column("list").to_pylist())):
        own = table.filter(pa.compute.equal(table.column("list"), k))
        yield model, neighbours._blocks(own.append_column("block", pa.array(np.zeros(len(own), np.int32)))).to_pylist()[0]


@pytest.mark.parametrize("n", [500, 2000])
def test_codes_decide_what_is_scored(n):
    """At small sizes too only some rows of a list are scored exactly, and none of the others is among the best."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    scored = rows = 0
    for model, row in indexed(x, int(round(n**0.5 / 4))):
        ids = np.frombuffer(row["ids"], "<i8")
        own = x[ids]
        q = x[::20]
        rough, off = neighbours._rough(model, row, q, len(ids))
        assert (abs(rough - q @ own.T) <= off).all()
        for k in range(len(q)):
            near = neighbours._worth(rough[k], off[k], own, q[k], ids != 20 * k, 5)
            exact = own @ q[k]
            exact[ids == 20 * k] = -np.inf
            assert set(np.argsort(-exact)[:5]) <= set(near)
            scored, rows = scored + len(near), rows + len(ids)
    print(n, scored / rows)
    assert scored < 0.5 * rows


def test_lists_that_cannot_hold_results_are_not_read(spark):
    """Vectors in 30 far clusters: nearly all lists are skipped by proof."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 24)) * 8
    x = (centres[np.arange(3000) % 30] + rng.normal(size=(3000, 24)) * 0.2).astype(np.float32).astype(float)
    model = neighbours.fit(x, 40)
    own = neighbours.nearest(x, model["centres"])
    live = np.unique(own)
    reach = np.array([np.linalg.norm(x[own == k] - model["centres"][k], axis=1).max() for k in live])
    batch = pa.RecordBatch.from_pydict({"query_id": pa.array(np.arange(0, 3000, 20)), "query": pa.array(x[::20].tolist(), pa.list_(pa.float64()))})
    read = next(neighbours._probe(model, len(live), live, reach, (np.arange(3000), x), 20)(iter([batch])))
    assert read.num_rows < 0.2 * 150 * len(live)
    ids = np.arange(3000)
    got, want = grouped(search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))), brute(ids, x, 20, 20)
    hits = sum(len({v for _, v, _ in rows} & {v for v, _ in want[q]}) for q, rows in got.items())
    assert got.keys() == want.keys() and hits >= 0.95 * 20 * len(want)
