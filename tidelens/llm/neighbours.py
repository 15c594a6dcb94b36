"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

A bounded sample of vectors fits coarse centroids and, on what they leave over, two layers of codebooks for each group of components: the
second codes what the first leaves. Every row is then indexed: dealt to its nearest centroid's list, coded, and kept in blocks of at most
`BLOCK` rows, so that a list with a third of all rows is many blocks. A query scores its best lists by asymmetric distance tables (its own
components against the codebooks). The codes alone decide which rows of a block are scored exactly, at every size: first the best `SHARE` of the block
by rough score, then those others that could still be among the best `want`, for a rough score is off by no more than the lengths, group by
group, of the query times those of what the codes leave of the row, which are kept beside them. Exact scores are inner products in double precision
on the original vectors. What a query finds in its lists is therefore exact, however many rows share their codes. How many lists are
probed is measured: the fewest that hold `TARGET` of the true neighbours within the sample. A query whose lists hold fewer rows than it wants is run
against all rows in blocks.

Lists are about the square root of the rows over 4, but no more than the sample can fit, one for `PER_LIST` of its rows: beyond some 250 million
rows lists grow, and a larger index needs a larger `sample`. Blocks keep a task's memory the same in any case. Of the probed lists those aren't read
whose rows can't reach the query's `want`-th best score within the sample, by the list's centroid and the distance of its furthest row: where vectors lie in
clusters that leaves few.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows with a null vec_id. Equal scores go by smaller vec_id. A repeated vec_id is found as often as it stands
there, but a query never finds its own id; a repeated query is asked once, with the least of its vectors. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm._spark import stable

WANT = 20
QUERY_STEP = 20
#: Rows that the index is fitted on, and rows of it that a centroid must have on average.
SAMPLE, PER_LIST = 20_000, 5
#: Rows of one block of a list.
BLOCK = 2048
#: Queries that are compared with a block at once.
QUERY_BLOCK = 256
GROUPS = 16
CODES = 256
#: Share of a block's rows that are scored exactly at first (`want` at least); others follow where their bound reaches what these find.
SHARE = 0.02
#: Share of the true neighbours that the probed lists must hold, measured within the sample.
TARGET = 0.97
_ROUNDS = 8


def valid(df: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    own = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)
    # The most frequent length (the smaller one of equally frequent): one row a length.
    lengths = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return own.filter(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def nearest(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """The index of the centre with the least Euclidean distance to each row."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(rows[at : at + step] @ centres.T - half, 1) for at in range(0, len(rows), step)]) if len(rows) else np.zeros(0, np.int64)


def kmeans(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    distinct = np.unique(rows, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(_ROUNDS):
        of = nearest(rows, centres)
        count = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int, groups: int = GROUPS, codes: int = CODES) -> dict:
    """Coarse centroids and, for each group of components, two codebooks: of residuals, and of what the first leaves of them."""
    centres = kmeans(sample, lists, 1)
    left = sample - centres[nearest(sample, centres)]
    cuts, layers = np.array_split(np.arange(sample.shape[1]), min(groups, sample.shape[1])), []
    for layer in range(2):
        books = [kmeans(left[:, c], codes, 2 + i + layer * groups) for i, c in enumerate(cuts)]
        left = left - _decoded(_coded(left, cuts, books), cuts, books)
        layers.append(books)
    return {"centres": centres, "cuts": cuts, "layers": layers}


def _coded(left: np.ndarray, cuts: list[np.ndarray], books: list[np.ndarray]) -> np.ndarray:
    return np.stack([nearest(left[:, c], b) for c, b in zip(cuts, books)], 1).astype(np.uint8)


def _decoded(codes: np.ndarray, cuts: list[np.ndarray], books: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(codes), sum(map(len, cuts))))
    for g, (c, book) in enumerate(zip(cuts, books)):
        out[:, c] = book[codes[:, g]]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assign(model: dict):
    """vec_id, list and codes of every row, its distance from the centroid, and the lengths of what the codes leave of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = model["cuts"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), model["centres"].shape[1])
            own = nearest(x, model["centres"])
            left, codes = x - model["centres"][own], []
            reach = np.linalg.norm(left, axis=1)
            size = np.linalg.norm(x, axis=1) + reach
            for books in model["layers"]:
                codes.append(_coded(left, cuts, books))
                left = left - _decoded(codes[-1], cuts, books)
            # The lengths of what is missed, and far more than rounding can add to them.
            errors = np.stack([np.linalg.norm(left[:, c], axis=1) for c in cuts], 1) * (1 + 1e-6) + 1e-9 * size[:, None]
            errors = np.nextafter(errors.astype("<f4"), np.float32(np.inf))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "embedding": batch.column(1), "list": pa.array(own, pa.int32()), "reach": reach * (1 + 1e-6) + 1e-9 * size, "codes": pa.array([r.tobytes() for r in np.concatenate(codes, 1)], pa.binary()), "errors": pa.array([r.tobytes() for r in errors], pa.binary())})

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """One block: ids, vectors, codes and errors as bytes, in the order of vec_id."""
    table = table.sort_by("vec_id")
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    whole = lambda c: pa.array([b"".join(table.column(c).to_pylist())], pa.binary())
    return pa.table({"list": table.column("list")[:1].cast(pa.int32()), "block": table.column("block")[:1].cast(pa.int32()), "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()), "codes": whole("codes"), "errors": whole("errors")})


def _probe(model: dict, probes: int, live: np.ndarray, reach: np.ndarray, known: tuple[np.ndarray, np.ndarray], want: int):
    """The lists to read for every query: of those that have rows the `probes` with the greatest inner products of their centroids, without those that can't hold a result.

    reach: the greatest distance of a live list's rows from its centroid, so that none of them scores more than the centroid does and that times the query's length.
    known: ids and vectors of rows of the table. The query's `want`-th best among these is reached by its results too.
    """
    ids, rows = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), model["centres"].shape[1])
            own = batch.column(0).to_numpy()
            for at in range(0, len(x), QUERY_BLOCK):
                q = x[at : at + QUERY_BLOCK]
                score = q @ rows.T
                score[own[at : at + QUERY_BLOCK, None] == ids[None, :]] = -np.inf
                least = np.partition(score, -want, 1)[:, -want] if score.shape[1] >= want else np.full(len(q), -np.inf)
                centre = q @ model["centres"][live].T
                length = np.linalg.norm(q, axis=1)[:, None]
                may = centre + length * reach * (1 + 1e-9) >= (least - 1e-9 * length[:, 0])[:, None]
                best = np.argsort(-centre, axis=1, kind="stable")[:, :probes]
                row, place = np.nonzero(np.take_along_axis(may, best, 1))
                yield pa.RecordBatch.from_pydict({"list": pa.array(live[best[row, place]], pa.int32()), "query_id": batch.column(0).take(pa.array(row + at)), "query": batch.column(1).take(pa.array(row + at))})

    return run


def _top(score: np.ndarray, want: int) -> np.ndarray:
    """Indices of the greatest scores, equal ones by smaller index."""
    if len(score) > 4 * want:
        least = np.partition(score, len(score) - want)[len(score) - want]
        some = np.flatnonzero(score >= least)
        return some[np.argsort(-score[some], kind="stable")[:want]]
    return np.argsort(-score, kind="stable")[:want]


def probes_for(model: dict, sample: np.ndarray, want: int, target: float = TARGET, queries: int = 256) -> int:
    """The fewest lists a query must probe so that they hold `target` of its neighbours in the sample."""
    q = sample[:queries]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, 1, kind="stable")[:, : min(want, len(sample) - 1)]
    place = np.argsort(np.argsort(-(q @ model["centres"].T), 1, kind="stable"), 1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, model["centres"])[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1 if len(needed) else 1


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _first(query: np.ndarray, vec: np.ndarray, score: np.ndarray, want: int) -> np.ndarray:
    """Indices of each query's best `want`, best first."""
    order = np.lexsort((vec, -score, query))
    own = query[order]
    begin = np.flatnonzero(np.diff(own, prepend=own[0] - 1)) if len(own) else np.zeros(0, int)
    return order[np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own)))) < want]


def _scored(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", x[at], q)


def _rough(model: dict, row: dict, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a block's rows by the distance tables of each query, and how far off these may be."""
    codes = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
    errors = np.frombuffer(row["errors"], "<f4").reshape(n, -1)
    rough = np.repeat((q @ model["centres"][row["list"]])[:, None], n, 1)
    lengths = np.empty((len(q), len(model["cuts"])))
    for g, c in enumerate(model["cuts"]):
        lengths[:, g] = np.linalg.norm(q[:, c], axis=1)
        for layer, books in enumerate(model["layers"]):
            rough += (q[:, c] @ books[g].T)[:, codes[:, layer * len(books) + g]]
    return rough, lengths @ errors.T.astype(float)


def _worth(rough: np.ndarray, off: np.ndarray, x: np.ndarray, q: np.ndarray, other: np.ndarray, want: int) -> np.ndarray:
    """Which rows of a block to score exactly for one query: none of the others can be among the best `want`. other: rows with another id than the query's."""
    few = _top(rough, max(want + 1, int(np.ceil(SHARE * len(rough)))))
    sure = np.sort(_scored(x, few[other[few]], q))
    if len(sure) < want:
        return np.flatnonzero(other)
    # A bound that isn't a number leaves its row in.
    return np.flatnonzero(~(rough + off < sure[-want]) & other)


def _search(model: dict | None, want: int, held: int = 400_000):
    """The best rows of a task's blocks for each of its queries; without a model all rows are scored exactly."""

    def block(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asked = np.array(row["query_ids"], np.int64)
        q = np.array(row["queries"], float)
        ids = np.frombuffer(row["ids"], "<i8")
        x = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
        rough, off = _rough(model, row, q, len(ids)) if model else (None, None)
        for k, own in enumerate(asked):
            other = ids != own
            near = _worth(rough[k], off[k], x, q[k], other, want) if model else np.flatnonzero(other)
            exact = _scored(x, near, q[k])
            best = _top(exact, want)
            yield np.full(len(best), own), ids[near[best]], exact[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def merged() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*found)]
            own = _first(*columns, want)
            return pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns], schema=_FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                found += block(row)
                if len(found) * want > held:
                    yield merged()
                    found.clear()
        if found:
            yield merged()

    return run


def _best(found: DataFrame, want: int) -> DataFrame:
    """Of each query's rows the best `want`: ranked by score, then vec_id. Tasks have left at most `want` rows of a query each."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= want)


def _asked(queries: DataFrame, turns: int) -> DataFrame:
    """Queries of one block of a list, in arrays of about QUERY_BLOCK. queries: query_id, query, list and how many blocks that has."""
    turn = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn")
    own = queries.groupBy("list", "blocks", turn).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries"))
    return own.select("list", "query_ids", "queries", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def search(embeddings: DataFrame, step: int = QUERY_STEP, want: int = WANT, target: float = TARGET, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: for every row whose vec_id is divisible by `step`, the `want` nearest found of the other rows."""
    spark = embeddings.sparkSession
    rows = stable(valid(embeddings))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A bounded sample, the same at every run: the rows with the least hashes.
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    sample = np.array(drawn["embedding"].tolist(), float)
    model = fit(sample, int(np.clip(round(total**0.5 / 4), 1, max(1, len(sample) // PER_LIST))))
    probes = probes_for(model, sample, want, target)

    coded = stable(rows.mapInArrow(_assign(model), "vec_id long, embedding array<double>, list int, reach double, codes binary, errors binary"))
    # One row for each list: no more than the sample's rows.
    found = sorted(coded.groupBy("list").agg(F.count("*"), F.max("reach")).collect())
    live, reach = np.array([r[0] for r in found]), np.array([r[2] for r in found])
    sizes = F.broadcast(spark.createDataFrame([(r[0], r[1], -(-r[1] // BLOCK)) for r in found], "list int, rows long, blocks int"))
    dealt = coded.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    blocks = stable(dealt.groupBy("list", "block").applyInArrow(_blocks, "list int, block int, ids binary, vectors binary, codes binary, errors binary"))

    queries = rows.filter(F.col("vec_id") % step == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    probed = stable(queries.mapInArrow(_probe(model, probes, live, reach, (drawn["vec_id"].to_numpy(), sample), want), "list int, query_id long, query array<double>"))
    # Queries whose lists hold too few rows for them: all rows for these.
    held = probed.join(sizes, "list").groupBy("query_id").agg(F.sum("rows").alias("rows"))
    short = stable(queries.join(held, "query_id", "left").filter(F.coalesce("rows", F.lit(0)) <= want).select("query_id", "query"))
    turns = max(1, -(-total // step // QUERY_BLOCK))
    schema = "query_id long, vec_id long, score double"
    pair = ["list", "query_ids", "queries", "ids", "vectors", "codes", "errors"]
    asked = _asked(probed.join(short, "query_id", "left_anti").join(sizes, "list"), turns)
    found = blocks.join(asked, ["list", "block"]).select(*pair).mapInArrow(_search(model, want), schema)
    if not short.isEmpty():
        every = short.select(F.explode(F.array(*[F.lit(k) for k in live.tolist()])).alias("list"), "query_id", "query").join(sizes, "list")
        found = found.union(blocks.join(_asked(every, turns), ["list", "block"]).select(*pair).mapInArrow(_search(None, want), schema))
    return _best(found, want)
