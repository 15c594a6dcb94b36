"""Learning to rank: trees boosted by LambdaRank gradients, where Spark does all that grows with the rows.

Rows have a model, a date (the query of the ranking), a key, binned features, a grade, and a score so far. A round is: the `top` rows of each date by score, found
without sorting the dates; each row's gradient from its pairs with these, weighted by what swapping the two would change in NDCG at `top`; and
one aggregate over (model, node, feature, bin) for each level of the tree, of which only these bounded histograms reach the driver. Beyond the top, rows
of one date, grade and score have the same pairs: such a class is paired once with the date's `top` rows and weighs as many as it has rows. So the cost is
classes x `top` and some passes over the rows; were all scores of a date distinct, it would be rows x `top`.

Gradients are whole numbers of 2**-24, so their sums are the same in any order and a model doesn't hang on how rows are partitioned. Several models
are trained at once, by one set of jobs: on the same rows with other features, on other rows, or with other grades.

A round's rows are written to the shared folder, which cuts the plan's lineage; those of the round before are deleted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions.ranks import pct_rank
from tidelens.operators import stats
from tidelens.sources.shared import delete, saved

#: Gradients are summed in units of 1 / UNIT.
UNIT = 1 << 24
#: Digits that scores and leaves are rounded to, and by which gains are compared.
DIGITS = 9


@dataclass(frozen=True)
class Params:
    rounds: int = 8
    depth: int = 2
    rate: float = 0.1
    top: int = 30
    ridge: float = 1.0
    #: Rows that each side of a split must have.
    least: int = 20
    #: Rounds without a better validation NDCG after which training ends; None runs all rounds.
    patience: int | None = None


@dataclass
class Tree:
    """Nodes in heap order from 1: feature (from 1), last bin that goes left, gain. Leaves from left to right."""

    feature: list[int]
    last: list[int]
    gain: list[float]
    leaves: list[float] = field(default_factory=list)


#: model -> its trees, a round each.
Forest = dict[str, list[Tree]]

_TREE = "struct<feature: array<int>, last: array<int>, leaves: array<double>>"


def rank_bins(features: Iterable[str], date: str, bins: int) -> Column:
    """Bins of the features' percentile ranks within the date; a NULL is the middle."""
    share = lambda c: F.coalesce(pct_rank(c, date), F.lit(0.5))
    return F.array(*[F.least(F.lit(bins - 1), F.floor(share(c) * bins)).cast("int") for c in features])


def _heap(x: Column, tree: Column, levels: int) -> Column:
    """Where a row stands after so many levels, in heap order."""
    step = lambda at, _: 2 * at + (F.element_at(x, F.element_at(tree["feature"], at)) > F.element_at(tree["last"], at)).cast("int")
    if levels > 3:
        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step)
    at = F.lit(1)
    for level in range(levels):  # compiled, but three times as long with each level
        at = step(at, level)
    return at


def _leaf(x: Column, tree: Column, depth: int) -> Column:
    return F.element_at(tree["leaves"], _heap(x, tree, depth) - 2**depth + 1)


def _as_rows(spark: SparkSession, trees: dict[str, list[Tree]]) -> DataFrame:
    """model and its trees, for a broadcast: as many rows as models."""
    return spark.createDataFrame([(m, [(t.feature, t.last, t.leaves) for t in own]) for m, own in trees.items()], f"model string, _trees array<{_TREE}>")


def predict(rows: DataFrame, forest: Forest, depth: int, x: str = "x", name: str = "score") -> DataFrame:
    """rows with the score of their model's trees."""
    add = lambda total, tree: F.round(total + _leaf(F.col(x), tree, depth), DIGITS)
    found = rows.join(F.broadcast(_as_rows(rows.sparkSession, forest)), "model")
    return found.withColumn(name, F.aggregate("_trees", F.lit(0.0), add)).drop("_trees")


def classes(rows: DataFrame, date: str) -> DataFrame:
    """model, date, grade, score and n: how many rows are alike to all pairs with others."""
    return rows.groupBy("model", date, "grade", "score").agg(F.count("*").alias("n"))


def ideal(rows: DataFrame, date: str, top: int) -> DataFrame:
    """model, date and ideal: the greatest DCG at `top` that the date's grades allow."""
    w = Window.partitionBy("model", date).orderBy(F.desc("grade"))
    most = rows.groupBy("model", date, "grade").agg(F.least(F.count("*"), F.lit(top)).alias("_n"))
    places = most.select("model", date, "grade", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    ranked = places.select("model", date, "grade", F.row_number().over(w).alias("_p")).filter(F.col("_p") <= top)
    # A few terms in the order of places, so that they add up alike everywhere.
    terms = F.array_sort(F.collect_list(F.struct(F.col("_p"), ((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_p") + 1.0)).alias("_g"))))
    return ranked.groupBy("model", date).agg(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["_g"]).alias("ideal"))


def leaders(rows: DataFrame, alike: DataFrame, best: DataFrame, date: str, key: str, top: int) -> DataFrame:
    """model, date, key, grade, score, _d (discount) and ideal of the `top` rows of each date by score, then key. alike: classes(rows); those that no row of the top is in are left out before rows are ordered."""
    down = Window.partitionBy("model", date).orderBy(F.desc("score"))
    above = F.coalesce(F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = alike.groupBy("model", date, "score").agg(F.sum("n").alias("_n")).withColumn("_above", above).filter(F.col("_above") < top).groupBy("model", date).agg(F.min("score").alias("_least"))
    near = rows.select("model", date, key, "grade", "score").join(F.broadcast(least), ["model", date]).filter("score >= _least").drop("_least")  # one row a model and date
    w = Window.partitionBy("model", date).orderBy(F.desc("score"), key)
    first = near.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= top)
    return first.withColumn("_d", 1 / F.log2(F.col("_p") + 1.0)).drop("_p").join(best, ["model", date])


def pair_gradients(left: DataFrame, tops: DataFrame, date: str) -> DataFrame:
    """What each pair of left (model, date, grade, score, _own: discount, 0 beyond the top; and more) with a top row of another grade adds: g to the left's gradient, h to both curvatures. The top row is key `_top`."""
    t = tops.select("model", date, F.col("grade").alias("_tg"), F.col("score").alias("_ts"), F.col("_d").alias("_td"), F.col("_key").alias("_top"), "ideal")
    met = left.join(t, ["model", date]).filter("grade <> _tg")
    side = F.signum(F.col("grade") - F.col("_tg"))
    change = F.abs(F.pow(F.lit(2.0), F.col("grade")) - F.pow(F.lit(2.0), F.col("_tg"))) * F.abs(F.col("_own") - F.col("_td")) / F.col("ideal")
    wrong = 1 / (1 + F.exp(side * (F.col("score") - F.col("_ts"))))
    whole = lambda v: F.floor(v * UNIT + 0.5).cast("long")
    met = met.withColumns({"_side": side.cast("long"), "_change": change, "_wrong": wrong})
    change, wrong = F.col("_change"), F.col("_wrong")
    return met.select(*left.columns, "_top", (whole(wrong * change) * F.col("_side")).alias("g"), whole(wrong * (1 - wrong) * change).alias("h"))


def gradients(rows: DataFrame, best: DataFrame, date: str, key: str, top: int) -> tuple[DataFrame, list[str]]:
    """rows (model, date, key, grade, score and more) with g and h: the sums of their pairs' gradients and curvatures, in units of 1 / UNIT; and the folders that this reads."""
    alike, a = saved(classes(rows, date), "classes")
    tops, b = saved(leaders(rows, alike, best, date, key, top).withColumnRenamed(key, "_key"), "leaders")
    place = ["model", date, "grade", "score"]
    within = tops.groupBy(*place).agg(F.count("*").alias("_k"))
    beyond = alike.join(within, place, "left").withColumn("n", F.col("n") - F.coalesce("_k", F.lit(0))).filter("n > 0").select(*place, "n", F.lit(0.0).alias("_own"))
    met = pair_gradients(beyond, tops, date)
    own, c = saved(met.groupBy(*place).agg(F.sum("g").alias("_g"), F.sum("h").alias("_h")), "gradients")
    # The top's own pairs are counted by both of their rows; those with rows beyond it are seen from there, once a class.
    inner = pair_gradients(tops.select(*place, "_key", F.col("_d").alias("_own")), tops, date).select("model", date, "_key", "g", "h")
    back = met.select("model", date, F.col("_top").alias("_key"), (-F.col("g") * F.col("n")).alias("g"), (F.col("h") * F.col("n")).alias("h"))
    none = tops.select("model", date, "_key", F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("h"))
    first, d = saved(none.unionByName(inner).unionByName(back).groupBy("model", date, F.col("_key").alias(key)).agg(F.sum("g").alias("_fg"), F.sum("h").alias("_fh")), "first")
    found = rows.join(first, ["model", date, key], "left").join(own, place, "left")
    both = lambda a, b: F.coalesce(a, b, F.lit(0).cast("long"))
    return found.withColumn("g", both("_fg", "_g")).withColumn("h", both("_fh", "_h")).drop("_fg", "_fh", "_g", "_h"), [a, b, c, d]


def histograms(rows: DataFrame, trees: dict[str, Tree], level: int) -> DataFrame:
    """model, node (heap order), feature (from 1), bin, g, h and n."""
    part = {m: [Tree(t.feature, t.last, t.gain, t.leaves or [0.0])] for m, t in trees.items()}
    known = rows.join(F.broadcast(_as_rows(rows.sparkSession, part)), "model")
    at = _heap(F.col("x"), F.element_at("_trees", 1), level).alias("node")
    bins = known.select("model", at, "g", "h", F.posexplode("x").alias("feature", "bin"))
    return bins.groupBy("model", "node", (F.col("feature") + 1).alias("feature"), "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def best_split(bins: dict[int, dict[int, tuple[int, int, int]]], allowed: list[int], params: Params) -> tuple[int, int, float, tuple[int, int], tuple[int, int]] | None:
    """Feature, last bin on the left, gain and the sums of both sides of the best split; of equal gains the first feature and bin. bins: feature -> bin -> g, h, n."""
    best = None
    worth = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + params.ridge)
    for f in allowed:
        own = bins.get(f, {})
        g, h, n = (sum(b[i] for b in own.values()) for i in range(3))
        gl = hl = nl = 0
        for b in sorted(own):
            gl, hl, nl = gl + own[b][0], hl + own[b][1], nl + own[b][2]
            if min(nl, n - nl) < params.least:
                continue
            gain = round(worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), DIGITS)
            if gain > 0 and (best is None or gain > best[2]):
                best = (f, b, gain, (gl, hl), (g - gl, h - hl))
    return best


def _grow(found: list, trees: dict[str, Tree], allowed: dict[str, list[int]], params: Params, last: bool) -> None:
    """Add a level to each model's tree from the level's histograms, and the leaves below the last one."""
    bins: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(dict)))
    for r in found:
        bins[r["model"]][r["node"]][r["feature"]][r["bin"]] = (r["g"], r["h"], r["n"])
    leaf = lambda g, h: round(params.rate * (g / UNIT) / (h / UNIT + params.ridge), DIGITS)
    for model, tree in trees.items():
        for node in range(len(tree.feature) + 1, 2 * len(tree.feature) + 2):
            own = bins[model][node]
            split = best_split(own, allowed[model], params)
            whole = tuple(sum(b[i] for b in own[min(own)].values()) for i in (0, 1)) if own else (0, 0)
            # Without a split all rows go left.
            f, b, gain, left, right = split or (allowed[model][0], 1 << 30, 0.0, whole, (0, 0))
            tree.feature.append(f)
            tree.last.append(b)
            tree.gain.append(gain)
            if last:
                tree.leaves += [leaf(*left), leaf(*right)]


def train(rows: DataFrame, features: list[str], allowed: dict[str, list[str]] | None = None, params: Params = Params(), valid: DataFrame | None = None, date: str = "date", key: str = "ticker") -> Forest:
    """The trees of every model in rows: model, date, key, x (bins of `features`) and grade. allowed: the features each model may split by, all if it isn't named.

    valid: rows whose NDCG at 10 ends training after params.patience rounds without a better one of any model.
    """
    # Written once: every round reads them several times, however much it takes to make them.
    state, path = saved(rows.select("model", date, key, "x", "grade", F.lit(0.0).alias("score")), "rows")
    models = sorted(r[0] for r in state.select("model").distinct().collect())  # as many as models
    number = {f: i for i, f in enumerate(features, 1)}
    may = {m: sorted(number[f] for f in (allowed or {}).get(m, features)) for m in models}
    forest: Forest = {m: [] for m in models}
    best, best_path = saved(ideal(state, date, params.top), "ideal")
    seen: list[dict[str, float]] = []
    for _ in range(params.rounds):
        graded, used = gradients(state, best, date, key, params.top)
        graded, new = saved(graded, "graded")
        for old in (path, *used):
            delete(old)
        path, trees = new, {m: Tree([], [], []) for m in models}
        for level in range(params.depth):
            _grow(histograms(graded, trees, level).collect(), trees, may, params, level == params.depth - 1)
        for m in models:
            forest[m].append(trees[m])
        known = graded.join(F.broadcast(_as_rows(rows.sparkSession, {m: [t] for m, t in trees.items()})), "model")
        state = known.withColumn("score", F.round(F.col("score") + _leaf(F.col("x"), F.element_at("_trees", 1), params.depth), DIGITS)).drop("_trees", "g", "h")
        if params.patience and valid is not None:
            seen.append(_validated(predict(valid, forest, params.depth), date))
            since = min(len(seen) - 1 - max(range(len(seen)), key=lambda i: (seen[i].get(m, 0.0), -i)) for m in models)
            if since >= params.patience:
                break
    delete(path)
    delete(best_path)
    return forest


def _validated(scored: DataFrame, date: str) -> dict[str, float]:
    found = stats.ndcg(scored.withColumn("_of", F.struct("model", date)).withColumn("_gain", F.col("grade").cast("double")), "score", "_gain", "_of")
    return {m: x for m, x in found.groupBy("_of.model").agg(F.round(F.avg("ndcg"), DIGITS)).collect()}


def best_rounds(valid: DataFrame, forest: Forest, depth: int, date: str = "date") -> dict[str, int]:
    """Each model's number of rounds with the greatest mean NDCG at 10 on valid, the fewest of equals: all rounds are scored by one job."""
    longest = max(len(t) for t in forest.values())
    parts = {f"{m}\n{n}": own[:n] for m, own in forest.items() for n in range(1, longest + 1)}
    rows = valid.withColumn("model", F.explode(F.array(*[F.concat("model", F.lit(f"\n{n}")) for n in range(1, longest + 1)])))
    found: dict[str, dict[int, float]] = defaultdict(dict)
    for name, x in _validated(predict(rows, parts, depth), date).items():
        m, n = name.split("\n")
        found[m][int(n)] = x
    return {m: max(found[m], key=lambda n: (found[m][n], -n)) if m in found else len(forest[m]) for m in forest}


def cut(forest: Forest, rounds: dict[str, int]) -> Forest:
    return {m: own[: rounds[m]] for m, own in forest.items()}


def importance(spark: SparkSession, forest: Forest, features: list[str]) -> DataFrame:
    """model, feature, gain (summed over its splits) and splits, for every feature."""
    rows = []
    for m, trees in forest.items():
        own = {f: [0.0, 0] for f in features}
        for t in trees:
            for f, gain in zip(t.feature, t.gain):
                if gain > 0:
                    own[features[f - 1]][0] += gain
                    own[features[f - 1]][1] += 1
        rows += [(m, f, round(gain, DIGITS), n) for f, (gain, n) in own.items()]
    return spark.createDataFrame(rows, "model string, feature string, gain double, splits long")


def permuted(rows: DataFrame, seeds: Iterable[int], date: str = "date", key: str = "ticker", name: str = "grade") -> DataFrame:
    """rows once for each seed, as model `seed n`, with `name` shuffled within the date: by the order of a digest of seed, key and date."""
    every = rows.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("model", F.concat(F.lit("seed "), F.col("_s").cast("string")))
    own = Window.partitionBy("_s", date).orderBy(key)
    other = Window.partitionBy("_s", date).orderBy(F.md5(F.concat_ws(":", F.col("_s").cast("string"), F.col(key).cast("string"), F.col(date).cast("string")).cast("binary")), key)
    ranked = every.withColumn("_a", F.row_number().over(own)).withColumn("_b", F.row_number().over(other))
    drawn = ranked.select("_s", date, F.col("_b").alias("_a"), F.col(name).alias("_drawn"))
    return ranked.drop(name).join(drawn, ["_s", date, "_a"]).withColumnRenamed("_drawn", name).drop("_s", "_a", "_b")
