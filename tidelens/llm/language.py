"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts are counted as character 1- to `NGRAM`-grams, hashed to `FEATURES` features. Document frequencies are taken over all
documents that may be learned from. Weights are trained by follow-the-regularised-leader with elastic-net
penalties (L1 makes them sparse) on a bounded sample: of each language's distinct texts those with the least hashes, `SAMPLE` over the number of
languages but `LEAST` at least, of the `LANGUAGES` languages with most texts. So it holds at most max(SAMPLE, LEAST * LANGUAGES) = 12,800 texts however
large the corpus is, a rare language isn't missed for being rare, and many copies of a text count once. A share of the sample is held back to fit the
temperature that calibrates the probabilities. Prediction is one pass over the whole texts, without a shuffle.

Learned from: rows with a text, a language and a doc_id whose CRC-32 (of the id in decimal) modulo 4 isn't 2.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if there is nothing to learn from
(keep_known() then keeps all texts with a letter). A very long text is counted whole, in steps. Where more than `LANGUAGES` values of lang occur, the rarer ones aren't learned.
Equal probabilities go by the order of language names. Rows with a null doc_id get predictions but aren't learned from. Repeated
rows stay. Extra columns are never inputs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm._spark import only, with_found
from tidelens.llm._text import Chunk, chunks, mix

UNKNOWN = "und"
NGRAM = 3
FEATURES = 1 << 14
#: Texts that weights are trained on, shared out among languages; a tenth of them fits the temperature.
SAMPLE = 4000
#: Texts of a language that are trained on where it has them, however many languages there are.
LEAST = 50
#: Languages that are learned at most.
LANGUAGES = 256
#: Characters that are counted at once.
STEP = 1 << 20
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
HELD_BACK = 0.1
#: The pipeline drops texts whose language is known with less probability than this.
LEAST_SCORE = 0.5

_LETTER = regex.compile(r"\p{L}")
_SHIFT = np.uint64(64 - FEATURES.bit_length() + 1)


def counts(text: bytes) -> np.ndarray:
    """How often each feature occurs in a text."""
    lower = text.decode("utf-8").lower()
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(lower), STEP):
        # The n-grams that begin in this step: some characters of the next one belong to them.
        points = np.frombuffer(lower[at : at + STEP + NGRAM - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        own = min(STEP, len(lower) - at)
        gram = np.zeros(len(points), np.uint64)
        for n in range(1, NGRAM + 1):
            gram = gram[: len(points) - n + 1] * np.uint64(0x110001) + points[n - 1 :] + np.uint64(1)
            if not len(gram):
                break
            out += np.bincount((mix(gram[:own]) >> _SHIFT).astype(np.int64), minlength=FEATURES)
    return out


def vector(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their TF-IDF values, of length 1."""
    seen = counts(text)
    at = np.flatnonzero(seen)
    values = np.log1p(seen[at]) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (features x classes) by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, labels):
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least negative log-likelihood, by golden-section search."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _may_learn() -> Column:
    return F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each feature occurs; feature -1 counts the documents."""
    found, rows = np.zeros(FEATURES, np.int64), 0
    for chunk in chunks(batches):
        for i in range(chunk.rows):
            found += counts(chunk.text(i)) > 0
        rows += chunk.rows
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(found[at], rows), pa.int64())})


def _trainer(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for chunk in chunks(batches):
            own = zip(chunk.column("hash").to_pylist(), chunk.column("lang").to_pylist(), range(chunk.rows))
            found += [(h, lang, *vector(chunk.text(i), idf)) for h, lang, i in own]
        if not found:
            return
        found.sort(key=lambda r: r[:2])  # in the same order at every run
        rows, names = [r[2:] for r in found], [r[1] for r in found]
        classes = sorted(set(names))
        labels = np.array([classes.index(x) for x in names])
        own = len(rows) - int(len(rows) * HELD_BACK)
        weights = train(rows[:own], labels[:own], len(classes))
        logits = np.array([x @ weights[at] for at, x in rows[own:]]).reshape(-1, len(classes))
        known = io.BytesIO()
        np.savez_compressed(known, weights=weights.astype(np.float32), temperature=temperature(logits, labels[own:]))
        yield pa.RecordBatch.from_pydict({"classes": pa.array([classes], pa.list_(pa.string())), "model": pa.array([known.getvalue()], pa.binary())})

    return run


def _sample(rows: DataFrame) -> DataFrame:
    """text, lang and hash of the sample, in one task: distinct texts with the least hashes of each language."""
    hash_ = F.xxhash64("text", "lang")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(hash_, 0.05).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    each = max(LEAST, SAMPLE // len(sizes))
    # A share that gives rather more than is wanted, for the counts are estimates.
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["n"])) for r in sizes], "lang string, share double")
    some = rows.select("text", "lang", hash_.alias("hash")).join(F.broadcast(shares), "lang").filter(F.col("hash") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    # Copies of a text are combined within tasks before they are shuffled.
    distinct = some.dropDuplicates(["lang", "hash"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    return distinct.withColumn("place", place).filter(F.col("place") <= each).select("text", "lang", "hash").coalesce(1)


def fit(docs: DataFrame) -> dict | None:
    """Classes, weights, idf and temperature, or None if no row may be learned from. Its size doesn't grow with the corpus."""
    rows = docs.select("doc_id", "text", "lang").filter(_may_learn())
    seen = dict(tuple(r) for r in rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect())
    total = seen.pop(-1, 0)
    if not total:
        return None
    found = np.zeros(FEATURES)
    found[list(seen)] = list(seen.values())
    idf = np.log((1 + total) / (1 + found)) + 1
    row = _sample(rows).mapInArrow(_trainer(idf), "classes array<string>, model binary").first()
    if row is None:
        return None
    model = np.load(io.BytesIO(row["model"]))
    return {"classes": row["classes"], "weights": model["weights"], "idf": idf.astype(np.float32), "temperature": float(model["temperature"])}


def _predict(model: dict | None):
    def run(chunk: Chunk) -> dict[str, pa.Array]:
        names, scores = [], np.zeros(chunk.rows)
        for i in range(chunk.rows):
            text = chunk.text(i)
            if model is None or not chunk.valid[i] or not _LETTER.search(text.decode("utf-8")):
                names.append(UNKNOWN)
                continue
            at, x = vector(text, model["idf"])
            p = _softmax((x @ model["weights"][at]).astype(float) / model["temperature"])
            best = int(p.argmax())
            names.append(model["classes"][best])
            scores[i] = p[best]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return run


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, learned from its rows with a language."""
    found, names = with_found(docs.select("doc_id", "text"), _predict(fit(docs)), "lang_pred string, score double")
    return found.select(F.col("c0").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is known with a probability of at least `least`; without anything to learn from, those whose text has a letter."""
    model = fit(docs)
    if model is None:
        found, names = with_found(docs, lambda chunk: {"fine": pa.array([bool(chunk.valid[i]) and _LETTER.search(chunk.text(i).decode("utf-8")) is not None for i in range(chunk.rows)])}, "fine boolean")
        return only(found.filter("fine"), names)
    found, names = with_found(docs, _predict(model), "lang_pred string, score double")
    return only(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), names)
