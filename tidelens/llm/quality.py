"""Quality rules: weak supervision over rules that vote or abstain.

Each rule votes that a text is clean, that it isn't, or abstains: where its measure lies between what it takes for clean and for faulty, and where the text
is too short for it to tell. Expectation-maximisation over all documents estimates how often each rule votes which way on clean texts and on
others, and the share of clean texts; a document's votes then give the posterior probability that it is clean. An abstention carries no evidence: it
enters no posterior, and neither does a rule that votes one way only on the whole corpus. A rule that fires as often on texts that the other rules find clean as on others loses its weight, whatever it was
written for. A text is kept if the posterior is at least `THRESHOLD` and the base rules don't fail it; EM runs over the texts that the base rules leave
open, or the kinds of faults that they catch would make up the class of texts that aren't clean. The votes have few patterns (3 ** rules at
most, some hundreds in practice), so Spark counts patterns over the corpus and EM runs on the counts: its cost doesn't grow with the corpus, and no
document is left out of them.

Defined cases: a null or empty text has no words, fails the base rules and isn't kept. Without any document there is nothing to
estimate and nothing to return. Repeated rows count as often as they stand there. A very long text is measured whole, held in memory by itself. Extra columns stay where rows
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm._spark import only, stable, with_found
from tidelens.llm._text import chunks, span_hashes, window_hashes, word_spans

WINDOW = 8
MIN_WORDS = 20
#: Percent of words in repeated windows beyond which a text fails.
MAX_REPEATED = 30
THRESHOLD = 0.5

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_wide", "n_shouts", "n_distinct", "n_same_next")


_SCHEMA = ", ".join(f"{c} long" for c in _COUNTS)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def _measures(chunk) -> dict[str, np.ndarray]:
    starts, ends, firsts = word_spans(chunk)
    data, offsets, n = chunk.data, chunk.offsets, np.diff(firsts)
    words = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(chunk.rows), n)
    found = {"n_words": n, "n_symbols": _sums(_IS_SYMBOL[data], offsets)}
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    found["word_chars"] = np.diff(np.append(0, np.cumsum(lead[ends] - lead[starts]))[firsts])

    hashes, at = window_hashes(words, firsts, WINDOW)
    owner = row[at] if len(at) else np.zeros(0, np.int64)
    again = pd.DataFrame({"r": owner, "h": hashes}).duplicated(keep=False).to_numpy()
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + WINDOW, -1)
    found["n_repeat_words"] = _sums(np.cumsum(edge[:-1]) > 0, firsts)

    distinct = ~pd.DataFrame({"r": row, "h": words}).duplicated().to_numpy()
    found["n_distinct"] = _sums(distinct, firsts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    found["n_same_next"] = _sums(same, firsts)

    # Lines that hold a word, by the hash of all their bytes; one is a repeat if it stands earlier in its text.
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    stops = np.append(begins[1:], len(data))
    stops = stops - np.isin(stops - 1, breaks)
    with_word = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops = begins[with_word], stops[with_word]
    line_row = np.searchsorted(offsets, begins, "right") - 1
    repeats = pd.DataFrame({"r": line_row, "h": span_hashes(data, begins, stops)}).duplicated().to_numpy()
    found["n_dup_lines"] = np.bincount(line_row[repeats], minlength=chunk.rows)
    found["n_lines"] = np.bincount(line_row, minlength=chunk.rows)

    upper = (data >= 0x41) & (data <= 0x5A)
    lower = (data >= 0x61) & (data <= 0x7A)
    found["n_upper"], found["n_letters"] = _sums(upper, offsets), _sums(upper | lower, offsets)
    found["n_wide"] = _sums(data >= 0xC0, offsets)
    found["n_shouts"] = _sums(data == 0x21, offsets)
    return found


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        found = _measures(chunk)
        yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id")} | {c: pa.array(found[c], pa.int64()) for c in _COUNTS})


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules need."""
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id long, {_SCHEMA}")


def votes() -> dict[str, Column]:
    """The rules: 0 says the text isn't clean, 1 that it is, 2 abstains. Each judges one measure, the least texts that it judges given in words, letters or lines."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    length = share("word_chars", "n_words")
    ten = c("n_words") >= 10

    def rule(enough: Column, faulty: Column, clean: Column) -> Column:
        return F.when(enough & faulty, 0).when(enough & clean, 1).otherwise(2)

    def below(measure: Column, clean: float, faulty: float, enough: Column) -> Column:
        """Clean up to one value, faulty from another on."""
        return rule(enough, measure >= faulty, measure <= clean)

    letters = (c("n_letters") + c("n_wide")) / F.greatest(c("word_chars"), F.lit(1))
    return {
        "symbols": below(share("n_symbols", "n_words"), 0.02, 0.15, ten),
        "letters": below(1 - letters, 0.05, 0.1, ten),
        "shouts": below(share("n_shouts", "n_words"), 0.03, 0.2, ten),
        "capitals": below(share("n_upper", "n_letters"), 0.2, 0.45, c("n_letters") >= 40),
        "word_length": rule(ten, (length < 3) | (length > 6.5), length.between(3.5, 6)),
        "stutter": below(share("n_same_next", "n_words"), 0.02, 0.1, ten),
        "repeats": below(share("n_repeat_words", "n_words"), 0.02, 0.1, c("n_words") >= 40),
        "lines": below(share("n_dup_lines", "n_lines"), 0.05, 0.2, c("n_lines") >= 5),
        "variety": rule(c("n_words") >= 50, share("n_distinct", "n_words") < 0.3, share("n_distinct", "n_words") > 0.6),
    }


#: Where EM starts: how often a rule is taken to vote against a text that is clean, and against one that isn't; and the share of clean texts.
_START = {"slip": 0.005, "fire": 0.1, "clean": 0.9}
#: What the start still weighs against the texts that aren't clean, in their number. With 0 EM hears the votes alone; more keeps rules of rare kinds of
#: faults from being taken for noise, and drops more clean texts with them.
_BELIEF = 0.0


def _estimable(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which rules cast votes of both kinds: of the others nothing can be learned, and they enter no posterior."""
    cast = [((patterns == v) * counts[:, None]).sum(0) > 0 for v in (0, 1)]
    return cast[0] & cast[1]


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 300, tolerance: float = 1e-9) -> dict:
    """EM over vote patterns (rows of 0, 1, 2): the clean share, each rule's rates, and each pattern's posterior.

    rates[v, y, k]: how often rule k votes v on texts that are clean (y=1) or not (y=0). An abstention says nothing: the posterior takes
    the rates of cast votes alone, and EM starts from `_START`. Half a text of prior weight a vote keeps rates off 0.
    """
    is_vote = np.stack([patterns == v for v in range(3)]).astype(float)
    heard = is_vote[:2] * _estimable(patterns, counts)
    weight = counts.astype(float)
    start = np.log([[_START["slip"] / _START["fire"]], [(1 - _START["slip"]) / (1 - _START["fire"])]])
    post = 1 / (1 + np.exp(-(np.log(_START["clean"] / (1 - _START["clean"])) + (heard.sum(2) * start).sum(0))))
    rates = clean = None
    for _ in range(steps):
        y = np.stack([1 - post, post]) * weight
        now = np.stack([y @ v for v in is_vote]) + 0.5
        now[:2, 0] += _BELIEF * y[0].sum() * np.array([[_START["fire"]], [1 - _START["fire"]]])
        now /= now.sum(0)
        done = rates is not None and abs(now - rates).max() < tolerance
        rates, clean = now, (y[1].sum() + 1) / (weight.sum() + 2)
        log = np.einsum("vpk,vyk->yp", heard, np.log(rates[:2]))
        post = 1 / (1 + np.exp(-np.clip(np.log(clean / (1 - clean)) + log[1] - log[0], -50, 50)))
        if done:
            break
    return {"clean": clean, "rates": rates, "posterior": post}


def without_praise(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The posteriors that the same rates give if votes for clean aren't heard: what those votes decide shows in the difference."""
    found = estimate(patterns, counts)
    against = (patterns == 0) * _estimable(patterns, counts)
    log = against @ (np.log(found["rates"][0, 1]) - np.log(found["rates"][0, 0]))
    return 1 / (1 + np.exp(-np.clip(np.log(found["clean"] / (1 - found["clean"])) + log, -50, 50)))


def accuracies(docs: DataFrame) -> DataFrame:
    """rule, votes, fires_on_clean, fires_on_others and accuracy (of its votes, by the posteriors): one row a rule.

    The last three are NULL for a rule that votes one way only: they can't be estimated.
    """
    patterns, counts = _counted(measures(docs).select(*_judged()))
    if not len(counts):
        return docs.sparkSession.createDataFrame([], "rule string, votes long, fires_on_clean double, fires_on_others double, accuracy double")
    found, known = estimate(patterns, counts), _estimable(patterns, counts)
    rows = []
    for k, name in enumerate(votes()):
        cast = counts * (patterns[:, k] < 2)
        right = np.where(patterns[:, k] == 1, found["posterior"], 1 - found["posterior"])
        told = (float(found["rates"][0, 1, k]), float(found["rates"][0, 0, k]), float((cast * right).sum() / cast.sum())) if known[k] else (None, None, None)
        rows.append((name, int(cast.sum()), *told))
    return docs.sparkSession.createDataFrame(rows, "rule string, votes long, fires_on_clean double, fires_on_others double, accuracy double")


def _counted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns that df has, at most 3 ** rules of them, and in how many texts that the base rules pass."""
    seen = sorted((r["pattern"], r["n"]) for r in df.groupBy("pattern").agg(F.count_if(~F.col("base_failed")).alias("n")).collect())
    return np.array([[int(v) for v in p] for p, _ in seen]).reshape(len(seen), len(votes())), np.array([n for _, n in seen])


def posteriors(counted: DataFrame) -> DataFrame:
    """pattern and posterior of every vote pattern in `counted`."""
    patterns, counts = _counted(counted)
    found = estimate(patterns, counts)["posterior"] if len(counts) else []
    return counted.sparkSession.createDataFrame([("".join(map(str, p)), float(x)) for p, x in zip(patterns.tolist(), found)], "pattern string, posterior double")


def _judged() -> list[Column]:
    """pattern and base_failed, from the counts."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return [F.concat(*[v.cast("string") for v in votes().values()]).alias("pattern"), failed.alias("base_failed")]


def _verdicts(counted: DataFrame, known: DataFrame) -> DataFrame:
    return counted.join(F.broadcast(known), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept of every row."""
    counted = stable(measures(docs).select("*", *_judged()))
    return _verdicts(counted, posteriors(counted))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and posterior."""
    return judged(docs).select("doc_id", *_COUNTS[:5], "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept. Texts are measured twice, for the corpus and for the verdicts, rather than shuffled."""
    known = posteriors(measures(docs).select(*_judged()))
    found, names = with_found(docs, lambda chunk: {c: pa.array(x, pa.int64()) for c, x in _measures(chunk).items()}, _SCHEMA)
    return only(_verdicts(found.select("*", *_judged()), known).filter("kept"), names)
