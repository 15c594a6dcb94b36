"""Token counts of the sections of texts, by offset-mapped attribution.

A text is encoded once, whole: the ids are those of its whole encoding, got from remembered pieces that no token crosses. Their
spans follow from the bytes that each id stands for, end to end, which is what the library's offset mapping says in characters; the spans are then joined to the sections' spans. The rule for a token
that crosses a boundary: it counts for the section that holds its first character ("first") or its last one ("last").
So the sections' counts add up to the text's. A token of a few bytes of one character lies where the character lies.

Sections are the lines of a text (a line ends with its newline), or begin at given character offsets.

Defined cases: a null or empty text is one empty section without tokens. Given offsets are sorted, and those that are null, negative, repeated or
beyond the text are dropped; characters before the first belong to a section that begins at 0. Repeated rows stay; extra columns are ignored. A very long
text is held in memory whole, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._text import chunks
from tidelens.llm._tokens import library_encoder


@lru_cache(maxsize=4)
def _id_bytes(tokenizer: str) -> np.ndarray:
    """How many bytes each id stands for: byte-level vocabularies write one character for a byte."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=False)
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


def _counts(tokenizer: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = library_encoder(tokenizer), _id_bytes(tokenizer)
        for chunk in chunks(batches):
            ids, _ = encoder.ids(chunk)
            lead = (chunk.data & 0xC0) != 0x80
            chars = np.append(0, np.cumsum(lead))
            opens = np.zeros(len(chunk.data) + 1, bool)
            if "sections" in chunk.batch.schema.names:
                byte = np.append(np.flatnonzero(lead), len(chunk.data))
                given = chunk.column("sections").to_pylist()
                for row, own in enumerate(given):
                    low, n = chars[chunk.offsets[row]], chars[chunk.offsets[row + 1]] - chars[chunk.offsets[row]]
                    at = np.array(sorted({x for x in own or () if x is not None and 0 <= x < n}), np.int64)
                    opens[byte[low + at]] = True
            else:
                opens[1:] = chunk.data == 0x0A
            heads = chunk.offsets[:-1]
            full = np.diff(chunk.offsets) > 0
            opens[-1] = False
            opens[heads[full]] = True
            # Sections of all rows in order; a row without text has one as well.
            begins = np.flatnonzero(opens)
            row = np.searchsorted(chunk.offsets, begins, "right") - 1
            of_byte = np.cumsum(opens[:-1]) - 1
            ends = np.cumsum(lengths[ids])
            at = ends - lengths[ids] if rule == "first" else ends - 1
            n = np.bincount(of_byte[at], minlength=len(begins)) if len(ids) else np.zeros(len(begins), np.int64)
            stops = np.append(begins[1:], len(chunk.data))
            bare = np.flatnonzero(~full)
            low = chars[chunk.offsets[row]]
            rows, begin, stop, n = np.append(row, bare), np.append(chars[begins] - low, np.zeros(len(bare), np.int64)), np.append(chars[stops] - low, np.zeros(len(bare), np.int64)), np.append(n, np.zeros(len(bare), np.int64))
            first = np.zeros(chunk.rows, np.int64)
            first[row[::-1]] = np.arange(len(row))[::-1]
            number = np.append(np.arange(len(row)) - first[row], np.zeros(len(bare), np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id").take(pa.array(rows)), "section": pa.array(number, pa.int32()), "begin": pa.array(begin, pa.int64()), "stop": pa.array(stop, pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    return run


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """doc_id, section (from 0), begin and stop (characters) and n_tokens of every section.

    sections: a column of character offsets (array<int>) at which sections begin; without it lines are sections.
    """
    if rule not in ("first", "last"):
        raise ValueError(f"rule {rule!r} is neither first nor last")
    columns = ["doc_id", "text"] + ([F.col(sections).alias("sections")] if sections else [])
    return docs.select(*columns).mapInArrow(_counts(tokenizer, rule), "doc_id long, section int, begin long, stop long, n_tokens long")


def field_tokens(docs: DataFrame, fields: list[str], tokenizer: str, glue: str = "\n", rule: str = "first") -> DataFrame:
    """doc_id, field and n_tokens, for the named string columns encoded as one text with `glue` after each but the last.

    The glue counts for the field before it. A null is empty; a last field that is empty has no row.
    """
    if not glue:
        raise ValueError("fields need something between them")
    text = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    pieces = [F.concat(x, F.lit(glue)) for x in text[:-1]] + text[-1:]
    begins, at = [], F.lit(0)
    for part in pieces:
        begins.append(at)
        at = at + F.char_length(part)
    whole = docs.select("doc_id", F.concat(*pieces).alias("text"), F.array(*begins).alias("begins"))
    found = section_tokens(whole, tokenizer, rule, "begins").select("doc_id", "section", "n_tokens")
    names = F.array(*[F.lit(f) for f in fields])
    return found.select("doc_id", F.element_at(names, F.col("section") + 1).alias("field"), "n_tokens")
