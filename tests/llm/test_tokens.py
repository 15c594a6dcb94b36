from __future__ import annotations

import base64
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelens.llm import _tokens, packing, token_counts, token_files
from tidelens.llm._text import chunks
from tidelens.llm._tokens import IdEncoder, library_encoder, piece_starts

PATH = P.path("byte_bpe_50k.json")


def odd_texts(n=300, seed=2):
    random.seed(seed)
    letters = list("aZé日9 ½\n\t  '''sstredvlm!?.  ​\U0001f600é") + ["word", "The ", "<|endoftext|>"]
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(n)] + ["", None, " ", "\n\n", "x" * 3000, "word " * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3 - 50, t) for i, t in enumerate(odd_texts())]
    random.shuffle(out)
    return out


def test_pieces_are_the_patterns_matches():
    pattern, texts = regex.compile(P.PATTERN), odd_texts(4000)
    got = []
    for c in chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), limit=5000):
        starts, firsts = piece_starts(c)
        ends, raw = np.append(starts[1:], len(c.data)), c.data.tobytes()
        got += [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(firsts, firsts[1:])]
    assert got == [pattern.findall(t or "") for t in texts]


def test_every_code_point_in_every_context(tokenizer):
    """Between letters, digits, spaces, apostrophes and its like: the pieces of our split give the ids that both libraries give."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(P.path("byte_bpe_multi_50k.tiktoken")).read_bytes().splitlines())}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}  {c}'{c}'s" for c in points[at : at + 2000]) for at in range(0, len(points), 2000)]
    encoder, at = library_encoder(PATH), 0
    for c in chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])):
        ids, offsets = encoder.ids(c)
        own = texts[at : at + c.rows]
        at += c.rows
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [x.ids for x in tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        starts, firsts = piece_starts(c)
        ends, raw = np.append(starts[1:], len(c.data)), c.data.tobytes()
        for text, x, y in zip(own, firsts, firsts[1:]):
            assert [i for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist()) for i in tik._encode_single_piece(raw[a:b])] == tik.encode_ordinary(text)


def counted(encoder):
    """The encoder, and the list of the pieces that it asks the library for."""
    asked, encode = [], encoder.encode
    encoder.encode = lambda pieces: asked.extend(pieces) or encode(pieces)
    return encoder, asked


def texts_of(texts, limit=1 << 20):
    return chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), limit=limit)


def test_the_library_sees_a_piece_once():
    """300,000 words, twice: more than what was remembered, as long as a task reads."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i // 17576 % 26] + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] for i in range(300_000)]
    texts = [" " + " ".join(words[at : at + 10_000]) for at in range(0, len(words), 10_000)]
    encoder, asked = counted(library_encoder.__wrapped__(PATH))
    once, again = ([encoder.ids(c)[0].tolist() for c in texts_of(texts)] for _ in range(2))
    assert len(asked) == len(set(asked)) == len(words)
    assert once == again


def test_forgotten_pieces_are_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr(_tokens, "REMEMBERED_FLAT", 40)
    encoder, asked = counted(library_encoder.__wrapped__(PATH))
    texts = odd_texts(400, seed=5) * 2
    got = []
    for c in texts_of(texts, limit=300):
        ids, offsets = encoder.ids(c)
        got += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [x.ids for x in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert len(asked) > len(set(asked))


def test_pieces_of_one_hash_keep_their_ids():
    encoder = IdEncoder(lambda pieces: (np.array([b for p in pieces for b in p], np.int32), np.array([len(p) for p in pieces], np.int64)))
    data, key = np.frombuffer(b"abcdabc", np.uint8), np.array([7], np.uint64)
    for _ in range(2):
        for start, end in ((0, 2), (2, 4), (4, 7), (0, 2)):
            at = encoder.known(key, data, np.array([start]), np.array([end]))
            assert encoder.young.ids[encoder.young.id_at[at[0]] : encoder.young.id_at[at[0] + 1]].tolist() == list(data[start:end])


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 25])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 300_001)
    raw = token_files.pack(ids, bits)
    assert len(raw) == (len(ids) * bits + 7) // 8
    assert (token_files.unpack(raw, bits, 0, len(ids)) == ids).all()
    assert (token_files.unpack(raw, bits, 131_071, 777) == ids[131_071 : 131_071 + 777]).all()
    assert len(token_files.unpack(raw, bits, 5, 0)) == 0


def test_token_files(spark, tmp_path, rows, tokenizer):
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, 2)
    blocks = token_files.read_token_files(spark, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(blocks).collect()}
    want, at = {}, 0
    for d, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    ids = {r.doc_id: r.ids for r in token_files.token_ids(blocks).collect()}
    assert all(ids[d] == tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows)


def test_token_files_odd(spark, tmp_path):
    twice = [(1, "b", 0), (1, "a", 0), (None, "c", 0), (1, "a", 0)]
    token_files.write_token_files(spark.createDataFrame(twice, "doc_id long, text string, start int"), str(tmp_path / "a"), PATH, 2)
    assert sorted((r.doc_id or 0, r.start) for r in token_files.digests(token_files.read_token_files(spark, str(tmp_path / "a"))).collect()) == [(0, 0), (1, 2), (1, 4), (1, 6)]
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), PATH, 2)
    assert token_files.digests(token_files.read_token_files(spark, str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("items", [10_000, 20])
def test_packing(spark, rows, tokenizer, items):
    capacity = 32
    docs = spark.createDataFrame([(*r, 5) for r in rows] + [(None, "a b", 5), (7, "again", 5), (7, "again", 5)], "doc_id long, text string, length int")
    got = packing.pack(packing.pieces(docs, PATH, 2, capacity), capacity, items).collect()
    want = defaultdict(list)
    for d, t, _ in docs.collect():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k].append((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    have, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= (total / capacity) * (1.02 if items > 20 else 1.1) + 1


def exact_fewest(fills, capacity):
    """The fewest sequences, by trying all ways (branch and bound)."""
    best = len(fills)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(order):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= order[at]}:
            i = rooms.index(room)
            place(at + 1, [*rooms[:i], room - order[at], *rooms[i + 1 :]])
        place(at + 1, [*rooms, capacity - order[at]])

    order = sorted(fills, reverse=True)
    place(0, [])
    return best


def test_best_fit_against_all_ways():
    rng = random.Random(5)
    gaps = []
    for _ in range(60):
        fills = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        bins = packing.best_fit(fills, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(fills))) and all(sum(fills[i] for i in b) <= 20 for b in bins)
        gaps.append(len(bins) - exact_fewest(fills, 20))
    assert max(gaps) <= 1 and sum(gaps) <= 3


def slow_best_fit(fills, capacity):
    """Longest first, each into the sequence with the least room that holds it: straight from the words."""
    rooms = []
    for x in sorted(fills, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= x]
        if fitting:
            i = min(fitting, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing_against_plain_best_fit(spark, tokenizer):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["river", "stone", "a", "walking"]) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    found = packing.pieces(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 2, 64)
    fewest = slow_best_fit([r.length for r in found.collect()], 64)
    assert packing.pack(found, 64).select("sequence_id").distinct().count() == fewest
    for items, most in ((200, 1.05), (40, 1.1)):
        assert packing.pack(found, 64, items, slack=1).select("sequence_id").distinct().count() <= most * fewest


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(1, "some words of one row")] * 5000, "doc_id long, text string").repartition(3)
    got = packing.pack(packing.pieces(docs, PATH, 2), items=300)
    assert got.count() == 5000
    size = got.first().length
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert all(r.n == r.end <= 1024 and r.k == r.m for r in used)
    assert len(used) <= -(-5000 // (1024 // size)) + 17  # each of 17 tasks may end with one that equal items can't fill
    # Each row has a salt of its own, so no task gets them all.
    salts = packing.pieces(docs, PATH, 2).select(F.xxhash64(F.monotonically_increasing_id()).alias("salt")).select(F.pmod("salt", F.lit(17)).alias("deal"))
    assert salts.groupBy("deal").count().agg(F.max("count")).first()[0] < 500


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0


@pytest.mark.parametrize("rule", ["first", "last"])
def test_line_counts(spark, rows, tokenizer, rule):
    got = defaultdict(dict)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in token_counts.section_tokens(docs, PATH, rule).collect():
        got[r.doc_id][r.section] = (r.begin, r.stop, r.n_tokens)
    for d, t in rows:
        t = t or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+$", t) or [""]
        bounds, at = [], 0
        for line in lines:
            bounds.append([at, at + len(line), 0])
            at += len(line)
        for (a, b), _ in zip(tokenizer.encode(t, add_special_tokens=False).offsets, range(10**9)):
            at = a if rule == "first" else b - 1
            next(x for x in bounds if x[0] <= at < x[1])[2] += 1
        assert [got[d][k] for k in sorted(got[d])] == [tuple(x) for x in bounds]


def test_field_counts(spark, tokenizer):
    docs = spark.createDataFrame([(1, "title", "a body\n\nof é日 text", None), (2, None, None, "x"), (3, "only", "", "")], "doc_id long, title string, body string, n_tokens string")
    got = {(r.doc_id, r.field): r.n_tokens for r in token_counts.field_tokens(docs, ["title", "body", "n_tokens"], PATH).collect()}
    for d, text in ((1, "title\na body\n\nof é日 text\n"), (2, "\n\nx"), (3, "only\n\n")):
        assert sum(n for (i, _), n in got.items() if i == d) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert got[1, "title"] == 2


def test_counts_of_odd_tables(spark):
    schema = "doc_id long, text string, section int, sections string"
    assert token_counts.section_tokens(spark.createDataFrame([], schema), PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b\nc", 9, "x")] * 3 + [(None, "a", 9, "x"), (2, None, 9, "x")], schema)
    got = sorted((r.doc_id or 0, r.section, r.n_tokens) for r in token_counts.section_tokens(docs, PATH).collect())
    assert got == [(0, 0, 1)] + [(1, 0, 3)] * 3 + [(1, 1, 1)] * 3 + [(2, 0, 0)]


def test_token_files_of_one_repeated_row(spark, tmp_path):
    docs = spark.createDataFrame([(5, "the same row")] * 3000 + [(1, "first"), (9, "last")], "doc_id long, text string").repartition(5)
    path = str(tmp_path / "same")
    token_files.write_token_files(docs, path, PATH, 2)
    blocks = token_files.read_token_files(spark, path)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.digests(blocks).collect())
    at = 0
    for start, _, n in got:
        assert start == at
        at += n
    assert [d for _, d, _ in got] == [1] + [5] * 3000 + [9]
    assert blocks.select("part").distinct().count() > 1
