"""Byte-level BPE encoding and decoding by DuckDB queries inside Spark tasks.

Texts are split into the pattern's matches, and each distinct piece that a worker hasn't met goes to DuckDB as token-position rows. A
recursive query joins neighbouring positions to the merge table and contracts each word's leftmost pair of
minimum rank until no word has a pair left. An ordered aggregation of the tokens' bytes decodes ids again.
A piece's ids don't depend on what stands around it, so a text's ids are those of its pieces in order.

Long pieces: where no token of the vocabulary that occurs in a piece reaches over a place in it, no merge ever does, so the piece is cut there
and its parts are words of their own. A step then contracts all of a part's pairs of the minimum rank, from the left: that is what one pair a step comes to, as
long as no merge makes a pair of lower rank than its own. The query watches for such a pair, and a part that has one is encoded again, one
pair a step.

Defined cases: a null text is an empty one and has no ids. Repeated rows stay; extra columns are ignored. A very long text is held in memory whole;
a very long word costs time in proportion to its length and the number of steps of its longest part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm._text import chunks
from tidelens.llm._tokens import Encoder

#: Words, and tokens of words, in one DuckDB query.
AT_ONCE, TOKENS_AT_ONCE = 20_000, 2_000_000
#: Bytes beyond which a piece is long.
LONG = 64

#: One pair of each word a step: the leftmost of minimum rank.
_ONE = """
with recursive state(word, tokens) using key (word) as (
    select word, list(token order by position) from start_tokens group by word
    union all (
        with pairs as (
            select word, position, tokens[position] as l, tokens[position + 1] as r
            from (select word, tokens, unnest(range(1, len(tokens))) as position from state)
        ),
        best as (
            select word, min((m.merged::bigint << 32) | p.position) as best
            from pairs p join merges m on m.l = p.l and m.r = p.r
            group by word
        )
        select s.word, s.tokens[: (best & 4294967295) - 1] || [(best >> 32)::int] || s.tokens[(best & 4294967295) + 2 :]
        from state s join best using (word)
    )
)
select word, tokens, false as wrong from state order by word
"""

#: All pairs of minimum rank of each word a step: of pairs that overlap, every other one from the left. wrong: a merge has made a pair of lower rank.
_ALL = """
with recursive state(word, tokens, rank, wrong) using key (word) as (
    select word, list(token order by position), -1, false from start_tokens group by word
    union all (
        with places as (
            select word, unnest(tokens) as token, unnest(range(1, len(tokens) + 1)) as position, unnest(tokens[2:] || [null::int]) as next from state
        ),
        ranked as (select p.word, p.position, m.merged from places p join merges m on m.l = p.token and m.r = p.next),
        best as (select word, min(merged) as merged from ranked group by word),
        least as (select word, position, merged, position - row_number() over (partition by word order by position) as run from ranked join best using (word, merged)),
        taken as (select word, position, merged from (select *, row_number() over (partition by word, run order by position) as k from least) where k % 2 = 1),
        between as (
            select t.word from taken t join taken u on u.word = t.word and u.position = t.position + 2 join places p on p.word = u.word and p.position = u.position
            join merges m on m.l = t.merged and m.r = p.token where m.merged < t.merged
        ),
        moved as (
            select p.word, p.position, coalesce(t.merged, p.token) as token, lag(t.merged) over (partition by p.word order by p.position) is not null as gone
            from places p semi join best using (word) left join taken t on t.word = p.word and t.position = p.position
        ),
        tokens as (select word, list(token order by position) as tokens from moved where not gone group by word)
        select word, t.tokens, b.merged, s.wrong or b.merged < s.rank or word in (select word from between)
        from tokens t join best b using (word) join state s using (word)
    )
)
select word, tokens, wrong from state order by word
"""

_DECODE = """
select i.word, string_agg(v.hex, '' order by i.position) as bytes
from (select word, unnest(ids) as id, unnest(range(len(ids))) as position from given_ids) i left join vocabulary v on v.id = i.id
group by i.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Every pair of tokens whose bytes together are a token: left, right, merged."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return left, right, merged


class Vocabulary:
    """A rank file as DuckDB tables, and its encoding and decoding queries."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks = read_ranks(path)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        left, right, merged = merge_rows(ranks)
        pairs = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})
        names = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        for name, rows in (("merges", pairs), ("vocabulary", names)):
            with self.given("given", rows):
                self.con.execute(f"create table {name} as select * from given")
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._automaton = None

    @contextmanager
    def given(self, name: str, rows: pa.Table):
        self.con.register(name, rows)
        yield
        self.con.unregister(name)

    def parts(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever no token that occurs in it reaches across."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self._automaton.add_word(token.decode("latin-1"), len(token))
            self._automaton.make_automaton()
        cover = np.zeros(len(piece) + 1, np.int32)
        for end, size in self._automaton.iter(piece.decode("latin-1")):
            cover[end - size + 2] += 1  # the first place inside the token
            cover[end + 1] -= 1
        cuts = np.flatnonzero(np.cumsum(cover[1:-1]) == 0) + 1
        return [piece[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)])]

    def contract(self, words: list[bytes], query: str = _ONE) -> list[np.ndarray]:
        """The ids of each word."""
        tokens = [np.array([self.ranks[w]], np.int32) if w in self.ranks else self.single[np.frombuffer(w, np.uint8)] for w in words]
        sizes = np.array([len(t) for t in tokens], np.int64)
        out: list[np.ndarray] = []
        ends, at = np.cumsum(sizes), 0
        while at < len(words):
            stop = max(at + 1, min(at + AT_ONCE, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, "right"))))
            own = sizes[at:stop]
            position = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            start = pa.table({"word": pa.array(np.repeat(np.arange(len(own)), own), pa.int32()), "position": pa.array(position, pa.int32()), "token": pa.array(np.concatenate(tokens[at:stop]), pa.int32())})
            with self.given("start_tokens", start):
                found = self.con.sql(query).to_arrow_table()
            lists, wrong = found.column("tokens").combine_chunks(), np.flatnonzero(found.column("wrong").to_numpy())
            cuts = lists.offsets.to_numpy()
            ids = np.split(lists.flatten().to_numpy(), (cuts[1:-1] - cuts[0]))
            for i, again in zip(wrong.tolist(), self.contract([words[at + i] for i in wrong]) if len(wrong) else ()):
                ids[i] = again
            out += ids
            at = stop
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG or p in self.ranks]
        for i, ids in zip(short, self.contract([pieces[i] for i in short])):
            out[i] = ids
        long = [i for i, x in enumerate(out) if x is None]
        if long:
            cut = [self.parts(pieces[i]) for i in long]
            distinct = sorted({w for x in cut for w in x})
            known = dict(zip(distinct, self.contract(distinct, _ALL)))
            for i, words in zip(long, cut):
                out[i] = np.concatenate([known[w] for w in words])
        return out

    def decode(self, ids: list[np.ndarray] | pa.Array) -> list[bytes]:
        """The bytes of each list of ids; a null list has none. An id that isn't in the vocabulary is an error."""
        ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.list_(pa.int32()))
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out, ends, at = [], np.cumsum(sizes), 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, "right")))
            rows = pa.table({"word": pa.array(np.arange(stop - at), pa.int32()), "ids": ids[at:stop]})
            with self.given("given_ids", rows):
                found = dict(self.con.execute(_DECODE).fetchall())
                wrong = self.con.execute("select id from (select unnest(ids) as id from given_ids) anti join vocabulary using (id) limit 1").fetchone()
            if wrong:
                raise ValueError(f"id {wrong[0]} isn't in the vocabulary")
            out += [bytes.fromhex(found.get(i) or "") for i in range(stop - at)]
            at = stop
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def duckdb_encoder(path: str) -> Encoder:
    """Known pieces are (ids as decimal text, number of ids, decoded bytes); the bytes are decoded from the ids alone."""
    own = vocabulary(path)

    def encode(pieces: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        ids = own.encode(pieces)
        return [(b",".join([b"%d" % i for i in x.tolist()]), len(x), back) for x, back in zip(ids, own.decode(ids))]

    return Encoder(encode)


def _round_trip(path: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = duckdb_encoder(path)
        for chunk in chunks(batches):
            codes, known, firsts = encoder.pieces(chunk)
            ids, decoded = (np.array([x[k] for x in known] + [None], object)[:-1] for k in (0, 2))
            counts = np.array([x[1] for x in known], np.int64)
            total = np.append(0, np.cumsum(counts[codes]))
            ids, decoded = ids[codes].tolist(), decoded[codes].tolist()
            spans = list(zip(firsts[:-1].tolist(), firsts[1:].tolist()))
            texts = [b",".join(ids[a:b]) for a, b in spans]
            back = [b"".join(decoded[a:b]) for a, b in spans]
            out = {"doc_id": chunk.column("doc_id"), "n_tokens": pa.array(np.diff(total[firsts]), pa.int64())}
            if whole:
                out |= {"ids": pa.array([np.array(x.split(b","), np.int32) if x else np.zeros(0, np.int32) for x in texts], pa.list_(pa.int32())), "decoded": pa.array(back, pa.binary())}
            else:
                out |= {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in texts], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes of every text."""
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path, True), "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas) and decoded_sha256 of every text."""
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_ids"))
            back = [None if not x.is_valid else y for x, y in zip(own, vocabulary(path).decode(own))]
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_ids"} | {"decoded": pa.array(back, pa.binary())})

    return run


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and the decoded bytes of every row's array of ids, by ordered aggregation. A null array gives NULL; a null id counts for nothing."""
    given = df.select(F.col(key), F.filter(F.col(ids), lambda x: x.isNotNull()).cast("array<int>").alias("_ids"))
    schema = T.StructType([given.schema[key], T.StructField("decoded", T.BinaryType())])
    return given.mapInArrow(_decode(path), schema)
