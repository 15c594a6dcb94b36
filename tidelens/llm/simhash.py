"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's shingles,
repeats included. Fingerprints that differ in at most `budget` bits are linked, and documents get the smallest
doc_id of the fingerprints that links reach. Rows are judged one by one: two rows of one doc_id with different texts aren't linked by it.

Two linked fingerprints agree in at least one of budget + 1 blocks of bits. So distinct fingerprints are
dealt once for each block by that block's value, and what is dealt to a task is one trie, with the block's bits
first: node pairs are traversed together from the root, differing bits add up, and a pair is pruned once it exceeds
its budget (none in the block, then the rest). The budget is raised step by step, and node pairs whose leaves are all
in one component already are pruned too, so a large group of near copies doesn't cost the square of its size. Tasks give links
to the smallest member only. A value that very many fingerprints share is dealt again by blocks of the other bits. The number of tasks
follows the number of fingerprints, and a worker holds a bounded run of its sorted rows.

A fingerprint that more than a thousandth of all rows share is joined back to its rows by broadcast, not in one task.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle. A row with a null doc_id gets its component but isn't its smallest member. Repeated rows
and extra columns stay. A very long text is held in memory whole, by itself; its hashes are added up in steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm._spark import MANY_TASKS, forget, join_hot, parts, stable
from tidelens.llm._text import chunks, joined, word_spans

SHINGLE = 3
SEED = 42
BUDGET = 3
BITS = 64
#: Fingerprints with one block's value beyond which they are dealt by another block too.
HOT = 4096
#: Dealt codes of one task, up to MANY_TASKS tasks; beyond that tasks grow, and their rows stream through them sorted.
TASK_CODES = 100_000
#: Dealt codes that a worker holds at once, but for those of one value (HOT at most).
AT_ONCE = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            starts, ends, firsts = word_spans(chunk)
            data, _, starts, ends = joined(_LOWER[chunk.data], starts, ends, firsts)
            counts = np.diff(firsts)
            sizes = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
            offsets = np.append(0, np.cumsum(sizes))
            row = np.repeat(np.arange(chunk.rows), sizes)
            first = firsts[row] + np.arange(offsets[-1]) - offsets[row]
            last = np.minimum(first + shingle, firsts[row + 1]) - 1
            raw, digest = data.tobytes(), xxhash.xxh64_digest
            hashes = b"".join([digest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())])
            hashes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
            votes = np.zeros((chunk.rows, BITS), np.int64)
            for at in range(0, len(hashes), 1 << 15):
                part, own = hashes[at : at + (1 << 15)], row[at : at + (1 << 15)]
                cuts = np.flatnonzero(np.diff(own, prepend=-1))
                votes[own[cuts]] += np.add.reduceat(np.unpackbits(part, axis=1), cuts, axis=0, dtype=np.int64)
            bits = np.packbits(2 * votes > sizes[:, None], axis=1)
            found = pa.array(bits.reshape(-1).view(">u8").astype(np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_pydict({c: chunk.column(c) for c in chunk.batch.schema.names if c != "text"} | {"fingerprint_bits": found})

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint_bits (long) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint_bits long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: every component gets its smallest."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def trie_labels(codes: np.ndarray, exact: int, budget: int = BUDGET, at_once: int = 1 << 20) -> np.ndarray:
    """Component labels (indices of smallest members) of sorted distinct codes that agree in the first `exact` bits and differ in at most `budget`."""
    n = len(codes)
    labels = np.arange(n, dtype=np.int64)
    ones = {}
    for most in range(1, budget + 1):
        todo = [(0, np.array([[0], [n], [0], [n], [0]], np.int32))]
        pairs: list[np.ndarray] = []
        apart = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        while todo:
            depth, nodes = todo.pop()
            if nodes.shape[1] > at_once:  # depth first from here on, in halves
                half = nodes.shape[1] // 2
                todo += [(depth, nodes[:, :half]), (depth, nodes[:, half:])]
                continue
            al, ah, bl, bh, off = nodes
            if depth not in ones:
                ones[depth] = np.concatenate([[0], np.cumsum((codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int32)]).astype(np.int32)
            count = ones[depth]
            am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
            own = al == bl
            down = [np.stack([al, am, bl, bm, off]), np.stack([am, ah, bm, bh, off])]
            if depth >= exact:
                cross = off < most
                down.append(np.stack([al, am, bm, bh, off + 1])[:, cross])
                down.append(np.stack([am, ah, bl, bm, off + 1])[:, cross & ~own])
            nodes = np.concatenate(down, axis=1)
            al, ah, bl, bh, off = nodes
            keep = (ah > al) & (bh > bl) & ~((al == bl) & (ah == al + 1))
            nodes = nodes[:, keep]
            al, ah, bl, bh, off = nodes
            keep = ~((apart[ah - 1] == apart[al]) & (apart[bh - 1] == apart[bl]) & (labels[al] == labels[bl]))
            leaf = keep & (ah == al + 1) & (bh == bl + 1)
            a, b = al[leaf], bl[leaf]
            near = _popcount(codes[a] ^ codes[b]) <= most
            if near.any():
                pairs.append(np.stack([a[near], b[near]]))
            nodes = nodes[:, keep & ~leaf]
            if nodes.shape[1] and depth + 1 < BITS:
                todo.append((depth + 1, nodes))
            if pairs and (len(pairs) > 64 or not todo):
                a, b = np.concatenate(pairs, axis=1)
                labels, pairs = merge_labels(labels, a, b), []
                apart = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        if pairs:
            a, b = np.concatenate(pairs, axis=1)
            labels = merge_labels(labels, a, b)
    return labels


def _trie_links(exact: int, budget: int, at_once: int = AT_ONCE):
    """Of the codes of each deal, links of members to the smallest member of their component. Rows come sorted by deal and code.

    Codes that differ in their first `exact` bits aren't linked here, so the rows are worked on in runs that end where these bits change.
    """
    shift = np.uint64(BITS - exact)

    def found(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        deal, codes, vertex = rows
        cuts = np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(deal)]):
            order = np.argsort(codes[a:b])
            own = vertex[a:b][order]
            labels = trie_labels(codes[a:b][order], exact, budget)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            if len(linked):
                yield pa.RecordBatch.from_pydict({"a": pa.array(own[linked], pa.int64()), "b": pa.array(own[labels[linked]], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            deal, code, vertex = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("deal", "code", "vertex"))
            held.append((deal, code.view(np.uint64), vertex))
            if sum(len(x[0]) for x in held) < at_once:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held))
            ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] >> shift != rows[1][:-1] >> shift)) + 1
            if len(ends):
                yield from found(tuple(x[: ends[-1]] for x in rows))
                rows = tuple(x[ends[-1] :] for x in rows)
            held = [rows]
        if held:
            yield from found(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def _rotated(code: Column, bits: int) -> Column:
    bits %= BITS
    return F.shiftleft(code, bits).bitwiseOR(F.shiftrightunsigned(code, BITS - bits)) if bits else code


def _dealt(codes: DataFrame, budget: int) -> DataFrame:
    """Each code once for each block, with the block's bits first."""
    width = BITS // (budget + 1)
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("deal"), _rotated(F.col("code"), i * width).alias("code")) for i in range(budget + 1)])).alias("x")
    return codes.select("vertex", turns).select("vertex", "x.deal", "x.code", F.shiftrightunsigned("x.code", BITS - width).alias("value"))


def deal_tasks(rows: int) -> int:
    """How many tasks share out so many dealt codes."""
    return parts(rows, max(TASK_CODES, rows / MANY_TASKS))


def links(codes: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """a, b: links that connect all distinct codes (vertex, code) that differ in at most `budget` bits."""
    width = BITS // (budget + 1)
    dealt = _dealt(codes, budget)
    total = codes.count() * (budget + 1)
    # At most (budget + 1) * 2**width values: a bounded table.
    often = stable(dealt.groupBy("deal", "value").count().filter(F.col("count") > hot).select("deal", "value", F.lit(True).alias("often")))
    dealt = dealt.join(F.broadcast(often), ["deal", "value"], "left")
    found = dealt.filter("often is null").repartition(deal_tasks(total), "deal", "value").sortWithinPartitions("deal", "code").mapInArrow(_trie_links(width, budget), "a long, b long")
    if not often.isEmpty():
        # Within such a value, one of budget + 1 blocks of the other bits must agree as well.
        space = BITS - width
        inner = space // (budget + 1)
        tail = F.col("code").bitwiseAND(F.lit((1 << space) - 1))
        head = F.shiftleft("value", space)

        def turned(i: int) -> Column:
            spun = F.shiftleft(tail, i * inner).bitwiseOR(F.shiftrightunsigned(tail, space - i * inner)).bitwiseAND(F.lit((1 << space) - 1))
            return head.bitwiseOR(spun if i else tail)

        turns = F.explode(F.array(*[F.struct(F.xxhash64("deal", "value", F.lit(i)).alias("deal"), turned(i).alias("code")) for i in range(budget + 1)])).alias("x")
        rest = dealt.filter("often").select("vertex", turns).select("vertex", "x.deal", "x.code")
        rest = rest.withColumn("inner_value", F.shiftrightunsigned("code", space - inner))
        rest = rest.repartition(deal_tasks(total * (budget + 1)), "deal", "inner_value").drop("inner_value").sortWithinPartitions("deal", "code")
        found = found.union(rest.mapInArrow(_trie_links(width + inner, budget), "a long, b long"))
    return found


def components(found: DataFrame) -> DataFrame:
    """vertex, root: for every vertex of a link that isn't its component's smallest, that smallest.

    Alternating large-star and small-star steps until nothing changes; each step's rows are kept in the checkpoint folder.
    """
    edges = stable(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        before = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stable(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        lower = stable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stable(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
        forget(before, least, large, lower)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        seen = now


def _components(prints: DataFrame, budget: int, hot: int) -> DataFrame:
    """The rows of prints (doc_id, fingerprint_bits and more) with root, which names their component, and component_id, its smallest doc_id."""
    seen = stable(prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(seen.select(F.col("fingerprint_bits").alias("vertex"), F.col("fingerprint_bits").alias("code")), budget, hot))
    roots = roots.withColumnRenamed("vertex", "fingerprint_bits")
    placed = stable(seen.join(roots, "fingerprint_bits", "left").withColumn("root", F.coalesce("root", "fingerprint_bits")))
    least = stable(placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    sizes = placed.agg(F.sum("n"), F.count("*")).first()
    known = stable(join_hot(placed.withColumnRenamed("n", "rows"), least, "root", sizes[1]).select("fingerprint_bits", "root", "component_id", F.col("rows").alias("n")))
    return join_hot(prints, known, "fingerprint_bits", sizes[0] or 0)


def near_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    out = _components(stable(fingerprints(docs, shingle)), budget, hot)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows of a table of two longs that may be broadcast: 32 MB. A larger one is joined by a shuffle.
MOST_SENT = 2_000_000


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """One row of each component of docs: that with the smallest doc_id, and of rows that share it the one with the smallest text hash.

    Rows with a null doc_id stay. Of rows alike in doc_id and text one stays. All columns stay as they are, whatever their names.
    """
    names, id_, text = docs.columns, docs.columns.index("doc_id"), docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("hash", F.xxhash64(f"c{text}"))
    bare = plain.select(F.col(f"c{id_}").alias("doc_id"), F.col(f"c{text}").alias("text"), "hash")
    prints = stable(bare.mapInArrow(_fingerprints(shingle), "doc_id long, hash long, fingerprint_bits long"))
    rows = _components(prints, budget, hot).filter("doc_id is not null")
    keys = stable(rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.min("root").alias("root")))
    first = keys.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("k.doc_id", "k.hash", F.lit(True).alias("kept"))
    keys = stable(keys.join(first, ["doc_id", "hash"], "left").select("doc_id", "hash", "n", "kept"))
    on = (plain[f"c{id_}"] == F.col("doc_id")) & (plain["hash"] == F.col("key_hash"))

    def some(of: DataFrame) -> DataFrame:
        of = of.select("doc_id", F.col("hash").alias("key_hash"))
        return F.broadcast(of) if of.count() <= MOST_SENT else of

    out = plain.join(some(keys.filter("kept is null or n > 1")), on, "left_anti")
    again = keys.filter("kept and n > 1")
    if not again.isEmpty():
        # Rows alike in doc_id and text: combined within tasks before they are shuffled.
        out = out.unionByName(plain.join(some(again), on, "left_semi").dropDuplicates([f"c{id_}", "hash"]))
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
