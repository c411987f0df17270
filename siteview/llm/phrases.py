"""Phrase collocations by vertically partitioned suffix trees.

Every word opens a suffix of at most three words that ends with its piece. A batch of texts turns into partial subtrees,
one for each (lang, slot), where a slot is a range of hashes of the first word; equal suffixes of a batch are one leaf with a
count. Slots are packed to groups whose leaves fit a budget; a slot over the budget has its prefixes extended by a word and
is dealt over several groups. Each group merges its partial subtrees on its own and reads counts off its leaves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, stored

#: Ranges of first words, leaves that a group may hold, bytes of text in a batch, and words in a suffix.
SLOTS, BUDGET, BATCH, DEPTH = 1024, 1_000_000, 6 << 20, 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False

_TREE = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("leaves", pa.int64()), ("words", pa.binary()), ("path", pa.binary()), ("counts", pa.binary())])
_TREE_DDL = "lang string, slot int, leaves long, words binary, path binary, counts binary"
_NODE_DDL = "lang string, w1 string, w2 string, w3 string, f long"


def _suffixes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of the texts and, for every word, the places in them of its suffix, plus one; 0 past its end."""
    raw = _LOWER[np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)]
    word = np.concatenate([[False], _WORD[raw], [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word[1:-1]].tobytes())])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    path = np.zeros((len(codes), DEPTH), np.int32)
    for d in range(min(DEPTH, len(codes))):
        path[: len(codes) - d, d] = np.where(piece[d:] == piece[: len(codes) - d], codes[d:], 0)
    return np.array(coded.dictionary.to_pylist() or [b""], object), path


def _leaves(path: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sum of their counts."""
    bits = int(path.max(initial=0)).bit_length()
    if bits * DEPTH <= 63:  # a row packs into one number
        key = np.zeros(len(path), np.int64)
        for d in range(DEPTH):
            key = (key << bits) | path[:, d].astype(np.int64)
        order = np.argsort(key, kind="stable") if counts is not None else None
        key = key[order] if order is not None else np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rows = np.column_stack([(key[first] >> (bits * (DEPTH - 1 - d))) & ((1 << bits) - 1) for d in range(DEPTH)])
    else:
        order = np.lexsort([path[:, d] for d in reversed(range(DEPTH))])
        path = path[order]
        first = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]).any(axis=1)]))
        rows = path[first]
    if counts is None:
        return rows, np.diff(np.concatenate([first, [len(path)]]))
    return rows, np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _slot(lang: str, word: bytes, slots: int) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode() + b" ")) % slots


def _packed(lang: str, slots: np.ndarray, words: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One record for each run of equal slots, with the words that its rows name."""
    cut = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    out: list[tuple] = []
    for lo, hi in zip(cut, [*cut[1:], len(slots)], strict=True):
        named, place = np.unique(rows[lo:hi], return_inverse=True)
        shift = 0 if named[0] == 0 else 1
        own = words[named[1 - shift :] - 1]
        out.append((lang, int(slots[lo]), int(hi - lo), b"\n".join(own), (place.reshape(-1, DEPTH) + shift).astype(np.int32).tobytes(), counts[lo:hi].astype(np.int64).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_TREE)], schema=_TREE)


def _partial(slots: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            words, path = _suffixes(held.pop(lang))
            size.pop(lang)
            if len(path):
                # places of words follow their slots, so that the leaves of a slot stand together
                of = np.array([_slot(lang, w, slots) for w in words])
                order = np.argsort(of, kind="stable")
                place = np.zeros(len(words) + 1, np.int32)
                place[order + 1] = np.arange(1, len(words) + 1, dtype=np.int32)
                rows, counts = _leaves(place[path], None)
                yield _packed(lang, of[order][rows[:, 0] - 1], words[order], rows, counts)
                pa.default_memory_pool().release_unused()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if sum(size.values()) >= batch_bytes:
                    yield from flush(max(size, key=size.__getitem__))
        for lang in list(held):
            yield from flush(lang)

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, rows, counts) of the partial subtrees of one language taken together."""
    lists = [x.split(b"\n") for x in table.column("words").to_pylist()]
    coded = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode()
    codes, at, paths = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1, 0, []
    for words, path in zip(lists, table.column("path").to_pylist(), strict=True):
        own = np.concatenate([codes[:0], [0], codes[at : at + len(words)]]).astype(np.int32)
        paths.append(own[np.frombuffer(path, np.int32).reshape(-1, DEPTH)])
        at += len(words)
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    rows, counts = _leaves(np.concatenate(paths), counts)
    return np.array(coded.dictionary.to_pylist(), object), rows, counts


def _langs(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    for lang in sorted(pc.unique(table.column("lang")).to_pylist()):
        yield lang, table.filter(pc.equal(table.column("lang"), lang))


def _subtree(least: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for lang, part in _langs(table):
            words, rows, counts = _merged(part)
            text = pa.array([None, *words], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            for d in range(1, DEPTH + 1):
                first = np.flatnonzero(np.concatenate([[True], (rows[1:, :d] != rows[:-1, :d]).any(axis=1)]))
                total = np.add.reduceat(counts, first)
                # a first word may have leaves in other groups; a longer prefix has all of them here
                keep = (rows[first, d - 1] > 0) & ((total >= least) | (d == 1))
                named = [text.take(pa.array(rows[first[keep], k])) if k < d else pa.nulls(int(keep.sum()), pa.string()) for k in range(DEPTH)]
                out.append(pa.table([pa.array([lang] * int(keep.sum()), pa.string()), *named, pa.array(total[keep].astype(np.int64))], names=["lang", "w1", "w2", "w3", "f"]))
        return pa.concat_tables(out)

    return run


def _dealt(first: np.ndarray, parts: np.ndarray):
    """Give each partial subtree its group; one whose slot has several is cut by the hash of its first two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(1).to_numpy()
            whole = np.flatnonzero(parts[slots] == 1)
            if len(whole):
                part = batch.take(pa.array(whole))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first[slots[whole]], pa.int32()), *part.columns[2:]], schema=_TREE)
            for at in np.flatnonzero(parts[slots] > 1):
                one = pa.Table.from_batches([batch.slice(at, 1)])
                words, rows, counts = _merged(one)
                text = [b"", *words]
                near = {x: zlib.crc32(text[x[0]] + b" " + text[x[1]]) for x in set(zip(rows[:, 0].tolist(), rows[:, 1].tolist(), strict=True))}
                group = first[slots[at]] + np.array([near[x] for x in zip(rows[:, 0].tolist(), rows[:, 1].tolist(), strict=True)]) % parts[slots[at]]
                order = np.argsort(group, kind="stable")
                yield _packed(one.column("lang")[0].as_py(), group[order], words, rows[order], counts[order])

    return run


def groups(loads: dict[int, int], slots: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each slot: neighbours share a group while their leaves fit the budget."""
    first, parts, at, filled = np.zeros(slots, np.int64), np.ones(slots, np.int64), 0, 0
    for slot in range(slots):
        load = loads.get(slot, 0)
        if filled and filled + load > budget:
            at, filled = at + 1, 0
        first[slot] = at
        filled += load
        if load > budget:
            parts[slot] = -(-load // budget)
            at, filled = at + int(parts[slot]), 0
    return first, parts


def phrase_counts(documents: DataFrame, least: int = 10, slots: int = SLOTS, budget: int = BUDGET, batch: int = BATCH) -> DataFrame:
    """(lang, w1, w2, w3, f): occurrences of every word and of the phrases of two and three words that come at least
    ``least`` times; w2 and w3 are null where a phrase ends. Texts are split to pieces at ``.,;:!?`` and line ends, and
    pieces to words at spaces and tabs; A-Z are lower-cased; a null lang is ``und``, a null text empty. Rows count as often
    as they occur. What the driver holds is ``slots`` numbers."""
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    trees = stored(docs.mapInArrow(_partial(slots, batch), _TREE_DDL), **LARGE_ROWS)
    loads = {r["slot"]: r["n"] for r in trees.groupBy("slot").agg(F.sum("leaves").alias("n")).collect()}
    first, parts = groups(loads, slots, budget)
    nodes = trees.mapInArrow(_dealt(first, parts), _TREE_DDL).groupBy("slot").applyInArrow(_subtree(least), _NODE_DDL)
    return stored(nodes)


def collocations(documents: DataFrame, least: int = 10, share: int = 50, top: int = 2000, **how: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    A phrase that comes a times and is cut after its first k words into parts that come l and r times scores
    floor(1000000 * a * a / (l * r)); the lowest cut counts, the smallest k of equals. A phrase inside a longer one that comes
    at least ``share`` per cent as often is left out. Order: score and a descending, phrase in byte order. Tables without
    words give no rows.
    """
    nodes = phrase_counts(documents, least, **how)
    words = nodes.where("w2 IS NULL").groupBy("lang", "w1").agg(F.sum("f").alias("f"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    pairs, triples = (nodes.where(x).withColumnRenamed("f", "a") for x in ("w2 IS NOT NULL AND w3 IS NULL", "w3 IS NOT NULL"))

    def word(name: str, count: str) -> DataFrame:
        return words.select("lang", F.col("w1").alias(name), F.col("f").alias(count))

    def pair(one: str, two: str, count: str) -> DataFrame:
        return pairs.select("lang", F.col("w1").alias(one), F.col("w2").alias(two), F.col("a").alias(count))

    def cut(k: int, left: str, right: str) -> Column:
        exact = F.expr(f"(1000000BD * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")
        return F.struct(exact.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    longer = triples.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("_longest"))
    two = pairs.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("_longest") < share * F.col("a"), F.lit(True)))
    two = two.join(word("w1", "_l"), ["lang", "w1"]).join(word("w2", "_r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(1, "_l", "_r").alias("best"))
    three = triples.join(word("w1", "_l1"), ["lang", "w1"]).join(pair("w2", "w3", "_r1"), ["lang", "w2", "w3"])
    three = three.join(pair("w1", "w2", "_l2"), ["lang", "w1", "w2"]).join(word("w3", "_r2"), ["lang", "w3"])
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, "_l1", "_r1"), cut(2, "_l2", "_r2")).alias("best"))
    rows = two.unionByName(three).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*by)  # a language may hold most phrases
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
