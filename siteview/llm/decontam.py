"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

The CGK random walk turns a string into a longer one: at step j it writes the current character and moves on by
a random bit that depends on (j, character), so strings at a small edit distance agree in most places. Sampling
a few of those places gives a key. Windows are much shorter than an item and start at every word (of short items at
every byte), in the texts as in the items, so that a copy holds many windows of which any one suffices; walks and
samples are so many that at least TARGET of the copies at the largest distance share a key. A hit lines the item
up with the text; the edit distance over the 64 bytes round the hit, many hits at a time, leaves out most chance hits,
and the exact edit distance between the item and its best match there decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of copies at distance ``most`` = 0.2 that share a key with their item; the settings in CLASSES
#: reach it for the shortest items of their class (tests/llm/test_llm.py, at 10, 15 and 19 % edits, and each kind of edit
#: alone, random, evenly spread or in one stretch).
TARGET = 0.95
#: About how many bytes of items a pass takes, so that what each task is sent is bounded (12 keys a word).
BYTES_A_PASS = 5 << 20
#: (shortest item in bytes, steps of a walk, walks, samples of each walk, places in a sample, whether windows start at
#: every byte), longest items first. Below 16 bytes the pigeonhole principle leaves an unedited piece as long as the walk.
CLASSES = ((112, 36, 3, 4, 9, False), (64, 20, 3, 2, 7, False), (16, 10, 3, 2, 6, True), (9, 3, 1, 1, 3, True), (4, 2, 1, 1, 2, True), (1, 1, 1, 1, 1, True))
#: Bytes from start to start inside a run without spaces in a text; items start at every byte of such a run.
RUN = 8
#: Starts whose keys are made together, and hits that are looked at together.
STARTS, HITS = 1 << 15, 1 << 12
#: Bytes of text that are searched together, or one text; 2000 texts at most.
TEXT = 2_000_000
#: Size of items with room for a window and 64 bytes beside any one stretch of edits.
WIDE = 160
#: Bits of a key by which most keys that no item has are told.
SEEN = 22


def normalise(text: str | None) -> bytes:
    """Lower-case A-Z, one space between words."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _walks(steps: int, walks: int, samples: int, sampled: int) -> list[tuple[np.ndarray, list[list[int]]]]:
    """For each walk a word for each byte, whose bit j is its move at step j, and the sampled steps."""
    rng = np.random.default_rng(7_919 + steps)
    out = []
    for _ in range(walks):
        moves = rng.integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, 256, dtype=np.uint64)
        moves[0] = 0  # the walk stays in the padding
        out.append((moves, [sorted(rng.choice(steps, sampled, replace=False).tolist()) for _ in range(samples)]))
    return out


def window_keys(body: np.ndarray, starts: np.ndarray, walks: list[tuple[np.ndarray, list[list[int]]]]) -> Iterator[np.ndarray]:
    """The keys of the windows of ``body`` (bytes) that begin at ``starts``, one array for each sample of each walk."""
    one = np.uint64(1)
    for number, (moves, samples) in enumerate(walks):
        at = starts.astype(np.int64)
        words = moves.take(body)
        keys = [np.full(len(starts), number * len(samples) + k + 1, np.uint64) for k in range(len(samples))]
        for j in range(max(x[-1] for x in samples) + 1):
            c = words.take(at, mode="clip")
            for k, sample in enumerate(samples):
                if j in sample:
                    keys[k] ^= c
                    keys[k] *= np.uint64(0x9E3779B97F4A7C15)
            c >>= np.uint64(j)
            c &= one
            at += c.view(np.int64)
        for k in keys:
            yield k ^ (k >> np.uint64(32))


#: Bytes from a window's start whose three-byte pieces are sketched, and of the text, where edits shift them.
SKETCH, SHIFT = 32, 4


def _sketches(body: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each place of ``body`` (bytes), in two words: the hashed pieces of the SKETCH bytes from there on, and of
    ``more`` bytes after them."""
    x = np.concatenate([body, np.zeros(SKETCH + more + 2, np.uint8)]).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    h ^= h >> np.uint32(7)
    bit = np.uint64(1) << (h & np.uint32(63)).astype(np.uint64)
    high = (h & np.uint32(64)).astype(bool)
    out = []
    for lane in (np.where(high, np.uint64(0), bit), np.where(high, bit, np.uint64(0))):
        size = 1
        while size * 2 <= SKETCH - 2:
            lane = lane[:-size] | lane[size:]
            size *= 2
        rest = SKETCH - 2 - size
        lane = lane[: len(lane) - rest] | lane[rest:]
        if more:
            lane = lane[:-more] | lane[more:]
        out.append(lane[: len(body)])
    return out[0], out[1]


def _word_starts(body: np.ndarray, stride: int) -> np.ndarray:
    """Starts of words, and every ``stride``-th byte on of a word, so that runs without spaces have windows too."""
    gap = (body == 32) | (body == 0)
    first = np.nonzero(~gap[1:] & gap[:-1])[0] + 1
    sizes = np.nonzero(gap[1:] & ~gap[:-1])[0] + 1 - first
    long = sizes >= 2 * RUN
    if not long.any():
        return first
    n = (sizes[long] - 1) // stride
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    return np.sort(np.concatenate([first, np.repeat(first[long], n) + place * stride]))


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range of n, end to end."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same hits in fewer parts, of HITS or more."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(x.shape[1] for x in held) >= HITS:
            yield np.concatenate(held, axis=1)
            held = []
    if held:
        yield np.concatenate(held, axis=1)


def _local(patterns: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """``best_match`` of many patterns of up to 64 bytes (rows, with their sizes) with a text each."""
    n, one = len(patterns), np.uint64(1)
    peq = np.zeros(n << 8, np.uint64)
    row = np.arange(n) << 8
    for j in range(patterns.shape[1]):
        x = row + patterns[:, j]
        peq[x] |= np.where(j < sizes, one << np.uint64(j), np.uint64(0))
    high = (sizes - 1).astype(np.uint64)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = sizes.astype(np.int64)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = peq.take(row + texts[:, j])
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += (ph >> high & one).view(np.int64)
        score -= (mh >> high & one).view(np.int64)
        np.minimum(best, score, out=best)
        ph <<= one
        mh <<= one
        xv = eq | mv
        pv, mv = mh | ~(xv | ph), ph & xv
    return best


def best_match(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance between ``item`` and any substring of ``text``, and the first end of one that has
    it. Bit-parallel: one column of the table is two integers."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        xv = eq | mv
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, k
    return best, end


class Index:
    """Window keys of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.tables = []
        self.sizes = np.array([len(body) for _, body in items], np.int64)
        self.flat = np.frombuffer(b"".join(body for _, body in items) + bytes(64), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        taken: set[int] = set()
        for least, steps, n, samples, sampled, dense in CLASSES:
            walks = _walks(steps, n, samples, sampled)
            keys, of, offset, low, high = [], [], [], [], []
            for k, (_, body) in enumerate(items):
                if k in taken or len(body) < least:
                    continue
                taken.add(k)
                x = np.frombuffer(b"\0" + body + bytes(steps + 1), np.uint8)
                starts = np.arange(1, len(body) + 1) if dense else _word_starts(x, 1)
                starts = starts[(starts <= len(body) + 1 - steps * 2 // 3) | (starts == 1)]
                lo, hi = _sketches(x)
                for values in window_keys(x, starts, walks):
                    keys.append(values)
                    of.append(np.full(len(starts), k))
                    offset.append(starts - 1)
                    low.append(lo[starts])
                    high.append(hi[starts])
            if keys:
                values = np.concatenate(keys)
                order = np.argsort(values, kind="stable")
                of, offset, low, high = (np.concatenate(v)[order] for v in (of, offset, low, high))
                values, first, count = np.unique(values[order], return_index=True, return_counts=True)
                seen = np.zeros(1 << SEEN, bool)
                seen[(values & np.uint64((1 << SEEN) - 1)).astype(np.int64)] = True
                self.tables.append((walks, dense, values, first, count, of, offset, low, high, seen))

    def _hits(self, body: np.ndarray, most: float) -> Iterator[np.ndarray]:
        """(item, where the item would start, place of the window in the item) of windows with equal keys, in parts.

        Windows of long items must also share pieces: of those of the item's SKETCH bytes, all but what 1.2 times the
        edits would break are in the text's. A copy has windows on both sides of denser edits."""
        words = text_low = None
        share = max(0.0, 1 - 1.2 * most) ** 3
        for walks, dense, values, first, count, of, offset, low, high, seen in self.tables:
            if dense:
                starts = np.nonzero(body)[0]
            else:
                starts = words = _word_starts(body, RUN) if words is None else words
                if text_low is None:
                    text_low, text_high = _sketches(body, SHIFT)
            for at in range(0, len(starts), STARTS):
                part = starts[at : at + STARTS]
                a, z = int(part[0]), int(part[-1]) + 260
                for keys in window_keys(body[a:z], part - a, walks):
                    maybe = np.nonzero(seen.take((keys & np.uint64((1 << SEEN) - 1)).view(np.int64)))[0]
                    key = keys[maybe]
                    lo = np.searchsorted(values, key)
                    lo[lo == len(values)] = 0
                    right = values[lo] == key
                    maybe, lo = maybe[right], lo[right]
                    n = count[lo]
                    ends = np.cumsum(n)
                    x0 = 0
                    while x0 < len(n):  # many equal keys go on in several parts
                        x1 = max(x0 + 1, int(np.searchsorted(ends, (ends[x0 - 1] if x0 else 0) + 1_000_000, "right")))
                        x = _spread(first[lo[x0:x1]], n[x0:x1])
                        place = np.repeat(part[maybe[x0:x1]], n[x0:x1])
                        if not dense:
                            shared = np.bitwise_count(low[x] & text_low[place]) + np.bitwise_count(high[x] & text_high[place])
                            alike = shared >= share * (np.bitwise_count(low[x]) + np.bitwise_count(high[x]))
                            x, place = x[alike], place[alike]
                        yield np.stack([of[x], place - offset[x], offset[x]])
                        x0 = x1

    def regions(self, body: np.ndarray, ends: np.ndarray, most: float) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """{(document, item): stretches of ``body`` that may hold the item}. The place of a hit is rounded, since the
        windows of one copy shift by its edits. The 64 bytes from the window on (all of a shorter item) may differ by
        the item's edits, and from WIDE bytes on by 1.6 times their share of them: such a copy has windows on both sides of
        denser edits, in a shorter one they may all lie in the 64 bytes."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        begins = np.concatenate([[0], ends[:-1]]) + 1
        padded = np.concatenate([np.zeros(512, np.uint8), body, np.zeros(512, np.uint8)])
        known = np.zeros(0, np.int64)
        for of, place, offset in _gathered(self._hits(body, most)):
            _, at = np.unique(of << 36 | (place + (1 << 24)), return_index=True)
            of, place, offset = of[at], place[at], offset[at]
            span = np.maximum(16, self.sizes[of] // 4)
            near = []
            for a in range(0, len(of), HITS):
                k, start = of[a : a + HITS], offset[a : a + HITS]
                size = np.minimum(self.sizes[k], 64)
                edits = np.floor(most * self.sizes[k])
                begin = np.minimum(start, self.sizes[k] - size)
                patterns = self.flat.take((self.first[k] + begin)[:, None] + np.arange(int(size.max())), mode="clip")
                slack = int(min(edits.max(), 16))
                texts = padded.take((place[a : a + HITS] + begin + 512 - slack)[:, None] + np.arange(int(size.max()) + 2 * slack), mode="clip")
                near.append(_local(patterns, size, texts) <= np.where(self.sizes[k] < WIDE, edits, np.minimum(edits, int(most * 64 * 1.6))))
            if not near:
                continue
            keep = np.concatenate(near)
            of, place, span = of[keep], place[keep], span[keep]
            # places are counted in their document, whatever stands beside it
            doc = np.searchsorted(ends, place + offset[keep], "right")
            code = np.setdiff1d(of << 45 | doc << 34 | (place - begins[doc] + (1 << 24)) // span, known)
            known = np.union1d(known, code)
            for k, doc, place in zip((code >> 45).tolist(), (code >> 34 & 2047).tolist(), (code & ((1 << 34) - 1)).tolist(), strict=True):
                size = int(self.sizes[k])
                span = max(16, size // 4)
                place = place * span - (1 << 24) + int(begins[doc])
                slack = int(most * size) + span
                lo, hi = max(place - slack, int(begins[doc])), min(place + size + 2 * slack, int(ends[doc]))
                found.setdefault((doc, k), []).append((lo, hi))
        return found


def contaminated(documents: DataFrame, benchmark: DataFrame, most: float = 0.2) -> DataFrame:
    """(doc_id, item_id, distance, similarity): items of which a document holds a copy within edit distance
    ``most`` times the item's length, in the normalised text. One row for each document row and item.

    Null and empty items match nothing, null and empty texts hold nothing; items that repeat are reported under
    each id, rows without an item id or doc_id under null. Whole texts are searched; a document costs a pass
    for every BYTES_A_PASS bytes of the benchmark.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _item_blocks(benchmark):
        found = docs.mapInArrow(_search(block, most), "doc_id long, item_id long, distance int, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, most: float = 0.2) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, unchanged."""
    at = documents.columns.index("text")

    def clean(block: list[tuple[int, bytes]]):
        search = _hits(block, most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block)
            for batch in batches:
                for k in range(0, batch.num_rows, 2000):
                    part = batch.slice(k, 2000)
                    bad = {doc for doc, _ in search(index, part.column(at).to_pylist())}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        return run

    for block in _item_blocks(benchmark):
        documents = documents.mapInArrow(clean(block), documents.schema)
    return documents


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of about BYTES_A_PASS bytes; one block, if there are no items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_PASS))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found = [(r["item_id"], normalise(r["text"])) for r in block]
        yield [x for x in found if x[1]]


def _search_some(index: Index, bodies: list[bytes], most: float) -> dict[tuple[int, int], int]:
    whole = b"\0" + b"\0".join(bodies) + bytes(64)
    ends = np.cumsum([len(x) + 1 for x in bodies])
    hits: dict[tuple[int, int], int] = {}
    for (doc, k), parts in index.regions(np.frombuffer(whole, np.uint8), ends, most).items():
        item = index.items[k][1]
        merged: list[list[int]] = []
        for a, b in sorted(parts):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        distance = min(best_match(item, whole[a:b])[0] for a, b in merged)
        if distance <= most * len(item):
            hits[doc, k] = distance
    return hits


def _hits(items: list[tuple[int, bytes]], most: float):
    """Search of some texts: {(text number, item number): distance}."""

    def search(index: Index, texts: list[str | None]) -> dict[tuple[int, int], int]:
        hits: dict[tuple[int, int], int] = {}
        bodies: list[bytes] = []
        first = size = 0
        for n, text in enumerate(texts, 1):
            bodies.append(normalise(text))
            size += len(bodies[-1])
            if size >= TEXT or n - first >= 2000 or n == len(texts):
                hits |= {(first + doc, k): d for (doc, k), d in _search_some(index, bodies, most).items()}
                bodies, first, size = [], n, 0
        return hits

    return search


def _search(items: list[tuple[int, bytes]], most: float):
    search = _hits(items, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = sorted(search(index, part.column(1).to_pylist()).items())
                rows = [(part.column(0)[doc].as_py(), items[k][0], d, 1 - d / len(items[k][1])) for (doc, k), d in found]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "distance", "similarity"])

    return run
