"""MinHash near-duplicate groups through a multi-index Hamming join.

Every distinct shingle set gets a signature of ``CHUNKS * WIDTH`` MinHash symbols of 8 bits. Two sets of
Jaccard similarity J differ in about (1 - J) of the symbols. The signature is cut into CHUNKS chunks; by the
pigeonhole principle two signatures that differ in fewer than ``2 * CHUNKS`` symbols differ in at most one
symbol of some chunk. Each chunk is indexed once for each single symbol left out, so every pair of
signatures within distance ``2 * CHUNKS - 1`` (23 of 72) meets in a bucket. At J = 0.8 the distance is 14.3
on average; that a link of exactly J = 0.8 meets in no bucket has a chance of about 3 in a million.

Buckets never emit all their pairs. Two rounds test each member with one member that stands for its bucket, first in
buckets of whole chunks, then in all, and contract what the full sets confirm; pairs inside a component are never
looked at again. Buckets that still hold several components are searched for signatures within distance FAR, which
join components to families; in a family the sets outside its largest component meet each other and that component
in blocks of BLOCK, and every pair of sets is tested in the block's task. Nothing is capped. All joins are merge joins:
what they join grows with the input, so none of it is broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored

CHUNKS, WIDTH = 12, 6
SYMBOLS = CHUNKS * WIDTH
#: Signatures at a larger distance are not of one family; J = 0.8 lies 4.6 standard deviations below it.
FAR = 30
#: Sets of a block; a family of more meets block by block.
BLOCK = 256
#: Central members of its buckets that a member is tested with before the search.
CENTRES = 3


class WordIds(dict):
    """64-bit ids of words, hashed once a task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:  # only a memo
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(values: np.ndarray, by: np.ndarray) -> bytes:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        np.minimum(low, (values[at : at + 4096, None] * by).min(axis=0), out=low)
    return ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(documents: DataFrame, shingle: int = 2) -> DataFrame:
    """(doc_id, n_shingles, digest, sig): digest names the set; null for a set without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids, by = WordIds(), _multipliers()
        for batch in batches:
            n, digest, sig = [], [], []
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(1).slice(at, 500).to_pylist():
                    s = shingle_set(text, shingle, ids)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(_signature(s, by) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sig"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _keys() -> Column:
    """One key for each chunk and each symbol of it that is left out."""
    out = []
    for c in range(CHUNKS):
        for w in range(WIDTH):
            first, rest = F.substring("sig", c * WIDTH + 1, w), F.substring("sig", c * WIDTH + w + 2, WIDTH - 1 - w)
            out.append(F.xxhash64(F.lit(c * WIDTH + w), first, rest))
    return F.explode(F.array(*out))


def _distance(a: str, b: str) -> Column:
    """Symbols that differ between two signatures held as arrays of longs."""

    def differing(x: Column) -> Column:
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    total = F.lit(0)
    for k in range(SYMBOLS // 8):
        total = total + differing(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _as_longs() -> Column:
    return F.array(*[F.conv(F.hex(F.substring("sig", 8 * k + 1, 8)), 16, -10).cast("long") for k in range(SYMBOLS // 8)])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): label is the smallest node of the component.

    Smallest labels pass along links, then labels are replaced by their own labels; each round is checkpointed.
    Joins are on checkpointed tables, so that Spark can split the many links of one node over tasks.
    """
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = edges.join(labels.hint("merge"), edges.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        hooked = checkpointed(labels.join(heard.hint("merge"), "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was")))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = checkpointed(hooked.join(up.hint("merge"), "label").select("node", F.col("above").alias("label"), "was"))
        changed = jumped.where(F.col("label") != F.col("was")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _with_rarity(classes: DataFrame) -> DataFrame:
    """Adds rarity: low for a signature of common symbols, which is the centre of a large group of near copies.

    Counts every symbol at every place over all classes; the table of SYMBOLS * 256 counts is all that comes to the driver.
    """

    def slots(batch: pa.RecordBatch, column: int) -> np.ndarray:
        sigs = b"".join(batch.column(column).to_pylist())
        return np.frombuffer(sigs, np.uint8).reshape(-1, SYMBOLS).astype(np.int64) + np.arange(SYMBOLS) * 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * 256, np.int64)
        for batch in batches:
            total += np.bincount(slots(batch, 0).ravel(), minlength=len(total))
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["slot", "n"])

    common = np.zeros(SYMBOLS * 256)
    for r in classes.select("sig").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        common[r["slot"]] = np.log(r["n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rarity = -common[slots(batch, 4)].sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rarity)], [*batch.schema.names, "rarity"])

    rows = classes.select("digest", "doc_id", "node", "n", "sig")
    return rows.mapInArrow(score, "digest binary, doc_id long, node long, n long, sig binary, rarity double")


def _alike(percent: int) -> Column:
    """Whether sets of n and m items, with signatures x and y, can be linked."""
    return (_distance("x", "y") <= FAR) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)


def _stars(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Blocks (family, i, j) of members with the central members of their buckets (key, node, centre)."""
    centres = members.where("node <> centre.node").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("centre")), 1, CENTRES).alias("c"))
    pairs = centres.select(F.explode("c.node").alias("a"), "node")
    one = known.select(F.col("node").alias("a"), F.col("longs").alias("x"), "n")
    two = known.select("node", F.col("longs").alias("y"), F.col("n").alias("m"))
    pairs = checkpointed(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "node").where(_alike(percent)).select("a", "node"))
    sizes = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    dealt = pairs.join(sizes.hint("merge"), "a").select(F.col("a").alias("family"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), "node")
    middle = sizes.select(F.col("a").alias("family"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("a").alias("node"))
    return dealt.union(middle).select("family", "i", F.col("i").alias("j"), F.col("i").alias("own"), "node", F.col("node").alias("label"))


def _contracted(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with a label for each node: the smallest node it is linked with, then that node's label; a part of its
    component."""
    least = links.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("low"))
    hooked = checkpointed(known.join(least.hint("merge"), "node", "left").withColumn("label", F.coalesce("low", "node")).drop("low"))
    above = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return checkpointed(hooked.join(above.hint("merge"), "label").withColumn("label", F.col("above")).drop("above"))


def _rest(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Blocks (family, i, j) of what the stars left apart: labels that signatures within FAR join in some bucket are
    one family. Blocks below 0 hold its largest label; they meet the others, which also meet each other."""
    of = members.select("key", "node").join(known.select("node", "label", "n", "longs").hint("merge"), "node")
    mixed = of.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = checkpointed(of.join(mixed.hint("merge"), "key", "left_semi"))
    family = connected_components(_near_labels(left, percent)).select(F.col("node").alias("label"), F.col("label").alias("family"))
    rows = checkpointed(known.join(family.hint("merge"), "label").select("family", "label", "node"))
    counts = rows.groupBy("family", "label").agg(F.count("*").alias("m"))
    sizes = counts.groupBy("family").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.max("m").alias("large"), F.sum("m").alias("all"))
    sizes = sizes.select("family", "largest", F.ceil(F.col("large") / BLOCK).cast("int").alias("large"), F.ceil((F.col("all") - F.col("large")) / BLOCK).cast("int").alias("small"))
    rows = rows.join(checkpointed(sizes).hint("merge"), "family")
    inside = F.col("label") == F.col("largest")
    own = F.when(inside, -1 - F.pmod(F.xxhash64("node"), F.col("large"))).otherwise(F.pmod(F.xxhash64("node"), F.col("small"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(inside, 0).otherwise(-F.col("large")), F.col("small") - 1)))
    return rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")


class _Union(dict):
    """Union-find over the labels that a task meets."""

    def top(self, x: int) -> int:
        while (y := self.setdefault(x, x)) != x:
            self[x] = x = self[y] = self.setdefault(y, y)
        return x

    def tops(self, labels: np.ndarray) -> np.ndarray:
        u, of = np.unique(labels, return_inverse=True)
        return np.array([self.top(x) for x in u.tolist()], np.int64)[of]

    def join(self, x: int, y: int) -> bool:
        """Whether ``x`` and ``y`` were apart."""
        x, y = self.top(x), self.top(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _near_labels(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels (a, b) that span, in every bucket, the members of different labels whose signatures are within FAR.
    Buckets of many members are searched in pairs of blocks; what a task has joined it does not compare again."""
    size = 4 * BLOCK
    counts = checkpointed(left.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")).where("blocks > 1"))
    rows = left.join(counts.hint("merge"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "label", "n", "longs")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def search(part: pa.Table, union: _Union) -> list[tuple[int, int]]:
        label, n = part.column("label").to_numpy(), part.column("n").to_numpy()
        top = union.tops(label)
        if (top == top[0]).all():
            return []
        sig = part.column("longs").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(n), -1)
        values, count = np.unique(top, return_counts=True)
        found = []
        for k in np.nonzero(top != values[count.argmax()])[0].tolist():
            top = union.tops(label) if found else top
            other = np.nonzero((top != top[k]) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent))[0]
            near = other[(sig[other] != sig[k]).sum(axis=1) <= FAR]
            found += [(int(label[k]), x) for x in np.unique(label[near]).tolist() if union.join(int(label[k]), x)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        union = _Union()
        for batch in _then_none(batches):
            found: list[tuple[int, int]] = []
            if batch is not None and batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            if held and (batch is None or sum(t.num_rows for t in held) > 20_000):
                part = pa.concat_tables(held).combine_chunks()
                k, i, j = (part.column(c).to_numpy() for c in ("key", "i", "j"))
                cut = np.nonzero((np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))[0] + 1
                edges = [0, *cut.tolist()]
                if batch is None:
                    edges.append(part.num_rows)
                for x, y in zip(edges, edges[1:], strict=False):
                    found += search(part.slice(x, y - x), union)
                held = [part.slice(edges[-1])] if edges[-1] < part.num_rows else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _tested(percent: int):
    """Spanning links between the labels of a block: all its pairs of sets, by products of 0/1 rows over its items."""

    def run(part: pa.Table) -> pa.Table:
        _, first = np.unique(part.column("node").to_numpy(), return_index=True)
        label, own = part.column("label").to_numpy()[first], part.column("own").to_numpy()[first]
        pairs: list[tuple[int, int]] = []
        if (label != label[0]).any():
            items = part.column("items").combine_chunks()
            sets = [items[int(k)].values.to_numpy() for k in first]
            sizes = np.array([len(x) for x in sets])
            shared = np.zeros((len(sets), len(sets)))
            flat = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), sizes)
            _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
            # items of one set only add nothing to an intersection
            keep = seen[column] > 1
            row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
            for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
                here = (column >= at) & (column < at + 4096)
                m = np.zeros((len(sets), 4096), np.float32)
                m[row[here], column[here] - at] = 1
                shared += m @ m.T
            linked = shared * 100 >= percent * (sizes[:, None] + sizes[None, :] - shared)
            one = part.column("i")[0].as_py() == part.column("j")[0].as_py()
            linked = np.triu(linked & (label[:, None] != label[None, :]) & ((own[:, None] != own[None, :]) | one), 1)
            union = _Union()
            pairs = [(a, b) for a, b in ((int(label[x]), int(label[y])) for x, y in np.argwhere(linked)) if union.join(a, b)]
        return pa.table([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    return run


def _links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that span the labels in each block of ``placed``."""
    return checkpointed(placed.join(sets.hint("merge"), "node").groupBy("family", "i", "j").applyInArrow(_tested(percent), "a long, b long"))


def near_duplicate_groups(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their shingle sets.

    Returns doc_id, n_shingles, component_id, kept, one row for each input row. Null and empty texts have no
    shingles and are linked with nothing. Equal sets are one class and are never expanded into pairs. A row
    with a null doc_id links nothing, has the component of its class and is kept only if that is null too.
    Repeated rows share their decision; a text that comes under several ids counts under the smallest.
    """
    rows = checkpointed(signatures(documents, shingle))
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = checkpointed(_with_rarity(checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))))
    keys = classes.select("node", "rarity", _keys().alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("rarity", "node")).alias("centre"), F.count("*").alias("of")).where("of > 1").select("key", "centre")
    members = checkpointed(keys.select("key", "node").join(buckets.hint("merge"), "key"))
    candidates = checkpointed(classes.join(members.select("node").distinct().hint("merge"), "node"))
    sets = stored(_sets(documents, candidates, shingle))
    known = candidates.select("node", "n", _as_longs().alias("longs"))
    central = _links(_stars(members, known, percent), sets, percent)
    others = _links(_rest(members, _contracted(known, central), percent), sets, percent)
    labels = connected_components(central.union(others))

    named = classes.join(labels.hint("merge"), "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
    named = checkpointed(named)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = checkpointed(named.join(checkpointed(least).hint("merge"), "label").select("digest", "component_id"))
    empty = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("digest is not null").join(of.hint("merge"), "digest", "left").select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets(documents: DataFrame, candidates: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of the candidates, worked out again from the text that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(text, shingle, ids) for text in part.column(2).to_pylist()]
                # an id may name several texts
                right = [xxhash.xxh3_128_digest(x.tobytes()) == y for x, y in zip(sets, part.column(1).to_pylist(), strict=True)]
                sets = [x if y else x[:0] for x, y in zip(sets, right, strict=True)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), items], ["node", "items"]).filter(pa.array(right, pa.bool_()))

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    joined = texts.join(candidates.select("doc_id", "node", "digest").hint("merge"), "doc_id").select("node", "digest", "text")
    return joined.mapInArrow(run, "node long, items array<long>")
