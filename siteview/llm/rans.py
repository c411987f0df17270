"""Token ids on disk: a static range asymmetric numeral system with shared frequencies, in independent blocks.

A token file is a folder of two Parquet tables. ``table`` has the ids that occur and their frequencies, which sum to 2 **
BITS. ``blocks`` has whole documents in order: the ids of its documents, their lengths, and a body. A body starts with a
header, has a checkpoint for each segment (the state of every lane, the place in the word stream, the checksum of the
segment's ids), then the words, then a checksum of all that. Token t of a block is coded in lane t mod LANES; decoding can
start at any checkpoint, so segments decode side by side and a range of tokens reads only the segments that hold it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, shared_dir

#: Frequencies sum to 2 ** BITS; lanes of a block; rows of lanes in a segment; tokens from which a block is full.
BITS, LANES, ROWS, FULL = 20, 512, 256, 1 << 18
END = 2
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_MAGIC = 0x534E4152
_HEAD = np.dtype([("magic", "<u4"), ("bits", "<u4"), ("lanes", "<u4"), ("rows", "<u4"), ("tokens", "<u8"), ("words", "<u8"), ("table", "<u4"), ("segments", "<u4")])
_LOW = np.uint64(1 << 31)


class Table:
    """Frequencies of ids: ``ids`` ascending, ``freq`` at least 1 each, sum 2 ** BITS."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u8").tobytes(), zlib.crc32(self.ids.astype("<u4").tobytes()))
        self._slots: np.ndarray | None = None
        # the place of each id, where ids are small numbers, as those of a vocabulary are
        self._places = np.full(int(self.ids[-1]) + 1, -1, np.int32) if len(ids) and self.ids[-1] < 1 << 24 else None
        if self._places is not None:
            self._places[self.ids] = np.arange(len(ids), dtype=np.int32)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray, bits: int = BITS) -> Table:
        """Frequencies near the counts' shares. Every id keeps at least 1; what rounding leaves goes to the largest."""
        order = np.argsort(ids)
        ids, counts = ids[order], [int(c) for c in counts[order]]
        if not counts:
            return cls(ids, np.zeros(0))
        if len(counts) > 1 << bits:
            raise ValueError(f"{len(counts)} ids do not fit frequencies of {bits} bits")
        total, room = sum(counts), (1 << bits) - len(counts)
        freq = np.array([1 + c * room // total for c in counts], np.int64)
        freq[int(np.argmax(counts))] += (1 << bits) - int(freq.sum())
        return cls(ids, freq)

    def places(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and not len(self.ids):
            raise ValueError("an id is not in the table")
        if self._places is not None:
            place = self._places[np.minimum(ids, len(self._places) - 1)]
        else:
            place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        if len(ids) and (self.ids[place] != ids).any():
            raise ValueError("an id is not in the table")
        return place

    def slots(self) -> np.ndarray:
        """The place of the id that each of the 2 ** BITS slots belongs to."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, rows: int = ROWS) -> bytes:
    """The body of a block. The last row of lanes is filled up with the commonest id, which costs the least."""
    n = len(ids)
    place = table.places(ids)
    bits = np.uint64(int(table.freq.sum()).bit_length() - 1) if n else np.uint64(BITS)
    steps = -(-n // lanes)
    if n:
        place = np.concatenate([place, np.full(steps * lanes - n, int(np.argmax(table.freq)))])
    f, c = table.freq[place].reshape(steps, lanes), table.start[place].reshape(steps, lanes)
    full = f << (np.uint64(63) - bits)
    x = np.full(lanes, _LOW)
    words: list[np.ndarray] = [np.zeros(0, "<u4")] * steps
    marks: list[np.ndarray] = []
    for r in range(steps - 1, -1, -1):
        over = x >= full[r]
        if over.any():
            words[r] = x[over].astype("<u4")  # the low half
            x[over] >>= np.uint64(32)
        q = x // f[r]
        x = (q << bits) + (x - q * f[r]) + c[r]
        if r % rows == 0:
            marks.append(x.astype("<u8"))
    sizes = np.cumsum([0, *[len(w) for w in words]])
    segments = -(-steps // rows)
    at = np.array([sizes[g * rows] for g in range(segments)], "<u8")
    span = lanes * rows
    sums = np.array([zlib.crc32(ids[g * span : (g + 1) * span].astype("<u4").tobytes()) for g in range(segments)], "<u4")
    head = np.array([(_MAGIC, int(bits), lanes, rows, n, int(sizes[-1]), table.crc, segments)], _HEAD)
    body = b"".join([head.tobytes(), at.tobytes(), sums.tobytes(), *[m.tobytes() for m in reversed(marks)], *[w.tobytes() for w in words]])
    return body + zlib.crc32(body).to_bytes(4, "little")


def decode_block(body: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from ``start`` up to ``stop``. Only the segments that hold them are decoded, all side by side; a damaged body
    or segment, or another table than the encoder's, is an error."""
    if zlib.crc32(body[:-4]) != int.from_bytes(body[-4:], "little"):
        raise ValueError("the checksum of a block differs")
    head = np.frombuffer(body, _HEAD, 1)[0]
    if head["magic"] != _MAGIC or head["table"] != table.crc:
        raise ValueError("not a block of this table")
    bits, lanes, rows, n, segments = np.uint64(head["bits"]), int(head["lanes"]), int(head["rows"]), int(head["tokens"]), int(head["segments"])
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    span, at = lanes * rows, _HEAD.itemsize
    g0, g1 = start // span, -(-stop // span)
    read = np.frombuffer(body, "<u8", segments, at)[g0:g1].astype(np.int64)
    sums = np.frombuffer(body, "<u4", segments, at + 8 * segments)[g0:g1]
    at += 12 * segments
    x = np.frombuffer(body, "<u8", segments * lanes, at).reshape(segments, lanes)[g0:g1].astype(np.uint64)
    words = np.frombuffer(body, "<u4", int(head["words"]), at + 8 * segments * lanes).astype(np.uint64)
    slots, mask = table.slots(), np.uint64((1 << int(bits)) - 1)
    out = np.zeros((g1 - g0, rows, lanes), np.uint32)
    last = -(-n // lanes) - (segments - 1) * rows  # rows of the block's last segment
    for r in range(rows):
        if r == last and g1 == segments:  # the last segment ends before the others
            x, read = x[:-1], read[:-1]
        if not len(x):
            break
        slot = x & mask
        place = slots[slot]
        out[: len(x), r] = place
        x = table.freq[place] * (x >> bits) + slot - table.start[place]
        low = x < _LOW
        taken = np.cumsum(low, axis=1)
        x[low] = (x[low] << np.uint64(32)) | words[(read[:, None] + taken - 1)[low]]
        read = read + taken[:, -1]
    ids = table.ids[out.reshape(-1)]
    for k, g in enumerate(range(g0, g1)):
        if zlib.crc32(ids[k * span : min(n - g * span, span) + k * span].astype("<u4").tobytes()) != sums[k]:
            raise ValueError("the checksum of a segment differs")
    return ids[start - g0 * span : stop - g0 * span]


#: Spaces with another white-space character beside them, or at an end, are no places to cut.
_ODD = " [{0}]|[{0}] |^ | $".format(r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
#: Units that a worker remembers at most, and ids of them.
_KEPT, _IDS = 1_500_000, 12_000_000
#: Marks behind a word, and characters of text that are encoded at once.
_MARKS, _AT_ONCE = ".,;:!?", 6_000_000


def _strings(values: pa.Array) -> list[str]:
    """The values of an array, cut from one string unless the separator is in one of them."""
    if not len(values):
        return []
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string())), "\0")[0].as_py().split("\0")
    return out if len(out) == len(values) else values.to_pylist()


def _lines(unit: str) -> list[str]:
    """The lines of a unit and the line feeds between them, if no other white space is beside a line feed."""
    lines = unit.split("\n")
    if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
        return []
    return [lines[0], *(x for line in lines[1:] for x in ("\n", line))]


class Units:
    """Ids of texts by the tokenizer, unit by unit. A text is cut before single spaces between two characters that are no
    white space, where the tokenizer's own split always cuts; each distinct unit is encoded once and remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(vocabulary)
        feed = self.coder.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.ids, self.size = np.zeros(1 << 16, np.uint32), 0
        self.count = 0
        self.first, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units, without the space before them, and how many each text has."""
        odd = pc.match_substring_regex(texts, pattern=_ODD)
        if not pc.any(odd).as_py():
            lists = pc.split_pattern(texts, " ")
        else:
            import re

            cut = re.compile(r"(?<=\S) (?=\S)")
            lists = pa.array([cut.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(texts.type))
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def _learn(self, units: list[str], lead: int) -> np.ndarray:
        """The number of each unit; those not known are encoded. The tokenizer's split always cuts between a letter and a
        sentence's mark, and before and behind a line feed between characters that are no white space, so a unit of several
        lines, and one that ends in marks behind a letter, is put together from its parts."""
        known = self.known[lead]
        number = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        lost = np.flatnonzero(number < 0)
        if not len(lost):
            return number
        asked = [units[k] for k in lost.tolist()]
        new = list(dict.fromkeys(asked))
        lines = [(u, *x) for u in new if "\n" in u and (x := _lines(u))]
        if lines:  # their parts may be among the others
            self._compose(lines, lead)
            new = [u for u in new if u not in known]
        ends = [(u, w, u[len(w) :]) for u in new if u[-1:] in _MARKS and (w := u.rstrip(_MARKS)) and w[-1].isalpha()]
        apart = {u for u, *_ in ends}
        self._encode([u for u in new if u not in apart], lead)
        if ends:
            self._compose(ends, lead)
        number[lost] = np.fromiter(map(known.__getitem__, asked), np.int64, len(asked))
        return number

    def _compose(self, units: list[tuple[str, ...]], lead: int) -> None:
        """Keep units that are given with their parts; parts that are not known are encoded."""
        counts = np.fromiter((len(c) - 1 for c in units), np.int64, len(units))
        starts = np.cumsum(counts) - counts
        of, behind = np.zeros(int(counts.sum()), np.int64), np.ones(int(counts.sum()), bool)
        behind[starts] = False
        of[starts] = self._learn([c[1] for c in units], lead)
        of[behind] = self._learn([x for c in units for x in c[2:]], 0)
        sizes = self.length[of]
        flat = self.ids[np.repeat(self.first[of] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        self._keep([c[0] for c in units], lead, flat, np.add.reduceat(sizes, starts))

    def _encode(self, new: list[str], lead: int) -> None:
        """Encode units. Those without white space are encoded as lines of one text: the tokenizer's split always cuts before
        and behind a line feed there, and no other token is its id."""
        if not new:
            return
        lines = ("\n " if lead else "\n").join(["", *new, ""])
        if self.feed is not None and lines.split() == new:
            flat = np.array(self.coder.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(flat == self.feed)
            if lead:  # the last line is a space
                flat = flat[: at[-1]]
            lengths = np.diff(at) - 1
            self._keep(new, lead, flat[flat != self.feed], lengths)
            return
        if len(new) > 1:
            bare = [len(u.split()) == 1 and u.strip() == u for u in new]
            if any(bare) and not all(bare):
                self._encode([u for u, x in zip(new, bare, strict=True) if x], lead)
                self._encode([u for u, x in zip(new, bare, strict=True) if not x], lead)
                return
        coded = [x.ids for x in self.coder.encode_batch_fast([" " + u for u in new] if lead else new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self._keep(new, lead, np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths)

    def _keep(self, new: list[str], lead: int, flat: np.ndarray, lengths: np.ndarray) -> None:
        at = self.count
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while at + len(new) > len(self.first):
            self.first, self.length = (np.concatenate([a, np.zeros(len(a), np.int64)]) for a in (self.first, self.length))
        self.ids[self.size : self.size + len(flat)] = flat
        self.first[at : at + len(new)] = self.size + np.cumsum(lengths) - lengths
        self.length[at : at + len(new)] = lengths
        self.size += len(flat)
        self.count += len(new)
        self.known[lead].update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end``, and the number of ids of each."""
        texts = pc.fill_null(texts, "")
        if self.count > _KEPT or self.size > _IDS:
            self.clear()
        units, n = self._units(texts)
        coded = units.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lead = np.ones(len(codes), bool)
        lead[(np.cumsum(n) - n)[n > 0]] = False
        named = _strings(coded.dictionary)
        number = np.zeros(len(codes), np.int64)
        for which in (0, 1):
            mine = np.flatnonzero(lead == bool(which))
            used = np.flatnonzero(np.bincount(codes[mine], minlength=len(named)))
            if len(used):
                each = np.zeros(len(named), np.int64)
                each[used] = self._learn(named if len(used) == len(named) else [named[k] for k in used.tolist()], which)
                number[mine] = each[codes[mine]]
        lengths = self.length[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        of = np.repeat(self.first[number] - ends[:-1], lengths) + np.arange(ends[-1])
        edge = ends[np.cumsum(n)]
        sizes = np.diff(np.concatenate([[0], edge])) + 1
        return np.insert(self.ids[of], edge, end), sizes


_UNITS: dict[int, Units] = {}


def _coder(vocabulary: str) -> Units:
    key = hash(vocabulary)
    if key not in _UNITS:
        _UNITS.clear()
        _UNITS[key] = Units(vocabulary)
    return _UNITS[key]


_FILE = "start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, body binary"
_BLOCK = "part int, block long, at long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, ids binary"


def _tokenised(vocabulary: str, end: int, full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), _coder(vocabulary)
        docs: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        at = block = held = 0

        def closed() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = [[part], [block], [at], [held], [docs], [sizes], [flat.astype("<u2" if int(flat.max()) < 1 << 16 else "<u4").tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "block", "at", "n_tokens", "doc_ids", "doc_tokens", "ids"])

        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _AT_ONCE
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(lo, hi - lo)
                got, lengths = coder.encode(some.column(1), end)
                edge = 0
                for doc, n in zip(some.column(0).to_pylist(), lengths.tolist(), strict=True):
                    docs.append(doc)
                    sizes.append(n)
                    ids.append(got[edge : edge + n])
                    edge += n
                    held += n
                    if held >= full:
                        yield closed()
                        at, block, held = at + held, block + 1, 0
                        docs, sizes, ids = [], [], []
        if docs:
            yield closed()

    return run


def _flat(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.bincount(_flat(ids, n))
            if len(got) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
            counts[: len(got)] += got
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])


def write_tokens(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, full: int = FULL, lanes: int = LANES, rows: int = ROWS) -> None:
    """Write the ids of all whole texts, each closed by ``end``, to a token file at ``path``.

    Documents stand in ascending doc_id, null ids first, equal ids by a hash of the text; a null text is empty and has only
    ``end``. Blocks hold whole documents. The frequencies are counts over all ids; what the driver holds of them is a number
    for each id of the vocabulary.
    """
    spark = documents.sparkSession
    with open(vocabulary, encoding="utf-8") as f:  # on the driver; the text goes along with the tasks
        rules = f.read()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_by", F.xxhash64("text"))
    docs = docs.repartitionByRange("doc_id", "_by").sortWithinPartitions("doc_id", "_by").select("doc_id", "text")
    raw = f"{shared_dir(spark).rstrip('/')}/siteview-{uuid.uuid4().hex}"
    docs.mapInArrow(_tokenised(rules, end, full), _BLOCK).write.options(compression="zstd", **LARGE_ROWS).parquet(raw)
    blocks = spark.read.schema(_BLOCK).parquet(raw)
    counts = blocks.select("n_tokens", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    table = Table.of_counts(counts.column("id").to_numpy(), counts.column("n").to_numpy())
    spark.createDataFrame(pa.table({"id": pa.array(table.ids.astype(np.int64)), "freq": pa.array(table.freq.astype(np.int64))})).coalesce(1).write.parquet(f"{path}/table")
    # a row a partition of the range above
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("part")) - F.col("_n"))
    placed = blocks.join(F.broadcast(parts.select("part", "_before")), "part").withColumn("start", F.col("_before") + F.col("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [encode_block(_flat(x, n).astype(np.uint32), table, lanes, rows) for n, x in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bodies, pa.binary())], ["start", "n_tokens", "doc_ids", "doc_tokens", "body"])

    coded = placed.select("start", "n_tokens", "doc_ids", "doc_tokens", "ids").mapInArrow(run, _FILE)
    coded.write.options(**LARGE_ROWS).parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").orderBy("id").toArrow()
    return Table(rows.column("id").to_numpy(), rows.column("freq").to_numpy())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file: the tokens of all before it, and its own as
    little-endian unsigned 32-bit integers. Checksums are tested."""
    table = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, sizes, body in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                ids = decode_block(body, table).astype("<u4")
                ends = np.cumsum([0, *sizes])
                if ends[-1] != len(ids):
                    raise ValueError("a block has other documents than tokens")
                each = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends[:-1]), pa.array(sizes, pa.int64()), each], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks").select("start", "doc_ids", "doc_tokens", "body")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): the tokens from ``start`` up to ``stop`` of the whole file, a row for each block that holds some; only
    the segments from the checkpoint before them are decoded."""
    table = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = decode_block(body, table, max(0, start - at), stop - at).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([max(at, start)]), pa.array([ids.tobytes()], pa.binary())], ["start", "ids"])

    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks").where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    return blocks.select("start", "body").mapInArrow(run, "start long, ids binary")


def token_digest(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a token file that is written and read back."""
    path = f"{shared_dir(documents.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents, path, vocabulary)
    return read_tokens(documents.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
