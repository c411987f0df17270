"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Spaces and the word they lead; no piece of a model that splits on white space goes on after such a unit.
UNIT = re.compile(r" *[^ \n]+| +|\n")
#: Characters of a unit up to which its agenda is a list; no candidate; candidates of a unit whose skips are drawn at once.
FEW, NONE, DRAWN = 48, 1 << 60, 16
#: Characters of units that are cut together; units cut at once; characters of text that are encoded at once.
TOGETHER, AT_ONCE, CHARACTERS = 32, 8192, 1_000_000
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The symbol that two neighbouring ones merge to, as a hash table in arrays. Symbols are numbers: those of ``symbols``
    first, then, from ``raw`` up, characters that are in no piece. A number below 0 merges with nothing."""

    def __init__(self, pieces: dict[str, int]):
        chars = {c for piece in pieces for c in piece}
        self.symbols = [*pieces, *sorted(chars - pieces.keys())]
        number = {x: k for k, x in enumerate(self.symbols)}
        self.raw = len(self.symbols)
        self.order = np.array([*pieces.values()] + [NONE] * (self.raw - len(pieces) + 1), np.int64)
        # of a code point; a space is the mark of a space, and that mark itself, if literal, a character in no piece
        self.of = np.arange(0x110000) + self.raw
        for c in chars:
            self.of[ord(c)] = number[c]
        self.of[32], self.of[ord(SPACE)] = number.get(SPACE, self.raw + ord(SPACE)), self.raw + ord(SPACE)
        pairs = [(number[x[:k]], number[x[k:]], number[x]) for x in pieces for k in range(1, len(x)) if x[:k] in number and x[k:] in number]
        a, b, c = np.array(pairs, np.int64).reshape(-1, 3).T
        self.width = self.raw + 0x110000
        key, bits = a * self.width + b, max(4, (4 * len(a)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = np.flatnonzero(self.keys[at[left]] < 0)
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free[first]]
            self.keys[at[put]], self.values[at[put]] = key[put], c[put]
            left = np.setdiff1d(left, put)
            at[left] = at[left] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _HASH >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to; -1 if none."""
        key = a * self.width + b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where((found == key) & (a >= 0) & (b >= 0), self.values[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = np.where((a[left[hit]] >= 0) & (b[left[hit]] >= 0), self.values[at[left[hit]]], -1)
            left = left[~hit & (found >= 0)]
        return out


class Pieces:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes, dropout: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.body: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.body.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.body.append(b"")
            else:
                self.rank[piece] = (-sp.get_score(i), i)
                self.body.append(piece.replace(SPACE, " ").encode())
        # place of each piece's score, best first; pieces of one score share a place
        places = {x: k for k, x in enumerate(sorted({x for x, _ in self.rank.values()}))}
        self.order = {piece: places[x] for piece, (x, _) in self.rank.items()}
        self.ids = {piece: i for piece, (_, i) in self.rank.items()}
        self.limit, self.seed = int(dropout * 65536), seed
        self.merges = Merges(self.order)
        self.id_of = np.array([self.ids.get(x, -1) for x in self.merges.symbols], np.int64)
        self.sizes = np.array([len(b) for b in self.body])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(self.body), np.uint8)

    def unit(self, text: str, draw: int, mask: int) -> tuple[bytes, int]:
        """Ids of one unit as int32, and how many candidates its agenda came to. The agenda holds candidate merges, best
        score first, leftmost on ties; the t-th candidate is skipped for good if the hash of (draw, t) falls under the
        dropout rate. ``mask`` has those hashes' outcomes for t < DRAWN."""
        # a literal U+2581 is kept apart from a space by its bytes
        sym = ["\0" + c if c == SPACE else SPACE if c == " " else c for c in text] if SPACE in text else list(text.replace(" ", SPACE))
        sym, t = self._few(sym, draw, mask) if len(sym) <= FEW else self._many(sym, draw, mask)
        out = list(map(self.ids.get, sym))
        if None in out:
            out = []
            for s in sym:
                got = self.ids.get(s)
                out += [got] if got is not None else [self.byte[b] for b in (s[1:] if len(s) > 1 else s).encode("utf-8", "surrogatepass")]
        return array("i", out).tobytes(), t

    def late(self, draw: int, t: int) -> bool:
        """Whether the t-th candidate is skipped, t from DRAWN up."""
        return (draw * (2 * t + 1) * 0xC2B2AE3D27D4EB4F >> 40) & 0xFFFF < self.limit

    def _few(self, sym: list[str], draw: int, mask: int) -> tuple[list[str], int]:
        """The agenda as a list beside the symbols, one candidate for each neighbouring pair."""
        order, t, limit = self.order.get, 0, self.limit
        agenda = [order(p, NONE) for p in map(add, sym, sym[1:])]
        while agenda:
            top = min(agenda)
            if top == NONE:
                break
            k = agenda.index(top)
            t += 1
            if mask:
                skip = mask & 1
                mask >>= 1
                if skip:
                    agenda[k] = NONE
                    continue
            elif t > DRAWN and limit and self.late(draw, t - 1):
                agenda[k] = NONE
                continue
            sym[k] = piece = sym[k] + sym.pop(k + 1)
            del agenda[k]
            if k < len(agenda):
                agenda[k] = order(piece + sym[k + 1], NONE)
            if k:
                agenda[k - 1] = order(sym[k - 1] + piece, NONE)
        return sym, t

    def _many(self, sym: list[str | None], draw: int, mask: int) -> tuple[list[str], int]:
        """The agenda as a heap over linked symbols; an entry whose symbols have changed since is passed over."""
        order, t = self.order.get, 0
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(got, i, len(sym[i]) + len(sym[i + 1])) for i, got in enumerate(map(order, map(add, sym, sym[1:]))) if got is not None]
        heapify(agenda)
        while agenda:
            top, i, size = heappop(agenda)
            j = after[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            skip = mask >> t & 1 if t < DRAWN else self.late(draw, t)
            t += 1
            if skip:
                continue
            piece = sym[i] + sym[j]
            sym[i], sym[j] = piece, None
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                got = order(piece + sym[k])
                if got is not None:
                    heappush(agenda, (got, i, len(piece) + len(sym[k])))
            if p >= 0:
                got = order(sym[p] + piece)
                if got is not None:
                    heappush(agenda, (got, p, len(sym[p]) + len(piece)))
        return [s for s in sym if s is not None], t

    def skips(self, draws: np.ndarray, t: int) -> np.ndarray:
        """Which of the units with these draws skip their t-th candidate."""
        return (draws * np.uint64((2 * t + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) >> np.uint64(40)) & np.uint64(0xFFFF) < np.uint64(self.limit)

    @staticmethod
    def mixed(keys: np.ndarray | np.uint64, places: np.ndarray) -> np.ndarray:
        """The draws of units at these places, from 1, of texts with these keys."""
        x = places.astype(np.uint64) * _HASH + keys
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of a known mixer
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
        return x ^ x >> np.uint64(31)

    def draws(self, key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n units of the text with this key: its draw, and which of its first DRAWN candidates are skipped."""
        x = self.mixed(np.uint64(key), np.arange(1, n + 1))
        mask = np.zeros(n, np.int64)
        if self.limit:
            for t in range(DRAWN):
                mask |= self.skips(x, t).astype(np.int64) << t
        return x, mask

    def _agendas(self, sym: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of units of one length, a row each, after their agendas, -1 where one was merged to its left; and how many
        candidates each came to. All rows take their t-th candidate together. Neighbours are linked; the last column is no
        symbol and stands at both ends."""
        merges, (n, size) = self.merges, sym.shape
        wide = size + 1
        full = np.full((n, wide), -1, np.int64)
        full[:, :size] = sym
        to = np.full((n, wide), -1, np.int64)
        to[:, : size - 1] = merges.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, -1)
        agenda = merges.order[to]  # of -1: none
        after = np.tile(np.minimum(np.arange(1, wide + 1), size), (n, 1))
        before = np.tile(np.r_[size, 0:size], (n, 1))
        rows, t, came = np.arange(n), 0, np.zeros(n, np.int64)
        flat, into, ranks, right, left = full.reshape(-1), to.reshape(-1), agenda.reshape(-1), after.reshape(-1), before.reshape(-1)
        while len(rows):
            k = (agenda if len(rows) == n else agenda[rows]).argmin(axis=1)
            at = rows * wide + k
            open_ = ranks[at] < NONE
            rows, at = rows[open_], at[open_]
            came[rows] += 1
            go = at
            if draws is not None:
                skip = self.skips(draws[rows], t)
                ranks[at[skip]] = NONE
                go = at[~skip]
            t += 1
            base = go - go % wide
            j = base + right[go]
            flat[go], flat[j], ranks[j] = into[go], -1, NONE
            following, previous = right[j], left[go]
            right[go] = following
            left[base + following] = go - base
            for x, y, z in ((go, base + following, go), (base + previous, go, base + previous)):
                into[z] = got = merges.merged(flat[x], flat[y])
                ranks[z] = merges.order[got]
        return full[:, :size], came

    def _ids(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols laid end to end, and how many each has: those without a piece are written as bytes."""
        got = np.where(sym < self.merges.raw, self.id_of[np.minimum(sym, self.merges.raw - 1)], -1)
        size = np.ones(len(sym), np.int64)
        bare = np.flatnonzero(got < 0)
        if not len(bare):
            return got, size
        kinds, of = np.unique(sym[bare], return_inverse=True)
        body = [[self.byte[b] for b in (chr(x - self.merges.raw) if x >= self.merges.raw else self.merges.symbols[x]).encode("utf-8", "surrogatepass")] for x in kinds.tolist()]
        size[bare] = np.array([len(x) for x in body])[of]
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int64)
        out[start] = got
        for j in range(4):
            some = size[bare] > j
            out[start[bare[some]] + j] = np.array([x[j] if j < len(x) else 0 for x in body])[of[some]]
        return out, size

    def cut(self, units: list[str], draws: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``unit`` does, many at a time: all ids as int32, where each unit's begin, how many they are, and how many
        candidates its agenda came to. Without ``draws`` nothing is skipped."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        if not units:
            return np.zeros(0, np.int32), n, n, n
        first, length, came = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, order = np.cumsum(n) - n, np.argsort(n, kind="stable")
        edges = np.flatnonzero(np.diff(n[order], prepend=-1))
        out, held = [], 0
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(n)], strict=True):
            size = int(n[order[a]])
            for lo in range(a, b, AT_ONCE):
                mine = order[lo : min(b, lo + AT_ONCE)]
                if size > TOGETHER:
                    got = [self._alone(units[k], None if draws is None else int(draws[k])) for k in mine.tolist()]
                    ids = np.frombuffer(b"".join(x for x, _ in got), np.int32)
                    lengths, came[mine] = np.array([len(x) // 4 for x, _ in got]), [t for _, t in got]
                else:
                    sym, came[mine] = self._agendas(self.merges.of[points[starts[mine][:, None] + np.arange(size)]], None if draws is None else draws[mine])
                    kept = sym >= 0
                    ids, each = self._ids(sym[kept])
                    of = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(kept.sum(axis=1))])]
                    lengths = np.diff(of)
                first[mine], length[mine] = held + np.cumsum(lengths) - lengths, lengths
                out.append(ids.astype(np.int32))
                held += len(ids)
        return np.concatenate(out), first, length, came

    def _alone(self, unit: str, draw: int | None) -> tuple[bytes, int]:
        if draw is not None:
            one = np.array([draw], np.uint64)
            return self.unit(unit, draw, sum(int(self.skips(one, t)[0]) << t for t in range(DRAWN)))
        limit, self.limit = self.limit, 0
        try:
            return self.unit(unit, 0, 0)
        finally:
            self.limit = limit

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts as int32, and how many each has; as ``encode`` gives them. Each distinct unit is cut once, and
        each occurrence that skips one of the candidates of that cut again. Nothing is kept for other texts."""
        found = [UNIT.findall(" " + t) if t else [] for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        code: dict[str, int] = {}
        codes = np.fromiter((code.setdefault(u, len(code)) for us in found for u in us), np.int64, int(n.sum()))
        units = list(code)
        ids, first, length, came = self.cut(units)
        first, length = first[codes], length[codes]
        if self.limit:
            places = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(n) - n, n)
            draws = self.mixed(np.repeat(np.array(keys, np.uint64), n), places)
            most = came[codes]
            other, asked = most > DRAWN, np.flatnonzero(most <= DRAWN)
            for t in range(DRAWN):
                asked = asked[most[asked] > t]
                skip = self.skips(draws[asked], t)
                other[asked[skip]] = True
                asked = asked[~skip]
            again = np.flatnonzero(other)
            more, begin, first_length, _ = self.cut([units[k] for k in codes[again].tolist()], draws[again])
            first[again], length[again] = begin + len(ids), first_length
            ids = np.concatenate([ids, more])
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(n)])])

    def encode(self, text: str | None, key: int, memo: Memo) -> bytes:
        """Ids of a whole text as int32. Every occurrence of a unit has draws of its own."""
        if not text:
            return b""
        units = UNIT.findall(" " + text)
        draws, masks = self.draws(key, len(units))
        plain, varied = memo.plain, memo.varied
        out = []
        for i, (unit, mask) in enumerate(zip(units, masks.tolist(), strict=True)):
            got = plain.get(unit)
            if got is None:
                out.append(memo.first(unit, mask, int(draws[i])))
                continue
            if not mask & got[1]:
                out.append(got[0])
                continue
            ids = varied.get((unit, mask & got[2]))
            out.append(memo.vary(unit, mask, got[2], int(draws[i])) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a text's ids, without the leading space that encoding adds."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[at][1:].tobytes()


class Memo:
    """Ids of the units met, as bytes: as they are without dropout, and under the skips that an occurrence drew.

    ``plain`` has a unit's ids, a mask of the candidates that it comes to without skips, and one of a few more, under
    which ``varied`` keeps it. A segmentation that comes to more candidates than that is not kept. Both are emptied when
    full, so memory is bounded.
    """

    def __init__(self, coder: Pieces, most: int = 700_000):
        self.coder, self.most = coder, most
        self.plain: dict[str, tuple[bytes, int, int]] = {}
        self.varied: dict[tuple[str, int], bytes] = {}

    def first(self, unit: str, mask: int, draw: int) -> bytes:
        """Ids of an occurrence of a unit that ``plain`` lacks; kept if no candidate that it came to was skipped."""
        ids, t = self.coder.unit(unit, draw, mask)
        if len(unit) < 64 and t <= DRAWN and not mask & ((1 << t) - 1):
            if len(self.plain) >= self.most:
                self.plain.clear()
            self.plain[unit] = ids, (1 << t) - 1, (1 << min(t + 2, DRAWN)) - 1
        return ids

    def vary(self, unit: str, mask: int, wide: int, draw: int) -> bytes:
        ids, t = self.coder.unit(unit, draw, mask)
        if t <= wide.bit_length() and len(unit) < 64:
            if len(self.varied) >= self.most:
                self.varied.clear()
            self.varied[unit, mask & wide] = ids
        return ids


#: The encoder that a Python worker keeps from task to task.
_CODERS: dict[tuple, Pieces] = {}


def _coder(model: bytes, dropout: float, seed: int) -> Pieces:
    key = (hash(model), dropout, seed)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Pieces(model, dropout, seed)
    return _CODERS[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; the bytes go along with the tasks
        return f.read()


def encode(documents: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless): the ids of each whole text, and whether decoding them gave the text.

    Whether a merge is dropped is a hash of (seed, doc_id, place of the unit in the text, place of the merge in its agenda),
    so a word is cut anew wherever it stands, repeated rows are cut alike, and another seed cuts all anew. A null id is
    drawn by its text. With dropout 0 the ids are those of the model's own encoder, but for a literal
    U+2581, which is written as bytes. Null and empty texts have no pieces.
    """
    body = _model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        coder = _coder(body, dropout, seed)
        for batch in batches:
            # a stretch of texts ends with the one that fills it
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHARACTERS
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                docs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                keys = [xxhash.xxh3_64_intdigest(str(d) if d is not None else (t or "").encode("utf-8", "surrogatepass"), seed=seed) for d, t in zip(docs, texts, strict=True)]
                ids, n = coder.encode_all(texts, keys)
                ends = np.concatenate([[0], np.cumsum(n)])
                right = [coder.decode(ids[a:b]) == (t or "").encode("utf-8", "surrogatepass") for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist(), strict=False)]
                pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pieces, pa.array(n), pa.array(right, pa.bool_())], ["doc_id", "pieces", "n_pieces", "lossless"])

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, pieces); a null row of pieces gives a null text."""
    body = _model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(body, 0, 0)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int32)).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "pieces").mapInArrow(run, "doc_id long, text string")
