"""Token files, phrases and conversation repair against brute force; odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siteview.llm import phrases, pii, rans, repair, topk

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, start string, part string, f string"
ODD = [
    (None, "words without an id, and more words.", "en"), (1, None, None), (2, "", "fr"), (3, "Same words; same words! same words", "en"), (3, "Same words; same words! same words", "en"),
    (4, "two  spaces \n and\ttabs . ,x", None), (5, "y" * 120_000, "en"), (6, "x " * 50_000, "en"), (7, " <|endoftext|> é è ü don't stop,now\r\n", "und"), (8, "a. b? c! d: e; f\x0bg\x0ch", "en"), (9, ",,, ... word,", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + ("s", 1, "?", "?", "?") for r in ODD], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 11


def _plain(rows):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(rans.VOCABULARY)
    at, out = 0, []
    for doc, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, rans.END], "<u4")
        out.append((doc, at, len(ids), ids.tobytes()))
        at += len(ids)
    return out


def test_token_file_of_a_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rans.write_tokens(docs, str(tmp_path / "t"), full=20_000, lanes=64, rows=16)
    want = _plain(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    got = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rans.read_tokens(spark, str(tmp_path / "t")).collect())
    assert got == want
    whole = b"".join(w[3] for w in want)
    for a, b in ((0, 5), (19_990, 90_001), (len(whole) // 4 - 3, len(whole) // 4 + 9)):
        part = rans.read_range(spark, str(tmp_path / "t"), a, b).orderBy("start").collect()
        assert b"".join(bytes(r.ids) for r in part) == whole[4 * a : 4 * b]


def test_token_digest_of_odd_and_empty_tables(spark, odd, empty):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.token_digest(odd).collect()]
    want = _plain(sorted(((d, t) for d, t, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted(got, key=lambda r: r[1]) == [(d, s, n, zlib.crc32(x)) for d, s, n, x in want]
    assert rans.token_digest(empty).count() == 0


@pytest.mark.parametrize("n, kinds, lanes, rows", [(0, 1, 4, 2), (1, 1, 4, 2), (5000, 1, 8, 4), (5000, 700, 8, 4), (4097, 40_000, 512, 256), (70_000, 3, 16, 300)])
def test_blocks_round_trip_and_tell_damage(n, kinds, lanes, rows):
    rng = np.random.default_rng(n + kinds)
    ids = (rng.zipf(1.3, n) % kinds * 7 + 2).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    table = rans.Table.of_counts(seen, counts)
    assert not n or (int(table.freq.sum()) == 1 << rans.BITS and table.freq.min() >= 1)
    body = rans.encode_block(ids, table, lanes, rows)
    assert (rans.decode_block(body, table) == ids).all()
    for a, b in ((0, n), (n // 3, n // 2), (n - 1, n + 5), (n, n)):
        assert (rans.decode_block(body, table, max(a, 0), b) == ids[max(a, 0) : b]).all()
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(body[:20] + bytes([body[20] ^ 1]) + body[21:], table)
    with pytest.raises(ValueError, match="table"):
        rans.encode_block(np.array([1], np.uint32), table, lanes, rows)


# 12


def _brute(rows, least, share, top):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for d in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in cand and 100 * a >= share * cand[q]}
        best = []
        for p, a in cand.items():
            if p not in inside:
                s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        out += [(lang, r, x[2].decode(), x[3], x[4], x[5], n[lang], -x[0]) for r, x in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("how", [{}, {"slots": 3, "budget": 50, "batch": 4000}])
def test_phrases_against_brute_force(spark, how):
    rnd = random.Random(5)
    words = ["of", "the", "The", "and", "x", "né", "ab-c", "über"] + [f"w{i}" for i in range(6)]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" "] * 6 + ["  ", "\t", ". ", ",", "\n", " ; "]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "fr", None, "und"])) for i in range(120)]
    rows += [(900, "the same line of words again\n" * 40, "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for least, share, top in ((10, 50, 2000), (3, 80, 25)):
        assert _rows(phrases.collocations(docs, least, share, top, **how)) == _brute([r[1:] for r in rows], least, share, top)


def test_phrases_of_odd_and_empty_tables(odd, empty):
    assert _rows(phrases.collocations(odd, 2)) == _brute([r[1:] for r in ODD], 2, 50, 2000)
    assert phrases.collocations(empty).count() == 0


def test_slots_are_packed_to_groups():
    first, parts = phrases.groups({0: 4, 1: 5, 2: 30, 3: 1, 5: 9}, 6, 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 4] and parts.tolist() == [1, 1, 3, 1, 1, 1]


# 13


def _conversations(rows):
    """Expected report of damaged conversations, by a table over (row, state) that keeps the least (cost, edits)."""
    due, groups = {0: 2, 1: 2, 2: 3, 3: 2}, {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = groups.setdefault(conv, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, r, x in held:
            b = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not b else "duplicate" if (r, x) in seen else "truncated" if b[-1] not in ".!?" else "")
            seen.add((r, x))
        best = {}
        for i in range(len(held), -1, -1):
            for q in range(4):
                ways = [(0, "", ())] if i == len(held) and q in (0, 3) else []
                if i < len(held):
                    (_, r, x), p = held[i], 3 if faults[i] else 0
                    steps = [(4, "D", q, ())]
                    if faults[i] in ("", "truncated"):
                        kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(r[:1], {}).get(q)
                        steps += [] if kept is None else [(p, "K", kept, (f"{r}:{x}",))]
                        steps.append((3 + p, "R", due[q], ((" ", " ", "user", "assistant")[due[q]] + ":" + x,)))
                    ways += [(c + best[i + 1, t][0], e + best[i + 1, t][1], l + best[i + 1, t][2]) for c, e, t, l in steps if best[i + 1, t]]
                best[i, q] = min(ways, default=None)
            for _ in range(4):
                for q in range(4):
                    then = best[i, due[q]]
                    if then:
                        way = (3 + then[0], "I" + then[1], (("user", "assistant")[due[q] - 2] + ":", *then[2]))
                        best[i, q] = way if best[i, q] is None else min(way, best[i, q])
        cost, audit, lines = best[0, 0]
        turns = {t for t, _, _ in held if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        counts = [faults.count(c) for c in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _repaired(spark, rows, chunk):
    df = spark.createDataFrame([r + ("?",) for r in rows], "conv_id long, turn long, role string, text string, audit string")
    got = repair.repair_digest(repair.damaged(df), chunk).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _repaired(spark, rows, repair.CHUNK) == _conversations(rows)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_repair_of_odd_rows_and_of_long_conversations_in_pieces(spark, chunk):
    rnd = random.Random(chunk)
    roles, texts = ["user", "assistant", "system", None, "", "User", "tool"], [None, "", "a.", "b?", "c", "d e!\n", "  ", " x.y", "z" * 20_000]
    rows = [(rnd.choice([None, 1, 2, 3, 3, 3, 3]), rnd.choice([None, *range(90)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(300)]
    rows += [(rnd.choice([7, 8]), i, rnd.choice(roles[:3]), rnd.choice(["a.", "c", f"text {i}.", f"text {i}!"])) for i in range(300)]
    rows += [(20, 3, "user", "a."), (20, 3, "user", "a."), *[(i, 0, "user", f"only {i}") for i in range(100, 160)]]
    assert _repaired(spark, rows, chunk) == _conversations(rows)
    assert _repaired(spark, [], chunk) == {}


def test_auction_prices_are_the_least_costs():
    rnd = random.Random(3)
    for _ in range(300):
        rows = tuple((rnd.choice("suax"), rnd.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randrange(7)))
        leave, last = tuple(rnd.choice([0, 3, 5, math.inf]) for _ in range(4)), rnd.random() < 0.5
        if min(leave) == math.inf:
            continue
        want = {(len(rows), q): leave[q] for q in range(4)} | {(i, q): math.inf for i in range(len(rows)) for q in range(4)}
        for _ in range(8 * len(rows) + 8):  # until nothing changes
            for i, q in want:
                for _, cost, taken, then in repair.arcs(rows[i] if i < len(rows) else None, q, i < len(rows) or last):
                    want[i, q] = min(want[i, q], cost + want[i + taken, then])
        price = repair.auction(rows, leave, last)
        assert all(price[i][q] == v for (i, q), v in want.items())


# 2 and 6


def test_very_long_numbers_are_no_addresses():
    zeros, ones = "0" * 5000, "1" * 5000
    assert pii.base_spans(f"{zeros}.1.1.1") == [(0, 5006, "ip")]
    assert pii.base_spans(f"{ones}.1.1.1 {ones} +{ones}") == []


def test_rows_that_share_an_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 1.0]), (1, [0.5, 2.0]), (2, [-1.0, 1.0]), (0, [0.25, 0.25]), (None, [1.0, 1.0]), (3, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v]
    pairs = sorted((-sum(x * y for x, y in zip(a, b)), j) for i, a in q if i == 0 for j, b in q if j != 0)[:5]
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id = 0"), 5).collect())
    assert got == [(k, j, -s) for k, (s, j) in enumerate(pairs, 1)]
    assert topk.top_k(table.where("false"), table.where("false"), 5).count() == 0


def test_units_of_a_large_worker_stay_known():
    from siteview.llm import subword

    class Coder:
        calls = 0

        def unit(self, text, draw, mask):
            self.calls += 1
            return b"", 1

    memo = subword.Memo(Coder())
    for k in range(400_000):
        memo.first(str(k), 0, 0)
    assert "0" in memo.plain and len(memo.plain) == 400_000
    small = subword.Memo(Coder(), most=10)
    for k in range(100):
        small.first(str(k), 0, 0)
    assert len(small.plain) <= 10


def test_units_are_cut_together_as_one_by_one(spark):
    from siteview.llm import subword

    odd = ["", None, "a", "\n", " ", "  two  spaces \n\n end ", "\u2581 literal\u2581", "\0 nul\0\u2581", "\U0001f600\U0001f600 \u00e9\u0301 \ud55c\uad6d", "a" * 33, "ab" * 40, "x" * 700, "1234567890 " * 9]
    texts = odd + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    keys = [(k * 0x9E3779B97F4A7C15 + 5) % (1 << 64) for k in range(len(texts))]
    for dropout in (0.0, 0.1, 0.6):
        coder = subword.Pieces(subword._model(subword.MODEL), dropout, 1)
        cuts = []
        alone, coder.unit = coder.unit, lambda unit, draw, mask: cuts.append(unit) or alone(unit, draw, mask)  # noqa: B023
        ids, n = coder.encode_all(texts, keys)
        assert all(len(u) > subword.TOGETHER for u in cuts)
        ends = np.concatenate([[0], np.cumsum(n)])
        memo = subword.Memo(coder)
        for text, key, a, b in zip(texts, keys, ends, ends[1:], strict=False):
            assert ids[a:b].tobytes() == coder.encode(text, key, memo), (dropout, text)
    none, n = coder.encode_all([None, ""], [1, 2])
    assert len(none) == 0 and n.tolist() == [0, 0]
    assert [len(x) for x in coder.encode_all([], [])] == [0, 0]


def test_lines_are_put_together_from_known_words():
    import pyarrow as pa

    with open(rans.VOCABULARY, encoding="utf-8") as f:
        units = rans.Units(f.read())
    marks = ["", ",", ".", "...", "?!", "»", "'s", "9", "́"]
    words = [w + m for w in ("hay", "Été", "x1", "don't", "한국", "<|endoftext|>", "Ġ", "-") for m in marks]
    gaps = [" ", "\n", "\n\n", " \n", "\n ", "\t", "\x1c", " ", "\r\n", "  "]
    draw = random.Random(3)
    for _ in range(6):  # what one round keeps must not mislead the next
        texts = ["".join(draw.choice(words) + draw.choice(gaps[: draw.choice((1, 2, 10))]) for _ in range(draw.randint(0, 30))) for _ in range(200)]
        ids, n = units.encode(pa.array(["", "hay,", "hay,\nhay.", "hay,", *texts]), rans.END)
        want = [[*units.coder.encode(t, add_special_tokens=False).ids, rans.END] for t in ["", "hay,", "hay,\nhay.", "hay,", *texts]]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]

    asked = []

    class Coder:
        def encode_batch_fast(self, given, add_special_tokens):
            asked.extend(given)
            return coder.encode_batch_fast(given, add_special_tokens=add_special_tokens)

    coder, units.coder = units.coder, Coder()
    units.encode(pa.array(["one two three\n", "two", "three", "\n"]), rans.END)
    asked.clear()
    ids, _ = units.encode(pa.array(["one two\nthree,\ntwo"]), rans.END)
    assert asked == [] and ids.tolist() == [*coder.encode("one two\nthree,\ntwo", add_special_tokens=False).ids, rans.END]


def test_a_worker_keeps_no_units():
    import tracemalloc

    from siteview.llm import subword

    coder = subword._coder(subword._model(subword.MODEL), 0.1, 1)
    coder.encode_all(["warm up"], [1])
    tracemalloc.start()
    for k in range(3):
        coder.encode_all([" ".join(f"w{k}x{i}" for i in range(20_000))], [k])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1 << 20
