"""Context-tree weighting over bytes, with a unigram word base.

The byte tree gives each token, a word with the byte that ends it, a probability; these sum to one over all tokens that can
follow. So do the shares of the words in the training texts. The score halves between both for every token, as a node
of the tree halves between its own estimate and its children's. From the second word on, RECENT of it goes to the shares of
the words that the text has had so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_bucket, stored

#: Bytes of context, and about how many bytes of text make a chunk, whose words are looked up together.
DEPTH, CHUNK = 4, 16 << 20
#: Ends a text in the byte model; not a byte of UTF-8.
END = 255
LN10 = math.log(10)
#: Weight of a text's own words so far.
RECENT = 0.1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _grams(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last DEPTH + 1 bytes at every byte of every line, packed in one integer, and where each line starts.
    A line is padded with DEPTH zero bytes on the left and ends with END."""
    body = np.frombuffer(b"".join(bytes(DEPTH) + x + bytes([END]) for x in lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1 + DEPTH
    ends = np.cumsum(sizes)
    keys = np.zeros(len(body), np.uint64)
    for k in range(DEPTH + 1):
        keys[DEPTH:] = (keys[DEPTH:] << np.uint64(8)) | body[k : len(body) - DEPTH + k]
    keep = np.ones(len(body), bool)
    for k in range(DEPTH):
        keep[ends - sizes + k] = False
    return keys[keep], np.concatenate([[0], np.cumsum(sizes - DEPTH)[:-1]]).astype(np.int64)


def _pieces(lines: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of lines of about ``most`` bytes; a longer line is a run of its own."""
    at = size = 0
    for k, x in enumerate(lines):
        if size and size + len(x) > most:
            yield at, k
            at, size = k, 0
        size += len(x) + DEPTH + 1
    if lines:
        yield at, len(lines)


def _count(table: pa.Table) -> pa.Table:
    """Words and grams of a chunk with their counts in training texts (0 for those only in others)."""
    words: dict[bytes, int] = {}
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    lines, train = [], []
    for text, held in zip(table.column("text").to_pylist(), table.column("held_out").to_pylist(), strict=True):
        found = _words(text)
        by = 0 if held else 1
        for w in found:
            words[w] = words.get(w, 0) + by
        lines.append(b" ".join(found))
        train.append(by)
    for a, b in _pieces(lines):
        keys, starts = _grams(lines[a:b])
        kept = np.repeat(np.array(train[a:b]), np.diff(np.append(starts, len(keys)))).astype(bool)
        u, n = np.unique(keys[kept], return_counts=True)
        grams.append((u, n))
        u = np.unique(keys[~kept])
        grams.append((u, np.zeros(len(u), np.int64)))
    chunk = table.column("chunk")[0].as_py()
    u, of = np.unique(np.concatenate([x for x, _ in grams]), return_inverse=True)
    n = np.bincount(of, np.concatenate([x for _, x in grams]), len(u)).astype(np.int64)
    w = len(words)
    return pa.table({
        "chunk": pa.array(np.full(w + len(u), chunk, np.int64)),
        "word": pa.concat_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(u), pa.binary())]),
        "gram": pa.concat_arrays([pa.nulls(w, pa.int64()), pa.array(u.astype(np.int64))]),
        "n": pa.array(np.concatenate([np.fromiter(words.values(), np.int64, w), n])),
        "ends": pa.array(np.concatenate([[sum(train)], np.zeros(w + len(u) - 1, np.int64)]).astype(np.int64)),
    })


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2: eight steps of the recurrence, then Stirling's series."""
    up, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up) - F.ln(product)


def _kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _ln_gamma(n0 + 0.5) + _ln_gamma(n1 + 0.5) - math.log(math.pi) - _ln_gamma(n0 + n1 + 1.0)


def context_tree(grams: DataFrame) -> DataFrame:
    """(gram, log10p): log10 of the weighted probability of each gram's last byte after its context.

    ``grams`` has (gram, n). A byte is eight binary decisions, each with a context tree of its own: ``node`` is
    the 1-prefixed path of bits so far, ``ctx`` the last d bytes. Upwards, a node's weighted probability is half
    its own estimate and half the product of its children's; downwards, the shares of the depths on a path
    follow, and with them the mixed probability of a one. Contexts without training counts predict 1/2.
    """
    bit = F.explode(F.sequence(F.lit(0), F.lit(7)))
    byte = F.col("gram").bitwiseAND(F.lit(255))
    bits = grams.select("gram", "n", bit.alias("k"), byte.alias("byte"), F.shiftright("gram", 8).alias("ctx"))
    bits = bits.withColumn("node", F.expr("cast((1 << k) | (byte >> (8 - k)) as int)")).withColumn("bit", F.expr("cast((byte >> (7 - k)) & 1 as int)"))
    level = bits.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = {DEPTH: checkpointed(level.withColumn("own", _kt(F.col("n0"), F.col("n1"))).withColumn("all", F.col("own")))}
    for d in range(DEPTH - 1, -1, -1):
        up = levels[d + 1].withColumn("ctx", F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1)))
        level = up.groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("all").alias("below"))
        level = level.withColumn("own", _kt(F.col("n0"), F.col("n1"))).withColumn("high", F.greatest("own", "below"))
        both = F.col("high") + F.ln(F.exp(F.col("own") - F.col("high")) + F.exp(F.col("below") - F.col("high"))) - math.log(2)
        levels[d] = checkpointed(level.withColumn("all", both).select("ctx", "node", "n0", "n1", "own", "all"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    here = F.exp(F.col("own") - F.col("all") - math.log(2))
    down = levels[0].select("ctx", "node", (here * one).alias("mix"), (1 - here).alias("left"))
    for d in range(1, DEPTH + 1):
        share = here if d < DEPTH else F.lit(1.0)
        at = levels[d].withColumn("above", F.col("ctx").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1)))
        at = at.join(down.withColumnRenamed("ctx", "above"), ["above", "node"])
        down = at.select("ctx", "node", (F.col("mix") + F.col("left") * share * one).alias("mix"), (F.col("left") * (1 - share)).alias("left"))
    p = F.when(F.col("bit") == 1, F.col("mix")).otherwise(1 - F.col("mix"))
    return bits.join(down, ["ctx", "node"]).groupBy("gram").agg(F.sum(F.log10(p)).alias("log10p"))


def _shares(words: list[np.ndarray], c: np.ndarray, train_tokens: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its share in the training tokens, its share in the words before it in its text, and their number. A
    text's tokens are its words (numbers into the counts ``c``), the last one together with the end; of a text without words, the end."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    every, of = np.concatenate([np.zeros(0, np.int64), *words]), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((every, of))  # stable: repeats of a word in a text stay in order
    new = np.ones(len(every), bool)
    new[1:] = (np.diff(every[order]) != 0) | (np.diff(of[order]) != 0)
    first = np.nonzero(new)[0]
    before = np.empty(len(every))
    before[order] = np.arange(len(every)) - np.repeat(first, np.diff(np.append(first, len(every))))
    place = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
    end = ends / max(1, train_tokens)
    goes = np.where(place == n[of] - 1, end, 1 - end)  # the end comes next, or another word
    seen = c[every] / max(1, train_tokens - ends) * goes * np.where(place == 0, 1 - end, 1)
    at = np.cumsum(np.maximum(1, n)) - np.maximum(1, n)  # where each text's tokens start
    tokens = np.repeat(at, n) + place
    out = tuple(np.zeros(int(np.maximum(1, n).sum())) for _ in range(3))
    for x, values in zip(out, (seen, before / np.maximum(1, place) * goes, place), strict=True):
        x[tokens] = values
    out[0][at[n == 0]] = end
    return out


def _score(train_tokens: int, vocabulary: int, ends: int):
    total = math.log10(train_tokens + 0.1 * (vocabulary + 1))

    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        is_word = items.column("word").is_valid()
        words, grams = items.filter(is_word), items.filter(items.column("gram").is_valid())
        number = {w: k for k, w in enumerate(words.column("word").to_pylist())}
        count = words.column("c").to_numpy().astype(np.float64)
        key, lp = grams.column("gram").to_numpy().astype(np.uint64), grams.column("log10p").to_numpy()
        order = np.argsort(key)
        key, lp = key[order], lp[order]
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base": [], "score": [], "tree": []}
        lines, numbers = [], []
        for text in docs.column("text").to_pylist():
            ws = _words(text)
            numbers.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)))
            c = count[numbers[-1]]
            out["n_known"].append(int((c > 0).sum()))
            out["n_tokens"].append(len(ws) + 1)
            out["base"].append(float(np.log10(c + 0.1).sum()) - total * len(ws))
            lines.append(b" ".join(ws))
        for a, b in _pieces(lines):
            k, starts = _grams(lines[a:b])
            byte = _look(key, lp, k)
            out["tree"] += np.add.reduceat(byte, starts).tolist()
            k &= np.uint64(255)
            after = np.nonzero((k == 32) | (k == END))[0] + 1  # where the next token starts
            token = np.add.reduceat(byte, np.concatenate([[0], after[:-1]]))
            seen, own, place = _shares(numbers[a:b], count, train_tokens, ends)
            with np.errstate(divide="ignore"):
                learnt = np.logaddexp(token * LN10, np.log(seen)) - math.log(2)
                token = np.where(place > 0, np.logaddexp(learnt + math.log(1 - RECENT), np.log(RECENT * own)), learnt) / LN10
            out["score"] += np.add.reduceat(token, np.searchsorted(after, starts, "right")).tolist()
        return pa.table([docs.column("doc_id"), docs.column("held_out"), *[pa.array(out[x], t) for x, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tree", pa.float64()))]], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tree"])

    return run


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at wanted, all of which are in the sorted keys: a trie of one table a byte where that is small, else
    binary search."""
    if len(np.unique(keys >> np.uint64(8))) > 150_000:
        return values[np.searchsorted(keys, wanted)]
    top = np.uint64(8 * (DEPTH - 1))
    index = np.unique(keys >> top)
    lead = np.zeros(1 << 16, np.int32)
    lead[index.astype(np.int64)] = np.arange(len(index), dtype=np.int32)
    at = lead[(wanted >> top).astype(np.int64)]
    for shift in range(8 * (DEPTH - 2), 0, -8):
        below = np.unique(keys >> np.uint64(shift))
        step = np.zeros(len(index) * 256, np.int32)
        step[np.searchsorted(index, below >> np.uint64(8)) * 256 + (below & np.uint64(255)).astype(np.int64)] = np.arange(len(below), dtype=np.int32)
        at = step[at.astype(np.int64) * 256 + ((wanted >> np.uint64(shift)) & np.uint64(255)).astype(np.int64)]
        index = below
    last = np.zeros(len(index) * 256)
    last[np.searchsorted(index, keys >> np.uint64(8)) * 256 + (keys & np.uint64(255)).astype(np.int64)] = values
    return last[at.astype(np.int64) * 256 + (wanted & np.uint64(255)).astype(np.int64)]


def score_texts(documents: DataFrame, folds: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Byte context-tree and word unigram scores of every whole text, learnt from ids whose fold is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, tree_score (the byte tree alone). The
    byte model reads the lower-cased words with one space between, then an end mark. Null and empty texts are the end
    token alone; a null id falls in fold 0; repeated rows count each time. Without training rows every count is
    0 and the tree predicts 1/2 for each bit.

    Documents are dealt to chunks by a hash of the id, as many as there are bytes for; each chunk sends its distinct words and
    grams, counted, to the corpus totals and gets them back, so nothing is broadcast and no word's texts meet in one task.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk))
    docs = docs.withColumn("held_out", id_bucket("doc_id", folds) == 0)
    # rows without an id, and repeats of one, are spread by their text
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    items = stored(docs.groupBy("chunk").applyInArrow(_count, "chunk long, word binary, gram long, n long, ends long"))
    counts = stored(items.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
    words = items.where("word is not null").select("chunk", "word").join(counts, "word")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("known")).first()
    ends = items.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    vocabulary = totals["known"] + (ends > 0)
    train_tokens = totals["n"] + ends
    grams = items.where("gram is not null")
    tree = context_tree(checkpointed(grams.groupBy("gram").agg(F.sum("n").alias("n"))))
    known = words.select("chunk", "word", "c", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("log10p"))
    known = known.unionByName(grams.join(tree, "gram").select("chunk", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"), "gram", "log10p"))
    scored = docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(train_tokens, vocabulary, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tree double")
    end = math.log10((ends + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.lit(end)).alias("base_score"), "score",
        F.col("tree").alias("tree_score"),
    )
