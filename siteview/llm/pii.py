"""Personal data: patterns, then terms that give a protected entity away by corpus co-occurrence.

A term t reveals an entity e by their pointwise mutual information, log(N n(e,t) / (n(e) n(t))), which is at most
e's own information log(N / n(e)). Terms whose share of that information reaches ``disclosure``, in at least
``support`` different texts that hold both, are spans of kind ``term`` wherever they stand in a text that holds the
entity, and are generalised on output. All four counts are of different texts, over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: from the run's start the same text would match or fail
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Terms: words, names and codes of two letters or digits up, lower-cased one by one.
_TERM = re.compile(r"[^\W_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from each @ outwards, so that long runs cost one look."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        got = start < at and _DOMAIN.match(text, at)
        if got:
            yield start, got.end()
            free = got.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the order of KINDS; leftmost, non-overlapping within a kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _entity(text: str, span: tuple[int, int, str]) -> str:
    value = text[span[0] : span[1]].lower()
    return span[2] + ":" + (value if span[2] in ("email", "ip") else "".join(c for c in value if c.isdigit()))


def _read(texts: DataFrame) -> DataFrame:
    """Of (text_hash, text): a row for each text, with its base spans and, where it has any, its entities and its terms with
    their places; and rows of (term, number of texts of the batch that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pa.struct([("term", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
        names = ["text_hash", "base", "entities", "places", "term", "n"]
        for batch in batches:
            counts: Counter = Counter()
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                base, entities, places = [], [], []
                for text in part.column(1).to_pylist():
                    spans = base_spans(text)
                    base.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
                    entities.append(sorted({_entity(text, span) for span in spans}))
                    words = _uncovered([(m.start(), m.end()) for m in _TERM.finditer(text)], spans) if spans else []
                    places.append([{"term": text[a:b].lower(), "a": a, "b": b} for a, b in words])
                    counts.update({w.lower() for w in set(_TERM.findall(text))})
                n = part.num_rows
                columns = [part.column(0), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(places, pa.list_(word)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
            t, terms = len(counts), sorted(counts)  # in order they take less room
            columns = [pa.nulls(t, pa.binary()), pa.nulls(t, pa.string()), pa.nulls(t, pa.list_(pa.string())), pa.nulls(t, pa.list_(word)), pa.array(terms, pa.string()), pa.array([counts[x] for x in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "text_hash binary, base string, entities array<string>, places array<struct<term:string,a:int,b:int>>, term string, n long")


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _uncovered(words: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Words that touch no span; both lists are by start."""
    out, k, reach = [], 0, 0
    for a, b in words:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        if a >= reach:
            out.append((a, b))
    return out


def _found(documents: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(text_hash, base, spans) for every different text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(_hash(F.col("text")).alias("text_hash"), text.alias("text")).groupBy("text_hash").agg(F.first("text").alias("text"))
    rows = stored(_read(texts))
    docs = rows.where("base is not null").select("text_hash", "base", "entities", "places")
    n = float(max(1, docs.count()))
    some = docs.where("size(entities) > 0")
    of = some.select("text_hash", F.explode("entities").alias("entity"))
    # an entity in fewer texts cannot reach the support with any term
    entities = checkpointed(of.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support))
    known = checkpointed(of.join(entities, "entity", "left_semi"))
    terms = some.select("text_hash", F.explode(F.array_distinct(F.col("places.term"))).alias("term"))
    pairs = known.join(terms, "text_hash").select("text_hash", "entity", "term")
    together = checkpointed(pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support))
    held = rows.where("term is not null").join(together.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    information = F.log(F.lit(n) / F.col("n_entity"))
    mutual = F.log(F.lit(n) * F.col("both") / (F.col("n_entity") * F.col("n_term")))
    telling = together.join(entities, "entity").join(held, "term").where((mutual >= disclosure * information) & (information > 0))
    telling = checkpointed(telling.select("entity", "term"))
    mine = pairs.join(telling, ["entity", "term"], "left_semi").groupBy("text_hash").agg(F.collect_set("term").alias("terms"))
    both = docs.join(mine, "text_hash", "left")
    parts = F.filter(F.split("base", ","), lambda x: x != "")
    order = F.array(*map(F.lit, KINDS))
    base = F.transform(parts, lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("a"), F.array_position(order, F.split(x, ":")[0]).cast("int").alias("k"), F.split(x, ":")[2].cast("int").alias("b"), F.split(x, ":")[0].alias("kind")))
    none = F.array().cast("array<struct<term:string,a:int,b:int>>")
    telling_places = F.coalesce(F.filter("places", lambda x: F.array_contains("terms", x["term"])), none)
    extra = F.transform(telling_places, lambda x: F.struct(x["a"].alias("a"), F.lit(9).alias("k"), x["b"].alias("b"), F.lit("term").alias("kind")))
    joined = F.array_join(F.transform(F.sort_array(F.concat(base, extra)), lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])), ",")
    return both.select("text_hash", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(joined).alias("spans"))


def find_personal_data(documents: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """(doc_id, text_hash, base, spans) for every row: base and all spans as ``kind:start:end``, by start,
    comma-joined, in code points.

    Null texts count as empty and have no spans. Every different text is searched and counted once, however many
    rows repeat it, and its spans go to all of them; ids play no part, so null and repeated ids are like any other.
    A term is a run of two or more letters and digits outside the base spans; single characters are none.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _hash(F.col("text")).alias("text_hash"))
    found = checkpointed(_found(documents, disclosure, support))
    return rows.join(found, "text_hash").select("doc_id", "text_hash", "base", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts of each kind and the hash of the base spans."""
    parts = F.split("base", ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(parts, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def sanitise(documents: DataFrame, disclosure: float = 0.9, support: int = 3) -> DataFrame:
    """``documents`` with every span replaced by ``[KIND]``, where spans overlap by the kind of the first;
    n_chars, if there, follows the new text. Rows without spans are unchanged; no row is lost."""
    found = checkpointed(_found(documents, disclosure, support).where("spans != ''").select("text_hash", F.col("spans").alias("_spans")))
    names = documents.columns
    columns = [F.col(f"`{c}`") for c in names]
    joined = documents.select(*columns, _hash(F.col("text")).alias("_hash")).join(found, F.col("_hash") == found["text_hash"], "left").select(*columns, "_spans")
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lengths = batch.column(size).to_pylist() if size is not None else []
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    texts[k] = masked(texts[k], spans)
                    if size is not None:
                        lengths[k] = len(texts[k])
            out = list(batch.columns[:-1])
            out[at] = pa.array(texts, pa.string())
            if size is not None:
                out[size] = pa.array(lengths, out[size].type)
            yield pa.RecordBatch.from_arrays(out, names)

    return joined.mapInArrow(run, documents.schema)


def masked(text: str, spans: str) -> str:
    out, done = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",")):
        if int(a) >= done:
            out += [text[done : int(a)], f"[{kind.upper()}]"]
        done = max(done, int(b))
    return "".join([*out, text[done:]])
