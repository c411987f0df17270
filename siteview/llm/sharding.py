"""Hilbert-curve shards: documents in curve order over several metadata dimensions, cut into equal runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits a dimension is quantised to, and parts that one curve cell is split into for ranking.
BITS, PARTS = 5, 256


def log_cell(x: Column, bits: int = BITS) -> Column:
    """Half-octave cells of a non-negative number; null counts as 0."""
    return F.least(F.floor(2 * F.log2(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)) + 1)), F.lit(2**bits - 1)).cast("long")


def name_cell(x: Column, bits: int = BITS) -> Column:
    """Cells of a string: equal strings share one; null counts as a string of its own."""
    return F.pmod(F.xxhash64(x), F.lit(2**bits))


def hilbert_index(coordinates: str, n: int, bits: int = BITS) -> Column:
    """Distance along the Hilbert curve of the ``n`` cell coordinates (below 2**bits) in an array column of
    longs, as folds over bit levels: turn the axes, Gray-code them, interleave their bits."""
    top = bits - 1
    q = f"shiftleft(1L, {top} - cast(floor(s / {n}) as int))"
    turned = f"""aggregate(sequence(0, {top * n - 1}), {coordinates}, (v, s) -> transform(v, (e, k) -> case
        when (v[s % {n}] & {q}) != 0 then if(k = 0, e ^ ({q} - 1), e)
        when s % {n} != 0 and (k = 0 or k = s % {n}) then e ^ ((v[0] ^ v[s % {n}]) & ({q} - 1))
        else e end))"""
    coded = f"aggregate(sequence(1, {n - 1}), {turned}, (v, s) -> transform(v, (e, k) -> if(k = s, e ^ v[s - 1], e)))" if n > 1 else turned
    flip = f"aggregate(sequence(0, {top - 1}), 0L, (t, s) -> if((w[{n - 1}] & shiftleft(1L, {top} - s)) != 0, t ^ (shiftleft(1L, {top} - s) - 1), t))"
    flipped = f"transform(array({coded}), w -> transform(w, e -> e ^ {flip}))[0]"
    return F.expr(
        f"""aggregate(sequence(0, {bits * n - 1}), struct(0L as h, {flipped} as x), (a, s) ->
            struct(a.h * 2 + (shiftright(a.x[s % {n}], {top} - cast(floor(s / {n}) as int)) & 1L) as h, a.x as x), a -> a.h)"""
    )


def hilbert_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Deal documents to ``shards`` runs of the curve over (text size, source, lang); law ``rows``.

    Rows are ordered by curve cell, then by a hash of id and text, then by id; shard i takes the ranks from ceil(i * n / shards), so counts are at most one apart. Returns
    doc_id, size, text_crc32, law, shard, slot, grown_shard, and the cell. Null texts have no bytes and size 1;
    null ids, sources and languages sort first or count as values of their own; rows that agree in everything
    are interchangeable.

    Ranks come from a histogram of (cell, part): its running sums are taken per block of cells and over the
    blocks, and rows are numbered inside their (cell, part) only. A part is a range of the hash, so a cell or a
    group of copies that holds a third of all rows is spread over PARTS groups.
    """
    text, source, lang = (F.col(c).cast("string") for c in ("text", "source", "lang"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.array(log_cell(size), name_cell(source), name_cell(lang)).alias("at"),
    )
    rows = rows.withColumn("cell", hilbert_index("at", 3)).drop("at")
    # the order within a cell is that of a hash of the row; a part is a range of it
    rows = rows.withColumn("by", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(2**32)))
    rows = rows.withColumn("part", F.expr(f"cast(`by` div {2**32 // PARTS} as int)"))
    counts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    block = F.shiftright("cell", 8)
    inside = Window.partitionBy("block").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("block", block).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("rows"))
    # at most 2 ** (3 * BITS - 8) = 128 blocks, however many rows there are
    over = Window.orderBy("block")
    blocks = blocks.select("block", F.coalesce(F.sum("rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("rows").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    starts = counts.join(blocks, "block").select("cell", "part", (F.col("offset") + F.col("before")).alias("start"), "total")
    within = Window.partitionBy("cell", "part").orderBy("by", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("i", F.row_number().over(within) - 1).join(starts, ["cell", "part"]).withColumn("rank", F.col("start") + F.col("i"))
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(({shards} - 1) + ((rank * {shards}) div total) * total) div {shards}")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell"
    )


def write_shards(documents: DataFrame, path: str, shards: int = 16) -> None:
    """Write whole documents in one folder a shard, in curve order, so that file statistics prune on several
    columns. Rows without an id, which name no document, are left to ``hilbert_shards``' report."""
    placed = hilbert_shards(documents, shards).where("doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = documents.join(placed, documents["doc_id"] == placed["_id"]).drop("_id")
    joined.repartition("_shard").sortWithinPartitions("_shard", "_slot").withColumn("shard", F.col("_shard")).drop("_shard", "_slot").write.partitionBy("shard").parquet(path)
