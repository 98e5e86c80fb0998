"""Proportional stratified interleaving: shards of equal row counts that all match the corpus's mixture of sources.

Within each source rows are ranked in a seeded shuffle; a row's fractional rank is (rank - phase) / size of its source,
with a seeded phase in (0, 1) for each source, so that rows of many tiny sources don't meet at one value. In the order of
fractional ranks every prefix holds each source in proportion, so any cut into contiguous runs does too.

Neither ranking uses a window over a whole source or over everything:
- a source's rows are dealt into `cells` by the leading bits of their shuffle hash; counts by (source, cell) give each
  cell's first rank, and ranks inside a cell come from a window over (source, cell);
- fractional ranks are even on (0, 1), so `cells` equal slices of that range are even too, whatever the sources' sizes;
  counts by slice give each slice's first position, and positions inside come from a window over the slice.
The number of cells follows from that of rows, so that a window holds about CELL_ROWS; it doesn't change the result. Rows that
are equal in all that decides are counted as one before the shuffle, ranked as a run of RUN at most, and told apart again
behind it, so however often a row is repeated, no window holds all its copies.
The text is read once, for its size and checksum; only narrow rows are shuffled.

Law `rows`: with N rows, shard k holds positions floor(kN/S) to floor((k+1)N/S) - 1, so counts differ by one at most.
Equal texts are not kept together: a group of copies may be larger than a shard.

Defined cases: a null text has no bytes and checksum 0; very long texts count with all their bytes; a null source is a source
of its own; rows without an id and repeated rows each get their own slot (equal rows are interchangeable); ties of the
shuffle go by id, checksum and size; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vecloom.llm.common import at, materialize

SHARDS, SEED, LEAST_CELLS, CELL_ROWS, RUN = 24, 42, 4096, 1 << 16, 4096
ROW_BYTES = 8


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, cells: int | None = None) -> DataFrame:
    """One row for each document: id_col, size, text_crc32, law, shard, slot, grown_shard, source.

    cells (a power of two) bounds what one window partition holds: a source's rows / cells, and all rows / cells. It follows from the number of rows if it is None.
    """
    text = at(text_col).cast("binary")
    source = at(source_col).cast("string")
    slim = docs.select(
        at(id_col).alias("id"),
        source.alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
    )
    # A long of 62 bits: what follows divides it by shifts only.
    slim = slim.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "crc", "size", "source"), 2))
    one = slim.groupBy("id", "source", "size", "crc", "h").agg(F.count(F.lit(1)).alias("copies"))
    runs = one.select("id", "source", "size", "crc", "h", F.explode(F.expr(f"transform(sequence(0L, (copies - 1) div {RUN}), i -> least({RUN}L, copies - {RUN} * i))")).alias("n"))
    slim = materialize(runs, "shard-rows")
    if cells is None:
        cells = LEAST_CELLS
        total = slim.agg(F.sum("n")).first()[0] or 0
        while cells * CELL_ROWS < total:
            cells *= 2
    bits = cells.bit_length() - 1
    slim = slim.withColumn("cell", F.shiftright("h", 62 - bits).cast("int"))

    sizes = slim.groupBy("source", "cell").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("source").orderBy("cell")
    sizes = sizes.select(
        "source",
        "cell",
        (F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("of"),
    )
    # Unlike the rows, this table is small: cells for each source at most.
    ranked = slim.alias("r").join(sizes.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell")))
    ranked = ranked.select("r.id", "r.source", "r.size", "r.crc", "r.h", "r.n", "r.cell", "c.before", "c.of")
    # Of the runs of copies that share a hash, cells hold one after the other.
    inside = F.sum("n").over(Window.partitionBy("source", "cell").orderBy("h", "id", "crc", "size", "n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = ranked.withColumn("inside", inside)
    ranked = ranked.withColumn("inside", F.explode(F.sequence(F.col("inside") + 1, F.col("inside") + F.col("n"))))
    phase = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "source"), 12).cast("double") + 0.5) / float(1 << 52)
    ranked = ranked.withColumn("f", (F.col("before") + F.col("inside") - phase) / F.col("of"))
    ranked = ranked.withColumn("slice", F.least(F.floor(F.col("f") * cells), F.lit(cells - 1)).cast("int"))
    ranked = materialize(ranked.select("id", "source", "size", "crc", "h", "f", "slice"), "shard-ranks")

    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))  # cells rows at most
    whole = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.select("slice", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("of"))
    placed = ranked.join(F.broadcast(slices), "slice")
    position = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("f", "source", "h", "id", "crc", "size")) - 1
    placed = placed.withColumn("position", position)
    k = F.expr(f"((position + 1) * {shards} - 1) div of")
    placed = placed.withColumn("shard", k)
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * of) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source").alias("source"),
    )
