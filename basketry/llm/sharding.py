"""Sharding along a Hilbert curve over document metadata.

Language, source and length are quantised to a few bits each; a cell of that grid gets its
index on the Hilbert curve, so that cells near one another on the curve agree in several
dimensions at once. Documents are ranked along the curve and cut into runs of equal row
counts, which leaves each shard a narrow range in every dimension for file pruning.

The global rank needs no single-task sort. The grid has a fixed number of cells; cells are
counted, each is cut into sub-cells of bounded size by a hash of ``doc_id``, size and checksum
of the text (so a source or a null id with a third of all rows is many sub-cells), and sub-cell
counts are summed along the curve. Both tables are bounded by the grid and the number of
sub-cells and are broadcast; ranks inside a sub-cell come from one window over identifiers and
sizes, not texts. Texts are read once; counts and ranks come from a slim table of the rows.

Defined cases: null lang, source or n_chars quantise to 0; a null text has no bytes; rows that
repeat a doc_id, or have none, get slots of their own; with fewer rows than shards the last
shards stay empty; an empty table gives an empty result. :func:`write_shards` keeps every row
and all columns; its own column is called ``shard``, with underscores behind where the table
has one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.workspace import free_name, new_path, written

#: Bits a dimension: the grid has 2 ** (3 * BITS) cells.
BITS = 4
#: Sub-cells that a table is cut into besides the grid's own cells, and the rows that one of them has at least.
SUBCELLS, SUBCELL_ROWS = 4096, 256
#: Columns of a row's place in the grid.
AXES = ["_lang", "_source", "_length"]


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point whose axes are integers of ``bits`` bits (Skilling's transform)."""
    n = len(axes)
    x = F.array(*[a.cast("long") for a in axes])
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def undo(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low = q - F.lit(1)
        own = F.element_at(x, i + 1)
        t = (F.element_at(x, 1).bitwiseXOR(own)).bitwiseAND(low)
        flip = own.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == i), v.bitwiseXOR(F.when(i == 0, F.lit(0)).otherwise(t))).otherwise(v),
        )

    walk = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])
    x = F.aggregate(walk, x, undo)
    # Gray encoding: each axis takes the running XOR of those before it
    x = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda v, k: F.when(k == i, v.bitwiseXOR(F.element_at(a, i))).otherwise(v))
    )
    fix = F.aggregate(
        F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]),
        F.struct(F.lit(0).cast("long").alias("t"), F.element_at(x, n).alias("last")),
        lambda s, q: F.struct(F.when(s["last"].bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"]).alias("t"), s["last"].alias("last")),
        lambda s: s["t"],
    )
    x = F.transform(x, lambda v: v.bitwiseXOR(fix))
    places = F.sequence(F.lit(bits * n - 1), F.lit(0), F.lit(-1))  # of the index's bits, highest first: bit of axis 0, 1, ...
    return F.aggregate(
        places, F.lit(0).cast("long"), lambda acc, p: acc * 2 + F.expr("1L").bitwiseAND(F.call_function("shiftright", F.element_at(x, (F.lit(bits * n - 1) - p) % n + 1), F.floor(p / n).cast("int")))
    )


def grid_axes(bits: int = BITS) -> list[Column]:
    """Language and source by hash, length by its power of two."""
    most = (1 << bits) - 1
    by_hash = [F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(1 << bits)).cast("int") for c in ("lang", "source")]
    length = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0)) + 1)), F.lit(most))
    return [*by_hash, length.cast("int")]


def _slim(docs: DataFrame, bits: int, *more: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    axes = [a.alias(n) for n, a in zip(AXES, grid_axes(bits), strict=True)]
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *axes, *more)
    return rows.withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32"))


def _placed(rows: DataFrame, shards: int, bits: int) -> DataFrame:
    """The rows of :func:`_slim` with hilbert, shard and slot."""
    cells = rows.groupBy(*AXES).count().withColumn("hilbert", hilbert_index([F.col(a) for a in AXES], bits))
    total = F.sum("count").over(Window.partitionBy())
    size = F.greatest(F.lit(SUBCELL_ROWS), F.ceil(total / SUBCELLS))
    cells = written(cells.select(*AXES, "hilbert", F.ceil(F.col("count") / size).cast("int").alias("cuts")), "hilbert-cells")
    placed = rows.join(F.broadcast(cells), AXES).withColumn("sub", F.pmod("hash", F.col("cuts").cast("long")).cast("int"))
    counts = placed.groupBy("hilbert", "sub").count()
    along = Window.orderBy("hilbert", "sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("hilbert", "sub", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("total"))
    counts = written(counts, "hilbert-counts")
    inside = Window.partitionBy("hilbert", "sub").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("row", F.row_number().over(inside)).join(F.broadcast(counts), ["hilbert", "sub"])
    rank, low = F.col("before") + F.col("row") - 1, F.floor(F.col("total") / shards)
    more = F.col("total") % shards  # the first shards that hold one row more
    early = F.col("rank") < more * (low + 1)
    late = F.col("rank") - more * (low + 1)
    shard = F.when(early, F.floor(F.col("rank") / (low + 1))).otherwise(more + F.floor(F.try_divide(late, low)))
    slot = F.when(early, F.col("rank") % (low + 1)).otherwise(F.try_mod(late, low))
    return ranked.withColumn("rank", rank).withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))


def assign(docs: DataFrame, shards: int = 40, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row; shard row counts are at most one apart."""
    return _placed(written(_slim(docs, bits), "hilbert-rows"), shards, bits).select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot")


def write_shards(docs: DataFrame, shards: int = 40, path: str | None = None, bits: int = BITS) -> str:
    """Write every row by shard, sorted along the curve, with all its columns; the path. Rows travel whole, beside their place."""
    path = path or new_path(docs.sparkSession, "hilbert-shards")
    name = free_name(docs, "shard")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    placed = _placed(_slim(docs, bits, whole), shards, bits).select(F.col("shard").alias(name), "slot", "whole")
    dealt = placed.repartitionByRange(shards, name, "slot").sortWithinPartitions(name, "slot")
    dealt.select(name, "whole.*").write.partitionBy(name).parquet(path)
    return path
