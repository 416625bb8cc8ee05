"""Sharding along a Hilbert curve over several quantised metadata dimensions, with DataFrame operations only.

Rows get a cell of a grid over their dimensions; cells are ordered by their index on the Hilbert curve, so that runs of
the order stay close in every dimension and files can be pruned by any of them. The order is cut at equal counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of each dimension: with three of them the curve has 4,096 cells.
BITS = 4
#: Rows ranked together at most on average, and parts of the table at least.
PART_ROWS, PARTS = 200_000, 4096


def grid_cells(bits: int = BITS, n: int = 3) -> dict[tuple[int, ...], int]:
    """Curve index of every cell of the grid, ``2 ** (bits * n)`` entries (Skilling's transposed form).

    From the highest bit down, coordinates whose bit is set invert the lower bits of the first coordinate, others
    exchange them with it; then the coordinates are Gray decoded and their bits interleaved.
    """
    table = {}
    for code in range(1 << (bits * n)):
        x = [code >> (bits * i) & ((1 << bits) - 1) for i in range(n)]
        at = tuple(x)
        for level in range(bits - 1, 0, -1):
            low = (1 << level) - 1
            for i in range(n):
                if x[i] >> level & 1:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
        for i in range(1, n):
            x[i] ^= x[i - 1]
        turn = 0
        for level in range(bits - 1, 0, -1):
            if x[n - 1] >> level & 1:
                turn ^= (1 << level) - 1
        x = [c ^ turn for c in x]
        table[at] = sum((x[i] >> level & 1) << (level * n + n - 1 - i) for level in range(bits) for i in range(n))
    return table


def hilbert_cell(dims: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer coordinates below ``2 ** bits``: a lookup in a constant array that Spark folds once."""
    n, cells = len(dims), grid_cells(bits, len(dims))
    order = [cells[tuple(code >> (bits * i) & ((1 << bits) - 1) for i in range(n))] for code in range(1 << (bits * n))]
    code = dims[0].cast("int")
    for i in range(1, n):
        code = code + F.shiftleft(dims[i].cast("int"), bits * i)
    return F.element_at(F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>"), code + 1)


def _ordinal(name: str, shared: int) -> Column:
    """A number in the order of a text column: seven bytes behind the ``shared`` first ones; null comes first."""
    raw = F.substring(F.col(name).cast("string").cast("binary"), shared + 1, 7)
    return F.coalesce(F.conv(F.rpad(F.hex(raw), 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))


def describe(docs: DataFrame, bits: int = BITS, by: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, d0, d1, d2): what sharding needs of each document, and its grid coordinates.

    The dimensions are the size on a log2 scale in whole steps, and the place of the source and of the language among the
    quantiles of their values in order, so that ranges of each stay together. Null text counts as empty with 0 bytes; null
    source or language comes before all others. Values that agree in the seven bytes behind what all have in common share
    a coordinate.
    """
    top = (1 << bits) - 1
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + 8
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), *(F.col(c).cast("string").alias(c) for c in by)
    )
    # Two rows of aggregates, whatever the table: what all values begin with, and the quantiles.
    ends = docs.agg(*(f(F.col(c).cast("string")).alias(f"{f.__name__}_{c}") for c in by for f in (F.min, F.max))).first()
    numbers = {}
    for c in by:
        pair = [(ends[f"{f}_{c}"] or "").encode() for f in ("min", "max")]
        numbers[c] = _ordinal(c, next((i for i, (x, y) in enumerate(zip(*pair, strict=False)) if x != y), min(map(len, pair))))
    cuts = [k / (top + 1) for k in range(1, top + 1)]
    found = docs.select(*(numbers[c].alias(c) for c in by)).agg(*(F.percentile_approx(c, cuts, 10_000).alias(c) for c in by)).first()
    place = {}
    for c in by:
        bounds = sorted(set(found[c] or ()))
        nth = sum((F.when(numbers[c] > x, 1).otherwise(0) for x in bounds), F.lit(0))
        # Few distinct values spread over the whole axis, else they would differ in the curve's last bits only.
        place[c] = F.floor(nth * top / max(1, len(bounds)))
    d0 = F.least(F.lit(top), F.greatest(F.lit(0), F.floor(F.log2("size") - 4)))
    return rows.select("doc_id", "size", "text_crc32", d0.alias("d0"), place[by[0]].alias("d1"), place[by[1]].alias("d2"))


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, cell, position, shard, slot): documents along the curve, cut into equal counts.

    The rank within the order is exact. A cell with many rows, such as one hot source, is split by a hash of the rows
    into parts of about ``part_rows`` rows, or fewer while the table is small, and only parts are ranked by a window.
    Equal texts of one source and language share a cell. Ties of all columns are repeated rows, whose order is the same
    either way. An empty table gives no rows.
    """
    cell = hilbert_cell([F.col("d0"), F.col("d1"), F.col("d2")], bits)
    rows = materialize(describe(docs, bits).select("doc_id", "size", "text_crc32", cell.alias("cell")))
    # As many rows as the curve has cells at most.
    cells = materialize(rows.groupBy("cell").count())
    total = cells.agg(F.sum("count")).first()[0] or 0
    size = min(part_rows, max(1, total // PARTS))
    by_cell = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("count").over(by_cell), F.lit(0)).alias("cell_start"),
        F.ceil(F.col("count") / size).cast("long").alias("parts"),
    )
    dealt = rows.join(F.broadcast(cells), "cell").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("parts"))
    )
    counts = dealt.groupBy("cell", "cell_start", "part").count()
    by_part = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "cell", "part", (F.col("cell_start") + F.coalesce(F.sum("count").over(by_part), F.lit(0))).alias("start")
    )
    ranked = dealt.withColumn(
        "rank", F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size"))
    )
    position = (F.col("start") + F.col("rank") - 1).alias("position")
    out = ranked.join(starts, ["cell", "part"]).select("doc_id", "size", "text_crc32", "cell", position)
    # The first total % shards shards get one more row than the rest.
    least, more = divmod(total, shards)
    head = more * (least + 1)
    at = F.col("position")
    early = at < head
    shard = F.when(early, F.floor(at / (least + 1))).otherwise(more + F.floor((at - head) / max(1, least)))
    slot = F.when(early, at % (least + 1)).otherwise((at - head) % max(1, least))
    return out.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
