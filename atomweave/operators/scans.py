"""Ordered scans that never put one key into one task.

A plain ``row_number() OVER (PARTITION BY structure ORDER BY atom)`` sends a whole structure to one
task; with a structure that holds a third of all rows this does not finish.  Here every ordered
series is cut into blocks of a bounded ordinal range:

* inside a block an ordinary window runs over ``(keys, block)``;
* one summary row per block is aggregated, and a second window over the few summary rows gives each
  block what it needs from all earlier blocks (offset, last value, ...);
* the summary is joined back on ``(keys, block)``, where both sides are already partitioned alike.

Series with a dense ordinal that only look a few rows back or ahead use :func:`halo` instead, which
copies the few rows at block borders and needs neither the summary nor the join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536
HALO_BLOCK = 4096


def tag(df: DataFrame, ordinal: str | Column, width: int = BLOCK) -> DataFrame:
    """Add the block number ``_blk`` of each row."""
    value = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return df.withColumn("_blk", F.floor(value / F.lit(width)).cast("long"))


def block_width(df: DataFrame, ordinal: str, blocks: int = 32) -> int:
    """Width that cuts the range of ``ordinal`` into ``blocks`` at most: the rows of a key that are strewn over a wide range would else be
    nearly as many blocks as rows.  Reads one column."""
    low, high = df.agg(F.min(ordinal), F.max(ordinal)).first()
    return BLOCK if low is None else max(BLOCK, -(-(high - low + 1) // blocks))


def inside(keys: Sequence[str], order: Sequence) -> Window:
    """Window over one block."""
    return Window.partitionBy(*keys, "_blk").orderBy(*order)


def upto(keys: Sequence[str], order: Sequence) -> Window:
    """Running frame inside one block, current row included."""
    return inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def across(keys: Sequence[str]) -> Window:
    """Window over the block summaries of one key."""
    return Window.partitionBy(*keys).orderBy("_blk")


def earlier(keys: Sequence[str]) -> Window:
    """All summaries of earlier blocks of one key."""
    return across(keys).rowsBetween(Window.unboundedPreceding, -1)


def attach(df: DataFrame, keys: Sequence[str], summaries: DataFrame) -> DataFrame:
    """Join block results back to the rows of their block."""
    return df.join(summaries, [*keys, "_blk"])


def row_index(df: DataFrame, keys: Sequence[str], ordinal: str, order: Sequence, name: str,
              total: str | None = None, width: int = BLOCK, keep_block: bool = False) -> DataFrame:
    """Zero-based dense position of each row within its key, and optionally the key's row count and the block ``_blk``."""
    tagged = tag(df, ordinal, width)
    counts = tagged.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    columns = [F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0)).alias("_base")]
    if total:
        columns.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(total))
    offsets = counts.select(*keys, "_blk", *columns)
    local = tagged.withColumn(name, F.row_number().over(inside(keys, order)) - 1)
    return (attach(local, keys, offsets)
            .withColumn(name, F.col("_base") + F.col(name))
            .drop("_base", *([] if keep_block else ["_blk"])))


def running_sum(df: DataFrame, keys: Sequence[str], ordinal: str, sums: dict[str, Column],
                width: int = BLOCK) -> DataFrame:
    """Inclusive running sums of integer expressions along ``ordinal``."""
    tagged = tag(df, ordinal, width)
    for name, value in sums.items():
        tagged = tagged.withColumn(f"_v_{name}", value.cast("long"))
    totals = (tagged.groupBy(*keys, "_blk")
              .agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
              .select(*keys, "_blk", *[
                  F.coalesce(F.sum(f"_t_{name}").over(earlier(keys)), F.lit(0)).alias(f"_t_{name}")
                  for name in sums]))
    local = tagged
    for name in sums:
        local = local.withColumn(name, F.sum(f"_v_{name}").over(upto(keys, [ordinal])))
    joined = attach(local, keys, totals)
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_t_{name}"))
    return joined.drop("_blk", *[f"_v_{n}" for n in sums], *[f"_t_{n}" for n in sums])


def last_before(df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, name: str,
                width: int = BLOCK) -> DataFrame:
    """Latest non-null ``value`` on any strictly earlier row of the key."""
    tagged = tag(df, ordinal, width).withColumn("_v", value)
    lasts = (tagged.where(F.col("_v").isNotNull())
             .groupBy(*keys, "_blk").agg(F.max_by("_v", ordinal).alias("_last")))
    blocks = tagged.select(*keys, "_blk").distinct().join(lasts, [*keys, "_blk"], "left")
    carried = blocks.select(*keys, "_blk",
                            F.last("_last", ignorenulls=True).over(earlier(keys)).alias("_carry"))
    frame = inside(keys, [ordinal]).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn(name, F.last("_v", ignorenulls=True).over(frame))
    return (attach(local, keys, carried)
            .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
            .drop("_blk", "_v", "_carry"))


def runs(df: DataFrame, keys: Sequence[str], ordinal: str, state: Column,
         breaks: dict[str, Callable[[Column, Column], Column]], index: str | None = None,
         positions: Sequence[str] = (), width: int = BLOCK) -> DataFrame:
    """Number consecutive runs along ``ordinal``.

    ``state`` is what two neighbouring rows are compared on; ``breaks[name](current, previous)`` says
    whether a new run of kind ``name`` starts.  Adds a zero-based run number per kind, optionally the
    dense row position ``index``, and for kinds in ``positions`` the row position inside the run
    (``<name>_pos``) and whether the row ends its run (``<name>_end``).  Runs are counted inside
    bounded blocks; whether a block opens with a new run is decided on the block summaries from the
    last row of the block before it.  A column ``_blk`` of ``df`` (:func:`row_index`, with ``ordinal`` as the index) is taken as
    the blocks, so rows that lie by block already are not shuffled again.
    """
    order, upto_here = inside(keys, [ordinal]), upto(keys, [ordinal])
    placed = df if "_blk" in df.columns else tag(df, ordinal, width)
    local = placed.withColumn("_state", state).withColumns(
        {"_prev": F.lag("_state").over(order), "_row": F.row_number().over(order) - 1})
    inner = {name: F.col("_prev").isNotNull() & starts(F.col("_state"), F.col("_prev"))
             for name, starts in breaks.items()}
    local = local.withColumns(
        {f"_s_{name}": F.when(starts, 1).otherwise(0) for name, starts in inner.items()}
        | {f"_at_{name}": F.when(inner[name], F.col("_row")) for name in positions})
    summary = local.groupBy(*keys, "_blk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_state", ordinal).alias("_first"), F.max_by("_state", ordinal).alias("_last"),
        *[F.sum(f"_s_{name}").alias(f"_c_{name}") for name in breaks],
        *[F.max(f"_at_{name}").alias(f"_m_{name}") for name in positions])
    blocks = summary.withColumns({
        "_before": F.lag("_last").over(across(keys)),
        "_base": F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0))})
    blocks = blocks.withColumns({
        f"_o_{name}": F.when(F.col("_before").isNull() | starts(F.col("_first"), F.col("_before")), 1).otherwise(0)
        for name, starts in breaks.items()})
    so_far = across(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [F.col("_base")]
    for name in breaks:
        total = F.sum(F.col(f"_c_{name}") + F.col(f"_o_{name}")).over(so_far)
        columns.append((total - F.col(f"_c_{name}") - 1).alias(f"_b_{name}"))
    for name in positions:
        opened = F.when(F.col(f"_o_{name}") == 1, F.col("_base"))
        last_start = F.coalesce(F.col("_base") + F.col(f"_m_{name}"), opened)
        columns.append(F.coalesce(opened, F.last(last_start, ignorenulls=True).over(earlier(keys)))
                       .alias(f"_r_{name}"))
        columns.append(F.coalesce(F.lead(f"_o_{name}").over(across(keys)), F.lit(1)).alias(f"_x_{name}"))
    bases = blocks.select(*keys, "_blk", *columns)
    local = local.withColumns(
        {name: F.sum(f"_s_{name}").over(upto_here) for name in breaks}
        | {f"_run_{name}": F.max(f"_at_{name}").over(upto_here) for name in positions}
        | {f"_next_{name}": F.lead(f"_s_{name}").over(order) for name in positions})
    joined = attach(local, keys, bases)
    result = [F.col(c) for c in df.columns if c not in breaks and c not in (index, "_blk")]
    if index:
        result.append((F.col("_base") + F.col("_row")).alias(index))
    result += [(F.col(f"_b_{name}") + F.col(name)).alias(name) for name in breaks]
    for name in positions:
        start = F.coalesce(F.col("_base") + F.col(f"_run_{name}"), F.col(f"_r_{name}"))
        result.append((F.col("_base") + F.col("_row") - start).alias(f"{name}_pos"))
        result.append((F.coalesce(F.col(f"_next_{name}"), F.col(f"_x_{name}")) == 1).alias(f"{name}_end"))
    return joined.select(*result)


def halo(df: DataFrame, ordinal: str, before: int, after: int, width: int = HALO_BLOCK) -> DataFrame:
    """Blocks of a dense series with copies of the border rows.

    Each row lands in its own block and, near a border, also in the neighbour block whose rows look
    at it.  Windows then run over ``(keys, _blk)``; rows with ``_own`` false are the copies and have
    to be dropped after the window.
    """
    at = F.col(ordinal)
    first = F.floor((at - after) / F.lit(width)).cast("long")
    last = F.floor((at + before) / F.lit(width)).cast("long")
    own = F.floor(at / F.lit(width)).cast("long")
    return (df.withColumn("_blk", F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col("_blk") == own))


def drop_halo(df: DataFrame) -> DataFrame:
    """Keep the rows a block owns."""
    return df.where("_own").drop("_own", "_blk")
