"""Order statistics and running totals in value order, without sorting anything in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import materialize

IN_PLAN_LIMIT = 200_000  # up to this many rows one exact `percentile` aggregate is used


def place_in_order(df: DataFrame, order: list[str], by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt to sorted ranges whose ends are sampled from the data, with ``_part`` and ``_at`` (rising along the order), and
    the parts (``by``, ``_part``) with ``_n`` rows each.  The ranges follow the data: a prefix or a value that many rows share takes no larger part.
    """
    by = by or []
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    return placed, placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))


def order_rank(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in the order (which must tell all rows apart), over all rows or within each ``by`` group."""
    by = by or []
    placed, parts = place_in_order(df, order, by)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(shift, same).withColumn(out, F.col("_at") + F.col("_shift")).select(*df.columns, out)


def running_totals(df: DataFrame, value_col: str, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Per distinct value (and ``by`` group): each sum, and its total over all smaller values.

    Equal values collapse in the map-side aggregation first, so one value holding most rows costs one row.  What is left is
    dealt to ranges (``_part``, rising) of the data's own order.  ``sums`` columns come back with ``<name>_below``.
    """
    by, names = by or [], list(sums)
    grouped = df.groupBy(*by, F.col(value_col).cast("double").alias(value_col)).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    placed, _ = place_in_order(grouped, [value_col], by)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_part").agg(*[F.sum(n).alias(n) for n in names])
        .select(*by, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names])
    )
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names])
    return running.join(offsets, [*by, "_part"]).select(
        *by, value_col, "_part", *names, *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(f"{n}_below") for n in names]
    )


def column_order_statistics(
    df: DataFrame, vec_col: str, dim: int, positions: list[int], max_cells: int = 65_536,
) -> np.ndarray:
    """Exact values at 0-based sorted ``positions`` of every vector entry, shape (dim, positions).

    Repeated histogram narrowing: each pass counts the rows of one shrinking interval per target in
    at most ``max_cells`` cells, until the interval holds a single value.  Only histograms travel.
    """
    spark = df.sparkSession
    data = df.select(F.col(vec_col).cast("array<double>").alias("v"))
    n_pos = len(positions)
    targets = dim * n_pos
    bins = max(16, max_cells // targets)
    bounds = data.mapInArrow(_range_of(dim), "d int, lo double, hi double").groupBy("d").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).toPandas().set_index("d").sort_index()
    lo = np.repeat(bounds["lo"].to_numpy(), n_pos)
    hi = np.repeat(bounds["hi"].to_numpy(), n_pos)
    below = np.zeros(targets, dtype=np.int64)
    want = np.tile(np.asarray(positions, dtype=np.int64), dim)
    while True:
        open_targets = np.flatnonzero(lo < hi)
        if len(open_targets) == 0:
            return lo.reshape(dim, n_pos)
        state = spark.sparkContext.broadcast((open_targets, lo[open_targets], hi[open_targets], n_pos, bins))
        cells = data.mapInArrow(_cell_counts(state, dim), "t int, b int, n long, lo double, hi double").groupBy("t", "b").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ).toPandas().sort_values(["t", "b"])
        for t, part in cells.groupby("t"):
            reach = below[t] + part["n"].cumsum().to_numpy()
            i = int(np.searchsorted(reach, want[t], side="right"))
            below[t] = reach[i] - part["n"].iloc[i]
            lo[t], hi[t] = part["lo"].iloc[i], part["hi"].iloc[i]
        state.destroy()


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _range_of(dim: int):
    def run(batches):
        lo, hi = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch, dim)
                lo, hi = np.minimum(lo, m.min(axis=0)), np.maximum(hi, m.max(axis=0))
        if np.isfinite(lo).any():
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(dim), pa.int32()), "lo": lo, "hi": hi})
    return run


def _cell_counts(state, dim: int):
    def run(batches):
        open_targets, lo, hi, n_pos, bins = state.value
        counts = np.zeros((len(open_targets), bins), dtype=np.int64)
        low = np.full((len(open_targets), bins), np.inf)
        high = np.full((len(open_targets), bins), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch, dim)
            for i, t in enumerate(open_targets):
                col = m[:, t // n_pos]
                col = col[(col >= lo[i]) & (col <= hi[i])]
                if len(col):
                    cell = np.minimum(((col - lo[i]) / (hi[i] - lo[i]) * bins).astype(np.int64), bins - 1)
                    np.add.at(counts[i], cell, 1)
                    np.minimum.at(low[i], cell, col)
                    np.maximum.at(high[i], cell, col)
        ti, bi = np.nonzero(counts)
        if len(ti):
            yield pa.RecordBatch.from_pydict({
                "t": pa.array(open_targets[ti], pa.int32()), "b": pa.array(bi, pa.int32()),
                "n": counts[ti, bi], "lo": low[ti, bi], "hi": high[ti, bi],
            })
    return run


def quantiles(
    df: DataFrame, value_col: str, probs: list[float], n: int | None = None, in_plan_limit: int = IN_PLAN_LIMIT,
) -> list[float]:
    """Exact linear-interpolated quantiles of one column; nulls do not count, NaN is the largest value.

    ``n``: rows with a value, if known.  No row with a value gives NaN for every quantile.
    """
    known = df.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    counts = known.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnan("v")).alias("nan")).first()
    rows, plain = counts["rows"], counts["rows"] - counts["nan"]
    if not rows:
        return [float("nan")] * len(probs)
    numbers = known.where(~F.isnan("v"))
    ends = sorted({min(int(p * (rows - 1)) + up, rows - 1) for p in probs for up in (0, 1)})
    inside = [e for e in ends if e < plain]
    at = {e: float("nan") for e in ends}
    if inside and plain <= in_plan_limit:
        shares = F.array(*[F.lit(e / max(1, plain - 1)) for e in inside])
        at.update(zip(inside, numbers.agg(F.percentile("v", shares).alias("q")).first()["q"]))
    elif inside:
        at.update(zip(inside, column_order_statistics(numbers.select(F.array("v").alias("v")), "v", 1, inside)[0]))
    out = []
    for p in probs:
        spot = p * (rows - 1)
        i = int(spot)
        low, high = at[i], at[min(i + 1, rows - 1)]
        out.append(float(low) if spot == i or low == high else float(low + (high - low) * (spot - i)))
    return out
