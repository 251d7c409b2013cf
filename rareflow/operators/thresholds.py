"""Operating points chosen on a validation curve.

Each choice is one aggregate with an ordered struct minimum, so nothing is sorted
globally. Equal values always resolve to the lowest threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL
from .metrics import confusion, pr_grid, ratio, score_curve

INFEASIBLE = "recall_target/precision_floor infeasible; using max-recall point"


@dataclass
class ThresholdConfig:
    """How the operating point is chosen."""

    mode: str = "max_f1"
    recall_target: float = 0.90
    precision_floor: float = 0.30
    manual_value: float = 0.5
    fn_cost: float = 10.0
    fp_cost: float = 1.0


def _best(order: Column, feasible: Column | None = None) -> Column:
    """Grid row with the smallest ``order``; the threshold breaks ties."""
    row = F.struct(
        order.alias("o"),
        F.col("threshold").alias("threshold"),
        F.col("precision").alias("precision"),
        F.col("recall").alias("recall"),
    )
    return F.min(row if feasible is None else F.when(feasible, row))


def _result(picked: DataFrame, mode: str, note: Column, keys: list[str]) -> DataFrame:
    return picked.select(
        *keys,
        F.col("b.threshold").alias("threshold"),
        F.lit(mode).alias("mode"),
        F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
        note.alias("note"),
    )


def _pick(grid: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    columns = [c.alias(n) for n, c in aggs.items()]
    return grid.groupBy(*keys).agg(*columns) if keys else grid.agg(*columns)


def feasible(recall_target: float, precision_floor: float) -> Column:
    return (F.col("recall") >= F.lit(float(recall_target))) & (
        F.col("precision") >= F.lit(float(precision_floor))
    )


def for_recall_target(
    grid: DataFrame,
    recall_target: float = 0.90,
    precision_floor: float = 0.0,
    keys: list[str] = (),
) -> DataFrame:
    """Highest precision among feasible points, else the highest recall with a note."""
    picked = _pick(
        grid,
        keys,
        good=_best(-F.col("precision"), feasible(recall_target, precision_floor)),
        fallback=_best(-F.col("recall")),
    )
    note = F.when(F.col("good").isNull(), F.lit(INFEASIBLE)).otherwise(F.lit(""))
    chosen = picked.withColumn("b", F.coalesce("good", "fallback"))
    return _result(chosen, "recall_target", note, keys)


def for_max_f1(grid: DataFrame, keys: list[str] = ()) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    picked = _pick(grid, keys, b=_best(-ratio(2.0 * p * r, p + r)))
    return _result(picked, "max_f1", F.lit(""), keys)


def manual(
    df: DataFrame, score: str, threshold: float, label: str = LABEL, keys: list[str] = ()
) -> DataFrame:
    counts = confusion(df, score, threshold, label, keys)
    return counts.select(
        *keys,
        F.lit(float(threshold)).alias("threshold"),
        F.lit("manual").alias("mode"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.lit("").alias("note"),
    )


def cost_of(fn_cost: float, fp_cost: float) -> Column:
    """Expected cost of a grid point; a point without hits counts every negative as false."""
    missed = (F.col("n_pos") - F.col("tp")).cast("double")
    false_alarms = F.when(F.col("precision") > 0, F.col("fp")).otherwise(F.col("n_neg"))
    return F.lit(float(fn_cost)) * missed + F.lit(float(fp_cost)) * false_alarms.cast("double")


def for_min_cost(
    grid: DataFrame, fn_cost: float = 10.0, fp_cost: float = 1.0, keys: list[str] = ()
) -> DataFrame:
    picked = _pick(grid, keys, b=_best(cost_of(fn_cost, fp_cost)))
    note = F.lit(f"min expected cost (FN={fn_cost}, FP={fp_cost})")
    return _result(picked, "cost", note, keys)


def cost_sweep(
    grid: DataFrame, fn_costs: list[float], fp_cost: float = 1.0
) -> DataFrame:
    """Best point for each false-negative cost: one aggregate over the grid for all costs."""
    picked = grid.agg(*[_best(cost_of(c, fp_cost)).alias(f"b{i}") for i, c in enumerate(fn_costs)])
    rows = [F.struct(F.lit(float(c)).alias("fn_cost"), F.col(f"b{i}").alias("b")) for i, c in enumerate(fn_costs)]
    return picked.select(F.inline(F.array(*rows))).select(
        "fn_cost",
        F.col("b.threshold").alias("threshold"),
        F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
        F.col("b.o").alias("cost"),
    )


def recall_sweep(
    grid: DataFrame, targets: list[float], precision_floor: float = 0.0
) -> DataFrame:
    """Best feasible point for each recall target, same single aggregate."""
    picked = grid.agg(
        *[
            F.coalesce(
                _best(-F.col("precision"), feasible(t, precision_floor)), _best(-F.col("recall"))
            ).alias(f"b{i}")
            for i, t in enumerate(targets)
        ]
    )
    rows = [F.struct(F.lit(float(t)).alias("recall_target"), F.col(f"b{i}").alias("b")) for i, t in enumerate(targets)]
    return picked.select(F.inline(F.array(*rows))).select(
        "recall_target",
        F.col("b.threshold").alias("threshold"),
        F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
    )


def select_threshold(
    df: DataFrame,
    score: str,
    config: ThresholdConfig | None = None,
    label: str = LABEL,
    grid: DataFrame | None = None,
) -> DataFrame:
    """One row (threshold, mode, precision, recall, note) for the configured mode."""
    config = config or ThresholdConfig()
    if config.mode == "manual":
        return manual(df, score, config.manual_value, label)
    choices = {
        "recall_target": lambda g: for_recall_target(
            g, config.recall_target, config.precision_floor
        ),
        "max_f1": for_max_f1,
        "cost": lambda g: for_min_cost(g, config.fn_cost, config.fp_cost),
    }
    if config.mode not in choices:
        raise ValueError(f"unknown threshold mode: {config.mode!r}")
    if grid is None:
        grid = pr_grid(score_curve(df, score, label))
    return choices[config.mode](grid)
