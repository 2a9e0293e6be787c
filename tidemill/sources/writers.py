"""Outputs: prediction matrix, error summary, detail, coefficients, selection; Parquet or CSV, by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import mse_bands, overall
from ..operators.models import coefficient_detail


def write(df: DataFrame, path: str, csv: bool = False, by: str | None = None) -> None:
    out = df.write.mode("overwrite")
    if by:
        out = out.partitionBy(by)
    out.option("header", True).csv(path) if csv else out.parquet(path)


def prediction_matrix(detail: DataFrame, horizon: int = 10) -> DataFrame:
    """forecast_id, day_1 .. day_h."""
    wide = detail.groupBy("forecast_id").pivot("horizon", list(range(1, horizon + 1))).agg(F.first("predicted"))
    return wide.withColumnsRenamed({str(h): f"day_{h}" for h in range(1, horizon + 1)})


def write_forecast(detail: DataFrame, folder: str, csv: bool = False, names: list[str] | None = None) -> None:
    """The tables of a forecast, each in a folder of its own; the weights too where detail has them and names are given."""
    write(prediction_matrix(detail), f"{folder}/pred_matrix", csv)
    write(mse_bands(detail), f"{folder}/mse_summary", csv)
    write(detail.drop("coef", "floor", "alpha"), f"{folder}/forecast_detail", csv)
    if names is not None:
        write(coefficient_detail(detail, names), f"{folder}/coefficients", csv)


def write_selection(selection: DataFrame, path: str, csv: bool = False) -> None:
    """The selection summary, the most frequent predictors first."""
    rows = selection.select("predictor", F.col("metric").alias("metric_name"), "n_selected", "total_slots", "pct_selected", "seed", "expanded", "forced", "in_model", "ordinal")
    write(rows.orderBy(F.desc("n_selected"), "ordinal").drop("ordinal").coalesce(1), path, csv)


def model_name(model: str = "basic", window: int | None = None, weather: bool = True, smooth: bool = False) -> str:
    """The name that tells a model's outputs apart."""
    return ("" if weather else "nwx_") + model + ("_esmooth" if smooth else "") + (f"_w{window}" if window else "")


def summary(bands: DataFrame) -> str:
    """Mean and median error of both bands, as text."""
    r = overall(bands).first()
    show = lambda x: "none" if x is None else f"{x:.4f}"
    return "\n".join(f"MSE days {band}: mean {show(r[f'mean_{c}'])}, median {show(r[f'median_{c}'])}" for band, c in (("1-5", "mse_1_5"), ("6-10", "mse_6_10")))
