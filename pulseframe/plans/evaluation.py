"""Composed evaluation of a long prediction table (sample, class, y, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import probability as P
from ..operators import calibration as C, metrics as M


def protocol_status(calibration: DataFrame | None, frozen: bool) -> str:
    """Fresh calibration rows make an evaluation prospective."""
    return "PROSPECTIVE" if calibration is not None else ("FROZEN_PARAMS" if frozen else "RETROSPECTIVE")


def evaluation_bundle(
    test: DataFrame,
    calibration: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
    temperature: float | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Per-class ranking, decision, calibration and threshold figures of the test rows.

    Thresholds and temperature are fitted on the calibration rows only, or given frozen;
    without either, the thresholds describe the test rows and the status says so.
    """
    status = protocol_status(calibration, thresholds is not None)
    fit = calibration if calibration is not None else test
    rep = M.multilabel_report(test, threshold).drop("tp", "fp", "tn", "fn", "support")
    cal = C.report(test)
    x = rep.join(cal, "class")
    if thresholds is None:
        x = x.join(M.max_f1_threshold(fit, ["class"]).select("class", "threshold"), "class")
    else:
        x = x.withColumn("threshold", F.try_element_at(F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv]), F.col("class")))
    if calibration is not None or temperature is not None:
        t = temperature if temperature is not None else C.fit_temperature(fit)
        after = C.report(test.withColumn("p", P.temperature(F.col("p"), t)))
        after = after.select("class", *[F.col(c).alias(f"{c}_after") for c in ("ece", "mce", "brier", "nll")])
        x = x.join(after, "class").withColumn("temperature", F.lit(t))
    return x.withColumn("protocol", F.lit(status))
