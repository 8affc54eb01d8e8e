"""The study as one job: clean once, then dispersion, area effect, models and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import study as S
from ..session import stored


def run_study(raw: DataFrame, output: str) -> dict[str, DataFrame]:
    """Write every report below ``output`` (CSV with header) and return them by name."""
    rows = stored(S.typed(raw), "study-typed")
    plausible = stored(S.plausible_rows(rows), "study-plausible")
    kept = stored(S.keep_large_groups(plausible), "study-kept")
    groups = stored(S.dispersion(kept), "study-groups")
    train, test = S.train_test(kept)
    predicted = stored(S.predict(test, *S.training_stats(train)), "study-predicted")
    reports = {
        "cleaning": S.cleaning_report(rows),
        "excluded": S.excluded_report(plausible),
        "q1_summary": S.dispersion_summary(groups),
        "q1_metric_distribution": S.metric_distribution(groups),
        "area_bins": S.area_bin_table(kept),
        "area_effect": S.fixed_effect_slopes(kept),
        "models": S.model_errors(predicted),
        "models_by_region": S.model_errors(predicted, ["region"], [S.PRIMARY]),
        "intervals": S.interval_decisions(predicted),
        "histogram": S.histogram_approximation(train, test),
    }
    for name, report in reports.items():
        report.write.mode("overwrite").option("header", True).csv(f"{output}/{name}")
    return reports
