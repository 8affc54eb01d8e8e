"""The area statistics as one job: raw price rows to neighbourhoods, district index and province list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import areas as A
from ..operators.order_stats import count_values
from ..session import stored
from ..sources import sinks


def build_areas(raw: DataFrame, path: str, price_year: int, coordinates: DataFrame | None = None) -> DataFrame:
    """Write the tables below ``path`` and return the accounting of the raw rows.

    ``coordinates`` (code, dong, lat, lon) holds neighbourhoods, and districts in rows without a dong.  What is not in
    it has no coordinates.  Labels ride on the value counts, so unit rows are grouped once.
    """
    labelled = stored(count_values(A.clean_units(raw), ["code", "dong", "region"], "price"), "area-counts")
    counted = labelled.groupBy("code", "dong", "price").agg(F.sum("cnt").alias("cnt"))
    areas = A.dong_stats(counted)
    index = A.district_stats(counted).join(A.district_labels(labelled), "code").withColumn("short", A.short_label(F.col("region")))
    if coordinates is None:
        areas, index = (t.withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")}) for t in (areas, index))
    else:
        of_district = F.coalesce("dong", F.lit("")) == ""
        areas = A.with_coordinates(areas, coordinates.where(~of_district), ["code", "dong"])
        index = A.with_coordinates(index, coordinates.where(of_district), ["code"])
    sinks.write_area_payload(areas, stored(index, "area-index"), path, price_year)
    return A.accounting(raw)
