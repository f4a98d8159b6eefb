import datetime as dt

from pyspark.sql import types as T

NAV_SCHEMA = T.StructType(
    [
        T.StructField("scheme_code", T.LongType()),
        T.StructField("nav_date", T.DateType()),
        T.StructField("nav", T.DoubleType()),
    ]
)

D0 = dt.date(2024, 1, 1)


def series(spark, navs, code=1, start=D0, step_days=1, dates=None):
    """A NAV series for one scheme: consecutive days unless ``dates`` given."""
    if dates is None:
        dates = [start + dt.timedelta(days=i * step_days) for i in range(len(navs))]
    return spark.createDataFrame([(code, d, None if v is None else float(v)) for d, v in zip(dates, navs)], NAV_SCHEMA)


def rows_by_date(df):
    return {r["nav_date"]: r.asDict() for r in df.collect()}
