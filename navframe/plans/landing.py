"""Landed payloads derived from the test tables.

The engine reads landed files (scheme-list pages, NAV documents, weather and
people objects, CSV). With no API or files in the test data, these builders
write such files from the driver tables, so every ingest query reads real
files whose size grows with the tables. Each document groups a bounded number
of items (a page of at most ``page_size`` schemes, one scheme-year of NAVs at
most 366 items, at most ``page_size`` people), never a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navframe.sources.csv import write_csv

PAGE_SIZE = 1000
#: documents of one packed file, which is read in one task
DOCUMENTS_A_FILE = 10_000
RELIST_MIN_ACCTBAL = 9000.0


def scheme_items(supplier: DataFrame) -> DataFrame:
    """Scheme-list items from ``supplier``: a growth ISIN for every scheme, a
    reinvestment ISIN only when the balance is not negative (otherwise the key
    is absent from the JSON element)."""
    code = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    return supplier.select(
        F.col("s_suppkey").alias("schemeCode"),
        F.col("s_name").alias("schemeName"),
        F.concat(F.lit("INF"), code, F.lit("G")).alias("isinGrowth"),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("INF"), code, F.lit("R"))).alias("isinDivReinvestment"),
        "s_acctbal",
    )


def land_scheme_pages(
    supplier: DataFrame, path: str, page_size: int = PAGE_SIZE, broken: bool = False, bad_every: int | None = None
) -> None:
    """One JSON array per page file under ``listing=<n>/page=<n>/``.

    Suppliers with a balance above ``RELIST_MIN_ACCTBAL`` are listed a second
    time, in a later listing, with a lower-cased name, so the batch holds
    duplicate keys whose first listing must win. With ``broken`` the pages of the
    second listing are cut off before their last character, as a download that
    broke off. ``bad_every`` gives the suppliers that it divides a code that is no
    number, or none if twice that number divides them.
    """
    items = scheme_items(supplier)
    page_no = (F.col("schemeCode") / page_size).cast("bigint")
    regular = items.select(F.lit(0).alias("listing"), page_no.alias("page"), "*")
    relisted = items.filter(F.col("s_acctbal") > RELIST_MIN_ACCTBAL).select(
        F.lit(1).alias("listing"),
        page_no.alias("page"),
        "schemeCode",
        F.lower("schemeName").alias("schemeName"),
        "isinGrowth",
        "isinDivReinvestment",
        "s_acctbal",
    )
    element = F.struct("schemeCode", "schemeName", "isinGrowth", "isinDivReinvestment")
    listed = regular.unionByName(relisted).withColumn("key", F.col("schemeCode"))
    if bad_every:
        bad = F.when(F.col("key") % (2 * bad_every) != 0, F.concat(F.lit("X"), F.col("key").cast("string")))
        listed = listed.withColumn("schemeCode", F.when(F.col("key") % bad_every == 0, bad).otherwise(F.col("key").cast("string")))
    pages = (
        listed.groupBy("listing", "page")
        .agg(F.sort_array(F.collect_list(F.struct("key", element.alias("e")))).alias("xs"))
        .select("listing", "page", F.to_json(F.transform("xs", lambda x: x["e"])).alias("value"))
    )
    if broken:
        cut = F.expr("left(value, length(value) - 1)")
        pages = pages.withColumn("value", F.when(F.col("listing") == 1, cut).otherwise(F.col("value")))
    pages.repartition("listing", "page").write.mode("overwrite").partitionBy("listing", "page").text(path)


def fund_house(code) -> F.Column:
    return F.concat(F.lit("Fund House "), (code / 10).cast("bigint").cast("string"))


def scheme_name(code) -> F.Column:
    return F.concat(F.lit("Scheme "), code.cast("string"))


def land_nav_documents(
    nav: DataFrame,
    path: str,
    year_end_unavailable: bool = False,
    no_meta_every: int | None = None,
    republish: bool = False,
    cut_every: int | None = None,
) -> None:
    """One NAV document per scheme and calendar year (JSON Lines), items
    newest first, dates as ``dd-MM-yyyy`` text and NAVs as text. The files are
    gzipped, with ``DOCUMENTS_A_FILE`` documents at most.

    With ``year_end_unavailable`` the NAV of every 31 December is published as
    ``N.A.`` (as a source does for a non-business day), which a lenient
    ingest must route to quarantine. ``no_meta_every`` leaves out ``meta`` for
    schemes whose code that number divides. ``republish`` adds, in the same file
    and after each document, one with the scheme's two oldest days of the year at
    other positions and other NAVs, which must lose. ``cut_every`` cuts off the
    documents of the schemes whose code it divides.

    Every document carries ``requested``, the code that was asked for.
    """
    # days travel as dates and numbers; their text is made where the document is. The
    # number of tasks is given: adaptive execution sizes them by packed bytes, of
    # which a few fill a task's memory once they are lists
    spark = nav.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dated = nav.select("scheme_code", F.year("nav_date").alias("yr"), "nav_date", "nav").repartition(tasks, "scheme_code", "yr")
    docs = dated.groupBy("scheme_code", "yr").agg(F.sort_array(F.collect_list(F.struct("nav_date", "nav")), asc=False).alias("xs"))

    def item(x):
        text = x["nav"].cast("string")
        if year_end_unavailable:
            year_end = (F.month(x["nav_date"]) == 12) & (F.dayofmonth(x["nav_date"]) == 31)
            text = F.when(year_end, F.lit("N.A.")).otherwise(text)
        return F.struct(F.date_format(x["nav_date"], "dd-MM-yyyy").alias("date"), text.alias("nav"))

    docs = docs.withColumn("xs", F.transform("xs", item))
    code = F.col("scheme_code")
    if republish:  # the oldest days come last in a document, here they come first
        late = F.transform(F.reverse(F.slice("xs", -2, 2)), lambda x: x.withField("nav", F.lit("0.01")))
        late = F.when(F.size("xs") >= 2, late).otherwise(F.lit(None))
        docs = docs.select("scheme_code", "yr", F.posexplode(F.array("xs", late)).alias("nth", "xs")).filter("xs IS NOT NULL")
    else:
        docs = docs.withColumn("nth", F.lit(0))
    meta = F.struct(code.alias("scheme_code"), fund_house(code).alias("fund_house"), scheme_name(code).alias("scheme_name"))
    if no_meta_every:
        meta = F.when(code % no_meta_every != 0, meta)
    value = F.to_json(F.struct(code.alias("requested"), meta.alias("meta"), F.col("xs").alias("data")))
    docs = docs.select("scheme_code", "yr", "nth", value.alias("value"))
    if cut_every:
        cut = F.expr("left(value, length(value) - 2)")
        docs = docs.withColumn("value", F.when(code % cut_every == 0, cut).otherwise(F.col("value")))
    if republish:  # a scheme's documents in one file, in order
        docs = docs.repartition("scheme_code").sortWithinPartitions("scheme_code", "yr", "nth")
    docs.select("value").write.mode("overwrite").option("maxRecordsPerFile", DOCUMENTS_A_FILE).text(path, compression="gzip")


def land_weather(events: DataFrame, path: str, cut_every: int | None = None) -> None:
    """One weather object per event (JSON Lines); ``cut_every`` cuts off the objects
    of the events whose id it divides."""
    cw = F.struct(
        F.col("value").alias("temperature"),
        F.col("user_id").cast("double").alias("windspeed"),
        F.get_json_object("props", "$.k").cast("double").alias("winddirection"),
        F.hour("ts").cast("int").alias("weathercode"),
    )
    docs = events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("event"), cw.alias("current_weather"))).alias("value"))
    if cut_every:
        cut = F.expr("left(value, length(value) - 1)")
        docs = docs.withColumn("value", F.when(F.col("event_id") % cut_every == 0, cut).otherwise(F.col("value")))
    docs.select("value").write.mode("overwrite").text(path)


def land_people(customer: DataFrame, path: str, page_size: int = PAGE_SIZE) -> None:
    """``{number, people[]}`` objects: customers per market segment, in
    pages of at most ``page_size`` people."""
    person = F.struct(F.col("c_mktsegment").alias("craft"), F.col("c_name").alias("name"))
    docs = customer.groupBy("c_mktsegment", (F.col("c_custkey") / page_size).cast("bigint").alias("pg")).agg(
        F.count(F.lit(1)).cast("int").alias("number"), F.collect_list(person).alias("people")
    )
    docs.select(F.to_json(F.struct("number", "people")).alias("value")).write.mode("overwrite").text(path)


def land_orders_csv(orders: DataFrame, path: str) -> None:
    """A header CSV of the order columns (dates as ``yyyy-MM-dd``)."""
    write_csv(
        orders.select(
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "o_totalprice",
            F.col("o_orderdate").cast("date").alias("o_orderdate"),
            "o_orderpriority",
        ),
        path,
    )
