"""Landed JSON payloads: scheme list pages, NAV documents, weather, people.

HTTP fetching is not part of the engine; responses are landed as files and
read here with Spark's readers, so parsing is distributed and a malformed
document is routed to quarantine instead of failing the batch.

Landing layouts
---------------
* scheme list: one JSON array per page, one page per file, in folders
  ``listing=<n>/page=<n>/`` (or ``page=<n>/``), read whole-file; listing, page
  number and array position give the payload order used for first-write-wins. A
  page is one value in a task; a file above ``MAX_PAGE_BYTES`` is read in splits and
  cut into its items, so a list may also come as one large array.
* NAV documents: JSON Lines, one ``{"requested": code, "meta": {...}, "data":
  [...]}`` object per line (splittable). ``requested`` is the scheme code that was
  asked for, added when the response is landed; a folder ``scheme_code=<code>/``
  says the same.
* weather, people: JSON Lines, one object per line.

Every landed line has a lasting place, its file and the hash of its text, by which
what is rejected is kept once, however often and with whichever other files it is
read again. (A line's number is that of one read: it orders the lines within it.)
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navframe import params as P
from navframe import schemas as S
from navframe.functions.dates import parse_day_first

CORRUPT = "_corrupt_record"
#: payload order of NAV rows: file, split of the file, line, position in ``data``
ORDER = ["source", "block", "line", "pos"]
#: lasting places of rejected documents and of rejected items of a document
DOCUMENT_PLACE = ["source", "line_key"]
ITEM_PLACE = [*DOCUMENT_PLACE, "pos"]


def _code(path: str):
    """A scheme code given as a JSON number or string -> bigint (NULL if not
    a whole number, so the row is dropped or quarantined as a NULL key)."""
    return F.expr(f"try_cast(trim({path}) AS BIGINT)")


# ---- scheme list (S5, P1) --------------------------------------------------


MAX_PAGE_BYTES = 256 * 1024 * 1024


def read_scheme_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page file: ``value`` (the JSON array), ``listing`` and
    ``page``; of a file above ``MAX_PAGE_BYTES`` one row per item, as an array of one.
    ``first_pos`` is the place of the value's first item in the page."""
    size = F.col("_metadata.file_size")
    whole = _placed_pages(spark.read.text(path, wholetext=True).filter(size <= MAX_PAGE_BYTES)).select("value", "listing", "page", F.lit(0).cast("bigint").alias("first_pos"))
    pieces = spark.read.option("lineSep", "}").text(path).filter(size > MAX_PAGE_BYTES)
    return whole.unionByName(_array_items(_placed_pages(with_source(pieces))))


def _placed_pages(df: DataFrame) -> DataFrame:
    if "page" not in df.columns:
        df = df.withColumn("page", F.col("_metadata.file_path"))
    return df if "listing" in df.columns else df.withColumn("listing", F.lit(0))


def _array_items(pieces: DataFrame) -> DataFrame:
    """The items of JSON arrays of objects that were read up to each ``}``.

    A piece ends an item where its ``}`` stands outside strings and closes the
    outermost object. Whether it does follows from running sums over the pieces of a
    file: of the quotes, which say whether a string is open, and of the braces. They
    are taken within a file split and then over the splits' totals, so no task reads a
    whole file; an item's pieces then meet in one row. Text that is no item, such as
    the end of a file that broke off, is a value of its own and parses to nothing.
    """
    plain = F.regexp_replace("value", r"\\.", "")  # without escaped characters
    rows = pieces.withColumns({"nth": F.monotonically_increasing_id(), "plain": plain}).withColumn("quotes", F.length(F.regexp_replace("plain", '[^"]', "")).cast("bigint"))
    rows = _running(rows, "quotes", "quotes_before")
    opened, open_ = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    closed = F.concat(F.when(opened, '"').otherwise(""), F.col("plain"), F.when(open_, '"').otherwise(""))
    braces = F.length(F.regexp_replace(F.regexp_replace(closed, '"[^"]*"', ""), "[^{]", ""))
    rows = rows.withColumn("depth", (braces - F.when(open_, 0).otherwise(1)).cast("bigint"))
    rows = _running(rows, "depth", "depth_before")
    ends = (~open_ & (F.col("depth_before") + F.col("depth") == 0)).cast("bigint")
    rows = _running(rows.withColumn("ends", ends), "ends", "item")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "value"))), lambda x: x["value"])
    items = rows.groupBy("source", "listing", "page", "item").agg(F.concat_ws("}", parts).alias("text"), F.max("ends").alias("whole"))
    text = F.regexp_replace("text", r"^[\s,]*(\[\s*)?", "")  # what stands before an item
    items = items.select("listing", "page", F.col("item").alias("first_pos"), "whole", text.alias("text"))
    rest = (F.col("whole") == 0) & F.regexp_replace("text", r"[\s\]}]", "").eqNullSafe("")  # the end of the array
    value = F.when(F.col("whole") == 1, F.concat(F.lit("["), "text", F.lit("}]"))).otherwise(F.col("text"))
    return items.filter(~rest).select(value.alias("value"), "listing", "page", "first_pos")


def _running(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: the sum of ``column`` over the pieces of the file before."""
    inner = Window.partitionBy("source", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("f_source").orderBy("f_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("source").alias("f_source"), F.col("block").alias("f_block")).agg(F.sum(column).alias("t"))
    totals = totals.select("f_source", "f_block", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("past"))
    placed = rows.withColumn("inside", F.coalesce(F.sum(column).over(inner), F.lit(0)))
    same = (F.col("source") == F.col("f_source")) & (F.col("block") == F.col("f_block"))
    return placed.join(totals, same).withColumn(name, F.col("past") + F.col("inside")).drop("inside", "past", "f_source", "f_block")


def corrupt_scheme_pages(pages: DataFrame, value_col: str = "value") -> DataFrame:
    """Pages that are not a JSON array of objects: ``listing``, ``page`` and the
    text. They yield no scheme and belong in quarantine."""
    parsed = F.from_json(value_col, S.SCHEME_LIST)
    return pages.filter(parsed.isNull()).select("listing", "page", F.col(value_col).alias(CORRUPT))


def parse_scheme_list(pages: DataFrame, value_col: str = "value") -> DataFrame:
    """Array pages -> one row per scheme, camelCase renamed to snake_case.

    A key missing from an element becomes NULL. ``listing``, ``page`` and ``pos``
    carry the payload order. Pages that don't parse yield no row; see
    :func:`corrupt_scheme_pages`.
    """
    items = _page_items(pages, value_col)
    return items.select(
        _code("item.schemeCode").alias("scheme_code"),
        F.col("item.schemeName").alias("scheme_name"),
        F.col("item.isinGrowth").alias("isin_growth"),
        F.col("item.isinDivReinvestment").alias("isin_div_reinvestment"),
        "listing",
        "page",
        "pos",
    )


def _page_items(pages: DataFrame, value_col: str) -> DataFrame:
    for name, default in (("listing", F.lit(0)), ("first_pos", F.lit(0).cast("bigint"))):
        if name not in pages.columns:
            pages = pages.withColumn(name, default)
    items = pages.select("listing", "page", "first_pos", F.posexplode(F.from_json(value_col, S.SCHEME_LIST)).alias("pos", "item"))
    return items.withColumn("pos", (F.col("first_pos") + F.col("pos")).cast("int")).drop("first_pos")


def quarantined_schemes(pages: DataFrame, value_col: str = "value") -> DataFrame:
    """Items of parsed pages without a code that is a whole number: their place
    (``listing``, ``page``, ``pos``) and the item as text."""
    items = _page_items(pages, value_col)
    bad = items.filter(_code("item.schemeCode").isNull())
    return bad.select("listing", "page", "pos", F.col("item.schemeCode").alias("code_text"), F.coalesce(F.to_json("item"), F.lit("null")).alias("item"))


# ---- NAV documents (S6, P2) ------------------------------------------------

NAV_DOCUMENT_WITH_CORRUPT = T.StructType(S.NAV_DOCUMENT.fields + [T.StructField(CORRUPT, T.StringType())])


def read_nav_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON Lines NAV documents, parsed with a fixed schema.

    Lines are read as text (splittable) and parsed with ``from_json``; a line
    that is not a valid document keeps its text in ``_corrupt_record``.
    """
    return parse_nav_documents(with_line(with_source(spark.read.text(path))))


def with_source(lines: DataFrame) -> DataFrame:
    """``source`` and ``block``: a line's file and the start of its file split."""
    return lines.select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"))


def with_line(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``line``: a number that grows with the lines of a file split. With
    ``source`` and ``block`` it orders the lines as the payload has them; it must
    be taken before any shuffle. ``line_key``: a hash of the line, its place in
    the file in every read."""
    return lines.withColumns({"line": F.monotonically_increasing_id(), "line_key": F.sha2(value_col, 256)})


def _landed_lines(spark: SparkSession, path: str) -> DataFrame:
    return with_line(with_source(spark.read.text(path))).filter(F.trim("value") != "")


def _parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of each line's object; a line that isn't one keeps its text in
    ``_corrupt_record``."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("d", F.from_json("value", whole, {"columnNameOfCorruptRecord": CORRUPT}))
    # a line such as [] or 1 parses to nothing without being called corrupt
    held = F.coalesce(*[F.col(f"d.{f.name}").cast("string") for f in whole.fields]).isNotNull()
    corrupt = F.when(held, F.col(f"d.{CORRUPT}")).otherwise(F.col("value"))
    return parsed.select(*[F.col(f"d.{f.name}") for f in schema.fields], corrupt.alias(CORRUPT), *[c for c in lines.columns if c != "value"])


def parse_nav_documents(docs: DataFrame, value_col: str = "value") -> DataFrame:
    """``meta``, ``data`` and ``_corrupt_record`` from a JSON text column
    (landed lines, or the value of a streaming source)."""
    others = [c for c in docs.columns if c != value_col]
    parsed = docs.select(
        F.from_json(value_col, NAV_DOCUMENT_WITH_CORRUPT, {"columnNameOfCorruptRecord": CORRUPT}).alias("d"),
        *others,
    )
    return parsed.select("d.requested", "d.meta", "d.data", f"d.{CORRUPT}", *others)


def explode_nav_documents(
    docs: DataFrame,
    nav_type: str = P.NAV_DECIMAL,
    strict: bool = True,
    date_format: str = P.NAV_DATE_FORMAT,
) -> DataFrame:
    """Documents -> one row per ``data`` item, with the document's
    ``meta.fund_house`` / ``meta.scheme_name`` repeated on each.

    A document without ``data`` yields no row; without ``meta`` the names are
    NULL. Dates are day-first text, NAVs are text cast to ``nav_type``.
    The scheme code is the one that was requested (the landing folder's, then
    the document's ``requested``), and ``meta.scheme_code`` only where neither
    is there. ``strict`` raises on a malformed document, a bad date or a bad
    number (ANSI); otherwise the document is skipped here (see
    :func:`corrupt_documents`), or the value is NULL and
    :func:`split_quarantine` separates the row. Output carries ``ORDER`` for
    payload ordering.
    """
    for name, kind in ((CORRUPT, "string"), ("source", "string"), ("block", "bigint"), ("line", "bigint"), ("line_key", "string"), ("requested", "string"), ("scheme_code", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    if strict:
        message = F.concat(F.lit("malformed NAV document in "), F.coalesce("source", F.lit("the input")))
        docs = docs.withColumn("data", F.when(F.col(CORRUPT).isNotNull(), F.raise_error(message)).otherwise(F.col("data")))
    else:
        docs = docs.filter(F.col(CORRUPT).isNull())
    items = docs.select(
        F.coalesce(F.expr("try_cast(scheme_code AS BIGINT)"), _code("requested"), _code("meta.scheme_code")).alias("scheme_code"),
        F.col("meta.fund_house").alias("fund_house"),
        F.col("meta.scheme_name").alias("scheme_name"),
        *ORDER[:-1],
        "line_key",
        F.posexplode("data").alias("pos", "item"),
    )
    items = items.select(
        "scheme_code",
        F.col("item.date").alias("_date_text"),
        F.col("item.nav").alias("_nav_text"),
        "fund_house",
        "scheme_name",
        *ORDER,
        "line_key",
    )
    nav = F.col("_nav_text").cast(nav_type) if strict else F.expr(f"try_cast(_nav_text AS {nav_type})")
    return items.select(
        "scheme_code",
        parse_day_first("_date_text", strict=strict, fmt=date_format).alias("nav_date"),
        nav.alias("nav"),
        "fund_house",
        "scheme_name",
        *ORDER,
        "line_key",
        "_date_text",
        "_nav_text",
    )


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) from a non-strict :func:`explode_nav_documents`.

    Quarantined: a NULL key, or a date / NAV text that did not parse.
    """
    bad = (
        F.col("scheme_code").isNull()
        | F.col("nav_date").isNull()
        | (F.col("nav").isNull() & F.col("_nav_text").isNotNull())
    )
    flagged = rows.withColumn("_bad", bad)
    valid = flagged.filter(~F.col("_bad")).drop("_bad", "line_key", "_date_text", "_nav_text")
    quarantined = flagged.filter(F.col("_bad")).drop("_bad")
    return valid, quarantined


def corrupt_documents(docs: DataFrame) -> DataFrame:
    """Landed lines that were not valid JSON documents."""
    return docs.filter(F.col(CORRUPT).isNotNull()).select(*[c for c in (*ORDER[:-1], "line_key") if c in docs.columns], CORRUPT)


# ---- weather (S7, P6) ------------------------------------------------------


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Landed weather objects. A line that isn't one, or holds no
    ``current_weather``, keeps its text in ``_corrupt_record``."""
    lines = _landed_lines(spark, path)
    docs = _parsed_lines(lines.withColumn("text", F.col("value")), S.WEATHER_DOCUMENT)
    missing = F.when(F.col("current_weather").isNull(), F.col("text"))
    return docs.withColumn(CORRUPT, F.coalesce(CORRUPT, missing)).drop("text")


def flatten_weather(
    docs: DataFrame, latitude: float = P.WEATHER_LATITUDE, longitude: float = P.WEATHER_LONGITUDE
) -> DataFrame:
    """``current_weather`` fields plus the (constant) location as doubles; corrupt
    documents give no row (see :func:`corrupt_documents`)."""
    if CORRUPT in docs.columns:
        docs = docs.filter(F.col(CORRUPT).isNull())
    return docs.select(
        F.lit(float(latitude)).alias("latitude"),
        F.lit(float(longitude)).alias("longitude"),
        "current_weather.temperature",
        "current_weather.windspeed",
        "current_weather.winddirection",
        "current_weather.weathercode",
    )


# ---- people (S8, P7) -------------------------------------------------------

# FIXED VALUES: the built-in list used when no landed document exists,
# as (craft, name), in the original order.
FALLBACK_PEOPLE = [
    ("ISS", "Oleg Kononenko"),
    ("ISS", "Nikolai Chub"),
    ("ISS", "Tracy Caldwell Dyson"),
    ("ISS", "Matthew Dominick"),
    ("ISS", "Michael Barratt"),
    ("ISS", "Jeanette Epps"),
    ("ISS", "Alexander Grebenkin"),
    ("ISS", "Butch Wilmore"),
    ("ISS", "Sunita Williams"),
    ("Tiangong", "Li Guangsu"),
    ("Tiangong", "Li Cong"),
    ("Tiangong", "Ye Guangfu"),
]


def read_people(spark: SparkSession, path: str | None) -> DataFrame:
    """People documents, or the built-in fallback when nothing is landed. A line
    that isn't a document keeps its text in ``_corrupt_record``."""
    if path:
        try:
            return _parsed_lines(_landed_lines(spark, path), S.PEOPLE_DOCUMENT)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    people = [{"craft": c, "name": n} for c, n in FALLBACK_PEOPLE]
    return spark.createDataFrame([(len(people), people)], S.PEOPLE_DOCUMENT)


def people_messages(docs: DataFrame, greeting: str = P.PEOPLE_GREETING, strict: bool = False) -> DataFrame:
    """One message per person: ``<name> is currently in space flying on the
    <craft>! <greeting>``. ``strict`` raises on a corrupt document; otherwise it
    gives no message (see :func:`corrupt_documents`)."""
    if strict and CORRUPT in docs.columns:
        message = F.concat(F.lit("malformed people document in "), F.col("source"))
        docs = docs.withColumn("people", F.when(F.col(CORRUPT).isNotNull(), F.raise_error(message)).otherwise(F.col("people")))
    p = docs.select(F.explode("people").alias("p")).select("p.craft", "p.name")
    return p.select(
        "craft",
        "name",
        F.format_string("%s is currently in space flying on the %s! %s", "name", "craft", F.lit(greeting)).alias(
            "message"
        ),
    )


def people_in_space(docs: DataFrame) -> DataFrame:
    """The reported head count (sum of ``number`` over the documents) next
    to the number of people actually listed."""
    listed = F.size(F.coalesce(F.col("people"), F.array()))
    return docs.agg(
        F.sum("number").cast("bigint").alias("number_of_people"),
        F.sum(listed).cast("bigint").alias("people_listed"),
    )
