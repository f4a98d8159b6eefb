"""I-Match fingerprints (operator 11), built from DataFrame functions only.

A word is a maximal run of digits, letters or non-ASCII characters of the
lower-cased text. The lexicon holds the words whose inverse document frequency
lies in a band: at least one distinct text in ``RARE`` and at most one in
``COMMON`` hold the word. It is cut at random (by the word's hash) into ``2**l``
subsets; a text of ``d`` distinct words uses the first ``SUBSETS`` of level ``l``,
where ``2**l`` is the largest power of two up to ``d / SPREAD``, and of level
``l + 1``. The distinct lexicon words of the text in a subset are sorted and hashed,
so an edit changes only the subsets that one of its words falls in. Two
fingerprints are alike by the share of equal hashes among the subsets, of a level
both have, that either keeps a word of.

A word belongs to the lexicon by its share of the texts, so the lexicon has at most
``RARE`` times the mean number of distinct words of a text, however many texts there
are. It is joined without a hint: broadcast while its measured size allows that,
shuffled otherwise. Frequencies count distinct texts, so that a group of copies
does not push its words out of the band.

The document that follows another is found without a global sort in one task: keys
are dealt into ranges, rows follow each other inside a range, and ranges are linked
by their first rows. Only texts that follow are shuffled beside the texts, cut to
the characters needed.

Defined results: null is the empty text. A text that keeps no lexicon word (empty,
blank or of common and rare words alone) is fingerprinted by its whole text, so it is
like equal texts (1) and no others (0). Documents are ordered by descending id, null
ids last; of one id by the text's MD5. Rows alike in id and text are one document:
each has the same next one, the following different document. A sole document is
its own next one. The id may have any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navframe.llm import common

#: one distinct text in RARE holds a lexicon word at least, one in COMMON at most
RARE, COMMON = 1100, 12
#: subsets of a level, and distinct words of a text for each of a level's subsets
SUBSETS, SPREAD = 16, 2
#: rows of a range of ordered documents, about
RANGE_ROWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def word_hash(word: Column) -> Column:
    """The first 32 bits of the word's MD5, which deal the lexicon into subsets."""
    return F.conv(F.left(F.md5(word), F.lit(8)), 16, 10).cast("bigint")


def level_of(n_words: Column) -> Column:
    """log2 of the largest power of two up to ``n_words / SPREAD`` (0 for fewer)."""
    return (F.length(F.bin(F.greatest(F.floor(n_words / SPREAD), F.lit(1)))) - 1).cast("int")


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


# -- documents and their next ones -------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.md5(body)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body.alias("body"), key.alias("text_key"))
    return rows.withColumn("uid", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_key")))


def next_documents(keyed: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``uid``, ``doc_id``, ``n_chars``, ``next_uid`` and ``first`` (of the documents
    of one text, the one with the smallest id) of every distinct document."""
    spark = keyed.sparkSession
    keys = common.store(keyed.select("uid", "doc_id", "text_key", F.length("body").cast("bigint").alias("n_chars")).dropDuplicates(["uid"]), "imatch_keys")
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // range_rows)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_key"), F.col("uid")]
    ranged = common.store(keys.repartitionByRange(n_ranges, *order).withColumn("part", F.spark_partition_id()), "imatch_ranges")
    heads = ranged.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("top"))
    # the first row of a range: the largest id (null ids last), then the smallest key
    heads = ranged.join(heads, "part").filter(F.col("doc_id").eqNullSafe(F.col("top.doc_id"))).groupBy("part").agg(F.min(F.struct("text_key", "uid")).alias("h"))
    heads = heads.select("part", F.col("h.uid").alias("head"))
    by_part = Window.orderBy("part")  # one row a range
    after = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("uid").over(Window.partitionBy("part").orderBy(*order))
    linked = ranged.withColumn("inside", inside).join(after, "part").withColumn("next_uid", F.coalesce("inside", "after"))
    firsts = keys.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")).alias("f")).select(F.col("f.uid").alias("uid"), F.lit(True).alias("first"))
    return linked.join(firsts, "uid", "left").select("uid", "doc_id", "n_chars", "next_uid", F.coalesce("first", F.lit(False)).alias("first"))


def with_edits(keyed: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct documents (``uid``, ``body``, ``first``), and with their edited text
    (``uid``, ``body``, ``edited``): the last third replaced by as many characters
    from the start of the next document."""
    bodies = keyed.groupBy("uid").agg(F.first("body").alias("body"))
    wanted = links.select(F.col("next_uid").alias("uid"), F.col("uid").alias("for_uid"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    bodies = common.store(bodies.join(links.select("uid", "n_chars", "first"), "uid").join(wanted, "uid"), "imatch_bodies")
    starts = bodies.select(F.col("for_uid").alias("uid"), F.left("body", F.col("need")).alias("start"))
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    return bodies, bodies.join(starts, "uid").select("uid", "body", F.concat(F.left("body", keep), F.col("start")).alias("edited"))


# -- the lexicon and the fingerprints ------------------------------------------------------


def lexicon(bodies: DataFrame, text_col: str = "body", rare: int = RARE, common_: int = COMMON) -> DataFrame:
    """The words (``term``) of distinct texts whose document frequency is in the band."""
    n = bodies.count()
    counts = bodies.select(F.explode(distinct_words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.filter((F.col("df") * rare >= n) & (F.col("df") * common_ <= n)).select("term")


def _hashes(kept: Column, level: Column) -> Column:
    """Hashes of the subsets of a level; empty ones are ''."""
    power = _power(level)
    words = lambda k: F.array_join(F.transform(F.filter(kept, lambda x: x["h"] % power == k), lambda x: x["term"]), " ")
    joined = F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(power, F.lit(SUBSETS).cast("bigint")) - 1), words)
    return F.transform(joined, lambda s: F.when(s == "", "").otherwise(F.left(F.md5(s), F.lit(8))))


def fingerprints(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``uid``, ``side`` of texts (``uid``, ``side``, ``body``) to ``sha`` (of the
    text), ``level``, ``low`` and ``high`` (hashes of the subsets of both levels)
    and ``fingerprint``."""
    terms = texts.withColumn("terms", distinct_words(F.col("body"))).withColumn("level", level_of(F.size("terms")))
    chosen = F.filter(F.transform("terms", lambda t: F.struct(t.alias("term"), word_hash(t).alias("h"), F.lit(None).cast("string").alias("sha"))), lambda x: x["h"] % _power(F.col("level")) < SUBSETS)
    # one more row a text, of the empty word, carries the text's own hash past the join
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(-1).cast("bigint").alias("h"), F.sha2("body", 256).alias("sha")))
    rows = terms.select("uid", "side", "level", F.inline(F.concat(own, chosen)))
    lexicon_ = words.select("term").unionByName(words.sparkSession.range(1).select(F.lit("").alias("term")))
    kept = rows.join(lexicon_, "term").groupBy("uid", "side").agg(
        F.max("level").alias("level"), F.max("sha").alias("sha"), F.sort_array(F.collect_list(F.when(F.col("h") >= 0, F.struct("term", "h")))).alias("kept")
    )
    hashed = kept.select("uid", "side", "sha", "level", _hashes(F.col("kept"), F.col("level")).alias("low"), _hashes(F.col("kept"), F.col("level") + 1).alias("high"))
    name = F.concat_ws(":", F.col("level").cast("string"), F.array_join("low", "."), F.array_join("high", "."))
    none = F.array_join(F.col("low"), "") == ""
    return hashed.withColumn("fingerprint", F.when(none, F.concat(F.lit("text:"), "sha")).otherwise(name))


def _alike(left: Column, right: Column) -> Column:
    """Equal hashes and subsets that either keeps a word of, as a struct."""
    both = F.filter(F.arrays_zip(left.alias("a"), right.alias("b")), lambda x: (x["a"] != "") | (x["b"] != ""))
    return F.struct(F.size(F.filter(both, lambda x: x["a"] == x["b"])).alias("same"), F.size(both).alias("all"))


def likeness(a: str, b: str) -> Column:
    """Likeness (0 to 1) of two fingerprint structs (``level``, ``low``, ``high``, ``fingerprint``)."""
    get = lambda c, f: F.col(f"{c}.{f}")
    nothing = F.struct(F.lit(0).alias("same"), F.lit(0).alias("all"))
    step = get(b, "level") - get(a, "level")
    first = F.when(step == 0, _alike(get(a, "low"), get(b, "low"))).when(step == 1, _alike(get(a, "high"), get(b, "low"))).when(step == -1, _alike(get(a, "low"), get(b, "high"))).otherwise(nothing)
    second = F.when(step == 0, _alike(get(a, "high"), get(b, "high"))).otherwise(nothing)
    same, all_ = first["same"] + second["same"], first["all"] + second["all"]
    whole = get(a, "fingerprint").startswith("text:") | get(b, "fingerprint").startswith("text:")
    share = F.when(whole | (all_ == 0), 0.0).otherwise(same / F.greatest(all_, F.lit(1)))
    return F.when(get(a, "fingerprint") == get(b, "fingerprint"), 1.0).otherwise(share)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next`` (see the module)."""
    keyed = _keyed(docs, id_col, text_col)
    links = common.store(next_documents(keyed), "imatch_links")
    bodies, edits = with_edits(keyed, links)
    words = common.store(lexicon(bodies.filter("first").select("body")), "imatch_lexicon")
    sides = edits.select("uid", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))))
    made = fingerprints(sides, words)
    mark = F.struct("level", "low", "high", "fingerprint")
    both = made.groupBy("uid").agg(
        F.first(F.when(F.col("side") == 0, mark), ignorenulls=True).alias("own"),
        F.first(F.when(F.col("side") == 1, mark), ignorenulls=True).alias("edited"),
        F.max(F.when(F.col("side") == 1, F.col("sha"))).alias("edited_sha256"),
    )
    both = common.store(both.select("uid", "own", "edited_sha256", F.col("edited.fingerprint").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited")), "imatch_marks")
    out = both.join(links.select("uid", "n_chars", "next_uid"), "uid").join(both.select(F.col("uid").alias("next_uid"), F.col("own").alias("next")), "next_uid")
    out = out.select("uid", "n_chars", "edited_sha256", F.col("own.fingerprint").alias("fingerprint"), "edited_fingerprint", "near_edited", likeness("own", "next").alias("near_next"))
    return keyed.select("doc_id", "uid").join(out, "uid").drop("uid")
