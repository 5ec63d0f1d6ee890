"""Lines that many documents share: kept in one of them, and told as a compressed bitmap of each document's lines.

A line's key is the line without blanks and 0x09 to 0x0D at both ends, A-Z folded; it travels as a 128-bit hash. Hashes are dealt by value
into as many ranges as there are shuffle partitions, each range is sorted by hash, then document (largest first) and position, and windows
stream over it: the first document of a hash keeps its lines, the others lose them if enough documents hold it. Only SQL functions are used.

A hash that a large part of all lines share would fill its range, so a sample of documents finds such hashes beforehand. Their lines are dealt by document
into several ranges next to each other, and what those find is added up. The sample decides about places only, never about rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from firstlook.plans.written import written

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One document in so many is looked at for hot lines.
SAMPLED_ONE_IN = 100
#: A hash is hot if it holds more than a fraction of a range's fair share of lines, and was seen so often.
HOT_SHARE, HOT_SEEN = 0.25, 10


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)  # lower() folds nothing but A-Z then, and is much faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _rows(docs: DataFrame, rest: bool) -> DataFrame:
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")] if rest else []
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"), *whole)


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, print, place, h1, h2) of each line whose key is long enough."""
    lines = rows.select("doc_id", "print", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keys = lines.select("doc_id", "print", "place", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("doc_id", "print", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot(rows: DataFrame, min_chars: int, ranges: int) -> DataFrame:
    """(h1, h2, parts): into how many ranges the lines of each hot hash are dealt. At most 1 / HOT_SHARE rows for a range."""
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", "print", F.lit("hot")), F.lit(SAMPLED_ONE_IN)) == 0)
    counts = written(_lines(picked, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("seen")))
    lines = counts.agg(F.sum("seen")).first()[0] or 1
    most = int(ranges / HOT_SHARE)
    parts = F.least(F.lit(ranges), F.ceil(F.col("seen") * most / lines)).cast("int").alias("parts")
    few = counts.filter(F.col("seen") >= HOT_SEEN).orderBy(F.desc("seen"), "h1", "h2").limit(most)
    return few.select("h1", "h2", parts).filter("parts > 1")


def _found(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, print, place) of the lines to drop."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Broadcast: no more rows than 4 for a shuffle partition, of 20 bytes each.
    lines = _lines(rows, min_chars).join(F.broadcast(_hot(rows, min_chars, ranges)), ["h1", "h2"], "left")
    own = F.floor(F.shiftrightunsigned("h1", 33) * F.lit(ranges) / F.lit(1 << 31))
    aside = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), "parts"))
    dealt = lines.withColumn("range", ((own + aside) % ranges).cast("int")).repartitionById(ranges, F.col("range"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("place")]
    group = Window.partitionBy("range", "h1", "h2")
    streamed = dealt.sortWithinPartitions("range", "h1", "h2", *order).withColumns({
        "top": F.first("doc_id").over(group.orderBy(*order)),
        "opens": ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(group.orderBy(*order))) | (F.row_number().over(group.orderBy(*order)) == 1),
    })
    counted = streamed.withColumn("docs", F.sum(F.col("opens").cast("long")).over(group))
    lost = (F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("top"))
    known = written(counted.filter(F.col("parts").isNotNull() | lost).select("doc_id", "print", "place", "h1", "h2", "parts", "range", "docs", "top"))
    hot = known.filter(F.col("parts").isNotNull())
    each = hot.groupBy("h1", "h2", "range").agg(F.first("docs").alias("docs"), F.max("top").alias("top"))  # a document is in one range only
    whole = each.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))  # as many rows as hot hashes
    at_large = hot.drop("docs", "top").join(F.broadcast(whole), ["h1", "h2"]).filter(lost)
    places = ["doc_id", "print", "place"]
    return known.filter(F.col("parts").isNull()).select(places).union(at_large.select(places))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, rest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep[, rest]) of each row: which of its lines stay.

    Lines are split at \\n; a null or empty text has one empty line. Keys of at least min_chars code points that at least min_docs documents hold stay
    only in the document with the largest id. keep is a bitmap in run lengths: so many lines kept, so many dropped, and so on by turns,
    from kept on. rest is a struct of all columns of docs, whatever their names.

    Rows with one id are one document; rows with a null id are together one more, with an id below all others. Equal rows get equal bitmaps.
    """
    rows = _rows(docs, rest)
    at = ["doc_id", "print"]
    row = Window.partitionBy(*at).orderBy("place")
    stretches = (
        _found(rows, min_chars, min_docs).groupBy(*at, "place").agg(F.count("*").alias("times"))
        .repartition(*at).withColumn("stretch", F.col("place") - F.row_number().over(row))
        .groupBy(*at, "stretch").agg(F.min("place").alias("start"), F.count("*").cast("int").alias("length"))
        .groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("gone"), F.sum("length").alias("n_dropped"))
        .select(F.col("doc_id").alias("gone_id"), F.col("print").alias("gone_print"), "gone", "n_dropped")
    )
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    sized = rows.select(*at, (breaks + 1).alias("n_lines"), *(["rest"] if rest else []))
    match = sized["doc_id"].eqNullSafe(F.col("gone_id")) & (sized["print"] == F.col("gone_print"))
    joined = sized.join(stretches, match, "left")
    return joined.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(_run_lengths(), F.array(F.col("n_lines").cast("int"))).alias("keep"), *(["rest"] if rest else []),
    )


def _run_lengths() -> Column:
    """gone, stretches (start, length) in order, as run lengths that begin with kept lines."""
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length")))
    pairs = F.arrays_zip(F.col("gone").alias("now"), F.slice(F.concat(none, "gone"), F.lit(1), F.size("gone")).alias("last"))
    by_turns = F.flatten(F.transform(pairs, lambda p: F.array(p["now"]["start"] - p["last"]["start"] - p["last"]["length"], p["now"]["length"])))
    tail = F.col("n_lines") - F.element_at("gone", -1)["start"] - F.element_at("gone", -1)["length"]
    return F.concat(by_turns, F.when(tail > 0, F.array(tail.cast("int"))).otherwise(F.array().cast("array<int>")))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined by \\n."""
    flags = F.flatten(F.transform(keep, lambda length, k: F.array_repeat(k % 2 == 0, length)))
    lines = F.filter(F.arrays_zip(F.split(text, "\n").alias("line"), flags.alias("stays")), lambda z: z["stays"])
    return F.array_join(F.transform(lines, lambda z: z["line"]), "\n")
