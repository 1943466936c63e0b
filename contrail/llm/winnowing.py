"""Document fingerprints by winnowing, in DataFrame functions only.

Every word gets a 64-bit hash and every run of 3 words the cyclic-polynomial rolling hash of those: the hash so far turned left by
one bit, the next word's mixed in by xor, which is also what dropping the oldest word from the previous run's hash gives. Of each 4
neighbouring runs the smallest hash is kept, the rightmost on ties, with its word position. Two texts that share 6 words in a row
share a kept hash. Hash (33 bits) and position (30 bits, counted down; no string holds more words) sit in one long, so that a plain minimum
applies the tie rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import BLANK, count_at_most, let

GRAM, WINDOW = 3, 4
POSITION_BITS = 30
#: A document's successor is sought within ranges of doc_id of about so many documents; at least and at most so many ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1000, 16, 65_536


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def marks(text: Column) -> Column:
    """The kept (hash, position) longs of a text in order: array<long>; no word: empty."""
    last = (1 << POSITION_BITS) - 1
    high = -(1 << POSITION_BITS)

    def place(h: Column, i: Column) -> Column:
        return F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(high)).bitwiseOR(F.lit(last) - i)

    def longer(step: int):
        """From the hashes of runs of `step` words to those of one word more."""
        return lambda h, g: F.zip_with(g, F.slice(h, step + 1, F.size(h)), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b))

    def rolled(h: Column) -> Column:
        grams = h
        for step in range(1, GRAM):
            grams = longer(step)(h, grams)
        return F.transform(F.slice(grams, F.lit(1), F.size(h) - GRAM + 1), place)

    def kept(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(place(F.xxhash64(h), F.lit(0)))
        return F.when(n == 0, F.array().cast("array<long>")).when(n < GRAM, whole).otherwise(let(rolled(h), chosen))

    def with_neighbour(step: int):
        return lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.least(a, b))

    def chosen(grams: Column) -> Column:
        size, out = 1, grams
        while size < WINDOW:
            step = min(size, WINDOW - size)
            out = let(out, with_neighbour(step))
            size += step
        # what starts in the last WINDOW - 1 places are shorter windows; a short text has one window
        return F.array_distinct(F.slice(out, F.lit(1), F.greatest(F.lit(1), F.size(grams) - WINDOW + 1)))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), kept)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of hashes; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def shown(kept: Column) -> Column:
    """hash:position pairs, hash in hex."""
    last = (1 << POSITION_BITS) - 1
    return F.array_join(
        F.transform(kept, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, POSITION_BITS))), F.lit(":"), (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("string"))), " "
    )


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) with the next document's text (ascending doc_id, after the last the first) as next_text.

    doc_id ranges of about equal counts are sorted apart; only each range's first row is looked up by the range before.
    """
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, docs.count() // RANGE_ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("bounds"))
    cuts = sorted(set(bounds.first()["bounds"] or ()))  # at most `ranges` numbers
    low = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.withColumn("range", count_at_most(cuts, low))
    # each range's first row serves the range before, as its last; ids first, then the texts of at most `ranges` rows
    lows = docs.withColumn("low", low).groupBy("range").agg(F.min("low").alias("low"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("range")
    ends = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = lows.select("low", F.coalesce(F.lag("range").over(by_range), F.last("range").over(ends)).alias("range"))
    texts = docs.select("doc_id", "text").withColumn("low", low).join(F.broadcast(ring), "low")
    ring = texts.groupBy("range").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = docs.select("doc_id", "text", "range", F.lit(False).alias("edge")).union(ring.select(F.lit(None).cast("long"), "text", "range", F.lit(True)))
    order = [F.col("edge"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    spread = rows.repartitionByRange(ranges, "range").sortWithinPartitions("range", *order).withColumn("marks", marks(F.col("text")))
    ahead = spread.select("*", F.lead(F.struct("text", "marks")).over(Window.partitionBy("range").orderBy(*order)).alias("ahead")).where("not edge")
    return ahead.select("doc_id", "text", "marks", F.col("ahead.text").alias("next_text"), F.col("ahead.marks").alias("next_marks"))


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text of docs(doc_id, text), of its edited text, and their likeness.

    The edited text has the last floor(n_chars/4) code points replaced by the first as many (or all) of the next document.
    Null counts as empty. A text without words has the empty fingerprint; one under 3 words has one hash of all its words;
    two empty fingerprints have likeness 1. A single document is its own successor. Equal doc_ids follow one another by a hash of the
    text, rows equal in both in any order; a null doc_id comes first. Texts of any length are read whole. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(docs, ranges)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 4) as int))"))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), "marks", "next_marks", edited.alias("edited"))
    near = near.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_marks": marks(F.col("edited"))})
    own = hashes(F.col("marks"))
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("marks")).alias("fingerprint"),
        shown(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(own, hashes(F.col("next_marks"))).alias("near_next"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
