"""One-permutation MinHash fingerprints with optimal densification and b-bit packing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, tasks_for, words

BINS, BITS, SHINGLE = 128, 8, 5
#: Values are kept as signed bytes, less this.
HALF = 1 << (BITS - 1)
_SHIFT = 64 - (BINS - 1).bit_length()


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: an array of BINS bytes, the low BITS bits of each bin's minimum (less HALF).

    A shingle's hash falls in the bin of its leading bits, once; sorting the hashes puts each
    bin's minimum first. An empty bin borrows from a full bin drawn at random, each empty
    bin by itself: the full bin with the least hash of the pair (optimal densification).
    What it takes is not the donor's low byte, which would make all borrowers of one donor
    agree by the same chance, but a byte of the donor's whole minimum mixed with the
    borrower's number. Under SHINGLE words the whole text is one shingle; no words: zeros.
    """
    w, h, o, b = (f"_{name}_{k}" for k in "whob")
    docs = docs.withColumn(w, words(F.col(text)))
    several = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    one = F.array(F.xxhash64(F.array_join(w, " ")))
    docs = docs.withColumn(h, F.sort_array(F.when(F.size(w) >= SHINGLE, several).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))))
    bin_of = lambda x: F.shiftrightunsigned(x, _SHIFT)
    docs = docs.withColumn(o, F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))))
    docs = docs.withColumn(b, F.transform(o, lambda x: F.struct(bin_of(x).alias("bin"), x.alias("least"))))
    low = F.lit((1 << BITS) - 1).cast("long")
    empty = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), F.col(f"{b}.bin"))
    donor = lambda e: F.array_min(F.transform(b, lambda x: F.struct(F.xxhash64(e, x["bin"]).alias("draw"), x["least"].alias("least"))))
    drawn = lambda e: F.xxhash64(donor(e)["least"], e).bitwiseAND(low)
    full = F.transform(b, lambda x: F.shiftleft(x["bin"], BITS).bitwiseOR(x["least"].bitwiseAND(low)))
    filled = F.transform(empty, lambda e: F.shiftleft(e, BITS).bitwiseOR(drawn(e)))
    whole = F.transform(F.sort_array(F.concat(full, filled)), lambda x: (x.bitwiseAND(low) - HALF).cast("tinyint"))
    docs = docs.withColumn(name, F.when(F.size(b) > 0, whole).otherwise(F.array_repeat(F.lit(-HALF).cast("tinyint"), BINS)))
    return docs.drop(w, h, o, b)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: equal bins, less those that b-bit values give by chance."""
    chance = 2.0**-BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / BINS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))


def packed(fingerprint: Column) -> Column:
    """Hex digits, BITS bits a bin in order."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("int") + HALF), BITS // 4, "0")), "")


#: Ranges that one list of borders tells apart; more are told apart by a second list for each.
BORDERS = 1024


def _cuts(column: str, parts: int) -> Column:
    return F.percentile_approx(column, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts)


def _above(borders: Column, value: Column) -> Column:
    """How many borders lie above a value."""
    return F.size(F.filter(F.array_distinct(borders), lambda s: value > s))


def ranged(docs: DataFrame, rows_each: int, borders: int = BORDERS) -> DataFrame:
    """docs with `_range`: numbers that rise with `_id`, with about `rows_each` rows each, from quantiles; beyond `borders` ranges, and their square at most, in two steps."""
    parts = max(1, docs.count() // rows_each)
    first = min(parts, borders)
    if first == 1:
        return docs.withColumn("_range", F.lit(0).cast("long"))
    top = [int(c) for c in docs.agg(_cuts("_id", first)).first()[0]]
    docs = docs.withColumn("_range", _above(F.array(*[F.lit(c).cast("long") for c in top]), F.col("_id")).cast("long"))
    inner = min(-(-parts // first), borders)
    if inner == 1:
        return docs
    finer = docs.groupBy("_range").agg(_cuts("_id", inner).alias("_cuts"))  # at most borders squared numbers
    return docs.join(F.broadcast(finer), "_range").withColumn("_range", F.col("_range") * inner + _above(F.col("_cuts"), F.col("_id"))).drop("_cuts")


def followed(docs: DataFrame, columns: list, rows_each: int = 1000, borders: int = BORDERS) -> DataFrame:
    """docs with key `_id`; adds next: struct of `columns` of the next row by descending _id, the first after the last.

    Rows are dealt to ranges of ids by quantiles, each range is ordered by itself, and the
    largest row of each range stands in for it at the end of the range above. One shuffle;
    no task sees more than its range.
    """
    docs = ranged(docs, rows_each, borders)
    tops = docs.groupBy("_range").agg(F.max("_id").alias("_id"))  # one row a range
    order = Window.orderBy("_range")
    above = tops.select("_id", F.coalesce(F.lead("_range").over(order), F.first("_range").over(order)).alias("_above"))
    both = docs.join(F.broadcast(above), "_id", "left").withColumn("_places", F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("s")), F.when(F.col("_above").isNotNull(), F.struct(F.col("_above").alias("r"), F.lit(True).alias("s"))))))
    dealt = both.withColumn("_place", F.explode("_places")).select(*[c for c in docs.columns if c != "_range"], F.col("_place.r").alias("_range"), F.col("_place.s").alias("_stand_in"))
    following = F.lead(F.struct(*columns)).over(Window.partitionBy("_range").orderBy("_stand_in", F.desc("_id"), "_fp"))
    return dealt.withColumn("next", following).filter("NOT _stand_in").drop("_range", "_stand_in")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    docs as from keyed(). The edited text has its last floor(n / 3) code points replaced by
    the first as many (or all) of the next document by descending id. Returns (row, n_chars,
    edited, fingerprint, edited_fingerprint, near_edited, near_next); fingerprints are arrays
    of bytes. Null text: empty. A null id is the smallest. Rows with equal ids follow each
    other in order of a hash of their texts. Texts of any length are taken whole. An empty table gives an empty result.
    """
    tasks = tasks_for(docs)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    docs = docs.withColumn("_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    docs = with_fingerprint(docs.withColumn("t", text), "t", "fingerprint").drop("t")  # the text travels in its row only
    docs = followed(docs, [text.alias("t"), F.col("fingerprint")]).withColumn("t", text)
    docs = docs.withColumn("n_chars", F.length("t").cast("long"))
    gone = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.col("n_chars").cast("int") - gone), F.substring(F.col("next.t"), F.lit(1), gone))
    docs = with_fingerprint(docs.withColumn("edited", edited), "edited", "edited_fingerprint")
    docs = few(docs, tasks)
    return docs.select("row", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"))
