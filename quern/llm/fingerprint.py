"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A sketch is the k least distinct hashes (48 bits) of a text's word shingles, ascending. Sketches of parts merge into the
sketch of the whole. Of two sketches, the k least hashes of their union are a sample of the union of the shingle sets:
the share of it that lies in both estimates resemblance.

Words are lower-cased and split at ASCII white space; a text of fewer words than a shingle takes is one shingle. Null
counts as the empty text, whose sketch is empty; two empty sketches are alike (1), an empty and another are not (0).
Repeated rows each get a result; null keys come before all others; an empty table gives an empty result; of further
columns none is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let

BITS = 48
EMPTY = "array<bigint>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct hashes of the runs of `size` words."""

    def of(h: Column) -> Column:
        run = lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, size))), 64 - BITS)
        many = F.array_distinct(F.slice(F.transform(h, run), F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1))))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(F.size(h) >= size, many).when(F.size(h) == 0, F.array().cast(EMPTY)).otherwise(whole)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = 128, size: int = 5) -> Column:
    return F.slice(F.sort_array(shingles(text, size)), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = 128) -> Column:
    """The number of distinct shingles: exact below k, then from the k-th least hash."""
    n = F.size(a)
    return F.when(n < k, n.cast("double")).otherwise((n - 1) * F.lit(2.0**BITS) / F.element_at(a, -1))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    both = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return let(merge(a, b, k), both)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """The share of a's shingles that b has."""
    union = merge(a, b, k)
    share = resemblance(a, b, k) * distinct_count(union, k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def to_string(a: Column) -> Column:
    """Base64 of the hashes, 6 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def merge_groups(sketches: DataFrame, group: str, column: str, k: int = 128) -> DataFrame:
    """One sketch a group. Spark combines max-k per task first: hashes are made distinct, then ranked within (group, salt), then within the group."""
    h = sketches.select(group, F.explode(column).alias("_h")).distinct().withColumn("_salt", F.pmod("_h", F.lit(64)))
    w1, w2 = Window.partitionBy(group, "_salt").orderBy("_h"), Window.partitionBy(group).orderBy("_h")
    least = h.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k)
    return least.groupBy(group).agg(F.sort_array(F.collect_list("_h")).alias(column))


def in_order(docs: DataFrame, key: str, text: str, rows: int = 1000, most: int = 4096) -> tuple[DataFrame, Window]:
    """key and _text in buckets of about `rows` rows (at most `most` buckets) by ascending key, and the window that walks a bucket. Each bucket also holds the first row of the next one (the last bucket: of the first), marked by _guest > 0, so that lead() needs no rows but its bucket's."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    total, some, least = d.agg(F.count("*"), F.count(key), F.min(key)).first()
    first = 0 if least is None else least - (total > some)
    d = d.withColumn("_order", F.coalesce(F.col(key), F.lit(first)).cast("long"))
    n = max(1, min(most, total, max(math.ceil(total / rows), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cuts = d.agg(F.percentile_approx("_order", [i / n for i in range(1, n + 1)], 20 * n)).first()[0] or []
    bounds = sorted({first, *cuts})
    literal = lambda x: F.lit(x).cast(EMPTY)
    step = 64  # two short walks instead of one long one
    coarse = F.size(F.filter(literal(bounds[::step]), lambda b: b <= F.col("_order"))) - 1
    d = d.withColumn("_coarse", coarse)
    fine = F.size(F.filter(F.slice(literal(bounds), F.col("_coarse") * step + 1, F.lit(step)), lambda b: b <= F.col("_order")))
    d = d.withColumn("_bucket", F.col("_coarse") * step + fine - 1)
    place = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    own = place(F.col("_bucket"), 0)
    places = F.when(F.col("_order") == first, F.array(own, place(F.lit(len(bounds) - 1), 2)))
    places = places.when(F.get(literal(bounds), F.col("_bucket")) == F.col("_order"), F.array(own, place(F.col("_bucket") - 1, 1))).otherwise(F.array(own))
    d = d.withColumn("_place", F.explode(places))
    d = d.select(key, "_text", "_order", F.col("_place.bucket").alias("_bucket"), F.col("_place.guest").alias("_guest"), F.xxhash64("_text").alias("_tie"))
    return d, Window.partitionBy("_bucket").orderBy("_guest", "_order", "_tie")


def compare_edited(docs: DataFrame, k: int = 128, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's sketch, that of its edited text - its last half replaced by the first half's worth of the next text - and its likeness to it and to the next one. One shuffle of the texts, by buckets of keys."""
    d, w = in_order(docs, key, text)
    n, half = F.char_length("_text"), F.floor(F.char_length("_text") / 2).cast("int")
    keep = F.substring(F.col("_text"), F.lit(1), n - half)
    d = d.withColumn("_next", F.lead("_text").over(w))
    d = d.select(key, "_bucket", "_guest", "_order", "_tie", n.cast("long").alias("n_chars"), F.col("_text"), F.concat(keep, F.substring(F.col("_next"), F.lit(1), half)).alias("_edited"))
    d = d.select(key, "_bucket", "_guest", "_order", "_tie", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("_text"), k, size).alias("sketch"), sketch(F.col("_edited"), k, size).alias("edited_sketch"))
    d = d.withColumn("_next_sketch", F.lead("sketch").over(w)).where("_guest = 0")
    return d.select(key, "n_chars", "edited_sha256", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"))
