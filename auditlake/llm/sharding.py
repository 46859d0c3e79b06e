"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows are shuffled by a seeded hash within their source, each gets the
fractional rank ``(2 r - 1) / (2 n)`` of its source, all rows are put in order
of that fraction, and the order is cut into shards of equal counts.  So every
shard holds each source in proportion, and the law is ``rows``.

No window runs over a whole source or the whole table: a rank is the number of
rows in the lower hash buckets of the source plus the rank within one of about
``sqrt(n)`` buckets of as many rows, and the global position is found in the
same way from buckets of the fraction.  Only counts per bucket are ever summed
up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.scratch import materialize

SEED = "auditlake-shard-1"
#: Parts into which the rows of a source are dealt where its total is joined.
SALTS = 64


def _prefix(counts: DataFrame, keys: list[str], order: str, n: str, out: str) -> DataFrame:
    """Running count of ``n`` before each row of a table of bucket counts."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _uniform(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a fraction in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def interleave(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    overhead: int = 16,
) -> DataFrame:
    """Shard and slot of every row.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``.
    A null text has size ``overhead`` and the checksum of no bytes; null sources
    form a source of their own; null ids and repeated rows are placed like any
    row (rows that share an id, or have none, take places by text and by where they stand in the table); an empty
    table gives no rows; further columns are ignored.  A text of any length counts
    whole; only its size and checksum leave the scan.
    """
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # An id that repeats, or is null, is no order; its rows are told apart by text and place in the table, so that they spread.
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull())
    again = rows.groupBy("_id", "_none").agg(F.count("*").alias("_c")).filter("_c > 1").select("_id", "_none", F.lit(True).alias("_again"))
    rows = rows.join(again.hint("merge"), ["_id", "_none"], "left")
    one, many = [F.lit(seed), F.col("doc_id").cast("string")], [F.col("text_crc32").cast("string"), F.col("_row").cast("string")]
    digest = F.when(F.col("_again"), F.md5(F.concat_ws("|", *one, *many))).otherwise(F.md5(F.concat_ws("|", *one)))
    rows = rows.select("doc_id", "source", "size", "text_crc32", digest.alias("_h"))
    own = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # joins by equality, null included
    rows = rows.withColumn("_src", own)
    totals = docs.select(F.col(source_col).cast("string").alias("source")).select(own.alias("_src")).groupBy("_src").agg(F.count("*").alias("_n"))
    # The row's source may hold any part of all rows, so the totals are joined under a salt as well.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(SALTS)).cast("int"))
    rows = rows.join(totals.withColumn("_salt", salts), ["_src", "_salt"]).drop("_salt")
    # Ranks within a source.  Buckets follow the hash, so they are of about equal size, the square root of the source's.
    rows = rows.withColumn("_b", F.floor(_uniform(F.col("_h")) * F.ceil(F.sqrt("_n"))).cast("long"))
    before = _prefix(rows.groupBy("_src", "_b").agg(F.count("*").alias("_c")), ["_src"], "_b", "_c", "_before")
    tie = ["_h", "doc_id", "text_crc32", "size"]
    local = Window.partitionBy("_src", "_b").orderBy(*tie)
    ranked = rows.withColumn("_r", F.row_number().over(local)).join(before.select("_src", "_b", "_before"), ["_src", "_b"])
    frac = (F.lit(2) * (F.col("_r") + F.col("_before")) - F.lit(1)).cast("double") / (F.lit(2) * F.col("_n")).cast("double")
    ranked = materialize(ranked.select("doc_id", "source", "size", "text_crc32", "_src", "_h", frac.alias("_f")), "ranks")
    # Positions over all rows, from buckets of the fraction; the total is one row.
    total = docs.agg(F.count("*").alias("_total"))
    ranked = ranked.crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("_g", F.floor(F.col("_f") * F.ceil(F.sqrt("_total"))).cast("long"))
    ahead = _prefix(ranked.groupBy("_g").agg(F.count("*").alias("_c")), [], "_g", "_c", "_ahead")
    order = Window.partitionBy("_g").orderBy("_f", "_src", *tie)
    placed = ranked.withColumn("_p", F.row_number().over(order)).join(ahead.select("_g", "_ahead"), "_g")
    # Shard k takes positions from ceil(k * total / shards) on, so that counts differ by one at most.
    placed = placed.withColumn("_pos", (F.col("_p") + F.col("_ahead") - F.lit(1)).cast("long"))
    placed = placed.withColumn("shard", F.floor(F.col("_pos") * F.lit(shards) / F.col("_total")).cast("int"))
    first = F.ceil(F.col("shard") * F.col("_total") / F.lit(shards)).cast("long")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_pos") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
