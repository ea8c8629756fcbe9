"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Every step works on what the step before could not tell apart. Which rows those are is
kept in a bitmap that is broadcast, so no text is shuffled: a row asks the bitmap while it is
scanned. The bitmap has ``BITS_A_KEY`` bits for each repeated key that was counted; beyond
``MAX_CHUNKS`` x 4 KB the keys are joined instead. Two keys can share a bit; then a row goes to
the next step for nothing, and the result is the same. Groups are partial aggregates, so a
group with a third of all rows reaches its task as one row from each mapper, and the join
back to the rows has plain keys, which AQE can split.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import durable, release

#: Characters of the prefix that is hashed.
PREFIX_CHARS = 256
#: Bits of the bitmap for each repeated key; it travels in chunks of 32,768 bits (4 KB).
BITS_A_KEY, CHUNK_BITS = 32, 32768
#: Largest bitmap that is broadcast: 64 MB.
MAX_CHUNKS = 1 << 14


def bit(bits: str, at: Column) -> Column:
    """Whether a bit of a bitmap chunk is set; false without a chunk."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _maybe(rows: DataFrame, out: str, among: str | None, *key: str) -> DataFrame:
    """``rows`` with ``out``: true if another row (of those where ``among`` holds) has the same key, by chance for others."""
    hashed = F.xxhash64(F.struct(*key))
    again = (rows.where(among) if among else rows).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(hashed.alias("_key"))
    again = durable(again.distinct())
    chunks = -(-again.count() * BITS_A_KEY // CHUNK_BITS)
    rows = rows.withColumn("_key", hashed)
    if chunks > MAX_CHUNKS:
        return rows.join(again.withColumn(out, F.lit(True)), "_key", "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("_key")
    slot = F.pmod("_key", F.lit(max(1, chunks) * CHUNK_BITS)) + 1
    placed = again.select(slot.alias("_slot"))
    bitmap = durable(placed.groupBy(F.bitmap_bucket_number("_slot").alias("_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))
    release(again)
    joined = rows.withColumn("_chunk", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmap), "_chunk", "left")
    return joined.withColumn(out, bit("_bits", F.bitmap_bit_position(slot))).drop("_key", "_chunk", "_bits")


KEY = ("_len", "_prefix", "_full")


def _refined(rows: DataFrame) -> DataFrame:
    """``rows``, whose text is ``_t``, with KEY; ``_full`` is null where no other row can have the text."""
    rows = _maybe(rows.withColumn("_len", F.octet_length("_t")), "_m1", None, "_len")
    rows = rows.withColumn("_prefix", F.when(F.col("_m1"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS))))
    rows = _maybe(rows, "_m2", "_m1", "_len", "_prefix")
    return rows.withColumn("_full", F.when(F.col("_m1") & F.col("_m2"), F.sha2("_t", 256))).drop("_m1", "_m2")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Callable[[Column], Column]] | None = None,
    normalize: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row for each input row: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``carry``.

    Texts are equal if ``normalize`` gives the same string for both; a null text counts as empty,
    so nulls and empty texts are one group. Of a group the largest id stays. Rows with that same
    id all count as kept; a null id stays only in a group where all ids are null. An empty table
    gives no rows. Other columns are ignored, whatever their names. ``carry`` maps names of
    more result columns to functions of the normalised text.
    """
    text = normalize(F.coalesce(F.col(text_col), F.lit("")))
    rows = _refined(docs.select(F.col(id_col).alias("_id"), text.alias("_t")))
    named = {c: f"_c{i}" for i, c in enumerate(carry or {})}
    more = [f(F.col("_t")).alias(named[c]) for c, f in (carry or {}).items()]
    narrow = durable(rows.select("_id", *KEY, *more))

    groups = narrow.where("_full is not null").groupBy(*KEY).agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    # Written first: a join with a table, unlike one with an aggregate, lets AQE split a large group.
    same = narrow.where("_full is not null").join(durable(groups.where("_n > 1")), list(KEY), "left")
    alone = narrow.where("_full is null").withColumns({"_keep": F.col("_id"), "_n": F.lit(None).cast("bigint")})
    out = same.unionByName(alone)
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), *(F.col(a).alias(c) for c, a in named.items()))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, with all columns: the one with the largest id.

    A row is judged by its own text, so one whose text is unique stays, whatever id it shares with others
    and if that is null. Null and empty texts are one text; a null id ranks last. Of rows that share
    text and largest id one stays, the largest by their other columns (those that can be
    ordered). Rows whose text has no copy aren't shuffled where the groups are few enough to broadcast.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    x = docs.toDF(*own.values())
    rows = _refined(x.withColumn("_t", F.coalesce(own[text_col], F.lit("")))).drop("_t")
    asked = rows.where("_full is not null")
    groups = asked.groupBy(*KEY).agg(F.max(own[id_col]).alias("_keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = durable(groups)
    same = F.col(own[id_col]).eqNullSafe(F.col("_keep"))
    order = [own[id_col], *(a for c, a in own.items() if c not in (id_col, text_col) and _ordered(docs.schema[c].dataType))]
    kept = asked.join(groups, list(KEY)).where(same).groupBy(*KEY).agg(F.max_by(F.struct(*own.values()), F.struct(*order)).alias("_row")).select("_row.*")
    alone = rows.where("_full is null").select(*own.values()).unionByName(asked.join(groups, list(KEY), "left_anti").select(*own.values()))
    return alone.unionByName(kept).toDF(*docs.columns)


def _ordered(kind: T.DataType) -> bool:
    """Whether values of this type can be compared."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, carry={"text_sha256": lambda t: F.sha2(t, 256)})


OP2_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
