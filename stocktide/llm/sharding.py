"""Sharding by extendible hashing.

Method. Documents hash to 60 bits of their id. A bucket is a prefix of these bits; it is split on one more bit only while it holds
more than the byte limit, so shards end at different depths and only crowded buckets get deeper. The directory is found level by
level without moving documents: bytes are summed per ``STEP`` bits below the buckets that are still too large, the sums of all
shorter prefixes follow from these cells, and only cells over the limit go to the next round. The directory then places each row
by its hash and the depths in use.

Only counts per cell are shuffled. The directory is broadcast up to ``BROADCAST_SHARDS`` shards and joined by a shuffle beyond.

Defined results: null text has 0 bytes; a null id hashes as a value of its own; rows of one id share all bits and stay together; a
bucket that one id fills beyond the limit cannot be split and is marked ``oversized``; an empty table has no shard; extra columns
pass through ``with_shard``, except that columns with the names of its results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import broadcast_if, fresh, named_columns
from stocktide.session import stage_table

BITS, STEP, LIMIT, BROADCAST_SHARDS = 60, 10, 64 * 2 ** 20, 1_000_000


def id_bits(doc_id: Column) -> Column:
    """The leading 60 bits of the MD5 of an id, as a long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def directory(keyed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (depth, prefix, shard_bytes, shard_docs, oversized), one per shard, from rows (bits, bytes)."""
    shards, inside = None, keyed
    for begin in range(0, BITS, STEP):
        end = begin + STEP
        cells = inside.groupBy(F.shiftright("bits", BITS - end).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        cells = stage_table(cells, "cells")
        levels = F.explode(F.sequence(F.lit(begin + 1 if begin else 0), F.lit(end)))
        above = cells.select("*", levels.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)"))
        sums = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), (F.min("low") == F.max("high")).alias("one"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | F.col("one"))
        # of the prefixes of a cell that fit, the shortest is its shard
        first = above.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        found = stage_table(first.select("s.*").distinct().withColumn("oversized", F.col("shard_bytes") > limit), "shards")
        shards = found if shards is None else shards.union(found)
        full = stage_table(cells.join(first, "cell", "left_anti").select(F.col("cell").alias("open")), "open")
        if full.isEmpty():
            break
        inside = inside.join(broadcast_if(full, BROADCAST_SHARDS), F.shiftright("bits", BITS - end) == F.col("open"), "left_semi")
    return shards


def with_shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The documents with (shard, depth, shard_bytes, shard_docs, oversized) added; ``shard`` is the prefix in bits."""
    named_columns(docs, doc_id, text)
    keyed = docs.select(id_bits(F.col(doc_id)).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    shards = stage_table(directory(stage_table(keyed, "bits"), limit), "directory")
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # at most 61
    bits, depth, prefix = (fresh(docs, k) for k in ("bits", "depth", "prefix"))
    of = {c: fresh(docs, f"of_{c}") for c in shards.columns}
    rows = docs.withColumn(bits, id_bits(F.col(doc_id))).withColumn(depth, F.explode(F.array(*map(F.lit, depths)).cast("array<int>")))
    rows = rows.withColumn(prefix, F.expr(f"shiftright(`{bits}`, {BITS} - `{depth}`)"))
    name = F.when(F.col(depth) == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), F.col(depth), F.lit("0")))
    found = shards.select(*[F.col(c).alias(n) for c, n in of.items()])
    out = rows.join(broadcast_if(found, BROADCAST_SHARDS), (F.col(depth) == F.col(of["depth"])) & (F.col(prefix) == F.col(of["prefix"])))
    added = {"shard": name, **{c: F.col(of[c]) for c in ("depth", "shard_bytes", "shard_docs", "oversized")}}
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() not in added], *[v.alias(c) for c, v in added.items()])


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write the documents as one folder per shard; a task never holds more than one shard at a time."""
    with_shard(docs, doc_id, text, limit).drop("depth", "shard_bytes", "shard_docs", "oversized").repartition("shard").write.partitionBy("shard").parquet(path)


def sql(limit: int = LIMIT) -> str:
    """The same shards of the whole ``documents`` table in DuckDB."""
    return f"""
with d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as bits, coalesce(strlen(text), 0)::bigint as bytes from documents),
p as (select d.*, g.depth, bits >> ({BITS} - g.depth) as prefix from d, range(0, {BITS + 1}) g(depth)),
s as (select depth, prefix, sum(bytes)::bigint as shard_bytes, count(*) as shard_docs from p group by depth, prefix
      having sum(bytes) <= {limit} or min(bits) = max(bits)),
f as (select doc_id, bits, bytes, p.depth, p.prefix, shard_bytes, shard_docs,
      rank() over (partition by bits order by p.depth) as k from p join s on p.depth = s.depth and p.prefix = s.prefix)
select doc_id, bytes, case when depth = 0 then '' else lpad(bin(prefix), depth::int, '0') end as shard, depth::int as depth,
    shard_bytes, shard_docs, shard_bytes > {limit} as oversized from f where k = 1
"""
