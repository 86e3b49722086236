"""Fixity audit of WARC replicas with Merkle trees.

Every record is hashed with its offset. Records whose offsets fall in one range of a file make a leaf, ``fan`` leaves or nodes
in a row make a node of the next level, up to one root per file. Roots of two replicas are compared first; below
them only branches that differ are read, level by level, down to the leaves, and only records of differing leaves are
compared. So an intact file costs one comparison, and damage is located to its record.

Ranges depend on offsets alone, so a lost record changes its own leaf and no other. A leaf holds at most
``range_bytes`` divided by the size of a record header, a node ``fan`` children, so no group is large. Trees are written to the shared folder;
levels are as many as the largest offset needs.

Records: ``warc_file, offset, length, digest`` (SHA-256). NULL content counts as empty. Repeated records (same
file and offset) are hashed in the order of their digests. An empty replica lacks every record of the other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.columns import running_total
from talentweave.plans.storage import materialize

RANGE_BYTES = 1 << 16
FAN = 16
FILE_PAGES = 512  # pages per file
COPIES = 1 << 10  # of a record, listed by one task


def warc_record(url: Column, content: Column) -> Column:
    """A response record as text."""
    body = F.coalesce(content, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def file_of(record_id: Column, *content: str) -> Column:
    """Name of the file of a page; pages without an id are spread over files of their own by a hash of ``content``."""
    spread = F.pmod(F.xxhash64(*content), F.lit(1 << 20)).cast("string")
    return F.when(record_id.isNull(), F.concat(F.lit("none-"), spread)).otherwise(
        F.concat(F.lit("pages-"), F.floor(record_id / FILE_PAGES).cast("string")))


def with_offsets(records: DataFrame) -> DataFrame:
    """Where each record (``warc_file, record_id, length, digest``) begins in its file, in the order of ids and digests.

    Rows equal in all columns are counted first and listed anew at the end, and totals go by id and the first signs of
    the digest, so a file that holds most rows is spread over tasks.
    """
    names = records.columns
    bucket = F.struct(F.coalesce("record_id", F.lit(0)).alias("id"), F.substring("digest", 1, 2).alias("signs"))
    copies = materialize(records.groupBy(*names).agg(F.count("*").alias("_n")).withColumns({
        "_bytes": F.col("_n") * F.col("length"), "_bucket": bucket}), "record-copies")
    order = ["record_id", "digest", *[c for c in names if c not in ("warc_file", "record_id", "digest")]]
    placed = running_total(copies, "warc_file", "_bucket", order, "_bytes", "_start")
    parts = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long")))).repartition("warc_file", "digest", "_from")
    each = parts.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_n")) - 1)))
    return each.select(*names, (F.col("_start") + F.col("_copy") * F.col("length")).cast("long").alias("offset"))


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN, levels: int = 1) -> DataFrame:
    """``warc_file, level, node, hash`` for levels 0 (leaves) to ``levels``, written to the shared folder."""
    line = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    at = records.select("warc_file", F.floor(F.col("offset") / range_bytes).alias("node"), "offset", "digest", line.alias("line"))

    def level(children: DataFrame, n: int) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest", "line"))), lambda c: c["line"])
        made = children.groupBy("warc_file", "node").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("hash"))
        return materialize(made.select("warc_file", F.lit(n).alias("level"), "node", "hash"), f"merkle-{n}")

    grown = [level(at.withColumnRenamed("offset", "place"), 0)]
    for n in range(1, levels + 1):
        children = grown[-1].select(
            "warc_file", F.floor(F.col("node") / fan).alias("node"), F.col("node").alias("place"), F.lit("").alias("digest"),
            F.concat_ws(" ", F.col("node").cast("string"), "hash").alias("line"))
        grown.append(level(children, n))
    whole = grown[0]
    for part in grown[1:]:
        whole = whole.unionByName(part)
    return whole


def levels_for(*replicas: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> int:
    """Levels above the leaves until one node covers the largest file."""
    ends = [r.agg(F.max("offset")).first()[0] or 0 for r in replicas]
    leaves, n = max(ends) // range_bytes + 1, 1
    while fan**n < leaves:
        n += 1
    return n


def differing(a: DataFrame, b: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """``warc_file, node``: leaves that differ, found from the roots downwards."""
    found = None
    for n in range(levels, -1, -1):
        left = a.where(F.col("level") == n).select("warc_file", "node", F.col("hash").alias("ha"))
        right = b.where(F.col("level") == n).select("warc_file", "node", F.col("hash").alias("hb"))
        if found is not None:
            parents = found.select(F.col("warc_file").alias("_f"), F.col("node").alias("_n"))
            under = [
                side.join(parents, (F.col("warc_file") == F.col("_f")) & (F.floor(F.col("node") / fan) == F.col("_n")), "left_semi")
                for side in (left, right)]
            left, right = under
        found = left.join(right, ["warc_file", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("warc_file", "node")
        if n:
            found = materialize(found, f"differing-{n}")
    return found


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Damaged records of replica ``b`` against ``a``: ``warc_file, offset, status, length_a, length_b, digest_a, digest_b``.

    ``status``: changed, missing (not in b) or extra (not in a).
    """
    levels = levels_for(a, b, range_bytes=range_bytes, fan=fan)
    leaves = differing(tree(a, range_bytes, fan, levels), tree(b, range_bytes, fan, levels), levels, fan).select(
        F.col("warc_file").alias("_f"), F.col("node").alias("_n"))
    sides = []
    for side, rows in (("a", a), ("b", b)):
        inside = rows.join(
            leaves, (F.col("warc_file") == F.col("_f")) & (F.floor(F.col("offset") / range_bytes) == F.col("_n")), "left_semi")
        # Records that share file and offset are numbered, so that each meets one of the other replica.
        turn = Window.partitionBy("warc_file", "offset").orderBy("digest")
        sides.append(inside.select(
            "warc_file", "offset", F.row_number().over(turn).alias("_turn"), F.col("length").alias(f"length_{side}"),
            F.col("digest").alias(f"digest_{side}")))
    met = sides[0].join(sides[1], ["warc_file", "offset", "_turn"], "full")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    same = F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("length_a").eqNullSafe(F.col("length_b"))
    return met.where(~same).select("warc_file", "offset", status.alias("status"), "length_a", "length_b", "digest_a", "digest_b")
