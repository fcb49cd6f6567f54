"""Fixity audit of web archives by Merkle trees.

Pages are laid out as WARC records in files; a record's place is its file and byte
offset. Records are hashed, ordered offset ranges of RANGE_BYTES are hashed over the
records that begin in them, and FANOUT ranges at a time over those, up to one root a
file. Two replicas compare roots first and then only the children of nodes that
differ, down to the corrupt, missing or surplus records.

Scale: every level is an aggregate over groups of bounded size (a range's records,
FANOUT children), keyed by file and range, so a large file is spread over tasks. The
layout needs one sorted run per file; files have at most about MOST_RECORDS records,
however many rows share an id. Payloads are hashed in the scan and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialise, ship

RANGE_BYTES, FANOUT = 1 << 16, 16
#: Ids per file, and the records from which a file is split by hash.
IDS_PER_FILE, MOST_RECORDS = 1024, 4096


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC response record; null url and body count as empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame) -> DataFrame:
    """records (page_id, url, length, digest, ...) -> with file and offset. Rows equal in these four are one record. A null page_id goes to file "none"."""
    one = records.dropDuplicates(["page_id", "url", "length", "digest"])
    one = one.withColumn("bucket", F.floor(F.col("page_id") / IDS_PER_FILE))
    parts = one.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / MOST_RECORDS).alias("parts")).withColumnRenamed("bucket", "b2")
    spread = one.join(parts, one.bucket.eqNullSafe(parts.b2)).withColumn("part", F.pmod(F.xxhash64("page_id", "url", "digest"), "parts"))
    file = F.concat_ws("-", F.coalesce(F.col("bucket").cast("string"), F.lit("none")), F.col("part").cast("string"))
    before = Window.partitionBy("file").orderBy("page_id", "url", "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    return spread.withColumn("file", file).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("bucket", "b2", "parts", "part")


def _levels(replica: DataFrame, top: int) -> list[DataFrame]:
    """(file, idx, hash) of each level from the offset ranges up to the roots."""
    leaf = F.concat_ws(":", "offset", "length", "digest")
    level = replica.groupBy("file", (F.floor(F.col("offset") / RANGE_BYTES)).alias("idx")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("offset", leaf.alias("leaf"))))["leaf"], ",").cast("binary"), 256).alias("hash"))
    out = [materialise(level, "merkle")]
    for _ in range(top):
        up = out[-1].groupBy("file", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(":", "idx", "hash").alias("leaf"))))["leaf"], ",").cast("binary"), 256).alias("hash"))
        out.append(materialise(up.withColumnRenamed("up", "idx"), "merkle"))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (file, offset, length, page_id, digest) -> one row per record that differs: file, offset, length, page_id, status (altered, missing or surplus in b), digest_a, digest_b, range.

    Equal replicas, and empty ones, give no rows. Records of one place that repeat are
    compared as the sorted list of their digests.
    """
    ship(a.sparkSession)
    sides = []
    for side in (a, b):
        # Repeated rows collapse before they are collected.
        one = side.groupBy("file", "offset", "length", "page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
        sides.append(one.withColumn("digest", F.when(F.col("n") > 1, F.concat_ws("x", "digest", "n")).otherwise(F.col("digest"))).drop("n"))
    last = [s.agg(F.max("offset")).first()[0] or 0 for s in sides]
    top = max(0, math.ceil(math.log(max(last) // RANGE_BYTES + 1, FANOUT)))
    trees = [_levels(s, top) for s in sides]
    bad: DataFrame | None = None
    for level in range(top, -1, -1):
        x, y = (t[level] for t in trees)
        if bad is not None:
            # Only children of nodes that differ are looked at.
            parent = bad.select(F.col("file").alias("pf"), F.col("idx").alias("pi"))
            x, y = (s.join(parent, (s.file == F.col("pf")) & (F.floor(s.idx / FANOUT) == F.col("pi")), "left_semi") for s in (x, y))
        both = x.withColumnRenamed("hash", "ha").join(y.withColumnRenamed("hash", "hb"), ["file", "idx"], "full")
        found = materialise(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "idx"), "differ")
        if bad is not None:
            discard(bad)
        bad = found
    ranges = bad.select(F.col("file").alias("bf"), F.col("idx").alias("bi"))
    suspects = []
    for s in sides:
        inside = s.join(ranges, (s.file == F.col("bf")) & (F.floor(s["offset"] / RANGE_BYTES) == F.col("bi")), "left_semi")
        suspects.append(inside.groupBy("file", "offset", "length", "page_id").agg(F.array_join(F.array_sort(F.collect_list("digest")), "+").alias("digest")))
    names = ["file", "offset", "length", "page_id"]
    x, y = suspects[0].toDF(*names, "digest_a"), suspects[1].toDF(*[f"{c}_b" for c in names], "digest_b")
    out = x.join(y, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in names], "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    pick = lambda c: F.when(F.col("digest_a").isNull(), F.col(f"{c}_b")).otherwise(F.col(c)).alias(c)
    status = F.when(F.col("digest_a").isNull(), "surplus").when(F.col("digest_b").isNull(), "missing").otherwise("altered")
    out = out.select(pick("file"), pick("offset"), pick("length"), pick("page_id"), status.alias("status"), "digest_a", "digest_b")
    for tree in trees:
        for t in tree:
            discard(t)
    return out.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES))


def damaged(page_id: Column, body: Column) -> tuple[Column, Column]:
    """A second replica's body, and whether it lost the record: the faults that the registered query audits for, set by id."""
    flip = F.when(F.substring(body, 1, 1) == "~", F.lit("#")).otherwise(F.lit("~"))
    altered = F.when((page_id % 97 == 5) & (F.length(body) > 0), F.concat(flip, F.expr("substring(html, 2)"))).otherwise(body)
    return altered, F.coalesce(page_id % 193 == 7, F.lit(False))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Lays pages out as an archive, damages a replica of it as damaged() says, and audits the two."""
    ship(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body, lost = damaged(F.col("page_id"), F.col("html"))
    hashed = lambda b: F.sha2(warc_record(F.col("page_id"), F.col("url"), b).cast("binary"), 256)
    length = F.octet_length(warc_record(F.col("page_id"), F.col("url"), F.col("html"))).cast("long")
    archive = materialise(lay_out(src.select("page_id", "url", length.alias("length"), hashed(F.col("html")).alias("digest"), hashed(body).alias("other"), lost.alias("lost"))), "archive")
    a = archive.select("file", "offset", "length", "page_id", "digest")
    b = archive.where("not lost").select("file", "offset", "length", "page_id", F.col("other").alias("digest"))
    return audit(a, b)


ORACLE = f"""
WITH p AS (SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, 'WARC/1.1\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <urn:page:' || page_id || '>\\r\\nWARC-Target-URI: ' || url
             || '\\r\\nContent-Type: text/html\\r\\nContent-Length: ' || octet_length(encode(html)) || '\\r\\n\\r\\n' AS head,
      CASE WHEN page_id % 97 = 5 AND length(html) > 0 THEN CASE WHEN html[1] = '~' THEN '#' ELSE '~' END || substring(html, 2) ELSE html END AS other FROM p),
s AS (SELECT page_id, url, octet_length(encode(head || html || '\\r\\n\\r\\n')) AS length, sha256(head || html || '\\r\\n\\r\\n') AS digest,
      sha256(CASE WHEN octet_length(encode(other)) = octet_length(encode(html)) THEN head ELSE replace(head, 'Content-Length: ' || octet_length(encode(html)), 'Content-Length: ' || octet_length(encode(other))) END || other || '\\r\\n\\r\\n') AS other,
      page_id % 193 = 7 AS lost FROM r),
o AS (SELECT *, page_id // {IDS_PER_FILE} || '-0' AS file, coalesce(sum(length) OVER (PARTITION BY page_id // {IDS_PER_FILE} ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s)
SELECT file, "offset", length::BIGINT AS length, page_id, CASE WHEN lost THEN 'missing' ELSE 'altered' END AS status, digest AS digest_a,
       CASE WHEN lost THEN NULL ELSE other END AS digest_b, "offset" // {RANGE_BYTES} AS range
FROM o WHERE lost OR digest <> other""".replace("\\r\\n", "' || chr(13) || chr(10) || '")
