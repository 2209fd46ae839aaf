"""Exact deduplication by Grace hashing.

Records are dealt by a hash of their content into buckets; Spark's shuffle files are the first spill.  Each
bucket is read by one task into an open-addressing table that compares complete contents.  A table holds at most
``bucket_bytes`` of distinct content: contents that come when it is full are deferred, as whole groups, to spill
files in the shared folder, and those records are dealt again with another hash, level by level, until every
bucket has fitted.  An input of more than ``fan_out`` buckets is first partitioned to spill files by another hash, and
each of these is then dealt by itself, so no shuffle has more buckets than that.

A group of copies cannot be split by any hash, so copies are collapsed before the shuffle (one record per content
and Arrow batch) and the documents of a group are joined to its verdict by digest afterwards; that join carries
ids only, and a large group is dealt to several tasks.

Defined cases: null text counts as empty; null ids are never the id that stays unless the group has no other
(then ``keep_id`` is null and ``kept`` true); rows that repeat the id that stays are all ``kept``; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_verdicts, map_arrow, shared_path, slices, total_text_bytes

RECORD = "h long, content binary, top_id long, n long"
LEVEL = "sha string, keep_id long, group_size long, h long, content binary, top_id long, n long"


def _hash64(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _collapse(batch: pa.RecordBatch):
    """One record for each content of the batch."""
    for part in slices(batch, "text"):
        seen: dict[bytes, list] = {}
        for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            content = (text or b"").lower()
            if (got := seen.get(content)) is None:
                seen[content] = [doc_id, 1]
            else:
                got[0], got[1] = _larger(got[0], doc_id), got[1] + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([_hash64(c) for c in seen], pa.int64()), pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            names=["h", "content", "top_id", "n"],
        )


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content is equal."""

    def __init__(self, most_bytes: int, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.top: list = []
        self.count: list[int] = []
        self.most_bytes, self.held = most_bytes, 0

    def _place(self, h: int, content: bytes) -> tuple[int, int]:
        """(slot, entry); entry is -1 where the content is not in the table."""
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return at, int(e)
            at = (at + 1) & mask
        return at, -1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e

    def add(self, h: int, content: bytes, top_id, n: int) -> bool:
        """False if the content is new and the table is full."""
        at, e = self._place(h, content)
        if e >= 0:
            self.top[e] = _larger(self.top[e], top_id)
            self.count[e] += n
            return True
        if self.hashes and self.held + len(content) > self.most_bytes:
            return False
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.top.append(top_id)
        self.count.append(n)
        self.held += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return True


def _bucket(most_bytes: int):
    def run(batches):
        table, names = ContentTable(most_bytes), ["sha", "keep_id", "group_size", "h", "content", "top_id", "n"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for whole in batches:
            for batch in slices(whole, "content"):
                late: list[tuple] = []
                for record in zip(*(batch.column(c).to_pylist() for c in ("h", "content", "top_id", "n")), strict=True):
                    if not table.add(*record):
                        late.append(record)
                if late:
                    cols = list(zip(*late, strict=True))
                    none = [None] * len(late)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([none, none, none, *cols], kinds, strict=True)], names=names)
        for i in range(0, len(table.hashes), 5000):
            part = slice(i, i + 5000)
            shas = [hashlib.sha256(c).hexdigest() for c in table.contents[part]]
            none = [None] * len(shas)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([shas, table.top[part], table.count[part], none, none, none, none], kinds, strict=True)], names=names)

    return run


def _levels(records: DataFrame, size: int, bucket_bytes: int, buckets: int | None) -> list[str]:
    """Deal records to buckets, and what did not fit again; the folders of all levels."""
    spark, paths = records.sparkSession, []
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * size / bucket_bytes))
    while True:
        dealt = records.repartition(n, F.xxhash64(F.lit(len(paths)), F.col("h")))
        paths.append(shared_path(spark, f"grace-level{len(paths)}"))
        map_arrow(dealt, _bucket(bucket_bytes), LEVEL).write.parquet(paths[-1])
        deferred = spark.read.schema(LEVEL).parquet(paths[-1]).where(F.col("content").isNotNull())
        left = deferred.agg(F.sum(F.octet_length("content"))).first()[0]
        if left is None:
            return paths
        records = deferred.select("h", "content", "top_id", "n")
        n = buckets or max(n, math.ceil(4 * left / bucket_bytes))


def grace_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, buckets: int | None = None, fan_out: int = 100_000) -> DataFrame:
    """One row per distinct content: sha (of the normalised content), keep_id, group_size."""
    spark = docs.sparkSession
    size = total_text_bytes(docs, text_col)
    records = arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), _collapse, RECORD)
    parts = math.ceil((buckets or 4 * size / bucket_bytes) / fan_out)
    if parts <= 1:
        paths = _levels(records, size, bucket_bytes, buckets)
    else:
        spill = shared_path(spark, "grace-parts")
        records.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("h")), F.lit(parts)).cast("int")).write.partitionBy("part").parquet(spill)
        stored = spark.read.schema(f"{RECORD}, part int").parquet(spill)
        paths = [p for k in range(parts) for p in _levels(stored.where(F.col("part") == k).drop("part"), size // parts, bucket_bytes, buckets and -(-buckets // parts))]
    return spark.read.schema(LEVEL).parquet(*paths).where(F.col("sha").isNotNull()).select("sha", "keep_id", "group_size")


def _digests(batch: pa.RecordBatch):
    for part in slices(batch, "text"):
        shas = [hashlib.sha256((t or b"").lower()).hexdigest() for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row_key"), pa.array(shas, pa.string())], names=["doc_id", "row_key", "sha"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, buckets: int | None = None, fan_out: int = 100_000) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, row_key (hash of the text as it is).

    Texts are equal when identical after lower-casing A-Z only; the largest id of a group stays.
    """
    groups = grace_groups(docs, id_col, text_col, bucket_bytes, buckets, fan_out)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row_key"))
    members = arrow_map(rows, _digests, "doc_id long, row_key long, sha string")
    return join_verdicts(members, groups, ["sha"], "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "row_key")
