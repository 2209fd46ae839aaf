"""A training-data pipeline over ``documents``: each stage's result is written as Parquet and read by the next.

A document is known by its id and a hash of its text, so that null ids and ids that rows of different texts share
(not so in ``documents``) are chosen text by text; rows that are repeated throughout stay or go together.  Every stage
takes null texts and ids, empty tables and extra columns; columns that are not those of ``documents`` end with the
first stage.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkquery.llm.common import write_shared
from larkquery.llm.exact_dedup import exact_dedup
from larkquery.llm.jaccard_join import jaccard_kept
from larkquery.llm.langid import fit_langid, keep_identified
from larkquery.llm.mixing import mix_sources
from larkquery.llm.queries import MIX_BLOCK, MIX_REST, MIX_SHARES, bpe_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    return keep_identified(docs.select(COLUMNS), fit_langid(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    gone = exact_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"))
    gone = write_shared(gone, "copies")  # its size decides how it is joined
    return docs.select(COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key")), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays (where none has an id, one of them)."""
    gone = jaccard_kept(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"))
    gone = write_shared(gone, "near-copies")
    return docs.select(COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files and rows in them by slot."""
    placed = mix_sources(docs.select(COLUMNS), MIX_SHARES, MIX_REST, MIX_BLOCK)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "mix_slot", "mix_pos").sortWithinPartitions("mix_slot", "mix_pos").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document doc_id, place, n_tokens and the digests of its ids and of the bytes they decode to.

    ``place`` numbers the rows of ``docs`` from 0 by file and row in it, the order of the mixture, whatever way Spark
    packs the files into partitions; the result is in this order too.
    """
    import public_tokenizers as tokenizers

    try:
        rows = docs.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_path").alias("path"))
    except AnalysisException:  # not read from Parquet
        return tokenize(spark, write_shared(docs.select(COLUMNS), "unplaced"), sf_dir)
    files, firsts, total = [], [], 0
    for path, file, n in sorted((tuple(r) for r in rows.groupBy("path", "file").count().collect()), key=lambda r: _file_order(r[0])):
        files.append(file)
        firsts.append(total)
        total += n
    # one row for each file; joined to the digests, not to the texts
    first = spark.createDataFrame(pa.table({"file": pa.array(files, pa.int64()), "first": pa.array(firsts, pa.int64())}))
    out = bpe_digests(rows, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ("file", "row"))
    out = out.join(first, "file").select("doc_id", (F.col("first") + F.col("row")).alias("place"), "n_tokens", "ids_sha256", "decoded_sha256")
    # the part of each place is known, so the documents are not coded twice to sample a range
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(parts, F.expr(f"CAST(place * {parts} DIV {max(total, 1)} AS INT)")).sortWithinPartitions("place")


def _file_order(path: str) -> tuple[int, str]:
    """Spark numbers the files of a table by partition, with more digits from the 100,000th."""
    found = re.match(r"part-(\d+)", path.rsplit("/", 1)[-1])
    return int(found[1]) if found else -1, path


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]
#: Language identification is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
