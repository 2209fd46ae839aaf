"""Line deduplication over the corpus.

Normalised lines are exploded with their position and hashed (128 bits); distinct documents are counted per hash
with partial aggregation on (hash, document) first, so that a line which a third of all documents share never
meets in one task as rows.  The few hashes over the threshold are joined back to the exploded positions; a
line of very many documents is dealt to as many more tasks.  Dropped positions are grouped per document, and each
document is reassembled by position from its own lines.  Texts cross the network once, with that last join.

Defined cases: null or empty text is one empty line; null ids are no document for the count and never the one
that keeps a line; rows with the same id are one document for the count, and each is rewritten by itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, join_verdicts, map_arrow, slices, write_shared


def _exploded(min_chars: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, pos, keys = [], [], []
                for r, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    for p, line in enumerate((text or b"").split(b"\n")):
                        if len(line) >= min_chars and len(key := line.strip(ASCII_SPACE)) >= min_chars and len(key.decode()) >= min_chars:
                            rows.append(r)
                            pos.append(p)
                            keys.append(hashlib.blake2b(key.lower(), digest_size=16).digest())
                if rows:
                    h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("row_key").take(at), pa.array(pos, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["id", "row_key", "pos", "h1", "h2"])

    return run


def _reassembled(batches):
    """Linear in the lines of a text, however many of them go."""
    for whole in batches:
        for batch in slices(whole, "text"):
            n_lines, n_dropped, kept = [], [], []
            for text, dropped in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                lines = text.split("\n")
                n_lines.append(len(lines))
                n_dropped.append(len(dropped or ()))
                if dropped:
                    gone = set(dropped)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in gone])
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, text (kept lines joined by a line feed).

    A line's key has ASCII white space stripped and A-Z lower-cased.  Keys of at least ``min_chars`` code points
    in at least ``min_docs`` documents lose all their lines except in the largest id that holds them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))
    lines = write_shared(map_arrow(texts, _exploded(min_chars), "id long, row_key long, pos int, h1 long, h2 long"), "line-hashes")
    common = lines.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n_docs"), F.count("*").alias("n_rows"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    common = write_shared(common, "common-lines")
    drops = (
        join_verdicts(lines, common, ["h1", "h2"], "n_rows")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row_key")
        .agg(F.collect_set("pos").alias("dropped"))
        .withColumnsRenamed({"id": "d_id", "row_key": "d_key"})
    )
    joined = texts.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("row_key") == F.col("d_key")), "left")
    return map_arrow(joined.select("id", "text", F.sort_array("dropped").alias("dropped")), _reassembled, "doc_id long, n_lines long, n_dropped long, text string")
