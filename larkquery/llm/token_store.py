"""Token ids in wavelet-matrix files.

Documents are dealt by ranges of their id, so that files in name order hold the corpus in ascending id order.  A
task encodes its documents, and for each shard of about ``shard_tokens`` ids writes one compressed file to the
shared folder: the wavelet matrix of the ids (bit-planes from the highest bit; each plane stably parts zeros from
ones) and the ids and lengths of its documents.  From one file, without decoding it, a reader gets the token at a
position, the count of a token in a range and the places where it occurs, by rank and select on the planes.

A file is written under a temporary name and moved, so a task that runs twice leaves one file.  The manifest, a
written table, gives each shard its first global position; the reader joins it.

Defined cases: null text is the empty text, so the document has its end id only; null ids come first; rows that
repeat an id are all stored, ordered by the hash of their text; a document longer than a shard makes a longer
shard; an empty table gives no file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import local_file, map_arrow, shared_path, ship_file, slices, total_text_bytes, write_shared
from .memo import Memo, run_sums

MAGIC = b"LQWM1\0"
NO_ID = -(1 << 63)
#: Words and pieces a worker remembers before it starts anew; bounds memory, not the result.
MEMO_WORDS = 600_000


def _bits_needed(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


@dataclass
class WaveletMatrix:
    """n tokens of ``bits`` bits; planes[l] holds bit l from the top, packed (first token in the lowest bit)."""

    n: int
    bits: int
    zeros: list[int]
    planes: list[np.ndarray]
    _ranks: dict[int, tuple] = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        x = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for b in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = np.flatnonzero(~one)  # positions are far cheaper here than masks
            zeros.append(len(low))
            x = np.concatenate([x.take(low), x.take(np.flatnonzero(one))])
        return cls(len(tokens), bits, zeros, planes)

    def decode(self) -> np.ndarray:
        """All tokens: undo the planes from the last to the first."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before, zeros = np.empty_like(x), self.zeros[level]
            before[np.flatnonzero(~one)] = x[:zeros]
            before[np.flatnonzero(one)] = x[zeros:] | x.dtype.type(1 << (self.bits - 1 - level))
            x = before
        return x.astype(np.uint32)

    def _rank_table(self, level: int):
        """(64-bit words of the plane, ones before each word)."""
        if level not in self._ranks:
            packed = self.planes[level]
            words = np.frombuffer(packed.tobytes().ljust(-(-(len(packed) + 1) // 8) * 8, b"\0"), "<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self._ranks[level] = words, np.concatenate([[0], np.cumsum(ones)])
        return self._ranks[level]

    def _rank1(self, level: int, i: int) -> int:
        words, before = self._rank_table(level)
        w, b = divmod(i, 64)
        return int(before[w]) + (int(words[w]) & ((1 << b) - 1)).bit_count() if b else int(before[w])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        words, before = self._rank_table(level)
        if bit:
            w = int(np.searchsorted(before, k, side="right")) - 1
            left, word = k - int(before[w]), int(words[w])
        else:
            clear = 64 * np.arange(len(before)) - before
            w = int(np.searchsorted(clear, k, side="right")) - 1
            left, word = k - int(clear[w]), ~int(words[w]) & ((1 << 64) - 1)
        for _ in range(left):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            ones = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - ones
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _interval(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        end = self.n if end is None else min(end, self.n)
        if token >> self.bits or start >= end:
            return 0
        a, b = self._interval(token, max(start, 0), end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        a, b = self._interval(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at


def pack_shard(tokens: np.ndarray, doc_ids: list, lengths: list[int], bits: int) -> bytes:
    """One file: magic, a table of section sizes, and compressed sections (documents, lengths, planes)."""
    import zstandard

    wm = WaveletMatrix.build(tokens, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    ids = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    sections = [squeeze(ids.tobytes()), squeeze(np.array(lengths, "<u8").tobytes()), *(squeeze(p.tobytes()) for p in wm.planes)]
    head = struct.pack("<QQB", wm.n, len(doc_ids), bits) + struct.pack(f"<{bits}Q", *wm.zeros) + struct.pack(f"<{len(sections)}Q", *map(len, sections))
    return MAGIC + head + b"".join(sections)


@dataclass
class Shard:
    doc_ids: list
    lengths: np.ndarray
    matrix: WaveletMatrix

    @classmethod
    def read(cls, data: bytes) -> Shard:
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC)
        n, n_docs, bits = struct.unpack_from("<QQB", data, at)
        at += 17
        zeros = list(struct.unpack_from(f"<{bits}Q", data, at))
        sizes = struct.unpack_from(f"<{bits + 2}Q", data, at + 8 * bits)
        at += 8 * bits + 8 * (bits + 2)
        sections, expand = [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            sections.append(expand(data[at : at + size]))
            at += size
        ids = np.frombuffer(sections[0], "<i8").tolist()
        return cls([None if d == NO_ID else d for d in ids], np.frombuffer(sections[1], "<u8").astype(np.int64), WaveletMatrix(n, bits, zeros, [np.frombuffer(s, np.uint8) for s in sections[2:]]))


def _joined(strings: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), by)[0].as_py()


def _flat_ids(encodings) -> tuple[np.ndarray, np.ndarray]:
    found = [x.ids for x in encodings]
    return np.array([x for ids in found for x in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))


class WordCodec:
    """A tokenizer that treats words between blanks one by one, each distinct word once.

    Sound for tokenizers whose normalisation and pre-tokenisation never look across white space; blank, tab and line
    ends are white space to all of them.  Where the tokenizer lower-cases, splits by a pattern, maps bytes and marks
    the end of each piece, words of Latin letters and signs (no normalisation applies to these) are split here by the
    tokenizer's own pattern, and the new distinct pieces of a batch go to the tokenizer's model together; all other
    words, and all that hold the string of an added token (in any case), go through the whole tokenizer.  Where such a
    string has white space, whole texts do.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = any(c.isspace() for t in self.added for c in t)
        pattern = self._pattern()
        if pattern:
            from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

            self.split = regex.compile(f"{pattern}|\n").findall
            byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
            self.mapped = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x180)}
            self.model = Tokenizer(self.tokenizer.model)  # no normalisation: pieces between blanks
            self.model.pre_tokenizer = WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
            self.last[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.simple = pattern is not None
        self._start()

    def _start(self) -> None:
        self.words, self.pieces = Memo(), Memo()

    def _pattern(self) -> str | None:
        import json

        made = json.loads(self.tokenizer.to_str())
        steps = [(x["type"], x.get("content")) for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        if not known or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        model = made["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or model["dropout"]:
            return None
        return cuts[0]["pattern"]["Regex"]

    def _simple_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) by way of their pieces; line ends part the words."""
        found = pa.array(self.split(_joined(words, "\n").lower()), pa.string()).dictionary_encode()
        distinct, at = found.dictionary, found.indices.to_numpy()
        breaks = pc.equal(distinct, "\n")
        rows = pc.if_else(breaks, -1, self.pieces.find(distinct))
        if len(new := distinct.filter(pc.is_null(rows))):
            # in parts, as the tokenizer keeps the offsets of all that it reads at once
            ids = [self.model.encode_batch_fast([_joined(new.slice(i, 2000), " ").translate(self.mapped)])[0].ids for i in range(0, len(new), 2000)]
            ids = np.concatenate([np.array(x, np.uint32) for x in ids])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(new) or ends[-1] != len(ids):
                raise RuntimeError("the model's tokens do not end where the pieces do")
            rows = self.pieces.add(rows, new, ids, np.diff(ends, prepend=0))
        rows = rows.to_numpy()[at]
        parts = np.diff(np.flatnonzero(rows < 0), prepend=-1, append=len(rows)) - 1  # pieces of each word
        ids, sizes = self.pieces.take(rows[rows >= 0])
        return ids, run_sums(sizes, parts)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words that are not known yet."""
        simple = pa.array(np.zeros(len(words), bool))
        if self.simple:
            simple = pc.match_substring_regex(words, "^[!-~\u00a1-\u012f\u0131-\u017f]+$")
            for token in self.added:
                simple = pc.and_not(simple, pc.match_substring(words, token, ignore_case=True))
        done = simple.to_numpy(zero_copy_only=False)
        if done.all():
            return self._simple_words(words)
        sizes, ids = np.empty(len(words), np.int64), {True: np.empty(0, np.uint32)}
        if done.any():
            ids[True], sizes[done] = self._simple_words(words.filter(simple))
        rest = words.filter(pc.invert(simple))
        parts = [_flat_ids(self.tokenizer.encode_batch_fast(rest.slice(i, 2000).to_pylist(), add_special_tokens=False)) for i in range(0, len(rest), 2000)]
        ids[False], sizes[~done] = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = np.empty(sizes.sum(), np.uint32)
        of = np.repeat(done, sizes)
        out[of], out[~of] = ids[True], ids[False]
        return out, sizes

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); null is the empty text."""
        texts = pc.fill_null(texts, "")
        if self.whole:
            return _flat_ids(self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False))
        if len(self.words) + len(self.pieces) > MEMO_WORDS:
            self._start()
        for white in "\n\t\r":
            texts = pc.replace_substring(texts, white, " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        rows = self.words.find(words.dictionary)
        if len(new := words.dictionary.filter(pc.is_null(rows))):
            rows = self.words.add(rows, new, *self._encoded(new))
        ids, sizes = self.words.take(rows.to_numpy()[words.indices.to_numpy()])
        return ids, run_sums(sizes, pc.list_value_length(split).to_numpy().astype(np.int64))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, sizes = self.encode_batch(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []


_codecs: dict[str, WordCodec] = {}


def _codec(path: str) -> WordCodec:
    """One codec for each worker process and tokenizer file, which Spark ships to where it is not."""
    if path not in _codecs:
        _codecs[path] = WordCodec(local_file(path))
    return _codecs[path]


#: Shards of so many tasks are numbered together; only sums of such blocks meet in one window.
MANIFEST_BLOCK = 1024


def write_tokens(docs: DataFrame, tokenizer: str, vocabulary_size: int, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 64 << 20, shard_tokens: int = 1 << 22) -> tuple[str, DataFrame]:
    """Write shards below ``out``; returns the folder and the manifest, a written table.

    The manifest has a row for each shard: name, start (its first global position), n_tokens.
    """
    spark = docs.sparkSession
    ship_file(spark, tokenizer)
    out = out or shared_path(spark, "token-shards")
    bits = _bits_needed(max(vocabulary_size, end_id + 1))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_text_bytes(docs, text_col) / part_bytes))

    def run(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(out)
        part, codec, end = TaskContext.get().partitionId(), _codec(tokenizer), np.array([end_id], np.uint32)
        rows, ids, lengths, parts = [], [], [], []

        def flush():
            data = pack_shard(np.concatenate(parts), ids, lengths, bits)
            name = f"part-{part:09d}-{len(rows):06d}.wvm"
            store.create_dir(folder)
            with store.open_output_stream(hidden := f"{folder}/_{name}.{uuid.uuid4().hex}") as stream:
                stream.write(data)
            store.move(hidden, f"{folder}/{name}")
            rows.append((name, part, sum(lengths)))
            ids.clear(), lengths.clear(), parts.clear()

        held = 0
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                tokens, sizes = codec.encode_batch(batch.column("text"))
                ends = np.cumsum(sizes)
                for doc_id, a, b in zip(batch.column("id").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                    ids.append(doc_id)
                    lengths.append(b - a + 1)
                    parts.extend((tokens[a:b], end))
                    held += b - a + 1
                    if held >= shard_tokens:
                        flush()
                        held = 0
        if ids:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["name", "part", "n_tokens"])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    shards = write_shared(map_arrow(ordered, run, "name string, part long, n_tokens long"), "shards").withColumn("block", F.floor(F.col("part") / MANIFEST_BLOCK))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = shards.groupBy("block").agg(F.sum("n_tokens").alias("n_tokens")).select("block", before(W.orderBy("block")).alias("first"))
    inside = shards.withColumn("inside", before(W.partitionBy("block").orderBy("name")))
    return out, write_shared(inside.join(blocks, "block").select("name", (F.col("first") + F.col("inside")).alias("start"), "n_tokens"), "manifest")


def read_tokens(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "name string, doc_id long, inside long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = Shard.read(content.as_buffer().to_pybytes())
                tokens = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                name = pa.array([path.rsplit("/", 1)[1]]).dictionary_encode().take(pa.array(np.zeros(len(crcs), np.int64))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crcs, pa.int64())], names=["name", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wvm").load(folder).select("path", "content")
    found = map_arrow(files, run, schema).join(manifest.select("name", "start"), "name")
    return found.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
