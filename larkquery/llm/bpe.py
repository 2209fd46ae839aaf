"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the vocabulary finds, in one pass over
a piece, the longest token that starts at each byte.  The encoder takes the longest match, steps to a shorter
prefix token where the pair with the token before is impossible, and goes back one token where none is left; a bit
for each position keeps dead ends from being tried twice, so the work is linear in the piece.  Two tokens may
stand side by side exactly if the merges turn their joint bytes into these two tokens; that is memoised.

The vocabulary file is named by a parameter and read by each Python worker, or shipped by Spark if it is not there.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_file, map_arrow, ship_file, slices
from .memo import Memo, run_sums, taken

#: A worker's memos are cleared beyond these numbers of entries; that bounds memory and changes no result.
MEMO_PIECES = 150_000
MEMO_PAIRS = 150_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 20


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.automaton = None
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.memo = Memo()
        tokens = sorted(self.bytes_of)
        self.byte_ends = np.zeros((tokens[-1] if tokens else -1) + 2, np.int64)
        self.byte_ends[np.array(tokens, np.int64) + 1] = [len(self.bytes_of[t]) for t in tokens]
        np.cumsum(self.byte_ends, out=self.byte_ends)
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of[t] for t in tokens), np.uint8)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, data: bytes, ranks: dict[bytes, int] | None = None) -> list[int]:
        """The merges themselves: the lowest rank first, the leftmost of equals.  For single tokens only."""
        ranks = self.ranks if ranks is None else ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte, or for a token that no merges reach."""
        if token not in self.halves:
            data = self.bytes_of[token]
            found = None
            if len(data) > 1:
                below = {k: v for k, v in ((data[i:j], self.ranks.get(data[i:j])) for i in range(len(data)) for j in range(i + 1, len(data) + 1)) if v is not None and v < token}
                parts = self.merge(data, below)
                found = (parts[0], parts[1]) if len(parts) == 2 else None
            self.halves[token] = found
        return self.halves[token]

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (None: can begin a piece).

        Undo the merges next to the boundary, latest first: the pair is impossible if, at some moment, the tokens
        that then touch the boundary would have merged before the merge that is being undone.
        """
        key = right if left is None else (left + 1) << 32 | right
        if (found := self.pairs.get(key)) is None:
            found = (len(self.bytes_of[right]) == 1 or self.halves_of(right) is not None) and (left is None or self._apart(left, right))
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        limit = 1 << 60  # merges across the boundary of a rank below this would have come first
        joined = self.ranks.get
        while True:
            across = joined(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < limit:
                return False
            a, b = self.halves_of(left), self.halves_of(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]  # equal ranks: the leftmost merge comes first
            else:
                limit, right = right + 1, b[0]

    def prefix_token(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for none."""
        if (found := self.shorter.get(token)) is None:
            data = self.bytes_of[token]
            found = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def matcher(self):
        """The automaton over all tokens, made when first needed (decoding does without)."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                self.automaton.add_word(token.decode("latin-1"), rank)
            self.automaton.make_automaton()
        return self.automaton

    def backtrack(self, data: bytes) -> list[int]:
        text, automaton, pairs, sizes = data.decode("latin-1"), self.matcher(), self.pairs, self.bytes_of
        n, after = len(data), automaton.iter_long
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, last = 0, None
        token = next(after(text))[1]
        while pos < n:
            while token >= 0:
                end = pos + len(sizes[token])
                if alive[end]:
                    fits = pairs.get(token if last is None else (last + 1) << 32 | token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = self.prefix_token(token)
            if token >= 0:
                out.append(token)
                last, pos = token, end
                if pos < n:
                    token = next(after(text, pos))[1]
            else:
                if last is None:
                    raise ValueError("the vocabulary lacks a byte of the text")
                alive[pos] = 0
                token = out.pop()
                pos -= len(sizes[token])
                last = out[-1] if out else None
        return out

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        return self.backtrack(data) if whole is None else [whole]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); each distinct piece is encoded once as long as the memo holds it."""
        split = [self.split(t) if t else [] for t in texts]
        found = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        if len(self.memo) > MEMO_PIECES:
            self.memo = Memo()
        rows = self.memo.find(found.dictionary)
        if len(new := found.dictionary.filter(pc.is_null(rows))):
            ids = list(map(self.piece, new.to_pylist()))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            rows = self.memo.add(rows, new, np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum()), sizes)
        ids, sizes = self.memo.take(rows.to_numpy()[found.indices.to_numpy()])
        return ids.astype(np.int32), run_sums(sizes, np.fromiter(map(len, split), np.int64, len(split)))

    def encode(self, text: str) -> np.ndarray:
        """The ids (int32) of a text."""
        return self.encode_batch([text])[0]

    def decode_batch(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Of ids of several texts, so many each: the bytes of each text (binary)."""
        flat, each = taken(self.byte_flat, self.byte_ends, ids.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(run_sums(each, sizes))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat)])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def worker_codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    if (key := (path, pattern)) not in _codecs:
        _codecs[key] = BytePairCodec.from_file(local_file(path), pattern)
    return _codecs[key]


def _encoded(vocabulary: str, pattern: str):
    def run(batches):
        codec = worker_codec(vocabulary, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, sizes = codec.encode_batch(batch.column("text").to_pylist())
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[*kept, "ids"])

    return run


def _decoded(vocabulary: str, pattern: str):
    def run(batches):
        codec = worker_codec(vocabulary, pattern)
        for batch in batches:
            # a part of an encoded slice, or of what Spark sends: its arrays are bounded like a batch
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = part.column("ids")
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, codec.decode_batch(ids.flatten().to_numpy(), sizes)], names=[*part.schema.names, "decoded"])

    return run


def encode_bpe(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (array of int), without special tokens.

    Defined cases: null text is the empty text and has no ids; null ids and repeated rows pass through; texts are
    read whole; an empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ship_file(docs.sparkSession, vocabulary)
    return map_arrow(rows, _encoded(vocabulary, pattern), "doc_id long, ids array<int>")


def decode_bpe(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Adds decoded (binary) to the rows of ``encode_bpe``; null ids decode to no bytes."""
    ship_file(encoded.sparkSession, vocabulary)
    return map_arrow(encoded.select("doc_id", "ids"), _decoded(vocabulary, pattern), "doc_id long, ids array<int>, decoded binary")


def round_trip_bpe(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", longs: tuple[str, ...] = ()) -> DataFrame:
    """``decode_bpe`` of ``encode_bpe``, with one worker and one codec a task for both: doc_id, ``longs``, ids, decoded.

    ``longs`` names columns of longs that pass through.
    """
    encode, decode = _encoded(vocabulary, pattern), _decoded(vocabulary, pattern)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *longs, F.col(text_col).alias("text"))
    ship_file(docs.sparkSession, vocabulary)
    return map_arrow(rows, lambda batches: decode(encode(batches)), "".join(f"{c} long, " for c in ("doc_id", *longs)) + "ids array<int>, decoded binary")
