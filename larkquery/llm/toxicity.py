"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is its words, lower-cased.  Each word enters as two vectors: an embedding of the word (hashed) and the
elementwise maximum of embeddings of its character n-grams (hashed, with word boundaries).  Windows of ``WINDOW``
words, each overlapping the next by half, run through a gated recurrent unit in both directions; attention pools
the states and a logistic layer scores the window.  A document's score is its highest window: one passage suffices.

The network is fitted on a bounded sample of labelled rows: at most about ``per_class`` documents of each label in
expectation, whatever their length; of a document of more than ``most_windows`` windows (about 4,000 words) so many
are learned from, spread over the whole text.  Scoring reads every window of every whole text.  The part of the
network before the recurrence depends on the word alone and is memoised per distinct word.

Defined cases: null texts and texts without words score 0; without a positive or without a negative row to learn
from every score is 0; labels that are null or whose document is missing are not learned from, and repeated
labels of a document count once (the largest); null ids are scored and never learned from; repeated rows score
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, map_arrow, slices

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
EMBED, HIDDEN, ATTEND = 8, 8, 8
GRAMS = (3, 4, 5)
#: Words a worker memoises before it starts anew; bounds its memory, not the result.
MEMO_WORDS = 150_000

_edges = re.compile(r"^\W+|\W+$")


def word_key(chunk: str) -> str:
    """A chunk between blanks as the network reads it."""
    return _edges.sub("", chunk.lower())


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' n-grams, how many of them each word has); words are marked at both ends."""
    marked = [f"<{w}>".encode("utf-8") for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    ends = np.cumsum(sizes)
    left = ends[owner] - np.arange(len(data))  # bytes up to the end of the word
    found, owners = [], []
    for n in (2, *GRAMS):
        at = np.flatnonzero(left >= n if n > 2 else (sizes[owner] == 2) & (left == 2))
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        found.append(h % np.uint32(GRAM_BUCKETS))
        owners.append(owner[at])
    by = np.concatenate(owners)
    order = np.argsort(by, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(by, minlength=len(words))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class WordTable:
    """Numbers distinct words; row 0 is padding.  The hashed inputs of new rows wait until they are taken."""

    def __init__(self):
        self.rows: dict[str, int] = {"": 0}
        self.waiting = [""]

    def __len__(self) -> int:
        return len(self.rows)

    def ids(self, text: str) -> np.ndarray:
        chunks, rows = text.split(), self.rows
        for c in set(chunks).difference(rows):
            rows[c] = len(rows)
            self.waiting.append(c)
        return np.fromiter(map(rows.__getitem__, chunks), np.int32, len(chunks))

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows since the last call: word bucket, n-gram buckets of all, and how many each has."""
        keys = list(map(word_key, self.waiting))
        self.waiting = []
        word = np.fromiter((zlib.crc32(k.encode("utf-8")) % WORD_BUCKETS for k in keys), np.int64, len(keys))
        return word, *gram_buckets(keys)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text, padded with 0."""
    k = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.zeros(STRIDE * (k - 1) + WINDOW, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def fresh_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * EMBED, HIDDEN
    p = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, EMBED)), "gram": rng.normal(0, 0.1, (GRAM_BUCKETS, EMBED))}
    for way in "fb":
        p |= {f"W{way}": rng.normal(0, d**-0.5, (d, 3 * h)), f"U{way}": rng.normal(0, h**-0.5, (h, 3 * h)), f"b{way}": np.zeros(3 * h)}
    p |= {"A": rng.normal(0, (2 * h) ** -0.5, (2 * h, ATTEND)), "a": np.zeros(ATTEND), "v": rng.normal(0, 0.3, ATTEND), "out": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def recur(x: np.ndarray, mask: np.ndarray, U: np.ndarray, backwards: bool, keep: bool = False):
    """States (B, T, H) of one direction.  x: the inputs' share of the gates; padding leaves the state as it is."""
    n, t, h = len(x), x.shape[1], HIDDEN
    state, states, tape = np.zeros((n, h), np.float32), np.empty((n, t, h), np.float32), {}
    for i in range(t - 1, -1, -1) if backwards else range(t):
        u = state @ U
        zr = _sigmoid(x[:, i, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(x[:, i, 2 * h :] + r * u[:, 2 * h :])
        if keep:
            tape[i] = (state, z, r, new, u[:, 2 * h :])
        state = np.where(mask[:, i, None], new + z * (state - new), state)
        states[:, i] = state
    return states, tape


def recur_back(d_states: np.ndarray, tape: dict, mask: np.ndarray, U: np.ndarray, backwards: bool):
    """Gradients of the inputs' share of the gates and of U."""
    n, t, h = d_states.shape
    dx, dU, dh = np.zeros((n, t, 3 * h), np.float32), np.zeros_like(U), np.zeros((n, h), np.float32)
    for i in range(t) if backwards else range(t - 1, -1, -1):
        before, z, r, new, un = tape[i]
        on = mask[:, i, None]
        d = dh + d_states[:, i]
        dn = d * (1 - z) * (1 - new**2) * on
        dz = d * (before - new) * z * (1 - z) * on
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r], 1)
        dx[:, i] = np.concatenate([dz, dr, dn], 1)
        dU += before.T @ du
        dh = np.where(on, d * z, d) + du @ U.T
    return dx, dU


def pooled(states: np.ndarray, mask: np.ndarray, p: dict):
    """(logits, what the backward pass needs)."""
    u = np.tanh(states @ p["A"] + p["a"])
    s = np.where(mask, u @ p["v"], -1e9)
    w = np.exp(s - s.max(1, keepdims=True)) * mask
    w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
    c = np.matmul(w[:, None], states)[:, 0]
    return c @ p["out"] + p["c"], (u, w, c)


def logits_of(windows: np.ndarray, gates: np.ndarray, p: dict) -> np.ndarray:
    """gates: per word the inputs' share of the gates of both directions (6 * HIDDEN)."""
    out, h = np.empty(len(windows), np.float32), 3 * HIDDEN
    for i in range(0, len(windows), 1024):
        w = windows[i : i + 1024]
        mask, x = w > 0, gates[w]
        states = np.concatenate([recur(x[:, :, :h], mask, p["Uf"], False)[0], recur(x[:, :, h:], mask, p["Ub"], True)[0]], 2)
        out[i : i + 1024] = pooled(states, mask, p)[0]
    return out


def word_gates(p: dict, taken: tuple) -> np.ndarray:
    """Per word, its share of the gates of both directions."""
    word, flat, counts = taken
    top = np.maximum.reduceat(p["gram"][known(p, "gram", flat)], np.cumsum([0, *counts])[:-1], axis=0)
    x = np.concatenate([p["word"][known(p, "word", word)], top], 1)
    return np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1).astype(np.float32)


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weight: np.ndarray):
    """Loss and gradients for windows whose word inputs are x (B, T, 2 * EMBED); "x": the inputs' gradient."""
    tapes, states = {}, []
    for way, back in (("f", False), ("b", True)):
        s, tapes[way] = recur(x @ p[f"W{way}"] + p[f"b{way}"], mask, p[f"U{way}"], back, keep=True)
        states.append(s)
    hs = np.concatenate(states, 2)
    logit, (u, w, c) = pooled(hs, mask, p)
    q = _sigmoid(logit)
    loss = float(-(weight * np.where(labels == 1, np.log(q + 1e-9), np.log(1 - q + 1e-9))).sum())
    d = ((q - labels) * weight).astype(np.float32)
    g = {"out": c.T @ d, "c": d.sum(keepdims=True)}
    dc = d[:, None] * p["out"]
    dw = np.matmul(hs, dc[:, :, None])[:, :, 0]
    ds = w * (dw - (w * dw).sum(1, keepdims=True))
    g["v"] = np.einsum("bt,bta->a", ds, u)
    du = ds[:, :, None] * p["v"] * (1 - u**2)
    g["A"], g["a"] = np.einsum("bth,bta->ha", hs, du), du.sum((0, 1))
    dhs = w[:, :, None] * dc[:, None] + du @ p["A"].T
    g["x"] = 0
    for i, (way, back) in enumerate((("f", False), ("b", True))):
        dx, g[f"U{way}"] = recur_back(dhs[:, :, i * HIDDEN : (i + 1) * HIDDEN], tapes[way], mask, p[f"U{way}"], back)
        g[f"W{way}"], g[f"b{way}"] = np.einsum("btd,bth->dh", x, dx), dx.sum((0, 1))
        g["x"] = g["x"] + dx @ p[f"W{way}"].T
    return loss, g


def start_embeddings(cut: list[np.ndarray], y: np.ndarray, taken: tuple, p: dict, min_docs: int, evidence: bool = True) -> None:
    """Set known_word and known_gram, and the first component of each embedding.

    Known is what at least ``min_docs`` texts hold; all else shares bucket 0.  The first component starts from the
    evidence of the label: the lower end (two standard errors) of the log-odds, where that is positive.  Without
    ``evidence`` it starts at random like the others.
    """
    word, flat, counts = taken
    ends = np.cumsum(counts)
    df_word, df_gram = np.zeros((2, WORD_BUCKETS)), np.zeros((2, GRAM_BUCKETS))
    for windows, label in zip(cut, y, strict=True):
        rows = np.unique(windows)
        df_word[label, np.unique(word[rows])] += 1
        df_gram[label, np.unique(np.concatenate([flat[ends[r] - counts[r] : ends[r]] for r in rows]))] += 1
    for what, df in (("word", df_word), ("gram", df_gram)):
        seen = df.sum(0) >= min_docs
        seen[0] = False
        odds = np.log((df[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((df[0] + 0.5) / ((y == 0).sum() + 1))
        sure = odds - 2 * np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
        p[f"known_{what}"] = seen.astype(np.float32)
        if evidence:
            p[what][:, 0] = np.where(seen, np.maximum(sure, 0), 0)


def known(p: dict, what: str, ids) -> np.ndarray:
    ids = np.asarray(ids, np.int64)
    return np.where(p[f"known_{what}"][ids] > 0, ids, 0)


def _sampled(most_windows: int):
    """Labelled texts in pieces: the whole text, or where it has too many windows, that many of them."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                pieces = []
                for text in batch.column("text").to_pylist():
                    words = text.split()
                    k = max(1, -(-(len(words) - WINDOW) // STRIDE) + 1)
                    if k <= most_windows:
                        pieces.append([text])
                    else:
                        pieces.append([" ".join(words[STRIDE * i : STRIDE * i + WINDOW]) for i in np.linspace(0, k - 1, most_windows).astype(int).tolist()])
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("h"), pa.array(pieces, pa.list_(pa.string()))], names=["y", "h", "pieces"])

    return run


def train_network(texts: list[list[str]], labels: list[int], steps: int = 300, batch: int = 48, rate: float = 0.01, decay: float = 0.02, min_docs: int = 3, seed: int = 11, evidence: bool = True) -> dict[str, np.ndarray]:
    """``texts`` are lists of pieces.  Adam with decaying embeddings; of each document the highest windows (two at most) learn its label."""
    rng, table, p = np.random.default_rng(seed), WordTable(), fresh_weights(seed)
    y = np.array(labels)
    cut = [np.concatenate([windows_of(table.ids(t)) for t in pieces]) for pieces in texts]
    word, flat, counts = taken = table.take()
    start_embeddings(cut, y, taken, p, min_docs, evidence)
    starts = np.cumsum(counts) - counts
    flat, word = known(p, "gram", flat), known(p, "word", word)
    learnt = [k for k in p if not k.startswith("known")]
    m, v, step = {k: np.zeros_like(p[k]) for k in learnt}, {k: np.zeros_like(p[k]) for k in learnt}, 0
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    while step < steps:  # as many of either label in an epoch
        each = max(map(len, sides))
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(s), each) for s in sides]))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            windows = np.concatenate([cut[i] for i in pick])
            ends = np.cumsum([0, *(len(cut[i]) for i in pick)])
            used, local = np.unique(windows, return_inverse=True)
            local = local.reshape(windows.shape)
            gram_rows = np.concatenate([np.arange(starts[w], starts[w] + counts[w]) for w in used])
            local_starts = np.cumsum([0, *counts[used]])[:-1]
            vectors = p["gram"][flat[gram_rows]]
            top = np.maximum.reduceat(vectors, local_starts, axis=0)
            x = np.concatenate([p["word"][word[used]], top], 1)
            gates = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1)
            mask = windows > 0
            h = 3 * HIDDEN
            xs = gates[local]
            hs = np.concatenate([recur(xs[:, :, :h], mask, p["Uf"], False)[0], recur(xs[:, :, h:], mask, p["Ub"], True)[0]], 2)
            logit = pooled(hs, mask, p)[0]
            chosen, target, weight = [], [], []
            for k, i in enumerate(pick):
                best = np.argsort(-logit[ends[k] : ends[k + 1]])[: 2 if y[i] == 0 else 1] + ends[k]
                chosen += best.tolist()
                target += [y[i]] * len(best)
                weight += [1 / len(best) / len(pick)] * len(best)
            rows = local[chosen]
            _, g = gradients(p, x[rows], mask[chosen], np.array(target, np.float32), np.array(weight, np.float32))
            dx = np.zeros_like(x)
            np.add.at(dx, rows, g.pop("x") * mask[chosen][:, :, None])
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], word[used], dx[:, :EMBED])
            owner = np.repeat(np.arange(len(used)), counts[used])
            hit = (vectors == top[owner]) * dx[owner, EMBED:]
            g["gram"] = np.zeros_like(p["gram"])
            np.add.at(g["gram"], flat[gram_rows], hit)
            step += 1
            for k in learnt:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                if k in ("word", "gram"):  # what few documents hold is forgotten again
                    p[k] *= 1 - rate * decay
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


@dataclass
class Scorer:
    """A worker's network with its memo of words."""

    weights: dict[str, np.ndarray]
    table: WordTable = field(default_factory=WordTable)
    gates: np.ndarray | None = None

    def windows(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.table) > MEMO_WORDS:
            self.table, self.gates = WordTable(), None
        return [windows_of(self.table.ids(t or "")) for t in texts]

    def window_scores(self, windows: np.ndarray) -> np.ndarray:
        if self.table.waiting:
            new = word_gates(self.weights, self.table.take())
            self.gates = new if self.gates is None else np.concatenate([self.gates, new])
        return _sigmoid(logits_of(windows, self.gates, self.weights))

    def scores(self, texts: list[str | None]) -> list[float]:
        cut = self.windows(texts)
        ends = np.cumsum([0, *map(len, cut)])
        best = np.maximum.reduceat(self.window_scores(np.concatenate(cut)), ends[:-1])
        return [float(b) if w[0, 0] else 0.0 for b, w in zip(best, cut, strict=True)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1000, most_windows: int = 256, held_out: tuple[int, int] = (4, 2), **training):
    """Weights, or None without rows of both labels; ``training`` goes to ``train_network``."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL").where(~is_held_out("id", *held_out)).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    limits = {0: 1.5 * per_class, 1: per_class}
    share = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, limits[k] * 2 / n))) for k, n in counts.items()])
    drawn = marks.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sampled = map_arrow(texts.join(F.broadcast(drawn), "id").select("y", F.xxhash64("id").alias("h"), "text"), _sampled(most_windows), "y int, h long, pieces array<string>")
    rows = sampled.orderBy("h", "pieces").limit(int(4 * sum(limits.values()))).collect()
    chosen: dict[int, list[list[str]]] = {0: [], 1: []}
    for r in rows:
        if len(chosen[r["y"]]) < limits[r["y"]]:
            chosen[r["y"]].append(r["pieces"])
    if not chosen[0] or not chosen[1]:
        return None
    return train_network(chosen[0] + chosen[1], [0] * len(chosen[0]) + [1] * len(chosen[1]), **training)


def score_toxicity(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""

    def run(batches):
        scorer = None if weights is None else Scorer(weights)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                scores = scorer.scores(texts) if scorer else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: tuple[int, int] = (4, 2), **fit) -> DataFrame:
    """Fit on labels that are not held out, then per document: doc_id, held_out, score, predicted."""
    weights = fit_toxicity(docs, labels, held_out=held_out, **fit)
    out = score_toxicity(docs, weights)
    return out.select("doc_id", is_held_out("doc_id", *held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
