"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum in the
window, and a softmax layer names the language.  A text's prediction is the mean over all its windows, weighted by
their bytes.  The network is fitted on a bounded sample of labelled rows (``per_lang`` documents of each language
in expectation, ``windows_per_doc`` windows of each, spread over the whole text), so training costs the same at any
corpus size; only windows, never texts, reach the driver.

For scoring, embedding and filters fold into two tables over byte pairs, so that a window costs two lookups and an
addition for each byte.

Defined cases: ``und`` with score 0 for null texts, texts without a letter, and where no labelled row is left to
learn from; a table with one language predicts that one; null ids count as rows to learn from; repeated rows are
predicted alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, map_arrow, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: More labels than this are no languages; the labels are read to the driver.
MOST_LANGS = 1000


@dataclass
class ByteCnn:
    langs: list[str]
    weights: dict[str, np.ndarray]
    tables: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "tables": None}

    def _tables(self):
        """(first pair, second pair): the filters' sums over bytes 0-1 and 2-3 for each pair of bytes."""
        if self.tables is None:
            p = self.weights
            part = {(w, k): p["E"] @ p[f"W{w}"][k * EMBED : (k + 1) * EMBED] for w in WIDTHS for k in range(w)}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
            none = np.zeros_like(part[2, 0])
            first = np.concatenate([pair(part[w, 0], part[w, 1]) for w in WIDTHS], 1)
            second = np.concatenate([pair(part[3, 2], none), pair(part[4, 2], part[4, 3])], 1)
            self.tables = first.astype(np.float32), second.astype(np.float32)
        return self.tables

    def window_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, WINDOW) bytes, padded with zeros."""
        first, second = self._tables()
        p, out = self.weights, []
        bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        for i in range(0, len(windows), 256):
            x = windows[i : i + 256].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            z = first[pairs[:, :-2]]
            z[:, :, FILTERS:] += second[pairs[:, 2:]]
            h = np.maximum(z.max(1) + bias, 0)
            s = h @ p["V"] + p["c"]
            e = np.exp(s - s.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
        return np.concatenate(out)


def cut_windows(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fresh_weights(n_langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"E": rng.normal(0, 0.5, (256, EMBED))}
    for w in WIDTHS:
        p[f"W{w}"], p[f"b{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p["V"], p["c"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_langs)), np.zeros(n_langs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of windows x (n, WINDOW) with labels y, and its gradients."""
    n, e, last = len(x), p["E"][x], WINDOW - max(WIDTHS) + 1
    tops, hs = {}, []
    for w in WIDTHS:
        z = np.concatenate([e[:, k : k + last] for k in range(w)], 2) @ p[f"W{w}"]
        tops[w] = top = z.argmax(1)
        hs.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + p[f"b{w}"])
    pre = np.concatenate(hs, 1)
    h = np.maximum(pre, 0)
    s = h @ p["V"] + p["c"]
    q = np.exp(s - s.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    loss = float(-np.log(q[np.arange(n), y] + 1e-30).mean())
    q[np.arange(n), y] -= 1
    q /= n
    g = {"V": h.T @ q, "c": q.sum(0), "E": np.zeros_like(p["E"])}
    dh = (q @ p["V"].T) * (pre > 0)
    rows = np.arange(n)[:, None]
    for i, w in enumerate(WIDTHS):  # only the maximal position of each filter has a gradient
        d, top = dh[:, i * FILTERS : (i + 1) * FILTERS], tops[w]
        g[f"b{w}"], g[f"W{w}"] = d.sum(0), np.zeros_like(p[f"W{w}"])
        for k in range(w):
            byte = x[rows, top + k]
            block = slice(k * EMBED, (k + 1) * EMBED)
            g[f"W{w}"][block] = np.einsum("nfe,nf->ef", p["E"][byte], d)
            np.add.at(g["E"], byte, d[:, :, None] * p[f"W{w}"][block].T[None])
    return loss, g


def train_cnn(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the cross-entropy of single windows."""
    rng = np.random.default_rng(seed)
    p = fresh_weights(len(langs), rng)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            _, g = gradients(p, windows[pick].astype(np.int64), labels[pick])
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(langs, p)


def _spread(windows_per_doc: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                langs, found = [], []
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    w = cut_windows(text)
                    for i in sorted(set(np.linspace(0, len(w) - 1, windows_per_doc).astype(int).tolist())):
                        langs.append(lang)
                        found.append(w[i].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "bytes"])

    return run


def fit_langid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, windows_per_doc: int = 8, held_out: tuple[int, int] = (3, 1)) -> ByteCnn | None:
    """A network from labelled rows that are not held out; None if there are none."""
    rows = docs.where(~is_held_out(id_col, *held_out)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in counts.items()])
    # by id and text, so that rows without an id are not all drawn together
    drawn = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("langid"), F.when(F.col("id").isNull(), F.col("text"))), F.lit(1 << 20)) < share * (1 << 20))
    sample = map_arrow(drawn.select("lang", "text"), _spread(windows_per_doc), "lang string, bytes binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], bytes(r["bytes"])))
    langs = sorted({r["lang"] for r in sample})
    windows = np.frombuffer(b"".join(bytes(r["bytes"]) for r in sample), np.uint8).reshape(-1, WINDOW)
    return train_cnn(windows, np.array([langs.index(r["lang"]) for r in sample]), langs)


def predict_texts(texts: list[str | None], model: ByteCnn | None) -> tuple[list[str], list[float]]:
    """(languages, scores) of a batch of texts."""
    some = [i for i, t in enumerate(texts) if t and model is not None and _letter()(t)]
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if some:
        cut = [cut_windows(texts[i].encode("utf-8")) for i in some]
        windows = np.concatenate(cut)
        weighted = model.window_probabilities(windows) * (windows != 0).sum(1, keepdims=True)
        total = np.add.reduceat(weighted, np.cumsum([0, *map(len, cut)])[:-1], axis=0)
        total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
        for i, k, row in zip(some, total.argmax(1), total, strict=True):
            pred[i], score[i] = model.langs[k], min(1.0, float(row[k]))
    return pred, score


@cache
def _letter():
    import regex

    return regex.compile(r"\p{L}").search


def predict_langid(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                pred, score = predict_texts(batch.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteCnn | None, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that have a language (not ``und``) of at least this score; no shuffle.

    Without a model nothing names a language or a score: only null texts and texts without a letter go.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                if model is None:
                    yield batch.filter(pa.array([bool(t and _letter()(t)) for t in batch.column(text_col).to_pylist()], pa.bool_()))
                    continue
                pred, score = predict_texts(batch.column(text_col).to_pylist(), model)
                yield batch.filter(pa.array([p != "und" and s >= least_score for p, s in zip(pred, score, strict=True)]))

    return map_arrow(docs, run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (3, 1), **fit) -> DataFrame:
    """Fit on the labelled rows that are not held out, then per document: doc_id, held_out, lang_pred, score."""
    model = fit_langid(docs, id_col, text_col, lang_col, held_out=held_out, **fit)
    out = predict_langid(docs, model, id_col, text_col)
    return out.select("doc_id", is_held_out("doc_id", *held_out).alias("held_out"), "lang_pred", "score")
