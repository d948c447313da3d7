"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays that numpy walks for all rows and trees at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, held_out, slices, table, text_buffers

#: Labelled rows that the trees are fitted on at most, drawn by a hash of their id.
TRAIN_ROWS = 16_000
CUTOFF = 0.3

STATISTICS = [
    "bytes", "words", "word_bytes", "word_bytes_sd", "upper", "digits", "exclamations", "symbols", "bars", "marks", "non_ascii", "lines", "line_bytes",
    "distinct_words", "adjacent_repeats", "distinct_trigrams", "top_word", "short_words", "repeated_lines", "blank",
]

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 digit, 3 !, 4 symbol, 5 |, 6 other mark, 7 beyond ASCII, 8 newline, 9 space
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[33] = 3
_CLASS[list(b"#*$%&<>@^~_={}[]\\/+")] = 4
_CLASS[124] = 5
_CLASS[list(b".,;:?'\"()-")] = 6
_CLASS[128:] = 7
_CLASS[10] = 8
_CLASS[[9, 11, 12, 13, 32]] = 9


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and how often its most frequent key occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    runs = np.diff(np.concatenate([head, [len(k)]]))
    most = np.zeros(n)
    np.maximum.at(most, d[head], runs)
    return np.bincount(d[head], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; texts are taken whole, an empty one gives zeros."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    size = np.diff(offsets).astype(float)
    w = Words(data, offsets)
    n_words = np.diff(w.first).astype(float)
    length = (w.end - w.start).astype(float)
    per = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    mean = per(np.bincount(w.doc, length, n), n_words)
    sd = np.sqrt(np.maximum(0, per(np.bincount(w.doc, length**2, n), n_words) - mean**2))
    same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    distinct, top = _distinct(w.doc, w.hash, n)
    tri = w.hash[:-2] * np.uint64(3) + w.hash[1:-1] * np.uint64(5) + w.hash[2:] * np.uint64(7)
    inside = w.doc[2:] == w.doc[:-2] if len(w.doc) > 2 else np.zeros(0, bool)
    tri, tri_doc = (tri[inside], w.doc[2:][inside]) if len(w.doc) > 2 else (w.hash[:0], w.doc[:0])
    distinct_tri, _ = _distinct(tri_doc, tri, n)
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    # a line's hash: the sum of its words' hashes by their place
    line_hash = np.zeros(len(line_start), np.uint64)
    if len(w.start) and len(line_start):
        at = np.searchsorted(line_start, w.start, side="right") - 1
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        place = (np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))).astype(np.uint64)
        line_hash[at[head]] = np.add.reduceat(w.hash * (place * np.uint64(2) + np.uint64(1)), head)
    filled = line_hash != 0
    lines = np.bincount(line_doc[filled], minlength=n).astype(float)
    distinct_lines, _ = _distinct(line_doc[filled], line_hash[filled], n)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), mean, sd, per(counts[:, 1], size), per(counts[:, 2], size), per(counts[:, 3], size), per(counts[:, 4], size), per(counts[:, 5], size),
        per(counts[:, 6], size), per(counts[:, 7], size), np.log1p(lines), per(size, lines), per(distinct, n_words), per(np.bincount(w.doc[1:][same], minlength=n).astype(float), n_words),
        per(distinct_tri, n_words), per(top, n_words), per(np.bincount(w.doc[length <= 3], minlength=n).astype(float), n_words), per(lines - distinct_lines, lines), per(counts[:, 8] + counts[:, 9], size),
    ])


class Trees:
    """Trees as flat arrays: feature (-1: leaf), threshold, left child (right is the next one), value; roots: the first node of each tree."""

    def __init__(self, base: float, feature, threshold, left, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.left, self.value, self.roots = (np.asarray(x) for x in (feature, threshold, left, value, roots))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; walks all rows and trees one level at a time."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.repeat(self.roots[None, :], len(part), 0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                right = part[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            out[at : at + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Boosts trees of logistic loss on histograms of gradients. Without rows, or with one label only, the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])  # code <= k: x <= edges[k]
        score = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            for x_ in (feature, threshold, left, value):
                x_.append(-1 if x_ is feature else 0)
            nodes = [(roots[-1], np.arange(len(y)))]
            for level in range(depth + 1):
                below = []
                for node, rows in nodes:
                    G, H = g[rows].sum(), h[rows].sum()
                    best = (1e-3, 0, 0)
                    if level < depth and H >= 2 * least / 4:
                        for j, e in enumerate(edges):
                            if not len(e):
                                continue
                            c = code[rows, j]
                            gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                            hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                            gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                            gain[(hl < least / 8) | (H - hl < least / 8)] = 0
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (float(gain[k]), j, k)
                    if best[0] <= 1e-3:
                        value[node] = float(-rate * G / (H + ridge))
                        score[rows] += value[node]
                        continue
                    _, j, k = best
                    feature[node], threshold[node], left[node] = j, float(edges[j][k]), len(feature)
                    for x_ in (feature, threshold, left, value):
                        x_ += [-1 if x_ is feature else 0] * 2
                    goes = code[rows, j] > k
                    below += [(left[node], rows[~goes]), (left[node] + 1, rows[goes])]
                nodes = below
    return Trees(base, feature, threshold, left, value, roots, depth) if roots else Trees(base, [-1], [0.0], [0], [0.0], [0], 0)


def _stat_rows(df: DataFrame, id_col: str, text_col: str, keep: list[str], model: Trees | None) -> DataFrame:
    """keep columns of df, with the statistics (no model) or the score."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                x = statistics(*text_buffers(batch.column(text_col)))
                more = [("score", pa.array(model.predict(x)))] if model else [(s, pa.array(x[:, j])) for j, s in enumerate(STATISTICS)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(a for _, a in more)], names=[*keep, *(c for c, _ in more)])

    names = ["score"] if model else STATISTICS
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{s}` double" for s in names])
    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fits on at most `rows` labelled documents outside the held-out fifth, drawn by a hash of the id, so the same ones whatever the partitions.

    The drawn ids and labels are a few hundred KB at that bound and are broadcast; documents are read once and only their statistics come back. Null labels are left out, repeated ones averaged.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("_label"))
    drawn = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(rows)
    seen = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    found = _stat_rows(seen, "_id", "_text", ["_id", "_label"], None).orderBy("_id", *STATISTICS).limit(rows).toPandas()
    return fit(found[STATISTICS].to_numpy(float), found["_label"].to_numpy(float))


def score(documents: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score to each document, in the scan itself: no shuffle. A null or empty text gets the score of zero statistics; repeated rows get equal scores."""
    return _stat_rows(documents, id_col, text_col, keep or [id_col], model)


def keep_good(documents: DataFrame, model: Trees, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The documents of a score of cutoff or more, with all their columns; judged in the scan."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(model.predict(statistics(*text_buffers(batch.column(text_col)))) >= cutoff))

    return documents.mapInArrow(run, documents.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    found = score(documents, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
