"""Language identification by a linear-chain conditional random field over words, so that code-switched texts get a label per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, held_out, mix, slices, table, text_buffers

#: Documents and words that the field is fitted on at most; documents are drawn by a hash of their id.
TRAIN_DOCS = 400
TRAIN_WORDS = 120_000
#: Longer texts are not drawn, so that what comes to the driver is bounded.
TRAIN_CHARS = 100_000
#: Text bytes that are labelled at once: sequences move together, so more of them share a step.
SLICE = 4 << 20
UNKNOWN = "und"
_GRAMS = 1 << 16
_HASHED = 1 << 15
#: Word-level features, each hashed into a table of _HASHED rows: prefixes and suffixes of 2 to 4 bytes, and the word itself (lexicon).
_AFFIXES = ("pre2", "pre3", "pre4", "suf2", "suf3", "suf4", "word")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(49)).astype(np.int64)


class Features:
    """Feature indices of the words of a batch: grams (one per byte and word edge, with the owning word) and affixes (a column each)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets, strip=True)
        b = w.data.astype(np.int64)
        n = w.end - w.start
        # byte bigrams of " word": position p pairs p - 1 and p; a word's first byte pairs with a blank
        self.at = np.repeat(w.start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        self.head = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        before = b[np.maximum(self.at - 1, 0)]
        before[self.head] = 32
        self.bigram = (before << 8) | b[self.at]
        third = b[np.maximum(self.at - 2, 0)]
        third[self.head] = 0
        second = self.head[n > 1] + 1
        third[second] = 32
        self.trigram = (third * 7919 + before * 263 + b[self.at] * 31) & (_GRAMS - 1)
        self.affix = []
        last = len(b) - 1
        for k, name in enumerate(_AFFIXES[:-1]):
            size = int(name[3])
            h = np.full(len(n), k + 1, np.uint64)
            for j in range(size):
                p = w.start + j if name[0] == "p" else w.end - 1 - j
                byte = np.where(j < n, b[np.clip(p, 0, max(last, 0))] if len(b) else 0, 0).astype(np.uint64)
                h = h * np.uint64(0x100000001B3) + byte
            self.affix.append(_bucket(h))
        self.affix.append(_bucket(w.hash))


@dataclass
class Field:
    """labels; weights of bigrams, trigrams and affixes by label; transitions[a, b]: from a to b; start."""

    labels: list[str]
    bigram: np.ndarray
    trigram: np.ndarray
    affix: list[np.ndarray]
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        out = np.zeros((len(f.words.start), len(self.labels)), np.float32)
        if len(out):
            out += np.add.reduceat(self.bigram[f.bigram] + self.trigram[f.trigram], f.head, axis=0)
            for k, table_ in enumerate(self.affix):
                out += table_[f.affix[k]]
        return out

    def posteriors(self, emissions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities of each word by forward-backward, expected transitions, and the log partition function summed over sequences.

        first: bounds of the sequences. All sequences move one word ahead at a time, the longest first, so a step is one small matrix product; steps are scaled to sum 1.
        """
        n, k = emissions.shape
        top = emissions.max(1, keepdims=True) if n else emissions
        e = np.exp(emissions - top)
        trans, start = np.exp(self.transitions), np.exp(self.start)
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        head, length = first[:-1][order], length[order]
        alpha, scale, beta = np.zeros((n, k), np.float32), np.ones(n, np.float32), np.zeros((n, k), np.float32)
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than t
        a = None
        for t in range(longest):
            m = active[t]
            at = head[:m] + t
            a = start * e[at] if t == 0 else (a[:m] @ trans) * e[at]
            s = a.sum(1)
            a = a / s[:, None]
            alpha[at], scale[at] = a, s
        moved = np.zeros((k, k))
        b = np.zeros((0, k), np.float32)
        for t in range(longest - 1, -1, -1):
            m = active[t]
            at = head[:m] + t
            new = np.ones((m, k), np.float32)
            if len(b):
                nxt = at[: len(b)] + 1
                ahead = e[nxt] * b / scale[nxt][:, None]
                new[: len(b)] = ahead @ trans.T
                moved += trans * (alpha[at[: len(b)]].T @ ahead)
            beta[at] = b = new
        return alpha * beta, moved, float(np.log(scale).sum() + top.sum())


def fit(texts: list[str], langs: list[str], rounds: int = 30, rate: float = 0.3, most_words: int = TRAIN_WORDS) -> Field | None:
    """Fits weights and transitions by AdaGrad on the conditional log-likelihood.

    Sequences are runs of one to three lines drawn from different documents, so that the field sees switches inside a sequence and learns how rare they are. Lines are taken until most_words.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(11)
    lines = [(line, labels.index(lang)) for text, lang in zip(texts, langs, strict=True) for line in text.split("\n") if line.strip()]
    lines = [lines[i] for i in rng.permutation(len(lines))]
    size = np.cumsum([line.count(" ") + 1 for line, _ in lines]) if lines else np.zeros(0)
    lines = lines[: int(np.searchsorted(size, most_words)) + 1]
    raw = [line.encode() for line, _ in lines]
    f = Features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    gold = np.array([y for _, y in lines], np.int64)[f.words.doc] if lines else np.zeros(0, np.int64)
    joined = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 4, len(lines)))]).clip(0, len(lines)))
    first = f.words.first[joined]
    k, n = len(labels), len(gold)
    field = Field(labels, *(np.zeros((_GRAMS, k), np.float32) for _ in range(2)), [np.zeros((_HASHED, k), np.float32) for _ in _AFFIXES], np.zeros((k, k)), np.zeros(k))
    if not n:
        return field
    onehot = np.eye(k, dtype=np.float32)[gold]
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(n, bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    owner = np.repeat(np.arange(n), f.words.end - f.words.start)
    parts = [(field.bigram, f.bigram, owner), (field.trigram, f.trigram, owner), *((field.affix[j], f.affix[j], None) for j in range(len(_AFFIXES)))]
    grown = [np.full_like(p, 1e-3) for p, _, _ in parts] + [np.full((k, k), 1e-3), np.full(k, 1e-3)]
    for _ in range(rounds):
        p, moved, _ = field.posteriors(field.emissions(f), first)
        slope = (onehot - p).astype(np.float64)
        for g, (weights, index, of) in zip(grown, parts, strict=False):
            each = slope if of is None else slope[of]
            d = np.column_stack([np.bincount(index, each[:, j], len(weights)) for j in range(k)]) / n * 100 - 1e-3 * weights
            g += d**2
            weights += (rate * d / np.sqrt(g)).astype(np.float32)
        d = (seen - moved) / n * 100 - 1e-3 * field.transitions
        grown[-2] += d**2
        field.transitions += rate * d / np.sqrt(grown[-2])
        d = (onehot[heads] - p[heads]).sum(0) / n * 100
        grown[-1] += d**2
        field.start += rate * d / np.sqrt(grown[-1])
    return field


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, words: int = TRAIN_WORDS) -> Field | None:
    """Draws at most docs documents of at most TRAIN_CHARS code points with a language outside the held-out fifth, by a hash of the id, and fits on at most words of their words. None if there are none."""
    ids = documents.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) <= TRAIN_CHARS) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"))
    drawn = ids.orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit("language")), "_id").limit(docs)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).join(F.broadcast(drawn.distinct()), "_id").where(F.col("_lang").isNotNull() & (F.char_length("_text") <= TRAIN_CHARS))
    found = rows.orderBy("_id", "_lang", "_text").limit(docs).toPandas()
    return fit(found["_text"].tolist(), found["_lang"].tolist(), most_words=words)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(df: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score: the label with the highest mean word probability over the whole text.

    A text that is null or has no letter gets "und" with score 0, as every text does if nothing was learned. Repeated rows are predicted each; other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                data, offsets = text_buffers(batch.column(text_col))
                n = batch.num_rows
                best, score = np.full(n, -1), np.zeros(n)
                if field is not None and len(data):
                    f = Features(data, offsets)
                    p, _, _ = field.posteriors(field.emissions(f), f.words.first)
                    size = np.diff(f.words.first)
                    some = size > 0
                    if some.any():
                        mean = np.add.reduceat(p, f.words.first[:-1][some], axis=0) / size[some][:, None]
                        best[some], score[some] = mean.argmax(1), mean.max(1).clip(0, 1)
                    letters = np.zeros(n, bool)  # ASCII letters tell at once; only texts without any are looked at further
                    is_letter = ((f.words.data >= 97) & (f.words.data <= 122)).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(is_letter)])
                    letters = total[offsets[1:]] > total[offsets[:-1]]
                    for i in np.flatnonzero(~letters & some):
                        letters[i] = _has_letter(batch.column(text_col)[int(i)].as_py())
                    best[~letters], score[~letters] = -1, 0.0
                names = pa.array([UNKNOWN if x < 0 else field.labels[x] for x in best], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(id_col), names, pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def label_words(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words of one language: id, run, start and end (bytes of the UTF-8 text), words, lang, score (mean probability). Texts without a word give no rows."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                f = Features(*text_buffers(batch.column(text_col)))
                w = f.words
                p, _, _ = field.posteriors(field.emissions(f), w.first)
                label = p.argmax(1)
                head = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])])) if len(label) else np.zeros(0, np.int64)
                tail = np.concatenate([head[1:], [len(label)]]).astype(np.int64) - 1 if len(head) else head
                doc = w.doc[head]
                base = text_buffers(batch.column(text_col))[1][doc]
                size = tail - head + 1
                score = np.add.reduceat(p[np.arange(len(p)), label], head) / size if len(head) else np.zeros(0)
                nth = np.arange(len(head)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (nth, w.start[head] - base, w.end[tail] - base, size)), pa.array([field.labels[x] for x in label[head]], pa.string()), pa.array(score.astype(np.float64))],
                    names=[id_col, "run", "start", "end", "words", "lang", "score"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, run long, start long, end long, words long, lang string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, train(documents))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
