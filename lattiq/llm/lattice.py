"""Likelihood of texts under a subword vocabulary: an existing list of pieces spells every word in many ways, and a forward recursion in log space sums up all of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, Written, slices, small_batches, table, text_buffers

#: Rounds in which the pieces' probabilities are fitted to the words of the corpus.
ROUNDS = 2
#: Added to every piece's expected count, so that no piece is impossible.
ADDED = 0.1
#: A word that makes up this share of all tokens or more is looked up in every task; there can be no more than 1 / share of them, at 24 bytes each. All others meet their counts in a join.
FREQUENT = 1 / (1 << 20)
#: Bytes of words that are spelled together, and of a single word that are looked at together.
TOGETHER = 1 << 18
#: Bytes of text whose words are counted together.
COUNTED = 4 << 20
LN10 = float(np.log(10))


@dataclass
class Pieces:
    """A vocabulary as a trie: edge keys (state * 256 + byte, ascending), the state each leads to, and for each state its piece or -1. weight: the pieces' probabilities to begin with."""

    keys: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    longest: int


def pieces(words: dict[bytes, float]) -> Pieces:
    """Trie of byte strings with their weights. All 256 bytes are pieces too, so every text can be spelled; those not listed weigh as little as the least piece."""
    words = {w: float(x) for w, x in words.items() if w}
    least = min(words.values(), default=1.0)
    words |= {bytes([b]): least for b in range(256) if bytes([b]) not in words}
    edges: dict[int, int] = {}
    piece = [-1]
    listed = sorted(words)
    for k, word in enumerate(listed):
        state = 0
        for b in word:
            key = state * 256 + b
            if key not in edges:
                edges[key] = len(piece)
                piece.append(-1)
            state = edges[key]
        piece[state] = k
    keys = np.array(sorted(edges), np.int64)
    weight = np.array([words[w] for w in listed])
    return Pieces(keys, np.array([edges[int(k)] for k in keys], np.int32), np.array(piece, np.int32), weight / weight.sum(), max(map(len, listed)))


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model and its scores. A word begin is a space here. A model's scores that are ranks (0, -1, -2, ...) and not logarithms weigh by Zipf's law; they only start the fit."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        word = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in word[1:]:
            scores[word] = max(scores.get(word, -np.inf), model.get_score(i))
    ranks = min(scores.values(), default=0) < -1000
    return pieces({w: 1 / (2 + abs(s)) if ranks else float(np.exp(s)) for w, s in scores.items()})


def _matches(vocabulary: Pieces, data: np.ndarray, left: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every piece that stands in data at one of starts: (start, length, piece). left: bytes from each start to the end of its word. All starts walk down the trie at once."""
    at, state = starts, np.zeros(len(starts), np.int64)
    out = []
    for n in range(1, vocabulary.longest + 1):
        more = left >= n
        at, state, left = at[more], state[more], left[more]
        if not len(at):
            break
        key = state * 256 + data[at + n - 1]
        k = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
        there = vocabulary.keys[k] == key
        at, state, left = at[there], vocabulary.to[k[there]].astype(np.int64), left[there]
        found = vocabulary.piece[state]
        hit = found >= 0
        out.append((at[hit], np.full(int(hit.sum()), n, np.int64), found[hit]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _steps(key: np.ndarray, node: np.ndarray):
    """Runs of equal key in ascending order: (rows of the run ordered by node, where each node's rows begin)."""
    order = np.lexsort((node, key))
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield rows, np.concatenate([[0], np.flatnonzero(np.diff(node[rows])) + 1])


def spell(vocabulary: Pieces, log_p: np.ndarray, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each word's probability, summed over all its spellings by pieces.

    data, offsets: the words' bytes one after another. With counts, each piece's expected number of uses (by forward and backward sums, times the word's count) is added to expected.
    Words are taken together by place: the recursion goes from byte to byte of all of them at once.
    """
    length = np.diff(offsets)
    nodes = offsets[:-1] + np.arange(len(length))  # a word of n bytes has n + 1 nodes
    word = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(data)) - offsets[:-1][word]
    start, n, piece = _matches(vocabulary, data, length[word] - inside, np.arange(len(data)))
    a = nodes[word[start]] + inside[start]
    b, lp = a + n, log_p[piece]
    alpha = np.full(len(data) + len(length), -np.inf)
    alpha[nodes] = 0
    for rows, first in _steps(inside[start] + n, b):
        alpha[b[rows[first]]] = np.logaddexp.reduceat(alpha[a[rows]] + lp[rows], first)
    total = alpha[nodes + length]
    if counts is not None:
        beta = np.full(len(alpha), -np.inf)
        beta[nodes + length] = 0
        for rows, first in _steps(-inside[start], a):
            beta[a[rows[first]]] = np.logaddexp.reduceat(beta[b[rows]] + lp[rows], first)
        w = word[start]
        expected += np.bincount(piece, np.exp(alpha[a] + lp + beta[b] - total[w]) * counts[w], len(expected))
    return total


def spell_long(vocabulary: Pieces, log_p: np.ndarray, data: np.ndarray, count: float = 0, expected: np.ndarray | None = None) -> float:
    """The same for one word of any length: TOGETHER bytes at a time, so that only two numbers a byte are held."""
    size, longest = len(data), vocabulary.longest
    alpha = np.full(size + 1, -np.inf)
    alpha[0] = 0

    def part(at: int):
        to = min(size, at + TOGETHER)
        starts = np.arange(at, to)
        start, n, piece = _matches(vocabulary, data, size - starts, starts)
        return start, start + n, piece, log_p[piece]

    for at in range(0, size, TOGETHER):  # pushes from each place to the ends of the pieces that begin there
        a, b, _, lp = part(at)
        for rows, _ in _steps(a, b):
            alpha[b[rows]] = np.logaddexp(alpha[b[rows]], alpha[a[rows]] + lp[rows])
    if expected is not None:
        beta = np.full(size + 1 + longest, -np.inf)
        beta[size] = 0
        for at in range((size - 1) // TOGETHER * TOGETHER, -1, -TOGETHER):
            a, b, piece, lp = part(at)
            for rows, _ in _steps(-a, b):
                beta[a[rows[0]]] = np.logaddexp.reduce(beta[b[rows]] + lp[rows])
            expected += np.bincount(piece, np.exp(alpha[a] + lp + beta[b] - alpha[size]) * count, len(expected))
    return float(alpha[size])


def _batches(batches, size: int = TOGETHER):
    """Joins Arrow batches of words (column word: binary) to tables of about so many bytes."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column("word").nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spelled(vocabulary: Pieces, log_p: np.ndarray, words, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """spell for a binary column of words, a space before each; the long ones one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    words = words.cast(pa.large_binary())
    size = np.asarray(pc.binary_length(words)).astype(np.int64)
    out = np.zeros(len(size))
    for k in np.flatnonzero(size > TOGETHER):
        data = np.frombuffer(b" " + words[int(k)].as_py(), np.uint8)
        out[k] = spell_long(vocabulary, log_p, data, float(counts[k]) if counts is not None else 0, expected)
    short = np.flatnonzero(size <= TOGETHER)
    short = short[np.argsort(size[short], kind="stable")]
    ends = np.cumsum(size[short] + 1)
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER)))
        rows = short[at:to]
        part = pc.binary_join_element_wise(pa.array([b""] * len(rows), pa.large_binary()), words.take(pa.array(rows)), pa.scalar(b" ", pa.large_binary()))
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        out[rows] = spell(vocabulary, log_p, np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], counts[rows] if counts is not None else None, expected)
        at = to
    return out


def word_counts(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """One row per distinct word: h (hash), word (bytes, A-Z folded), n (times in rows where learn is true), seen (times in all rows). Words are counted in each task before they are shuffled."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", COUNTED):
                words = Words(*text_buffers(part.column("text")))
                if not len(words.hash):
                    continue
                learns = np.asarray(part.column("learn").to_numpy(zero_copy_only=False), bool)[words.doc]
                _, first, which, seen = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
                size = words.end[first] - words.start[first]
                offsets = np.concatenate([[0], np.cumsum(size)])
                data = words.data[np.repeat(words.start[first] - offsets[:-1], size) + np.arange(offsets[-1])]
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                n = np.bincount(which, learns, len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.hash[first].view(np.int64)), column, pa.array(n), pa.array(seen.astype(np.int64))], ["h", "word", "n", "seen"])

    found = docs.select(F.col(text_col).alias("text"), learn.alias("learn")).mapInArrow(run, "h long, word binary, n long, seen long")
    return found.groupBy("h", "word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


@dataclass
class Model:
    """log_p: natural logarithms of the pieces' probabilities; end: that of the end of a text. Together they sum to 1."""

    vocabulary: Pieces
    log_p: np.ndarray
    end: float


def train(words: DataFrame, texts: int, vocabulary: Pieces, rounds: int = ROUNDS) -> Model:
    """Fits the probabilities of the pieces to words (word, n): each round spreads every word's count over its spellings, on the executors, and sums the pieces' uses. Only a number per piece, bounded by the vocabulary, reaches the driver.

    texts: number of texts that ended. Without words the vocabulary's own weights stay.
    """
    import pyarrow as pa

    log_p = np.log(vocabulary.weight)
    total = 0.0
    for _ in range(rounds):

        def run(batches, log_p=log_p):
            uses = np.zeros(len(log_p))
            for part in _batches(batches):
                _spelled(vocabulary, log_p, part.column("word"), np.asarray(part.column("n"), float), uses)
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(uses[some])], ["piece", "uses"])

        uses = words.where("n > 0").select("word", "n").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        count = np.zeros(len(log_p))
        count[uses["piece"].to_numpy()] = uses["uses"].to_numpy()
        total = count.sum()
        if not total:
            break
        log_p = np.log((count + ADDED) / (total + ADDED * len(count)))
    end = (texts + ADDED) / (texts + total + 2 * ADDED)
    return Model(vocabulary, log_p + np.log1p(-end), float(np.log(end)))


def _looked_up(docs: DataFrame, h: np.ndarray, base: np.ndarray, log10_p: np.ndarray, known: np.ndarray, end: tuple[float, float, int]) -> DataFrame:
    """Per document its number of tokens and the sums over frequent words (h ascending) and the end; rest: hashes and numbers of the other words."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast((h, base, log10_p, known))

    def run(batches):
        h, base, log10_p, known = held.value
        for batch in batches:
            for part in slices(batch, "text", COUNTED):
                words = Words(*text_buffers(part.column("text")))
                n = part.num_rows
                at = np.minimum(np.searchsorted(h, words.hash), max(len(h) - 1, 0))
                there = h[at] == words.hash if len(h) else np.zeros(len(words.hash), bool)
                doc, k = words.doc[there], at[there]
                sums = [np.bincount(doc, x[k], n) + e for x, e in zip((base, log10_p, known), end, strict=True)]
                rest = np.stack([words.doc[~there].astype(np.uint64), words.hash[~there]], 1)
                order = np.lexsort((rest[:, 1], rest[:, 0]))
                rest = rest[order]
                new = np.flatnonzero(np.concatenate([[True], np.any(rest[1:] != rest[:-1], 1)])) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([new, [len(rest)]]))
                offsets = np.searchsorted(rest[new, 0], np.arange(n + 1).astype(np.uint64)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rest[new, 1].view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])
                tokens = np.bincount(words.doc, minlength=n) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(tokens.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.rint(sums[2]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                    ["id", "held_out", "n_tokens", "base", "score", "known", "rest"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, base double, score double, known long, rest array<struct<h:long,n:long>>")


def score(docs: DataFrame, held_out: Column, vocabulary: Pieces, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (words by themselves), score (log10 of the text's probability).

    A text's words (A-Z folded, white space dropped) are spelled by the pieces, a space before each, then comes its end. Its probability is the sum over all spellings. As no piece reaches over a space, that is the product
    of the words' sums. The probabilities of pieces are learned from rows where held_out is not true. Null texts are empty: their end is all they have. Rows with null, equal or repeated ids are rows of
    their own; a null held_out is false. An empty table gives no rows, and other columns are not read. Without learned rows the vocabulary's own weights hold.

    Every word is counted over the whole corpus. Words that are frequent in it (at most 1 / FREQUENT) are looked up in each task; rows with the other words of each document meet their counts by hash
    in a join, where none of them can be a hot key. Words are told apart by 64-bit hashes there.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)

    written = Written(spark)
    try:
        held = F.coalesce(held_out, F.lit(False))
        counted = written.cut(word_counts(docs, ~held, text_col))
        texts = docs.where(~held).count()
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
        n, v = total.n + texts, total.v + (texts > 0)
        model = train(counted, texts, vocabulary, rounds)
        log_p = model.log_p

        def spelled(batches):
            for part in _batches(batches):
                value = _spelled(vocabulary, log_p, part.column("word")) / LN10
                yield from pa.table({"h": part.column("h"), "n": part.column("n"), "seen": part.column("seen"), "log10_p": pa.array(value)}).to_batches()

        base = lambda c: F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
        words = counted.mapInArrow(spelled, "h long, n long, seen long, log10_p double").withColumn("base", base(F.col("n")))
        words = written.cut(words)
        top = words.where(F.col("seen") >= max(2, total.seen * FREQUENT)).select("h", "n", "log10_p", "base").toPandas()
        h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        end = (float(np.log10((texts + 0.5) / (n + 0.5 * (v + 1)))), model.end / LN10, int(texts > 0))
        rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
        rows = _looked_up(rows, h[order], top["base"].to_numpy()[order], top["log10_p"].to_numpy()[order], (top["n"].to_numpy()[order] > 0).astype(float), end)
        rows = written.cut(rows.withColumn("key", F.monotonically_increasing_id()))  # written once, so that a row keeps its key
        rest = rows.select("key", F.explode("rest").alias("r")).select("key", F.col("r.h").alias("h"), F.col("r.n").alias("times"))
        rest = rest.join(words.where(F.col("seen") < max(2, total.seen * FREQUENT)), "h")
        times = F.col("times")
        rest = rest.select("key", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), (times * F.col("base")).alias("base"), (times * F.col("log10_p")).alias("score"), F.when(F.col("n") > 0, times).otherwise(0).alias("known"))
        full = rows.drop("rest").unionByName(rest).groupBy("key").agg(
            F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
        )
        return written.keep(full.drop("key"))
    finally:
        written.drop()


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score(docs, held_out, read_pieces(str(public_tokenizers.path("piece_bpe_32k.model"))))
