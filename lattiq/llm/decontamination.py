"""Benchmark decontamination: word pairs of the test items, so many that no alignment of the cutoff or more can miss them, seed matches in training documents, and Smith-Waterman alignment of words scores the passages around them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, slices, table, text_buffers

#: Words of a seed; items too short for pairs to be sure of a hit are seeded by single words.
GRAM = 2
#: Alignment score over the score of a perfect copy, from which on a document counts as contaminated.
CUTOFF = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are taken in blocks of about so many, and of so many bytes, at most; what is sent to the executors is bounded by a block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
_SIEVE = 1 << 18


def _grams(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each n-gram inside one text."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(h) + k]
    at = np.flatnonzero(doc[: len(h)] == doc[size - 1 :])
    return mix(h[at]), at


def budget(n: np.ndarray, cutoff: float) -> np.ndarray:
    """What the alignment of an item of n words may lose of a perfect score and still reach the cutoff."""
    return np.floor(MATCH * n * (1 - cutoff) + 1e-9).astype(np.int64)


def least_grams(n: np.ndarray, cutoff: float, size: int) -> np.ndarray:
    """How many n-grams of an item of n words any alignment of cutoff or more keeps whole, at least.

    A substituted or deleted word costs MATCH + 1, one cut off at the ends MATCH, an inserted one 1. The first breaks two pairs at most and the others one each, so pairs are lost
    cheapest by insertions, and single words by cutting off.
    """
    return n - 1 - budget(n, cutoff) if size == GRAM else n - budget(n, cutoff) // MATCH


@dataclass
class Items:
    """A block of test items: ids, words (hashes) with bounds, and the sorted hashes of their n-grams: pairs, or single words where pairs can't be sure of a hit."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    gram: np.ndarray  # of each n-gram: its index in `known`
    item: np.ndarray  # its item
    known: np.ndarray
    sieve: np.ndarray
    sizes: tuple[int, ...]  # of the n-grams in use
    whole: np.ndarray  # of each item: n-grams that a match keeps at least
    reach: np.ndarray  # of each item: words of a matching passage at most

    @classmethod
    def of(cls, ids: list, texts: list[str], cutoff: float) -> Items:
        raw = [(t or "").encode() for t in texts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), strip=True)
        n = np.diff(w.first)
        pairs = least_grams(n, cutoff, GRAM)
        by_pairs = pairs >= 1
        grams = []
        for size, of_items in ((1, ~by_pairs), (GRAM, by_pairs)):
            h, at = _grams(w.hash, w.doc, size)
            keep = of_items[w.doc[at]]
            grams.append((h[keep], w.doc[at][keep]))
        known, gram = np.unique(np.concatenate([h for h, _ in grams]), return_inverse=True)
        sizes = tuple(size for size, (h, _) in zip((1, GRAM), grams, strict=True) if len(h))
        whole = np.maximum(np.where(by_pairs, pairs, least_grams(n, cutoff, 1)), 1)
        return cls(np.array(ids), w.hash, w.first, gram, np.concatenate([item for _, item in grams]), known, _sieve(known), sizes, whole, n + budget(n, cutoff))

    def grams(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each n-gram of the sizes in use."""
        found = [_grams(w.hash, w.doc, size) for size in self.sizes]
        return np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[at for _, at in found]])

    def find(self, h: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of h that are in known, and where they are there."""
        at = np.flatnonzero(sieve[(h >> np.uint64(46)).astype(np.int64)])
        k = np.minimum(np.searchsorted(known, h[at]), max(len(known) - 1, 0))
        ok = known[k] == h[at] if len(known) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def _sieve(known: np.ndarray) -> np.ndarray:
    sieve = np.zeros(_SIEVE, bool)
    sieve[(known >> np.uint64(46)).astype(np.int64)] = True
    return sieve


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the end of it in the passage. A row of the matrix at a time; gaps along the row by a running maximum."""
    n = len(passage)
    place = np.arange(1, n + 1)
    above = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) - GAP * place) + GAP * place, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
        above[1:] = row
    return best, end


def _matches(w: Words, items: Items, seeds: np.ndarray, seed_sieve: np.ndarray, of_seed: pd.DataFrame, enough: np.ndarray, cutoff: float):
    """(text, item, score, first word, end) of each item found in each text of a batch, the best place of each."""
    h, start = items.grams(w)
    at, k = items.find(h, seeds, seed_sieve)
    if not len(at):
        return []
    hits = pd.DataFrame({"seed": k, "pos": start[at], "doc": w.doc[start[at]]}).merge(of_seed, on="seed")
    hits = hits.sort_values(["doc", "item", "pos"], kind="stable")
    doc, item, pos = (hits[c].to_numpy() for c in ("doc", "item", "pos"))
    # Hits stay that have as many others as a match needs within its reach.
    last = np.arange(len(pos)) + enough[item] - 1
    to = np.minimum(last, len(pos) - 1)
    head = (last < len(pos)) & (doc[to] == doc) & (item[to] == item) & (pos[to] - pos < items.reach[item])
    inside = np.cumsum(np.bincount(np.flatnonzero(head), minlength=len(pos) + 1) - np.bincount(last[head] + 1, minlength=len(pos) + 1))[: len(pos)] > 0
    doc, item, pos = doc[inside], item[inside], pos[inside]
    if not len(pos):
        return []
    out: dict[tuple[int, int], tuple] = {}
    size = np.diff(items.first)
    gap = np.ones(len(pos), bool)
    gap[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] >= items.reach[item[1:]])
    heads = np.flatnonzero(gap)
    for a, b in zip(heads, [*heads[1:], len(pos)], strict=True):
        i, d = item[a], doc[a]
        n, reach = int(size[i]), int(items.reach[i])
        words = items.words[items.first[i] : items.first[i + 1]]
        lo = max(int(w.first[d]), int(pos[a]) - reach)
        hi = min(int(w.first[d + 1]), int(pos[b - 1]) + reach)
        if _at_most(words, w.hash[lo:hi]) < cutoff * MATCH * n - 1e-6:
            continue
        best, end = align(words, w.hash[lo:hi])
        value = best / (MATCH * n)
        if value >= cutoff and value > out.get((d, i), (0.0,))[0]:
            out[d, i] = (value, max(lo, lo + end - n) - int(w.first[d]), lo + end - int(w.first[d]))
    return [(d, i, *v) for (d, i), v in out.items()]


def _at_most(item: np.ndarray, passage: np.ndarray) -> int:
    """A bound of the alignment score: matched words in runs, of which each but one has cost an edit. A run has one pair less than words, so runs are words less whole pairs."""
    one = np.isin(item, passage)
    both = one[1:] & one[:-1]
    pairs = np.count_nonzero(both & np.isin(*[_grams(x, np.zeros(len(x), np.int64), 2)[0] for x in (item, passage)])) if both.any() else 0
    words = np.count_nonzero(one)
    return min(MATCH * words, (MATCH - 1) * words + pairs + 1)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, cutoff: float):
    """Blocks of at most about BLOCK_ITEMS items, each small enough to be sent to every executor."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(F.col("_item").cast("string")), F.lit(blocks)) == block).orderBy("_item", "_text").toPandas()
        yield Items.of(rows["_item"].tolist(), rows["_text"].tolist(), cutoff)


def gram_counts(documents: DataFrame, items: Items, text_col: str) -> np.ndarray:
    """In how many documents of the whole corpus each n-gram of the items occurs. A task gives one row per n-gram it met, so what is gathered is bounded by the block."""

    def run(batches):
        total = np.zeros(len(items.known), np.int64)
        for whole in batches:
            for batch in slices(whole, text_col):
                w = Words(*text_buffers(batch.column(text_col)), strip=True)
                h, start = items.grams(w)
                at, k = items.find(h, items.known, items.sieve)
                pairs = np.unique(w.doc[start[at]] * np.int64(len(items.known)) + k) if len(at) else np.zeros(0, np.int64)
                total += np.bincount(pairs % max(len(items.known), 1), minlength=len(items.known))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["gram", "n"])

    found = documents.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.known), np.int64)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _seeds(items: Items, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pd.DataFrame, np.ndarray]:
    """The n-grams of each item but its commonest ones, and how many of them a match must hit: at most half of the n-grams that a match keeps whole are left out, the rest must be hit."""
    grams = pd.DataFrame({"gram": items.gram, "item": items.item, "n": counts[items.gram]})
    grams = grams.sort_values(["item", "n", "gram"], ascending=[True, False, True], kind="stable")
    spare = (items.whole - 1) // 2
    chosen = grams[grams.groupby("item").cumcount() >= spare[grams["item"]]].drop_duplicates(["item", "gram"])
    index, seed = np.unique(chosen["gram"].to_numpy(np.int64), return_inverse=True)
    seeds = items.known[index]
    return seeds, _sieve(seeds), chosen.assign(seed=seed)[["seed", "item"]].reset_index(drop=True), items.whole - spare


def contaminations(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """A row per document and test item found in it: id, item, score (share of a perfect alignment), start_word and end_word (about where, in words of letters and digits).

    Case and punctuation don't count. Null or empty documents and items, and items without a word, match nothing; an item of one word is found wherever that word stands, one of two words where both stand in order with a word between them at most; repeated rows each give their rows; an
    empty table on either side gives none. Every item with an alignment of cutoff or more is found, whatever its edits. Documents are read twice, without a shuffle: once for the n-gram counts, once for seeds and alignment.
    """
    kinds = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, {item_col} {benchmark.schema[item_col].dataType.simpleString()}"
    item_type = benchmark.schema[item_col].dataType
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, cutoff):
        found = documents.select(id_col, text_col).mapInArrow(_finder(documents, items, id_col, text_col, item_col, item_type, cutoff), f"{kinds}, score double, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(documents, items, id_col, text_col, item_col, item_type, cutoff):
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = _seeds(items, gram_counts(documents, items, text_col))
    arrow = to_arrow_type(item_type)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                found = _matches(Words(*text_buffers(batch.column(text_col)), strip=True), items, *chosen, cutoff)
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(cols[0], pa.int64())), pa.array([items.ids[i].item() if hasattr(items.ids[i], "item") else items.ids[i] for i in cols[1]], arrow), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=[id_col, item_col, "score", "start_word", "end_word"],
                )

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The documents in which no test item is found, with all their columns; nothing is shuffled."""
    for items in _blocks(benchmark, item_col, item_text_col, cutoff):
        chosen = _seeds(items, gram_counts(documents, items, text_col))

        def run(batches, items=items, chosen=chosen):
            for whole in batches:
                for batch in slices(whole, text_col):
                    found = _matches(Words(*text_buffers(batch.column(text_col)), strip=True), items, *chosen, cutoff)
                    clean = np.ones(batch.num_rows, bool)
                    clean[[f[0] for f in found]] = False
                    yield batch.filter(pa.array(clean))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
