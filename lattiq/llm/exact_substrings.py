"""Exact repeated-substring removal. Suffixes are sorted column by column over many documents at once: each round inserts one symbol per document, read from a sequential file, and updates the
collection's Burrows-Wheeler column and common-prefix lengths.

Sorting all suffixes of a corpus in one place would not scale, so the work is cut by content. Every 400-byte string is filed under its anchor, the least hashed 128-byte string inside
it. Equal strings have the same anchor at the same place, so only strings of one anchor can be equal, and they stand aligned: suffixes inserted in the same round are the only ones to compare,
and the transform is kept a column at a time.

A unit is bytes, or words of letters and digits with case folded: the same steps find repeated strings of 400 bytes, and passages of over 50 words whatever their bytes.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BLOCK, _CODE, _POW, _POW_INV, Words, Written, bitmap, bitmap_bits, cut, has_bit, id_bit, id_bitmap, maybe_in, mix, slices, table, text_buffers


@dataclass(frozen=True)
class Unit:
    """What a string is made of: bytes, or words; the symbols of a string, and of the anchor inside it. step: neighbouring strings whose common core is compared between chunks before they are (31 at most)."""

    words: bool
    length: int
    anchor: int
    step: int = 16


LENGTH = 400
BYTES = Unit(False, LENGTH, 128)
#: Passages of over 50 words.
PASSAGES = Unit(True, 51, 16)
#: Contexts of one anchor that are sorted together; an anchor with more is dealt into chunks, and strings that are single in their chunk are compared between chunks.
CHUNK = 4096
#: Contexts that a bundle of anchors holds on average.
BUNDLE = 8192
#: Text bytes that a task hashes at once; about 150 bytes of memory go with each.
SLICE = 1 << 20
_PLACE = np.uint64((1 << 30) - 1)


def _code(symbols: np.ndarray) -> np.ndarray:
    """An odd 64-bit number for each symbol; words are told by their hash already."""
    return _CODE[symbols] if symbols.dtype == np.uint8 else symbols.astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of data[p:p + size] for every p, by prefix sums modulo 2**64, block by block."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = _BLOCK - size
    for at in range(0, n, step):
        piece = data[at : at + _BLOCK]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_code(piece) * _POW[: len(piece)], out=sums[1:])
        m = min(step, n - at)
        out[at : at + m] = (sums[size : size + m] - sums[:m]) * _POW_INV[:m]
    return mix(out)


def _range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; ranges are of a few hundred symbols, starts ascend."""
    out = np.zeros(len(start), np.uint64)
    half = _BLOCK // 2
    cuts = np.searchsorted(start // half, np.arange(len(data) // half + 2))
    for block in range(len(data) // half + 1):
        own = slice(cuts[block], cuts[block + 1])
        if own.start == own.stop:
            continue
        at = block * half
        piece = data[at : at + _BLOCK]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_code(piece) * _POW[: len(piece)], out=sums[1:])
        out[own] = (sums[end[own] - at] - sums[start[own] - at]) * _POW_INV[start[own] - at]
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i: minima from the left and right ends of blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = BYTES.anchor):
    """For every anchor of every text: text index, place p (in data), first and last start lo, hi of the strings filed under it, and the hash of the anchor. The strings' starts are covered without gaps."""
    found = []
    some = np.diff(offsets) >= length
    first, end = offsets[:-1][some], offsets[1:][some] - length + 1  # starts whose string ends inside the text
    for at in range(0, max(len(data) - length + 1, 0), SLICE):
        n = min(SLICE, len(data) - length + 1 - at)
        h = _gram_hash(data[at : at + n + length - 1], anchor)
        place = (_sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - anchor + 1) & _PLACE).astype(np.int64)
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, np.clip(first - at, 0, n), 1)
        np.add.at(mark, np.clip(end - at, 0, n), -1)
        ok = np.cumsum(mark)[:n] > 0
        head = ok & np.concatenate([[True], (place[1:] != place[:-1]) | ~ok[:-1]])
        head[first[(first >= at) & (first < at + n)] - at] = True
        last = ok & np.concatenate([head[1:] | ~ok[1:], [True]])
        lo = np.flatnonzero(head)
        p = place[lo]
        found.append((np.searchsorted(offsets, lo + at, side="right") - 1, p + at, lo + at, np.flatnonzero(last) + at, h[p]))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_starts(contexts: list[np.ndarray], before: np.ndarray, after: np.ndarray, group: np.ndarray, owner: np.ndarray, length: int = LENGTH, anchor: int = BYTES.anchor) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise suffix sorting of aligned documents.

    The symbol file is scratch of this one call, written and read by this task alone and gone with it; a lost task starts it anew elsewhere.
    contexts: the symbols of text[lo:hi + length] each, small numbers from 0 on; before = p - lo and after = p - hi tell how it lies around its anchor; group: only documents of one group are compared; owner: whose a context is, and
    only equals of different owners count. Returns two boolean matrices by (start from the anchor backwards, document): the string that starts there occurs with another owner in the group; and it
    stands for its equals, as the first in sorted order, or for itself where no equal counts.
    """
    m, back = len(contexts), length - anchor
    width = back + length
    owner = np.unique(owner, return_inverse=True)[1]
    rank = np.unique(group, return_inverse=True)[1].astype(np.uint16 if m < 65536 else np.int64)
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(m + 1, np.int32)  # of each suffix in sorted order and the one before it
    with tempfile.TemporaryFile() as symbols:
        kind = np.dtype(np.int16 if contexts[0].dtype == np.uint8 else np.int32)
        rows = np.full((min(m, 2048), width), -1, kind)
        full = np.memmap(symbols, kind, "w+", shape=(width, m))  # a column of the collection after the other
        for at in range(0, m, 2048):
            part = rows[: min(2048, m - at)]
            part[:] = -1
            for i in range(len(part)):
                x = contexts[at + i]
                begin = back - before[at + i]
                part[i, begin : begin + len(x)] = x
            full[:, at : at + len(part)] = part.T
        full.flush()
        symbols.seek(0)
        repeated, first = np.zeros((back + 1, m), bool), np.zeros((back + 1, m), bool)
        for column in range(width - 1, -1, -1):
            symbols.seek(column * m * kind.itemsize)
            bwt = np.frombuffer(symbols.read(m * kind.itemsize), kind)[order]  # the symbols before the sorted suffixes
            by_symbol = np.argsort(bwt, kind="stable")
            by = by_symbol[np.argsort(rank[order[by_symbol]], kind="stable")]
            s, g = bwt[by], rank[order[by]]
            same = np.flatnonzero((s[1:] == s[:-1]) & (g[1:] == g[:-1]) & (s[1:] >= 0)) + 1
            new = np.zeros(m + 1, np.int32)
            if len(same):
                # neighbours with one symbol: 1 + the least common prefix between their old places
                ends = np.column_stack([by[same - 1] + 1, by[same] + 1]).ravel()
                new[same] = 1 + np.minimum.reduceat(lcp, ends)[::2]
            order, lcp = order[by], new
            if column <= back:
                heads = np.flatnonzero(lcp[:-1] < length)
                own = owner[order]
                differ = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
                size = np.diff(np.concatenate([heads, [m]]))
                counts = np.repeat(differ, size)
                repeated[column, order[counts]] = True
                single = ~counts
                single[heads] = True
                first[column, order[single]] = True
        del full
    start = np.arange(back + 1)[:, None] - back  # from the anchor
    inside = (start >= -before[None, :]) & (start <= -after[None, :])
    return repeated & inside, first & inside


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True along the rows."""
    pad = np.zeros((flags.shape[0], 1), bool)
    edge = np.diff(np.concatenate([pad, flags, pad], 1).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, a, b - 1


def _rid(dk: np.ndarray, p: np.ndarray, lo: np.ndarray, unit: Unit) -> np.ndarray:
    x = dk.astype(np.uint64) + p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(unit.words)
    return (mix(x) >> np.uint64(1)).astype(np.int64)


_ROW = "words boolean, rid long, h long, whole long, dk long, p long, lo long, hi long"


def _symbols(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch of texts and the bounds of the texts in them."""
    if not unit.words:
        return data, offsets
    w = Words(data, offsets, strip=True)
    return w.hash, w.first


def _anchor_rows(docs: DataFrame, units: tuple[Unit, ...], column: str = "h", bits: np.ndarray | None = None, contexts: bool = False) -> DataFrame:
    """docs (dk, text) -> an anchor per row, of each unit; with a bitmap, only those whose value in `column` has its bit set; with the symbols of their contexts if asked for."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, offsets = text_buffers(batch.column("text"))
                keys = np.asarray(batch.column("dk")).astype(np.int64)
                for unit in units:
                    symbols, first = _symbols(data, offsets, unit)
                    doc, p, lo, hi, h = anchors(symbols, first, unit.length, unit.anchor)
                    h = mix(h + np.uint64(unit.words)).astype(np.int64)
                    rid = _rid(keys[doc], p - first[doc], lo - first[doc], unit)
                    if bits is not None:
                        keep = np.flatnonzero(has_bit(bits, (h if column == "h" else rid) & (len(bits) * 8 - 1)))
                        doc, p, lo, hi, h, rid = (x[keep] for x in (doc, p, lo, hi, h, rid))
                    base = first[doc]
                    alike = mix(_range_hash(symbols, lo, hi + unit.length) + (p - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)
                    cols = [pa.array(np.full(len(p), unit.words)), *(pa.array(x) for x in (rid, h, alike, keys[doc], p - base, lo - base, hi - base))]
                    if contexts:
                        cols.append(pa.array([symbols[a:b].tobytes() for a, b in zip(lo, hi + unit.length, strict=True)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["words", "rid", "h", "whole", "dk", "p", "lo", "hi", "symbols"][: len(cols)])

    return docs.select("dk", "text").mapInArrow(run, _ROW + (", symbols binary" if contexts else ""))


def _low_bits(df: DataFrame, column: str, rows: int) -> np.ndarray:
    bits = bitmap_bits(rows)
    return bitmap(df.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("_bit")), bits)


def _concatenated(symbols: list[bytes], unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of contexts one after the other, and the bounds of the contexts."""
    kind = np.dtype(np.uint64 if unit.words else np.uint8)
    return np.frombuffer(b"".join(symbols), kind), np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in symbols])]).astype(np.int64)


def _steps(unit: Unit) -> list[tuple[int, int]]:
    """First and last of each step of starts, counted from the earliest one that an anchor allows."""
    last = unit.length - unit.anchor
    return [(a, min(a + unit.step - 1, last)) for a in range(0, last + 1, unit.step)]


_FOUND = "words boolean, rid long, h long, dk long, many boolean, p long, lo long, hi long, chunk long, symbols binary, steps array<struct<step:int,core:bigint,first:int,alone:int>>"


def _sort(units: tuple[Unit, ...]):
    """A bundle of contexts -> spans (lo, hi) of strings that repeat in their chunk. The contexts of frequent anchors come back too: their symbols, and for each step of starts that has a string which
    stands for its equals: the hash of the core that all strings of the step hold, which strings stand for their equals, and which of these have none in the chunk (bits)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for unit in units:
            own = pdf[pdf["words"] == unit.words].reset_index(drop=True)
            if not len(own):
                continue
            back = unit.length - unit.anchor
            p, lo, hi, dk, chunk = (own[c].to_numpy(np.int64) for c in ("p", "lo", "hi", "dk", "chunk"))
            symbols, bounds = _concatenated(own["symbols"].tolist(), unit)
            small = np.unique(symbols, return_inverse=True)[1].astype(np.int32) if unit.words else symbols
            group = mix(own["h"].to_numpy(np.int64).astype(np.uint64)) + chunk.astype(np.uint64)
            # among words, only other documents count; a context that several documents have meets all others
            owner = np.where(own["many"].to_numpy(bool), np.arange(len(own)) - 2**62, dk >> 1) if unit.words else np.arange(len(own))
            repeated, first = repeated_starts([small[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], p - lo, p - hi, group, owner, unit.length, unit.anchor)
            repeated, first = repeated.T, first.T
            row, a, b = _runs(repeated)
            out.append(own[["words", "rid", "h", "dk", "many"]].iloc[row].assign(p=p[row], lo=p[row] + a - back, hi=p[row] + b - back + unit.length, chunk=chunk[row], symbols=None, steps=None))
            split = np.flatnonzero(own["chunks"].to_numpy() > 1)
            if len(split):
                steps: list[list[dict]] = [[] for _ in split]
                for k, (head, tail) in enumerate(_steps(unit)):
                    flags = first[split, head : tail + 1]
                    some = np.flatnonzero(flags.any(1))
                    at = bounds[split[some]] + p[split[some]] - lo[split[some]] - back
                    core = (_range_hash(symbols, at + tail, at + head + unit.length) | np.uint64(1)).astype(np.int64)
                    power = 1 << np.arange(tail - head + 1)
                    of_first, of_alone = flags[some] @ power, (flags[some] & ~repeated[split[some], head : tail + 1]) @ power
                    for i, c, f, g in zip(some, core.tolist(), of_first.tolist(), of_alone.tolist(), strict=True):
                        steps[i].append({"step": k, "core": c, "first": f, "alone": g})
                out.append(own[["words", "rid", "h", "dk", "many", "p", "lo", "hi", "chunk", "symbols"]].iloc[split].assign(steps=steps))
        return pd.concat(out)

    return run


def _between(found: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Spans of strings of frequent anchors that are single in their chunk and occur in another one. Steps of starts whose core is in one chunk alone are passed over; the strings of the others are
    compared by hash."""
    contexts = found.where("symbols IS NOT NULL")
    steps = contexts.select("words", "rid", "h", "chunk", F.inline("steps"))
    keys = ["words", "h", "step", "core"]
    shared = steps.groupBy(*keys).agg(F.min("chunk").alias("_lo"), F.max("chunk").alias("_hi")).where("_lo != _hi").select(*keys)
    live = steps.join(shared, keys).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("step", "first", "alone"))).alias("steps"))
    live = contexts.drop("steps", "chunk", "h").join(live, "rid")

    def run(batches):
        for batch in batches:
            for unit in units:
                own = batch.filter(pa.array([w == unit.words for w in batch.column("words").to_pylist()], pa.bool_()))
                symbols, bounds = _concatenated(own.column("symbols").to_pylist(), unit)
                p, lo = (np.asarray(own.column(c)).astype(np.int64) for c in ("p", "lo"))
                spread = _steps(unit)
                at = [(i, spread[s["step"]][0] + k, s["alone"] >> k & 1) for i, steps in enumerate(own.column("steps").to_pylist()) for s in steps for k in range(unit.step) if s["first"] >> k & 1]
                i, s, alone = (np.array(x, np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 3
                start = p[i] - (unit.length - unit.anchor) + s
                begin = bounds[i] + start - lo[i]
                prints = _range_hash(symbols, begin, begin + unit.length) + s.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(unit.words)
                cols = [own.column(c).take(pa.array(i)) for c in ("words", "dk", "many")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(start), pa.array(start + unit.length), pa.array(mix(prints).astype(np.int64)), pa.array(alone == 1)], names=["words", "dk", "many", "lo", "hi", "print", "alone"])

    prints = cut(live.select("words", "dk", "many", "p", "lo", "symbols", "steps").mapInArrow(run, "words boolean, dk long, many boolean, lo long, hi long, print long, alone boolean"))
    counts = prints.groupBy("print").agg(F.count("*").alias("_n"), (F.min("dk") != F.max("dk")).alias("_differ"), F.max("many").alias("_many"), F.max("words").alias("_words"))
    shared = counts.where("_n > 1 AND (NOT _words OR _differ OR _many)").select("print")
    return prints.where("alone").join(shared, "print").select("words", "dk", "lo", "hi")


def repeated_spans(docs: DataFrame, passing: Written, units: tuple[Unit, ...] = (BYTES, PASSAGES)) -> DataFrame:
    """docs (dk, text) -> spans (words, dk, lo, hi) in bytes or words, overlapping ones as they come: every string of a unit's length that occurs twice (of words: in two documents) lies in a span, and
    each symbol of a span in such a string."""
    # written first: joined to an aggregate directly, a frequent anchor's rows could not be split between tasks
    counted = cut(_anchor_rows(docs, units).groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"))
    rows = passing.cut(_anchor_rows(docs, units, "h", _low_bits(counted, "h", counted.count())).join(counted, "h"))
    # Equal contexts: all strings of both are repeated. One of each kind goes on to meet the others of its anchor.
    kinds = rows.groupBy("words", "h", "whole").agg(((F.count("*") > 1) & (~F.col("words") | (F.min("dk") != F.max("dk")))).alias("many"), F.min(F.struct("rid", "dk", "p", "lo", "hi")).alias("one"))
    kinds = passing.cut(kinds.select("words", "h", "whole", "many", "one.*"))
    length = F.when(F.col("words"), max([u.length for u in units if u.words], default=0)).otherwise(max([u.length for u in units if not u.words], default=0))
    spans = rows.join(kinds.where("many").select("words", "h", "whole"), ["words", "h", "whole"]).select("words", "dk", "lo", (F.col("hi") + length).alias("hi"))
    several = kinds.groupBy("h").agg(F.count("*").alias("_kinds")).where("_kinds > 1")
    meet = cut(kinds.join(several, "h").select("rid", "many", F.ceil(F.col("_kinds") / CHUNK).alias("chunks")))
    total, most = meet.agg(F.count("*"), F.max("chunks")).first()
    if not total:
        return spans
    contexts = _anchor_rows(docs, units, "rid", _low_bits(meet, "rid", total), contexts=True).drop("whole").dropDuplicates(["rid"]).join(meet, "rid")
    # An anchor in one chunk goes to the bundle of its hash; the chunks of a frequent one are spread over bundles.
    contexts = contexts.withColumn("chunk", F.pmod(F.xxhash64("rid"), "chunks")).withColumn("bundle", F.pmod(F.xxhash64("h", "chunk"), F.lit(max(1, total // BUNDLE))))
    found = passing.cut(contexts.groupBy("bundle").applyInPandas(_sort(units), _FOUND))
    spans = spans.unionByName(found.where("symbols IS NULL").select("words", "dk", "lo", "hi"))
    return spans.unionByName(_between(found, units)) if most > 1 else spans


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans; touching ones become one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.column_stack([spans[head, 0], reach[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(spans) - 1]])]])


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = BYTES.anchor, passages: Unit = PASSAGES) -> DataFrame:
    """id, n_bytes, spans (array of lo, hi), kept (the remaining bytes), passages (array of lo, hi in words: what other documents have too, in runs of passages.length words or more) for every document.

    A null text is empty; a text shorter than `length` loses nothing. Repeated rows are documents of their own, so both lose what they share; of passages, rows of one id and text count as one document.
    An empty table gives no rows; other columns are not read. Texts are taken whole. Only documents that may have a span (by a bitmap) move to meet their spans.
    """
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("dk", F.xxhash64(id_col, "text"))
    passing = Written(df.sparkSession)
    spans = repeated_spans(docs, passing, (Unit(False, length, anchor, passages.step), passages))
    at = F.struct("lo", "hi")
    merged = spans.groupBy("dk").agg(F.sort_array(F.collect_set(F.when(~F.col("words"), at))).alias("spans"), F.sort_array(F.collect_set(F.when(F.col("words"), at))).alias("passages"))
    merged = cut(merged)
    passing.drop()
    bitmap, bits = id_bitmap(merged, "dk", merged.count())
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")
    sure = docs.withColumns({"spans": none, "passages": none, "_bit": id_bit("dk", bits)})
    rest = maybe_in(docs, "dk", bitmap, bits).join(merged, "dk", "left").withColumn("_bit", F.lit(-1).cast("long")).select(*sure.columns)

    def run(batches):
        for whole in batches:
            bit = np.asarray(whole.column("_bit"))
            mine = (bit < 0) | ~has_bit(bitmap, np.maximum(bit, 0))  # joined already, or not in the bitmap
            for batch in slices(whole.filter(pa.array(mine)), "text", SLICE):
                data, offsets = text_buffers(batch.column("text"))
                raw = data.tobytes()
                found, kept = [], []
                for i, own in enumerate(_merged(batch.column("spans"))):
                    text = raw[offsets[i] : offsets[i + 1]]
                    at, parts = 0, []
                    for a, b in own:
                        parts.append(text[at:a])
                        at = b
                    kept.append(b"".join([*parts, text[at:]]))
                    found.append(own)
                kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
                lists = [pa.array([[{"lo": int(a), "hi": int(b)} for a, b in own] for own in x], kind) for x in (found, _merged(batch.column("passages")))]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(offsets)), lists[0], pa.array(kept, pa.binary()), lists[1]], names=[id_col, "n_bytes", "spans", "kept", "passages"])

    kind = df.schema[id_col].dataType.simpleString()
    spans = "array<struct<lo:bigint,hi:bigint>>"
    return sure.unionByName(rest).select(id_col, "text", "spans", "passages", "_bit").mapInArrow(run, f"{id_col} {kind}, n_bytes long, spans {spans}, kept binary, passages {spans}")


def _merged(column) -> list[np.ndarray]:
    return [_merge(np.array([(s["lo"], s["hi"]) for s in own or []], np.int64).reshape(-1, 2)) for own in column.to_pylist()]


def op4_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; then n_passages and n_passage_words, the runs of over 50 words that other documents have too, and their words, and has_passage."""
    found = remove(table(spark, sf_dir, "documents"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    n_passages = F.size("passages").cast("long")
    return found.select(
        "doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        n_passages.alias("n_passages"), total("passages").alias("n_passage_words"), (n_passages > 0).alias("has_passage"),
    )
