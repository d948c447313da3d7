"""Packing of tokenised documents into training sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

LENGTH = 4096
END_ID = 2
#: Documents in a randomised group on average.
GROUP_DOCS = 2048
#: Equal rows that go to one group together.
REPEATS = 64
#: Words whose ids a Python worker keeps at most; beyond that it starts anew.
CACHE_WORDS = 300_000
#: Bytes of text whose words are split and numbered together.
SLICE = 4 << 20

#: Formats of 1, 2, ... little-endian 32-bit numbers.
_UINTS = [struct.Struct(f"<{n}I") for n in range(1, 33)]
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)?([.,!?;:]+)?")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words and texts on which the quick way must give a tokenizer's own ids; with any other tokenizer, texts are encoded whole.
_PROBES = ["Hello", "WORLD,", "na\xefve", "stra\xdfe", "\xc9t\xe9!", "don't", "x.", "...", "A", "internationalisation;"]


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Ids of whitespace-separated words as little-endian bytes, where pieces of the tokenizer never span white space, so that a text's ids are its words' ids in a row (by_words)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.by_words = True
        self.parts: dict[str, bytes] = {}
        try:
            own = [self.text(" ".join(_PROBES)), *(self[w] for w in _PROBES)]
        except Exception:  # a model that can't be asked for pieces of such letters
            own = []
        self.by_words = own == [self.encode(" ".join(_PROBES)), *(self.encode(w) for w in _PROBES)]
        self.clear()

    def encode(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def piece(self, text: str) -> bytes:
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)  # printable ASCII stands for itself
        ids = [t.id for t in self.model.tokenize(letters)]
        return _UINTS[len(ids) - 1].pack(*ids) if 0 < len(ids) <= len(_UINTS) else struct.pack(f"<{len(ids)}I", *ids)

    def part(self, text: str) -> bytes:
        """piece, remembered apart from the words: a word's forms in other case and with other marks share it."""
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) > CACHE_WORDS:
                self.parts.clear()
            ids = self.parts[text] = self.piece(text)
        return ids

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            ids = self.encode(word)
        else:
            letters, marks = plain.groups()
            ids = (self.part(letters.lower()) if letters else b"") + (self.part(marks) if marks else b"")
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not self.by_words or any(c in text for c in _ODD):  # Python splits at these, the tokenizer doesn't
            return self.encode(text)
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a column. Texts are split and their words numbered as arrays; each different word is looked up once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f"[{_ODD[0]}-{_ODD[-1]}]") if self.by_words else pa.array([True] * len(texts))
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = words.flatten().dictionary_encode()
        if len(self) > CACHE_WORDS:
            self.clear()
        known = [self[w] for w in coded.dictionary.to_pylist()]
        n = np.array([len(x) // 4 for x in known], np.int64)
        code = coded.indices.to_numpy()
        size = n[code]
        to = np.concatenate([[0], np.cumsum(size)])
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(first[code] - to[:-1], size) + np.arange(to[-1])]
        bounds = to[words.offsets.to_numpy()]
        return [self.encode(texts[k].as_py()) if o else ids[a:b].tobytes() for k, (o, a, b) in enumerate(zip(odd.to_pylist(), bounds[:-1], bounds[1:], strict=True))]


@lru_cache(2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Tokenises whole texts and cuts them at multiples of length: one row per piece, with the checksum of its ids.

    A null text is empty and gives one piece of the end id alone. Repeated rows give their own pieces. The tokenizer file must lie at the same path on each executor.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        ids_of = _word_ids(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, text_col, SLICE)):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.column(batch.column(1)), strict=True):
                data = ids + end
                n = len(data) // 4
                for start in range(0, n, length):
                    part = data[4 * start : 4 * (start + length)]
                    for x, v in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])
        ids_of.clear()  # workers live on and serve other operators; only the words' parts stay for the next task

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size. A tournament tree holds the largest free capacity below each node, so the first bin with room is found in one descent."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    free = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs all documents: a row per piece with sequence_id and offset; a sequence holds at most length ids and is padded to it by the reader.

    Groups are drawn by a hash of document, position and content, about group_docs documents each whatever the corpus size, and packed apart, so their ids never meet in
    one task; only piece rows are shuffled, never ids. Equal rows are counted first and dealt out in runs of at most REPEATS, so a row that very many repeat is no group of its own. Ties in size go by document and start. An empty table gives no rows. Other columns are not read.
    """
    groups = max(1, -(-df.count() // group_docs))
    cut_up = pieces(df, tokenizer, id_col, text_col, length, end_id)
    cut_up = cut_up.groupBy(*cut_up.columns).agg(F.count(F.lit(1)).alias("_n"))
    cut_up = cut_up.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(REPEATS).cast("long"))))
    cut_up = cut_up.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", "_from", F.lit("pack")), F.lit(groups)))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.loc[rows.index.repeat((rows["_n"] - rows["_from"]).clip(upper=REPEATS))]
        rows = rows.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].tolist(), length)
        rows["sequence_id"], rows["offset"] = [(key[0] << 32) + b for b in bins], offsets
        return rows.drop(columns=["_group", "_n", "_from"])

    kind = df.schema[id_col].dataType.simpleString()
    return cut_up.groupBy("_group").applyInPandas(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
