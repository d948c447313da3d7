"""What the operators of this subpackage share: reading tables, cutting lineage, hashing words in batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09 to \x0D, and nothing else.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Makes Arrow batches of whole texts a few MB: Spark's default of 10,000 rows is meant for narrow rows. A session that has chosen a size of its own keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one serves local mode; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and goes on from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Written:
    """Wide or long tables that several steps read, as compressed Parquet in the shared folder; drop() deletes them when no one reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_folder(spark), []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/written-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes a result that outlives the tables it was made from; drop() leaves it."""
        out = self.cut(df)
        self.paths.pop()
        return out

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def held_out(id_col: str) -> F.Column:
    """True for the fifth of the rows that no model may learn from; a null id isn't among them."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) == 0, F.lit(False))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(int(_B), -1, 2**64))
_BLOCK = 1 << 20
_POW = np.full(_BLOCK, _B, np.uint64)
_POW[0] = 1
_POW = np.multiply.accumulate(_POW)
_POW_INV = np.full(_BLOCK, _B_INV, np.uint64)
_POW_INV[0] = 1
_POW_INV = np.multiply.accumulate(_POW_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many ranges, by prefix sums modulo 2**64. Ranges of over half a block (512 KiB) are hashed in pieces of that, from their start."""
    n = len(data)
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    block = 0
    half = _BLOCK // 2
    which = start // half
    order = np.argsort(which, kind="stable") if np.any(np.diff(which) < 0) else np.arange(len(start))
    cuts = np.searchsorted(which[order], np.arange(n // half + 2))
    for block in range(n // half + 1):
        rows = order[cuts[block] : cuts[block + 1]]
        if not len(rows):
            continue
        at = block * half
        piece = data[at : at + _BLOCK]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CODE[piece] * _POW[: len(piece)], out=sums[1:])
        s, e = start[rows] - at, end[rows] - at
        out[rows] = (sums[np.minimum(e, len(piece))] - sums[s]) * _POW_INV[s]
    out = mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(end - start > half):
        at = np.arange(0, end[k] - start[k], half)
        out[k] = end[k] - start[k]
        for part in range_hash(data[start[k] : end[k]], at, np.minimum(at + half, end[k] - start[k])):
            out[k : k + 1] = mix(out[k : k + 1] * _B + part)
    return out


class Words:
    """The words of a batch of UTF-8 texts: doc (index of the text), start, end (byte ranges in data), hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, strip: bool = False):
        """data: bytes of all texts, offsets: len(texts) + 1. A-Z are folded; strip: only letters and digits count."""
        self.data = _FOLD[data]
        inside = ~_BLANK[self.data]
        if strip:
            inside = _WORDLIKE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        is_start = inside & (~before | edge[:-1])
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        is_end = inside & (~after | edge[1:])
        self.start = np.flatnonzero(is_start)
        self.end = np.flatnonzero(is_end) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = range_hash(self.data, self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))  # first word of each text, and the end


_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[65:91] = _WORDLIKE[97:123] = True
_WORDLIKE[128:] = True


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch, text: str = "text", most: int = 1 << 20):
    """Cuts an Arrow batch into runs of rows of about `most` text bytes, so that memory follows the texts and not the row count."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
        yield batch.slice(at, to - at)
        at = to


#: Bits of an id bitmap at most (16 MB); it only spares work, so a full one costs time and never a row.
BITMAP_BITS = 1 << 27


def id_bit(id_col: str, bits: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("bit")), F.lit(bits))


def bitmap(bit: DataFrame, bits: int) -> np.ndarray:
    """The bits that the single column of `bit` names, as bytes. Pages of 32,768 bits are built by the executors; at most BITMAP_BITS / 8 bytes reach the driver."""
    at = F.col(bit.columns[0])
    pages = bit.groupBy(F.shiftright(at, 15).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    for page, data in zip(pages["page"], pages["bits"], strict=True):
        out[page * 4096 : (page + 1) * 4096] = np.frombuffer(data, np.uint8)
    return out


def bitmap_bits(rows: int) -> int:
    """Bits for so many rows: 32 or so a row, a page at least and BITMAP_BITS at most."""
    return 1 << min(BITMAP_BITS.bit_length() - 1, max(15, int(rows * 32).bit_length()))


def id_bitmap(ids: DataFrame, id_col: str, rows: int) -> tuple[np.ndarray, int]:
    """A bitmap with the bit of every id set, and its number of bits."""
    bits = bitmap_bits(rows)
    return bitmap(ids.select(id_bit(id_col, bits).alias("_bit")), bits), bits


def has_bit(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, id_col: str, bitmap: np.ndarray, bits: int, inside: bool = True) -> DataFrame:
    """The rows whose id's bit is set (inside) or not; all columns stay and nothing is shuffled."""
    import pyarrow as pa

    def run(batches):
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            bit = np.asarray(batch.column(batch.num_columns - 1))
            hit = has_bit(bitmap, bit)
            part = batch.filter(pa.array(hit if inside else ~hit))
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])

    return df.withColumn("_bit", id_bit(id_col, bits)).mapInArrow(run, df.schema)


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose id is among ids. Only rows that may be among them, by a bitmap, meet ids in a join; the others never move."""
    bitmap, bits = id_bitmap(ids, id_col, ids.count())
    sure = maybe_in(df, id_col, bitmap, bits, inside=False)
    rest = maybe_in(df, id_col, bitmap, bits).join(ids.select(id_col).distinct(), id_col, "left_anti")
    return sure.unionByName(rest)
