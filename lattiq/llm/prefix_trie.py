"""Trie of conversation prefixes. Sorted conversations give a Patricia tree: points only where conversations branch or end, with compressed edges between them. Totals are taken on that tree, and the nodes inside an edge follow from sums along the edge."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, small_batches, table

#: Conversations share the opening of the first of so many.
FAMILY = 20
#: Openings have fewer turns than this.
OPENINGS = 4
#: Members of one conversation text that are joined to one piece of the digested list; ids in such a range of 2**ID_BITS.
ID_BITS = 12
#: Hexadecimal digits of a turn's hash.
DIGITS = 32
#: Sorted conversations that one task turns into a tree, on average.
PART_ROWS = 200_000

_POINT = "pid int, id string, parent string, depth long, conv_id long, n_convs long, n_leaves long, n_children long, uses long, own long, edge array<long>, ends_sha256 string, border boolean"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (array of (order, h: hash of role and text, w: words of the text)). Texts stay behind here; only hashes move on."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    h = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), h.alias("h"), words.alias("w")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # null turns first, equal ones by hash


def rebuilt(own: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """Each conversation with the first h turns of its family's first conversation in place of its own, h by the id's checksum."""
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, openings - 1).alias("_opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).cast("int")
    rows = own.withColumn("_of", F.col("conv_id") - F.col("conv_id") % family).join(first, F.col("_of") == F.col("_first"), "left")
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("_opening", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def distinct_sequences(own: DataFrame, passing: Written) -> DataFrame:
    """Conversations with the same turns become one row: key (hashes of the turns one after another), w (words of each turn), conv_id (least), n (number), ends_sha256 (digest of all their ids in order).

    Ids are joined to pieces of at most 2**ID_BITS of them first. Only where a text has several pieces they meet, in order, in a task that holds one piece at a time: the digest has no other way.
    """
    rows = own.select("conv_id", F.array_join(F.transform("turns", lambda t: t["h"]), "").alias("key"), F.transform("turns", lambda t: t["w"]).alias("w"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    rows = rows.groupBy("key", "w", F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), line.alias("ids"))
    rows = passing.cut(rows.withColumn("seq", F.md5(F.col("key").cast("binary"))))
    one = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min_by("range", "conv_id").alias("range"))
    many = one.where("pieces > 1").select("seq")
    few = rows.join(one.select("seq", "range", F.col("pieces"), F.col("n").alias("_n"), F.col("conv_id").alias("_c")), ["seq", "range"])  # the piece with the least id carries key and words
    few = few.select("seq", "key", "w", F.col("_c").alias("conv_id"), F.col("_n").alias("n"), F.when(F.col("pieces") == 1, F.sha2(F.col("ids").cast("binary"), 256)).alias("_digest"))

    def digests(batches):
        import pyarrow as pa

        seq, state = None, None
        for batch in batches:
            done = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != seq:
                    if seq is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["seq", "digest"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.string()), pa.array([state.hexdigest()], pa.string())], ["seq", "digest"])

    full = rows.join(many, "seq", "left_semi").select("seq", "range", "ids").repartition("seq").sortWithinPartitions("seq", "range").select("seq", "ids").mapInArrow(digests, "seq string, digest string")
    return few.join(full, "seq", "left").select("key", "w", "conv_id", "n", F.coalesce("_digest", "digest").alias("ends_sha256"))


def _common(a: str, b: str) -> int:
    """Turns that two keys have in common from the start; looked for by halves, so that whole stretches are compared at once."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    if a[: high * DIGITS] == b[: high * DIGITS]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGITS : mid * DIGITS] == b[low * DIGITS : mid * DIGITS]:
            low = mid
        else:
            high = mid
    return low


@dataclass
class _Point:
    """An open point on the path to the present conversation; children add to it as they close."""

    depth: int
    owned: bool = True  # counted here, not in the part before
    border: bool = False  # also in another part
    goes_on: bool = False  # the next part has a conversation that begins with this one
    least: int | None = None
    n: int = 0
    leaves: int = 0
    children: int = 0
    uses: int = 0  # sum over the subtree of members times words
    own: int = 0  # sum over the subtree's owned nodes of words
    ends: str | None = None


@dataclass
class _Patricia:
    """The tree of one part of the sorted conversations, a path at a time. Memory follows the longest conversation.

    A part shares the path to its first conversation with the part before (down to `left` turns), and the path to its last one with the part after (down to `right`). Nodes there are points of their own in every part that
    has them; their sums are added up later. The first part that has a node owns it.
    """

    left: int
    rows: list = field(default_factory=list)
    key: str = ""
    words: list = field(default_factory=list)
    path: list = field(default_factory=list)

    def add(self, key: str, w: list, conv_id: int, n: int, ends: str) -> None:
        if not self.path:
            self.key, self.words = key, w
            self.path = [_Point(d, d > self.left, True) for d in range(max(self.left, 0) + 1)]
        else:
            shared = _common(self.key, key)
            self.close(shared)
            self.key, self.words = key, w
        depth = len(w)
        if self.path[-1].depth < depth:
            self.path.append(_Point(depth))
        top = self.path[-1]
        top.least, top.n, top.ends = conv_id if top.least is None else min(top.least, conv_id), top.n + n, ends

    def close(self, depth: int) -> None:
        """Closes all points below depth; a branch at depth becomes a point."""
        while self.path[-1].depth > depth:
            point = self.path.pop()
            if self.path[-1].depth < depth:
                self.path.append(_Point(depth))
            self.out(point, self.path[-1])

    def out(self, point: _Point, over: _Point | None) -> None:
        top = over.depth + 1 if over else 0
        edge, total = [], 0
        for d in range(point.depth, top - 1, -1):  # words from here to the last node before the point
            edge.append(total)
            total += self.words[d - 2] if d > top else 0
        words = sum(self.words[max(top, 1) - 1 : point.depth])
        own_words = self.words[point.depth - 1] if point.depth else 0
        uses, own = point.uses + point.n * own_words, point.own + (own_words if point.owned else 0)
        if point.ends is not None and not point.children:
            point.leaves += not point.goes_on
        name = lambda d: hashlib.md5(self.key[: d * DIGITS].encode()).hexdigest()
        self.rows.append((name(point.depth), name(over.depth) if over else None, point.depth, point.least, point.n, point.leaves, point.children, uses, own, edge[::-1], point.ends, point.border))
        if over:
            over.least = point.least if over.least is None else min(over.least, point.least)
            over.n += point.n
            over.leaves += point.leaves
            over.children += point.owned
            over.uses += point.uses + point.n * words
            over.own += point.own + (words if point.owned else 0)

    def end(self, right: int) -> None:
        """After the last conversation: points at all depths that the next part has too, then everything closes."""
        if not self.path:
            return
        have = {p.depth: p for p in self.path}
        for d in range(max(right, 0) + 1):
            if d not in have:
                have[d] = _Point(d)
            have[d].border = True
        self.path = [have[d] for d in sorted(have)]
        if right == self.path[-1].depth and self.path[-1].ends is not None:
            self.path[-1].goes_on = True
        while self.path:
            point = self.path.pop()
            self.out(point, self.path[-1] if self.path else None)


def points(sequences: DataFrame, passing: Written, part_rows: int = PART_ROWS) -> DataFrame:
    """The compressed tree: one row per point with its edge. Sorted parts make trees of their own, and the sums of nodes on the parts' borders are added up."""
    import pyarrow as pa

    spark = sequences.sparkSession
    sequences = passing.cut(sequences)
    parts = max(1, -(-sequences.count() // part_rows))
    ranged = sequences.repartitionByRange(parts, "key").withColumn("pid", F.spark_partition_id())
    ranged = passing.cut(ranged)  # a conversation keeps its part from here on
    borders = ranged.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    around = W.orderBy("pid")  # one row a part

    def shared(batches):
        for batch in batches:
            high, low = (batch.column(c).to_pylist() for c in ("before", "low"))
            yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array([-1 if h is None else _common(h, x) for h, x in zip(high, low, strict=True)], pa.int64())], ["pid", "left"])

    borders = borders.select("pid", "low", F.lag("high").over(around).alias("before")).mapInArrow(shared, "pid int, left long")
    borders = passing.cut(borders).select("pid", "left", F.coalesce(F.lead("left").over(around), F.lit(-1)).alias("right"))
    sides = {r.pid: (r["left"], r["right"]) for r in borders.collect()}  # three numbers a part

    def trees(batches):
        names = [x.split()[0] for x in _POINT.split(", ")]
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64()), pa.string(), pa.bool_()]

        def flush(pid, tree, least=0):
            if len(tree.rows) > least:
                columns = [[pid] * len(tree.rows), *zip(*tree.rows, strict=True)]
                tree.rows = []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        at, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pid"] != at:
                    if tree:
                        tree.end(sides[at][1])
                        yield from flush(at, tree)
                    at, tree = row["pid"], _Patricia(sides[row["pid"]][0])
                tree.add(row["key"], row["w"], row["conv_id"], row["n"], row["ends_sha256"])
                yield from flush(at, tree, 1000)
        if tree:
            tree.end(sides[at][1])
            yield from flush(at, tree)

    made = ranged.repartition(parts, "pid").sortWithinPartitions("pid", "key").mapInArrow(trees, _POINT)
    made = passing.cut(made)
    add = lambda c: F.sum(c).alias(c)
    shared_points = made.where("border").groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[add(c) for c in ("n_convs", "n_leaves", "n_children", "uses", "own")], F.max("edge").alias("edge"), F.max("ends_sha256").alias("ends_sha256")
    )
    inner = made.where(~F.col("border")).select(*shared_points.columns)
    return passing.cut(inner.unionByName(shared_points))


def trie(own: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """own (conv_id, turns) -> one row per node of the trie: conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are told apart by 128-bit hashes of role and text. A null conv_id names no conversation and is left out; null roles and texts are empty; turns with equal numbers (and repeated rows) keep an order by hash; other columns
    are not read; an empty table has no nodes. A conversation's hashes, 32 digits and a number a turn, are one value; copies are merged before the tree is built, so a conversation that very many repeat is one row of it.
    """
    small_batches(own.sparkSession)
    passing = Written(own.sparkSession)
    try:
        found = points(distinct_sequences(own, passing), passing, part_rows)
        over = found.select(F.col("id").alias("_id"), F.col("conv_id").alias("_over"))
        rows = found.join(over, F.col("parent") == F.col("_id"), "left")
        rows = rows.select("*", F.posexplode("edge").alias("_j", "_words"))
        last = F.col("_j") == F.size("edge") - 1
        top = F.col("_j") == 0
        nodes = rows.select(
            "conv_id", (F.col("depth") - F.size("edge") + 1 + F.col("_j")).cast("long").alias("depth"), F.when(top, F.col("_over")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("uses") - F.col("own") + (F.col("n_convs") - 1) * F.col("_words")).alias("saved_tokens"),
            F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
        return passing.keep(nodes)
    finally:
        passing.drop()


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))
