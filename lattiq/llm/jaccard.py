"""Exact n-gram Jaccard self-join: prefix index lists skipped by position and size, with answers of a set taken over from a similar set where they are known already."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, Written, cut, drop_ids, has_bit, id_bit, id_bitmap, maybe_in, mix, slices, table, text_buffers
from .components import components

SHINGLE = 4
#: Sets link when OF * intersection >= PART * union.
PART, OF = 85, 100
#: Counters of the frequency sketch that orders shingles (rare first); any order gives the same links, a good one short index lists.
COUNTERS = 1 << 22
_PAGE = 1 << 12
#: Tasks whose counts are added in one group; groups are added in a second round.
GROUP_TASKS = 256
#: Places of a token in all sets, beyond which its index list is dealt into parts with a leader each: so many at least, and this share of all.
LIST_ROWS, LIST_SHARE = 1 << 16, 1 << 16


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word window, in the order of the texts; a text of fewer words gives its whole sequence."""
    n = np.diff(w.first)
    k = len(w.hash)
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(k, np.uint64)
    left = w.first[1:][w.doc] - np.arange(k)  # words from here to the end of the text
    for j in range(size):
        more = left > j
        h[more] = h[more] * np.uint64(0x9E3779B97F4A7C15) + w.hash[np.flatnonzero(more) + j]
        h[~more] = h[~more] * np.uint64(0xC2B2AE3D27D4EB4F)
    keep = (left >= size) | ((np.arange(k) == w.first[w.doc]) & (n[w.doc] < size))
    return mix(h[keep]), w.doc[keep]


def _sketch(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """A class per counter, growing with how many shingles of the whole corpus fall there. What reaches the driver is COUNTERS bytes, whatever the input."""

    def count(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for whole in batches:
            for batch in slices(whole, text_col):
                h, _ = shingles(Words(*text_buffers(batch.column(text_col))), size)
                met, n = np.unique((h >> np.uint64(42)).astype(np.int64), return_counts=True)
                total[met] += n.astype(np.uint32)
        part = TaskContext.get().partitionId() // GROUP_TASKS
        for page in range(COUNTERS // _PAGE):
            own = total[page * _PAGE : (page + 1) * _PAGE]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([part], pa.int64()), pa.array([own.astype(np.int64).tobytes()], pa.binary())], names=["page", "part", "counts"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_PAGE, np.int64)
        for data in pdf["counts"]:
            total += np.frombuffer(data, np.int64)
        return pd.DataFrame({"page": [key[0]], "counts": [total.tobytes()]})

    def grade(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(add(key, pdf)["counts"][0], np.int64)
        return pd.DataFrame({"page": [key[0]], "classes": [np.minimum(127, (4 * np.log2(1 + total)).astype(np.int64)).astype(np.uint8).tobytes()]})

    pages = docs.select(text_col).mapInArrow(count, "page long, part long, counts binary").groupBy("page", "part").applyInPandas(add, "page long, counts binary")
    pages = pages.groupBy("page").applyInPandas(grade, "page long, classes binary").toPandas()
    out = np.zeros(COUNTERS, np.uint8)
    for page, data in zip(pages["page"], pages["classes"], strict=True):
        out[page * _PAGE : (page + 1) * _PAGE] = np.frombuffer(data, np.uint8)
    return out


def _tokens(batch, text_col: str, size: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 63-bit tokens in the global order (class, then hash), their texts, and the bounds of the texts."""
    h, doc = shingles(Words(*text_buffers(batch.column(text_col))), size)
    token = (classes[(h >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h & np.uint64(2**56 - 1))
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        token, doc = token[new], doc[new]
    return token.astype(np.int64), doc, np.searchsorted(doc, np.arange(batch.num_rows + 1))


def _lists(token: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(token))


def _prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, part: int, of: int, classes) -> DataFrame:
    """id, k (id_col), n (set size), f1 and f2 (fingerprint of the set), prefix: the first tokens, of which any linked set must share one."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                token, doc, first = _tokens(batch, text_col, size, classes.value)
                n = np.diff(first)
                u = token.astype(np.uint64)
                sums = [np.concatenate([[0], np.cumsum(mix(u + np.uint64(s)))]).astype(np.uint64) for s in (0x51ED270B, 0x7FEB352D)]
                f1, f2 = ((s[first[1:]] - s[first[:-1]]).astype(np.int64) for s in sums)
                short = n - (part * n + of - 1) // of + 1
                keep = np.arange(len(token)) - first[doc] < short[doc]
                bounds = np.concatenate([[0], np.cumsum(np.minimum(short, n))])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column(id_col), pa.array(n), pa.array(f1), pa.array(f2), _lists(token[keep], bounds)], names=["id", id_col, "n", "f1", "f2", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", id_col, text_col).mapInArrow(run, f"id {kind}, {id_col} long, n long, f1 long, f2 long, prefix array<long>")


def _close(part: int, of: int, na: str, nb: str, pa_: str, pb: str):
    """Whether two sets that share a token at places pa and pb can link: by their sizes, and by the tokens that are left behind the places."""
    sizes = F.expr(f"least({na}, {nb}) * {of} >= greatest({na}, {nb}) * {part}")
    left = F.expr(f"({of} + {part}) * least({na} - {pa_}, {nb} - {pb}) >= {part} * ({na} + {nb})")
    return sizes & left


def _verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, classes, part: int, of: int, repeated: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """pairs (a, b) -> a, b, distance (1 - similarity), linked. repeated: a bitmap with the ids that several rows have, equal ones, of which one is enough.

    Sets are built again from the texts of the documents in pairs only (found by a bitmap in the scan), and each meets its pairs in a join: a set with very many partners is
    one row on one side, so adaptive execution splits the other side.
    """
    ids = pairs.select(F.col("a").alias(id_col)).unionByName(pairs.select(F.col("b").alias(id_col)))
    bitmap, bits = id_bitmap(ids, id_col, pairs.count() * 2)

    def run(batches):
        for whole in batches:
            own = whole.filter(pa.array(has_bit(bitmap, np.asarray(whole.column("_bit")))))
            for batch in slices(own, text_col):
                token, _, first = _tokens(batch, text_col, size, classes.value)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), _lists(token, first)], names=["id", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    sets = docs.select(id_col, text_col, id_bit(id_col, bits).alias("_bit")).mapInArrow(run, f"id {kind}, tokens array<long>")
    if repeated is not None:
        sets = maybe_in(sets, "id", *repeated, inside=False).unionByName(maybe_in(sets, "id", *repeated).groupBy("id").agg(F.any_value("tokens").alias("tokens")))
    met = pairs.join(sets, pairs["b"] == sets["id"]).select("a", "b", F.col("tokens").alias("_tb"))
    met = met.join(sets, F.col("a") == F.col("id")).select("a", "b", F.size(F.array_intersect("tokens", "_tb")).cast("long").alias("_both"), (F.size("tokens") + F.size("_tb")).cast("long").alias("_sum"))
    union = F.col("_sum") - F.col("_both")
    return cut(met.select("a", "b", (1 - F.col("_both") / union).alias("distance"), (of * F.col("_both") >= part * union).alias("linked")))


def _list_parts(classes: np.ndarray) -> tuple[int, int]:
    """How many places a part of a list may hold, and into how many parts the longest list may be dealt."""
    counts = np.exp2(classes / 4)
    share = max(LIST_ROWS, int(counts.sum()) // LIST_SHARE)
    return share, math.ceil(counts.max() / share)


def _stars(postings: DataFrame, passing: Written, share: int, most: int) -> DataFrame:
    """postings (token, s, n, pos) -> token, s, n, pos, and p, np, pp: set, size and place of the list's leader, the set with the earliest place.

    A list that may hold more than `share` places is dealt into parts, each with a leader of its own; the leaders of the parts form a list once more.
    """
    names = ["token", "s", "n", "pos", "p", "np", "pp"]

    def led(rows: DataFrame, *keys: str) -> DataFrame:
        by = W.partitionBy("token", *keys).orderBy("pos", "n", "s")
        lead = F.first(F.struct("s", "n", "pos")).over(by.rowsBetween(W.unboundedPreceding, 0))
        out = rows.withColumns({"_lead": lead, "_nth": F.row_number().over(by)})
        return out.withColumns({"p": F.col("_lead.s"), "np": F.col("_lead.n"), "pp": F.col("_lead.pos")}).drop("_lead")

    if most <= 1:
        return passing.cut(led(postings).where("_nth > 1").select(*names))
    parts = F.ceil(F.pow(2.0, F.shiftright("token", 56) / 4) / share)
    dealt = passing.cut(led(postings.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("s"), "_parts")), "_part").where("_nth > 1 OR _parts > 1"))
    return dealt.where("_nth > 1").select(*names).unionByName(led(dealt.where("_nth = 1").select("token", "s", "n", "pos")).where("_nth > 1").select(*names))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, part: int = PART, of: int = OF) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links of similarity part / of or more.

    A null text or one without words has an empty set, links with nothing and is its own component; one of fewer words than a shingle is one shingle. Repeated texts share a component.
    Sets have keys of their own, so rows with a null id link others as any row does, and get the component's id, null if no row of it has one; different texts under one id are different rows, and a repeated row is
    one set. An empty table gives no rows; other columns are not read. Steps:

    1. Documents with equal sets become one set. Only a set's prefix in the order of rarity enters the index lists.
    2. In each list, the set with the earliest place leads; the others are checked against it alone (skipped by size and place). Linked ones share its component, and with it all its answers.
       A very frequent token's list is dealt into parts with leaders of their own, which are checked against one another's first.
    3. Lists whose sets are all in one component by now are skipped whole. In the rest, sets of different components are paired block by block of similar size, skipping places too far back and pairs
       that the known distances to the leader rule out (the triangle inequality of the Jaccard distance). A place too far back for any set of a block skips that block before it is joined. So every link
       between components is found, and none inside one is looked for.
    """
    return _joined(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, part, of).select(F.col("id").alias(id_col), "n_shingles", F.col("first.id").alias("component_id"))


def row_key(id_col: str, text_col: str) -> F.Column:
    """64-bit key of a row's id and text; only repeated rows share one."""
    return F.xxhash64(id_col, text_col)


def _joined(docs: DataFrame, size: int, part: int, of: int) -> DataFrame:
    """docs (id, text) -> id, k (row_key), n_shingles, first: the component's first row as a struct (no_id, id, k), by id, nulls last; a row without words is its own."""
    id_col, text_col = "k", "text"
    docs = docs.withColumn("k", row_key("id", "text"))
    passing = Written(docs.sparkSession)
    try:
        return _components(docs, id_col, text_col, size, part, of, passing)
    finally:
        passing.drop()


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, part: int, of: int, passing: Written) -> DataFrame:
    classes = docs.sparkSession.sparkContext.broadcast(_sketch(docs, text_col, size))
    rows = passing.cut(_prefixes(docs, id_col, text_col, size, part, of, classes))
    own = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("k"))
    sets = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("k").alias("s"), F.min(own).alias("first"), F.any_value("prefix").alias("prefix"))
    twice = passing.cut(rows.where("n > 0").groupBy("k").count().where("count > 1").select("k"))
    n_twice = twice.count()
    repeated = id_bitmap(twice, "k", n_twice) if n_twice else None
    postings = sets.select("s", "n", F.posexplode("prefix").alias("pos", "token"))
    star = _stars(postings, passing, *_list_parts(classes.value))
    pairs = cut(star.where(_close(part, of, "n", "np", "pos", "pp")).select(F.col("p").alias("a"), F.col("s").alias("b")).distinct())
    known = _verify(pairs, docs, id_col, text_col, size, classes, part, of, repeated)
    links = known.where("linked").select("a", "b")
    reached = components(links)

    # Lists with sets of more than one component; the leader stands in its own list at distance 0.
    named = reached.select(F.col("node").alias("s"), "component")
    member = star.join(known.select(F.col("a").alias("p"), F.col("b").alias("s"), "distance"), ["p", "s"], "left").select("token", "s", "n", "pos", "p", "distance")
    leaders = star.select("token", F.col("p").alias("s"), F.col("np").alias("n"), F.col("pp").alias("pos"), "p", F.lit(0.0).alias("distance")).distinct()
    member = member.unionByName(leaders).join(named, "s", "left").withColumn("component", F.coalesce("component", "s"))
    member = passing.cut(member)
    open_ = member.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo != _hi").select("token")
    member = member.join(open_, "token").withColumn("block", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(of / part)))).cast("int"))
    # A partner is of the same size block or of the next ones up: similar sizes differ by the factor of a block at most.
    least = lambda b: F.floor(F.exp(b * F.lit(float(np.log(of / part)))) * (1 - 1e-9))  # noqa: E731  sets of block b have as many tokens at least
    near = F.filter(F.array(F.col("block"), F.col("block") + 1, F.col("block") + 2), lambda b: (of + part) * (F.col("n") - F.col("pos")) >= part * (F.col("n") + F.greatest(F.col("n"), least(b))))
    left, right = member.withColumn("block", F.explode(near)), member
    slack = 1 - part / of + 1e-9
    both = left.alias("x").join(right.alias("y"), ["token", "block"])
    both = both.where("x.component != y.component AND (x.n < y.n OR (x.n = y.n AND x.s < y.s))").where(_close(part, of, "x.n", "y.n", "x.pos", "y.pos"))
    both = both.where((F.col("x.p") != F.col("y.p")) | F.coalesce(F.abs(F.col("x.distance") - F.col("y.distance")) <= slack, F.lit(True)))
    more = both.select(F.col("y.s").alias("a"), F.col("x.s").alias("b")).distinct()
    seen = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = cut(more.join(seen, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = _verify(more, docs, id_col, text_col, size, classes, part, of, repeated).where("linked").select("a", "b")
        if not found.isEmpty():  # components known so far stand for their links
            reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    found = passing.cut(sets.select("f1", "f2", "n", "s", "first").join(reached.select(F.col("node").alias("s"), "component"), "s", "left"))
    heads = found.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("_head"))
    linked = found.where("component IS NOT NULL").join(heads, "component").select("f1", "f2", "n", F.col("_head").alias("first"))
    found = linked.unionByName(found.where("component IS NULL").select("f1", "f2", "n", "first"))
    some = rows.where("n > 0").drop("prefix").join(found, ["f1", "f2", "n"]).select("id", "k", F.col("n").alias("n_shingles"), "first")
    none = rows.where("n = 0").select("id", "k", F.col("n").alias("n_shingles"), own.alias("first"))
    out = cut(some.unionByName(none))
    classes.destroy()
    return out


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, part: int = PART, of: int = OF) -> DataFrame:
    """docs with one document of each component, the one of the smallest id, which a null id never is while there is another. Rows with equal id and text are brought to one; different texts under one id are
    documents of their own. Documents without words stay, and so do all of them without an id."""
    found = _joined(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, part, of)
    keyed = docs.withColumn("_k", row_key(id_col, text_col))
    out = drop_ids(keyed, found.where(F.col("first.k") != F.col("k")).select(F.col("k").alias("_k")), "_k")
    twice = cut(found.where("first.k = k AND (id IS NOT NULL OR n_shingles > 0)").groupBy(F.col("k").alias("_k")).count().where("count > 1").select("_k"))
    n = twice.count()
    if n:
        bitmap, bits = id_bitmap(twice, "_k", n)
        rest = maybe_in(out, "_k", bitmap, bits)
        stay = rest.join(twice, "_k", "left_anti").select(*out.columns)
        out = maybe_in(out, "_k", bitmap, bits, inside=False).unionByName(stay).unionByName(rest.join(twice, "_k", "left_semi").select(*out.columns).dropDuplicates(["_k"]))
    return out.drop("_k")
