"""Secret scans: pattern spans per document, and corpus-wide ownership counts that tell owner-specific credentials from copied examples. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: kind -> (pattern, what a match must satisfy, the part that is the credential); fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Cheap tests that a text must pass before the patterns with positions run.
HINT_ASSIGN = r"(?i:passw|secret|token|api_?key)"
#: Matches of a text whose places are summed up in one list; a text with more has several lists.
RUN = 512
#: A credential counts as copied from place to place if it has more owners, and is in more repositories, than this number and than this share of all owners of the corpus. All others count as live.
MOST_OWNERS, OWNERS_SHARE = 2, 1e-4


_NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _pieces(text: Column, pattern: str, hint: Column) -> Column:
    """Array of structs (gap, hit): a pattern's leftmost non-overlapping matches, and how many code points stand before each since the last one. Null where the cheap test fails.

    Spark has no function for match positions; the pieces between matches give them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return F.when(hint, F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit")))


def _spans(kind: str, rank: int, pieces: Column, test) -> Column:
    """Array of structs (start, rank, end, kind, value) of the matches that pass the test; code points, end exclusive. Lists are built in runs of RUN matches, so the work grows with the matches and not with their square."""
    some = lambda at: F.struct(at.alias("at"), F.array().cast(_NO_SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(test(pair["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    runs = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(RUN))
    lists = F.aggregate(runs, F.array(some(F.lit(0))), lambda acc, at: F.concat(acc, F.array(F.aggregate(F.slice(pieces, at, RUN), some(F.element_at(acc, -1)["at"]), step))))
    return F.when(F.size(pieces) > 0, F.flatten(F.transform(lists, lambda x: x["out"])))


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: id, the columns in keep, found (array of base spans by start, then kind as listed); null texts are empty."""
    text = F.col("_text")
    value = r".*?[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
    d = df.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.select(id_col, *keep, _pieces(text, ASSIGN, text.rlike(HINT_ASSIGN)).alias("_assign"), _pieces(text, ACCESS, text.contains("AKIA")).alias("_access"), _pieces(text, HEX, text.rlike(HEX)).alias("_hex"))
    assign = _spans("assign", 0, F.col("_assign"), lambda hit: F.char_length(F.regexp_extract(hit, value, 1)) >= 6)
    access, hexes = _spans("access", 1, F.col("_access"), lambda hit: F.lit(True)), _spans("hex", 2, F.col("_hex"), lambda hit: F.lit(True))
    both = F.concat(*[F.coalesce(x, F.array().cast(_NO_SPANS)) for x in (assign, access, hexes)])
    return d.select(id_col, *keep, F.array_sort(both).alias("found"))


def _credential(kind: Column, hit: Column) -> Column:
    """The credential itself: what follows the assignment, or the whole match."""
    return F.when(kind == "assign", F.regexp_extract(hit, r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)).otherwise(hit)


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates (secret, owner, repository) -> secret, owners, repositories: distinct ones over the whole corpus.

    Equal candidates are merged in each task before anything is counted, so a widely copied example costs a row per owner, repository and task at most.
    """
    return candidates.groupBy("secret").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", most_owners: int = MOST_OWNERS, owners_share: float = OWNERS_SHARE) -> DataFrame:
    """Per document: id, base (spans by pattern), live (spans of credentials that aren't widely copied), copied (number of spans of widely copied ones), owners and repositories (the most that any of its credentials has, 0 without one).

    A credential is widely copied if it has more than most_owners owners and is in more than so many repositories, and more than the share owners_share of all owners: what two owners have in common, or one owner has in
    very many repositories, is live. Null texts are empty, null owners and repositories count as one nameless owner and repository. Rows with one id, equal ones and those with a null id included, are judged each by its own
    spans. Documents without a span keep empty arrays. Other columns are not read. The corpus-wide count works on hashes of candidates, so only documents with a candidate are shuffled, and each meets the counts
    in a join with one row per credential on their side, which adaptive execution splits where a credential is in very many documents.
    """
    return _scan(df, id_col, text_col, owner_col, repository_col, most_owners, owners_share).drop("_text_hash")


def _scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str, most_owners: int, owners_share: float) -> DataFrame:
    owner, repository = F.coalesce(F.col(owner_col).cast("string"), F.lit("")), F.coalesce(F.col(repository_col).cast("string"), F.lit(""))
    own = df.select(F.col(id_col), F.col(text_col), owner.alias("_owner"), repository.alias("_repository"), F.xxhash64(text_col).alias("_text_hash"))
    rows = cut(base_spans(own, id_col, text_col, ("_owner", "_repository", "_text_hash")).withColumn("_row", F.monotonically_increasing_id()))  # written once, so that a row keeps its number
    bound = max(most_owners, owners_share * rows.agg(F.count_distinct("_owner")).first()[0])
    some = rows.where(F.size("found") > 0).select("_row", "_owner", "_repository", F.explode("found").alias("span"))
    some = some.withColumn("secret", F.sha2(_credential(F.col("span.kind"), F.col("span.value")), 256))
    counts = ownership(some.select("secret", F.col("_owner").alias("owner"), F.col("_repository").alias("repository")))
    copied = (F.col("owners") > bound) & (F.col("repositories") > bound)
    at = some.select("_row", "span", "secret").join(counts, "secret").groupBy("_row").agg(F.collect_list(F.when(~copied, F.col("span"))).alias("_live"), F.max("owners").alias("owners"), F.max("repositories").alias("repositories"))
    full = rows.where(F.size("found") > 0).join(at, "_row").select(id_col, "_text_hash", "found", F.array_sort("_live").alias("live"), "owners", "repositories")
    bare = rows.where(F.size("found") == 0).select(id_col, "_text_hash", "found", F.col("found").alias("live"), F.lit(0).cast("long").alias("owners"), F.lit(0).cast("long").alias("repositories"))
    return full.unionByName(bare).select(id_col, "_text_hash", F.col("found").alias("base"), "live", (F.size("found") - F.size("live")).alias("copied"), "owners", "repositories")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and joined spans of the contract, and the most owners and repositories of a credential; a live span is listed once more under the kind live, after the base kinds at its start."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.transform("live", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("live").alias("kind"), F.lit("").alias("value")))
    return found.select(
        id_col, n("assign"), n("access"), n("hex"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.array_sort(F.array_distinct(F.concat("base", live)))).alias("spans"), "owners", "repositories"
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """df with every live credential's span replaced by mark; other rows and columns stay as they are.

    Texts that fail the cheap pattern tests can't have a span and pass by; the rest meet their spans in a join by id, null ones included, and text, so rows that share an id are treated each. Overlapping
    spans are replaced as one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hint = text.rlike(HINT_ASSIGN) | text.contains("AKIA") | text.rlike(HEX)
    live = _scan(df, id_col, text_col, owner_col, repository_col, MOST_OWNERS, OWNERS_SHARE).where(F.size("live") > 0)
    live = live.groupBy(F.col(id_col).alias("_id"), F.col("_text_hash").alias("_of")).agg(F.array_sort(F.first("live")).alias("_live"))
    at = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        new = span["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, span["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_live", at, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.char_length(text_col))))
    some = df.where(hint).join(live, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_of")), "left")
    some = some.withColumn(text_col, F.when(F.col("_live").isNull(), F.col(text_col)).otherwise(done)).select(*df.columns)
    return df.where(~hint).unionByName(some)
