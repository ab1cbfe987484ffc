"""Secrets in texts, told apart by who owns them (operator 2), in DataFrame functions only.

Candidates are found by pattern. Their hashes are aggregated over the corpus by distinct repositories and owners: a
value that several owners show is a copied example, one that stays with its owner is live-looking. The values of
live-looking assignments are then looked for where they stand bare (kind `known`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Kinds in the order of the report: pattern, group of the value, characters that the value has at least.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: Tokens of so many characters with a digit that can be a known value: from a token's start on, up to its end.
BARE_CHARS = 12
BARE = r"((?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_.=-]{12})[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+)"
ORDER = ["assign", "access", "hex", "known"]
#: A value is an example if so many owners show it, or two owners and so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
MASK = "[SECRET]"


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Of every match, in order: kind, place, match, value, characters between the match before and this one."""
    found, values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), values.alias("v"), F.transform(between, F.char_length).alias("b")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.char_length(x["m"]).alias("n"), x["v"].alias("value"), x["b"].alias("between")),
    )
    rows = F.filter(rows, lambda x: x["n"].isNotNull())  # what follows the last match is no match
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """row_id, row_hash, repository, owner, kind, start, end (code points, end exclusive), value: a row per match that holds."""
    text = F.col("text")
    keyed = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(f"`{text_col}`").alias("row_hash"), F.col(f"`{repository_col}`").cast("string").alias("repository"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{text_col}`").alias("text"))
    arrays = [F.coalesce(_matches(text, kind, pattern, group), F.array()) for kind, (pattern, group, _) in KINDS.items()]
    arrays.append(F.coalesce(_matches(text, "known", BARE, 1), F.array()))
    rows = keyed.select("row_id", "row_hash", "repository", "owner", F.explode(F.concat(*arrays)).alias("c"))
    rows = rows.select("row_id", "row_hash", "repository", "owner", "c.*")
    # Repeated rows of one id and text give the same matches.
    rows = rows.dropDuplicates(["row_id", "row_hash", "repository", "owner", "kind", "place"])
    w = Window.partitionBy("row_id", "row_hash", "repository", "owner", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("between") + F.col("n")).over(w)).withColumn("start", F.col("end") - F.col("n"))
    least = F.lit(BARE_CHARS)
    for kind, (_, _, n) in KINDS.items():
        least = F.when(F.col("kind") == kind, n).otherwise(least)
    return rows.filter(F.char_length("value") >= least).select("row_id", "row_hash", "repository", "owner", "kind", "start", "end", "value")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """value_hash, n_owners, n_repositories, assigned (some match is an assignment), live of each candidate value."""
    by_value = found.groupBy("value_hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"), F.max(F.col("kind") == "assign").alias("assigned"))
    example = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= example_repositories))
    return by_value.withColumn("live", ~example)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """The rows and columns of docs and `secrets`: array of struct(start, rank, end, kind, live) in order of start, then kind.

    Spans of the kinds assign, access and hex are all there, examples or not; `known` spans are bare tokens whose value
    is assigned elsewhere, is live-looking, and lies outside the other spans. A null text, like an empty one, has none. Repeated rows
    each have theirs; rows that share an id are told apart by their texts. Spans that begin at one place go by kind. Null owners and
    repositories don't count; a row's repository and owner are columns of the caller's choice. An empty table gives no rows. A column named
    secrets is replaced. A text of any length is scanned whole in its task, by Spark's own patterns.
    """
    found = candidates(docs, id_col, text_col, repository_col, owner_col).withColumn("value_hash", F.sha2(F.col("value").cast("binary"), 256)).drop("value")
    # Both sides are written first: then Spark can split the rows of a value that is everywhere.
    found = stored(found)
    # Where a value stands bare counts as well, of values that some pattern has found.
    candidate = stored(found.filter("kind <> 'known'").select("value_hash").distinct())
    owned = stored(ownership(found.join(candidate, "value_hash", "left_semi")).withColumnRenamed("value_hash", "owned_hash"))
    judged = found.join(owned, F.col("value_hash") == F.col("owned_hash"), "left").filter((F.col("kind") != "known") | (F.col("assigned") & F.col("live")))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    spans = judged.select("row_id", "row_hash", F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"), F.col("live")).alias("s"))
    # known spans give way to the others: the furthest end of those that begin no later, and the next that begins.
    back = Window.partitionBy("row_id", "row_hash").orderBy("s.start", "s.rank").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("row_id", "row_hash").orderBy("s.start", "s.rank").rowsBetween(0, Window.unboundedFollowing)
    base = F.col("s.kind") != "known"
    spans = spans.withColumn("_end", F.max(F.when(base, F.col("s.end"))).over(back)).withColumn("_next", F.min(F.when(base, F.col("s.start"))).over(on))
    spans = spans.filter(base | ((F.coalesce("_end", F.lit(0)) <= F.col("s.start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("s.end")))))
    by_doc = spans.groupBy("row_id", "row_hash").agg(F.sort_array(F.collect_set("s")).alias("secrets"))
    by_doc = by_doc.select(F.col("row_id").alias("_row_id"), F.col("row_hash").alias("_row_hash"), "secrets")
    base_docs = docs.drop("secrets")
    # The hash is taken before the join, which then needs no text where the caller needs none.
    joined = base_docs.withColumn("_own_hash", F.xxhash64(f"`{text_col}`")).join(by_doc, F.col(f"`{id_col}`").eqNullSafe(F.col("_row_id")) & (F.col("_own_hash") == F.col("_row_hash")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,live:boolean>>")
    return joined.select(*base_docs.columns, F.coalesce("secrets", none).alias("secrets"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of each document."""
    spans = F.col("secrets")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "known")
    return scanned.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        *(F.array_size(F.filter(F.transform(spans, lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, line), ",").alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def mask(scanned: DataFrame, text_col: str = "text", masked: str = MASK) -> DataFrame:
    """scanned without `secrets`; its live-looking spans are replaced in the text, examples stay. Overlapping spans are one."""
    text = F.col(f"`{text_col}`")
    live = F.array_sort(F.filter("secrets", lambda s: s["live"]))
    # Of the spans in order of start, those that begin at or after every end before them start a mask; its end is the furthest.
    start = F.struct(F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("done"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    step = lambda acc, s: F.when(s["start"] >= acc["b"], F.struct(F.concat(F.coalesce(acc["done"], F.array().cast("array<struct<a:bigint,b:bigint>>")), F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))).alias("done"), s["start"].alias("a"), s["end"].alias("b"))).otherwise(F.struct(acc["done"].alias("done"), acc["a"].alias("a"), F.greatest(acc["b"], s["end"]).alias("b")))
    merged = F.aggregate(live, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
    # The first of `merged` is the empty span at 0.
    with_masks = scanned.withColumn("_masks", F.when(F.size(live) > 0, merged))
    after = lambda i: F.get("_masks", i)["b"].cast("int")
    until = lambda i: F.coalesce(F.get("_masks", i + 1)["a"].cast("int"), F.char_length(text))
    pieces = F.transform(F.sequence(F.lit(0), F.size("_masks") - 1), lambda i: F.substring(text, after(i) + 1, until(i) - after(i)))
    return with_masks.withColumn(text_col, F.when(F.col("_masks").isNull(), text).otherwise(F.array_join(pieces, masked))).drop("_masks", "secrets")
