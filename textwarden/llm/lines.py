"""Removal of boilerplate lines that spread over many sites (operator 3), in DataFrame functions only.

A HyperLogLog sketch of sites per line hash, merged by aggregation, estimates how many sites show a line. Where the
estimate is too near the threshold to tell, the distinct sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: A line goes from every document when so many sites show it.
MIN_SITES = 5
#: Code points that a line has at least, trimmed: lines of blanks alone stay.
MIN_CHARS = 1
#: log2 of the registers of a sketch, and how near an estimate is counted again: a share of the threshold (over six
#: standard errors of the sketch) and sites.
SKETCH_LG_K, NEAR_SHARE, NEAR_SITES = 12, 0.1, 2
#: What is cut from both ends of a line before it is compared.
TRIM = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIM))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_hash of the lines (line_hash, site) that at least min_sites distinct sites show; null sites don't count."""
    low, high = min_sites - max(NEAR_SITES, NEAR_SHARE * min_sites), min_sites + max(NEAR_SITES, NEAR_SHARE * min_sites)
    sketches = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LG_K)).alias("sketch"))
    spread = sketches.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low)
    spread = stored(spread)
    near = spread.filter(F.col("sites") <= high).select("line_hash")
    pairs = lines.join(near, "line_hash", "left_semi").groupBy("line_hash", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line_hash").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(F.col("sites") > high).select("line_hash").unionByName(exact.select("line_hash"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows and columns of docs, text without boilerplate lines, and n_lines, n_removed (long).

    Lines are split at \\n and compared with ASCII blanks cut from their ends; the lines that stay keep theirs. A null
    text stays null (no lines); an empty one has one, empty, line. A null site counts for no line; with min_sites
    1 every line that some site shows goes. Repeated rows stay repeated; rows that share an id are told apart by their texts. Lines shown by equally many sites are judged alike. An empty table
    gives no rows. Columns of docs named n_lines or n_removed are replaced. A text of any length is split whole in its task.
    """
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(text).alias("row_hash"), F.col(f"`{site_col}`").cast("string").alias("site"), text.alias("text"))
    lines = keyed.select("row_id", "row_hash", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("row_id", "row_hash", "site", "pos", _trimmed(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars)
    # 128 bits, of two seeds, so that no two lines of any corpus share a hash.
    lines = lines.select("row_id", "row_hash", "site", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("line_hash"))
    # What is joined on the line's hash is written first: then Spark can split the rows of a line that is everywhere.
    # Only lines with enough occurrences, and if several sites are asked for on more than one, can spread; these sums are exact and keep no strings.
    site_hash = F.when(F.col("site").isNotNull(), F.xxhash64("site"))
    seen = lines.groupBy("line_hash").agg(F.count("site").alias("n"), F.min(site_hash).alias("a"), F.max(site_hash).alias("b"))
    several = F.col("a") != F.col("b") if min_sites > 1 else F.lit(True)
    repeated = stored(seen.filter((F.col("n") >= min_sites) & several).select("line_hash"))
    found = stored(lines.join(repeated, "line_hash", "left_semi"))
    spread = stored(spread_lines(found.select("line_hash", "site"), min_sites))
    removed = found.join(spread, "line_hash", "left_semi").groupBy("row_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("_removed"))
    removed = removed.select(F.col("row_id").alias("_row_id"), F.col("row_hash").alias("_row_hash"), "_removed")
    base = docs.drop("n_lines", "n_removed")
    joined = base.join(removed, F.col(f"`{id_col}`").eqNullSafe(F.col("_row_id")) & (F.xxhash64(text) == F.col("_row_hash")), "left")
    parts = joined.withColumn("_lines", F.split(text, "\n", -1))
    # The removed places with one before the first line and one after the last: what stays lies between them.
    parts = parts.withColumn("_cuts", F.concat(F.array(F.lit(-1)), F.col("_removed"), F.array(F.size("_lines"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_removed")), lambda i: F.slice("_lines", F.get("_cuts", i) + 2, F.get("_cuts", i + 1) - F.get("_cuts", i) - 1)))
    new_text = F.when(F.col("_removed").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = parts.withColumns({
        "n_lines": F.coalesce(F.when(text.isNotNull(), F.size("_lines")), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.when(F.col("_removed").isNotNull(), F.size("_removed")), F.lit(0)).cast("long"),
        text_col: new_text,
    })
    return out.select(*base.columns, "n_lines", "n_removed")


#: The same rows as the query over `documents`, by exact distinct counts.
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents
), t AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l
), spread AS (
  SELECT bare FROM t WHERE length(bare) >= {MIN_CHARS} GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT t.*, spread.bare IS NOT NULL AS gone FROM t LEFT JOIN spread ON t.bare = spread.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
