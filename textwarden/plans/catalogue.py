"""The registered queries over facts, sentences, reviews, documents and events, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import masking
from ..functions import text as tx
from ..functions.dims import STOP_WORDS
from ..operators import coverage, facts, mutation, overlap, packet, quiz, quotes, recheck, review, rollup, sentences, snapshots
from ..sources import readers
from ..streaming import streams
from . import inputs
from .inputs import EXPECTED, FACTS, SENTENCES

from .registry import QUERIES, SQL, Query, query, spread
from .registry import table as _table


def _checked(spark: SparkSession, sf_dir: str, *kept: str, only: list[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """The projected sentences (KEY and kept) with their risk and checks (of `only`)."""
    lines = inputs.lines_by_case(spark, sf_dir) if lines is None else lines
    said = inputs.sentences(spark, sf_dir, lines).select("case_id", "sent_id", "text_en", "fact_ids")
    return sentences.checked(said, inputs.facts_of_cases(spark, sf_dir, lines=lines), only=only, buckets=inputs.buckets_of(spark, sf_dir)).select("case_id", "sent_id", *kept, "risk", "checks")


# ------------------------------------------------------------------ statuses of cases


@query(f"""
WITH r AS (SELECT case_id, count(*) AS sentences, count(*) FILTER (WHERE status = 'green') AS green, count(*) FILTER (WHERE status = 'amber') AS amber,
    count(*) FILTER (WHERE status = 'red') AS red, count(*) FILTER (WHERE risk = 'high') AS high_risk, count(*) FILTER (WHERE status <> 'green' OR risk = 'high') AS needs_review
  FROM ({EXPECTED}) GROUP BY case_id)
SELECT *, CASE WHEN red * 1.0 / sentences > 0.3 THEN 'interpreter' ELSE 'standard' END AS route FROM r
""")
def packet_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.case_status(rollup.with_status(_checked(spark, sf_dir)))


def _one_check(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _checked(spark, sf_dir, "text_en", only=[name]).select("case_id", "text_en", F.get("checks", F.lit(0))["status"].alias("status"))
        return rows.groupBy("case_id", "text_en").agg(F.count("status").alias("n"), F.max("status").alias("status"))

    return run


for _name, _column, _check in (("sentence_citation_check", "citation", "citation"), ("sentence_numbers_check", "numbers", "numbers"), ("sentence_drug_check", "drug_check", "drug"), ("sentence_polarity_check", "polarity", "meaning_polarity"), ("sentence_units_check", "units", "units")):
    QUERIES[_name] = _one_check(_check)
    SQL[_name] = f"SELECT case_id, text_en, count({_column}) AS n, max({_column}) AS status FROM ({EXPECTED}) GROUP BY case_id, text_en"


@query(f"""
WITH l AS (SELECT CASE WHEN citation = 'fail' THEN 'citation' END AS a, CASE WHEN numbers = 'fail' THEN 'numbers' END AS b,
    CASE WHEN drug_check IS NOT NULL THEN 'drug' END AS c, CASE WHEN polarity IS NOT NULL THEN 'meaning_polarity' END AS d, CASE WHEN units IS NOT NULL THEN 'units' END AS e FROM ({EXPECTED}))
SELECT name, count(*) AS n FROM (SELECT unnest([a, b, c, d, e]) AS name FROM l) WHERE name IS NOT NULL GROUP BY name
""")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.issue_histogram(_checked(spark, sf_dir).select(F.explode("checks").alias("c")).select("c.name", "c.status"))


@query(f"""
SELECT risk, count(*) FILTER (WHERE status = 'green') AS green, count(*) FILTER (WHERE status = 'amber') AS amber, count(*) FILTER (WHERE status = 'red') AS red
FROM ({EXPECTED}) GROUP BY risk
""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rollup.with_status(_checked(spark, sf_dir))
    return judged.groupBy("risk").pivot("status", ["green", "amber", "red"]).agg(F.count(F.lit(1))).na.fill(0)


def _blockers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = inputs.lines_by_case(spark, sf_dir)
    judged = rollup.with_status(_checked(spark, sf_dir, lines=lines)).withColumn("removed", F.lit(False))
    own = inputs.facts_of_cases(spark, sf_dir, lines=lines)
    cases = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "facts").otherwise("ready").alias("stage"))
    missing = coverage.omissions(own, inputs.sentences(spark, sf_dir, lines))
    part = F.col("p_partkey")
    # Some facts aren't in the source, some of those are dismissed; some medicines disagree, some of those are resolved.
    found = own.select("case_id", "fact_id", F.when(part % 17 == 0, "red").otherwise("green").alias("status"), (part % 2 == 0).alias("dismissed"))
    issues = own.filter(part % 19 == 0).select("case_id", "drug", (part % 3 == 0).alias("resolved"))
    return cases, rollup.blockers(judged, missing, found, issues, cases)


def _omissions_sql(facts_from: str, told_by: str) -> str:
    return f"""
SELECT f.case_id, f.fact_id, unnest([
    CASE WHEN s.n IS NULL THEN 'not_explained'
         WHEN f.med_action IN ('new', 'changed', 'continue') AND NOT dose_said THEN 'dose_never_stated' END,
    CASE WHEN s.n IS NOT NULL AND NOT named THEN 'never_named'
         WHEN s.n IS NOT NULL AND f.med_action IN ('stop', 'hold') AND NOT stop_said THEN 'stop_not_clear' END]) AS rule
FROM (SELECT DISTINCT case_id, fact_id, med_action FROM ({facts_from})) f
LEFT JOIN (SELECT case_id, fact_id, count(*) AS n, bool_or(k <> 0) AS dose_said, bool_or(k <> 1) AS named, bool_or(k NOT IN (1, 2)) AS stop_said
           FROM ({told_by}) WHERE k <> 3 GROUP BY case_id, fact_id) s USING (case_id, fact_id)
"""


_OMISSIONS = _omissions_sql(SENTENCES, SENTENCES)


@query(f"SELECT case_id, fact_id, rule FROM ({_OMISSIONS}) WHERE rule IS NOT NULL")
def coverage_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.lines_by_case(spark, sf_dir)
    return coverage.omissions(inputs.facts_of_cases(spark, sf_dir, lines=lines), inputs.sentences(spark, sf_dir, lines))


_BLOCKED = f"""
SELECT o_orderkey AS case_id, 'not_ready' AS source FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT case_id, 'sentence' FROM ({EXPECTED}) WHERE status <> 'green' OR risk = 'high'
UNION ALL SELECT case_id, 'omission' FROM ({_OMISSIONS}) WHERE rule IS NOT NULL
UNION ALL SELECT case_id, 'fact' FROM (SELECT DISTINCT case_id, p_partkey FROM ({SENTENCES})) WHERE p_partkey % 17 = 0 AND p_partkey % 2 <> 0
UNION ALL SELECT case_id, 'medicine' FROM (SELECT DISTINCT case_id, p_partkey FROM ({SENTENCES})) WHERE p_partkey % 19 = 0 AND p_partkey % 3 <> 0
"""


@query(f"SELECT case_id, source, count(*) AS n FROM ({_BLOCKED}) GROUP BY case_id, source")
def blockers_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blockers(spark, sf_dir)[1].groupBy("case_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT case_id FROM ({_BLOCKED}))")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, found = _blockers(spark, sf_dir)
    return rollup.releasable(cases, found).select("case_id")


_WAITING = f"""
SELECT case_id, 0 AS rank, fact_id AS o, fact_id AS id, 'red' AS state FROM ({_OMISSIONS}) WHERE rule IS NOT NULL
UNION ALL SELECT case_id, 3, text_en, text_en, CASE WHEN status = 'green' THEN 'high' ELSE status END FROM ({EXPECTED}) WHERE status <> 'green' OR risk = 'high'
"""


@query(f"SELECT case_id, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY rank, o) AS INTEGER) AS place, id, state, count(*) AS n FROM ({_WAITING}) GROUP BY case_id, rank, o, id, state")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a reviewer in each case, in order: omissions, then sentences; equal ones share a place."""
    lines = inputs.lines_by_case(spark, sf_dir)
    own, said = inputs.facts_of_cases(spark, sf_dir, lines=lines), inputs.sentences(spark, sf_dir, lines)
    judged = rollup.with_status(_checked(spark, sf_dir, "text_en", lines=lines))
    none = own.select("case_id", F.col("drug"), F.lit(True).alias("resolved")), own.select("case_id", "fact_id", F.lit("green").alias("status"), F.lit(False).alias("dismissed"))
    listed = judged.select("case_id", F.col("text_en").alias("sent_id"), F.lit(0).alias("pos"), F.lit("medicines").alias("section"), "status", "needs_review", F.lit(False).alias("reviewed"), F.lit(False).alias("removed"))
    found = review.queue(coverage.omissions(own, said), none[0], none[1], listed, by="id")
    return found.groupBy("case_id", "place", "id", "state").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ facts


@query(f"SELECT fact_id, CASE WHEN med_action IN ('stop', 'hold', 'changed') OR drug IN ('warfarin', 'insulin', 'oxycodone') THEN 'high' ELSE 'normal' END AS risk, CAST(dose_n AS VARCHAR) AS dose FROM ({FACTS})")
def fact_risk_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs.load(spark, sf_dir, "part")
    rows = facts.features(spark.sql(inputs.spark_sql(FACTS)))
    return rows.select("fact_id", "risk", F.get(tx.digits_in(F.col("dose")), F.lit(0)).alias("dose"))


@query(f"""
WITH f AS (SELECT *, p_partkey % 11 AS k FROM ({FACTS}))
SELECT fact_id, 'quote' AS name, CASE WHEN k = 1 THEN 'fail' ELSE 'pass' END AS status FROM f
UNION ALL SELECT fact_id, 'numbers', 'fail' FROM f WHERE k = 2
UNION ALL SELECT fact_id, 'drug', 'warn' FROM f WHERE k = 3
UNION ALL SELECT fact_id, 'cross_check', 'warn' FROM f WHERE k = 4
UNION ALL SELECT fact_id, 'classification', 'warn' FROM f WHERE k = 5
""")
def fact_checks_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs.load(spark, sf_dir, "part")
    rows = spark.sql(inputs.spark_sql(FACTS)).withColumn("case_id", F.col("p_partkey")).withColumn("k", F.col("p_partkey") % 11)
    sources = rows.select("case_id", F.when(F.col("k") == 1, "Nothing of it.").otherwise(F.concat(F.lit("Medicines\n"), "source_quote")).alias("source"))
    rows = rows.withColumns({
        "dose": F.when(F.col("k") == 2, F.concat(F.lit("9"), "dose")).otherwise(F.col("dose")),
        "drug": F.when(F.col("k") == 3, "digoxin").otherwise(F.col("drug")),
        "med_action": F.when(F.col("k") == 4, F.when(F.col("med_action") == "new", "hold").otherwise("new")).otherwise(F.col("med_action")),
        "kind": F.when(F.col("k") == 5, "diagnosis").otherwise(F.col("kind")),
    })
    classified = facts.classify(rows.join(sources, "case_id", "left"), source=F.col("source")).drop("source")
    return facts.fact_checks(classified, sources).select("fact_id", "name", "status")


@query("""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'fail' WHEN l.quality = 0 THEN 'warn' WHEN l.quality = 1 THEN 'pass' ELSE 'warn' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def verdict_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "contradicts").when(F.col("quality") == 0, "partially_supported").when(F.col("quality") == 1, "supported").alias("verdict"))
    docs = _table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return docs.select("doc_id", sentences.model_check(F.col("verdict"), F.lit(False)).alias("status"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def uncovered_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ reviewers' work, checked again

#: Of every tenth case: what k = 0 has wrong is edited right, k = 6 is edited wrong, k = 7 and k = 1 (red) are approved, k = 8 is removed, and of k = 9 English
#: alone is edited where there is a translation.
_TOUCHED = "case_id % 10 = 0 AND k IN (0, 1, 6, 7, 8, 9)"


def _rechecked(spark: SparkSession, sf_dir: str) -> recheck.Checked:
    """The stored checks are taken from the keys alone, so that only what is touched is read."""
    lines = inputs.lines_by_case(spark, sf_dir)
    rows = inputs.sentences(spark, sf_dir, lines)
    own = inputs.facts_of_cases(spark, sf_dir, lines=lines)
    k, no = F.col("k"), F.lit(False)
    rows.createOrReplaceTempView("numbered_sentences")
    known = spark.sql(inputs.spark_sql(EXPECTED.replace(f"({SENTENCES})", "numbered_sentences")))
    state = known.select(
        "case_id", "sent_id", "k", "dose_n", (k == 9).alias("translated"), no.alias("judged"), "text_en", F.when(k == 9, "Texto").alias("text_tl"), "fact_ids", F.lit("").alias("back_en"), F.lit(None).cast("string").alias("verdict"),
        no.alias("tl_stale"), no.alias("removed"), F.lit(None).cast("string").alias("review"), "status", "risk", ((F.col("status") != "green") | (F.col("risk") == "high")).alias("needs_review"),
    )
    none = spark.createDataFrame([], "case_id long, sent_id string, seq int, name string, status string")
    stored = recheck.Checked(state, none, coverage.omissions(own, rows))
    right = F.regexp_replace("text_en", F.concat(F.col("dose_n").cast("string"), F.lit("0 ")), F.concat(F.col("dose_n").cast("string"), F.lit(" ")))
    wrong = F.regexp_replace("text_en", F.concat(F.lit(" "), F.col("dose_n").cast("string"), F.lit(" ")), F.concat(F.lit(" "), F.col("dose_n").cast("string"), F.lit("0 ")))
    text = F.when(k == 0, right).when(k == 6, wrong).when(k == 9, F.concat(F.lit("Please: "), "text_en"))
    action = F.when(k.isin(1, 7), "approve").when(k == 8, "remove").otherwise("edit")
    events = state.filter(_TOUCHED).select("case_id", "sent_id", F.lit(1).alias("at"), action.alias("action"), text.alias("text_en"), F.lit(None).cast("string").alias("text_tl"), F.lit(None).cast("array<string>").alias("fact_ids"))
    return recheck.recheck(stored, own, events, streams.new_folder(spark))


@query(f"""
WITH s AS (SELECT *, {_TOUCHED} AS touched FROM ({EXPECTED})),
t AS (SELECT *, CASE WHEN touched AND k = 8 THEN NULL WHEN touched AND k = 0 THEN 'green' WHEN touched AND k IN (6, 9) THEN 'red' ELSE status END AS now,
  CASE WHEN touched AND k = 7 THEN 'approved' WHEN touched AND k IN (0, 6, 9) THEN 'edited' END AS review FROM s)
SELECT case_id, k, now AS status, review, touched AND k = 8 AS removed, touched AND k = 9 AS tl_stale,
  CASE WHEN touched AND k = 8 THEN NULL WHEN touched AND k = 7 THEN false ELSE now <> 'green' OR risk = 'high' END AS needs_review, count(*) AS n
FROM t GROUP BY ALL
""")
def recheck_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rechecked(spark, sf_dir).sentences
    return rows.groupBy("case_id", "k", "status", "review", "removed", "tl_stale", "needs_review").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT name, status, count(*) AS n FROM (
  SELECT unnest([{{'name': 'citation', 'status': 'pass'}}, {{'name': 'numbers', 'status': CASE WHEN k = 6 THEN 'fail' ELSE 'pass' END}},
    CASE WHEN k = 9 THEN {{'name': 'translation_stale', 'status': 'fail'}} END]) AS c
  FROM ({EXPECTED}) WHERE {_TOUCHED} AND k IN (0, 6, 9)), LATERAL (SELECT c.name AS name, c.status AS status) WHERE name IS NOT NULL GROUP BY ALL
""")
def recheck_new_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks made again: of edited sentences only, as none were stored."""
    return _rechecked(spark, sf_dir).checks.groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT case_id, fact_id, rule FROM ({_omissions_sql(SENTENCES, f"SELECT * REPLACE (CASE WHEN {_TOUCHED} AND k = 0 THEN 5 WHEN {_TOUCHED} AND k = 6 THEN 0 ELSE k END AS k) FROM ({SENTENCES}) WHERE NOT ({_TOUCHED} AND k = 8)")}) WHERE rule IS NOT NULL
""")
def recheck_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing after the edits and removals."""
    return _rechecked(spark, sf_dir).omissions


# ------------------------------------------------------------------ errors put in on purpose

_OTHER = inputs.pick(inputs.DRUGS, "((p_partkey + 3) % 7)")


_KINDS = f"""
SELECT *, unnest(['clean', 'number_changed', 'unsupported_sentence', 'hallucinated_medicine', 'wrong_medicine_named', CASE WHEN med_action IN ('stop', 'hold') THEN 'flip_stop_to_keep' END,
  CASE WHEN med_action = 'hold' THEN 'hold_as_permanent_stop' END, CASE WHEN unit IN ('mg', 'ml') THEN 'other_unit' END]) AS mutation FROM ({SENTENCES}) WHERE k >= 5
"""


@query(f"""
SELECT coalesce(mutation, 'all') AS mutation, count(*) AS total, count(*) FILTER (WHERE mutation <> 'clean') AS flagged, count(*) FILTER (WHERE mutation NOT IN ('clean', 'hold_as_permanent_stop')) AS blocked
FROM ({_KINDS}) WHERE mutation IS NOT NULL GROUP BY ROLLUP (mutation)
""")
def mutation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.matrix(_mutated(spark, sf_dir))


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good sentences with errors put in: base, mutation, status, flagged, blocked and n, the sentences that are alike in all this."""
    lines = inputs.lines_by_case(spark, sf_dir)
    said = inputs.sentences(spark, sf_dir, lines).filter("k >= 5").withColumn("other", F.expr(_OTHER))
    good = said.select("case_id", "sent_id", "text_en", "fact_ids", F.struct("drug", "med_action", "other").alias("about"))
    rows = sentences.alike(good, inputs.facts_of_cases(spark, sf_dir, lines=lines), lambda of: mutation.mutants(of.select("*", "about.drug", "about.med_action"), F.col("about.other")))
    worst = rollup.with_status(rows).select("base", "mutation", "status", "n")
    return worst.withColumn("flagged", F.col("status") != "green").withColumn("blocked", F.col("status") == "red")


@query(f"SELECT mutation, CASE mutation WHEN 'hold_as_permanent_stop' THEN 'flagged' ELSE 'blocked' END AS outcome, count(*) AS n FROM ({_KINDS}) WHERE mutation <> 'clean' GROUP BY mutation")
def mutation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the clean sentence: blocked before flagged before slipped."""
    rows = _mutated(spark, sf_dir)
    clean = F.max(F.when(F.col("mutation") == "clean", F.col("status"))).over(Window.partitionBy("base"))
    new = rows.withColumn("clean_status", clean).filter("mutation <> 'clean'")
    outcome = F.when(F.col("blocked") & (F.col("clean_status") != "red"), "blocked").when(F.col("flagged") & (F.col("clean_status") == "green"), "flagged").otherwise("slipped")
    return new.groupBy("mutation", outcome.alias("outcome")).agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ text functions on documents

_EMAIL = r"([\w.+-]+@[\w-]+\.[\w.]*\w)"


@query(rf"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '{_EMAIL}', 1), lambda x: lower(x)))) AS n FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mail addresses, all rules at work, and how many tokens stand for them; each is in the text."""
    docs = masking.mask(spread(_table(spark, sf_dir, "documents")).select("doc_id", "text"), "text")
    mine = F.filter("mapping", lambda m: F.startswith(m["token"], F.lit("[EMAIL_")))
    rows = docs.select("doc_id", F.size(mine).cast("long").alias("n"), F.size(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"\[EMAIL_\d+\]"), F.lit(0)))).alias("tokens"))
    return rows.filter("n > 0 and tokens = n").select("doc_id", "n")


@query("SELECT doc_id, false AS touched FROM documents")
def mask_leaves_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rule has taken a lower-case word of letters for a value: none may."""
    docs = masking.mask(spread(_table(spark, sf_dir, "documents")).select("doc_id", "text"), "text", masking.RULES)
    return docs.select("doc_id", F.exists("mapping", lambda m: m["value"].rlike(r"^\p{Ll}+$")).alias("touched"))


@query()
def mask_counts_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, n: masked values of every kind, with every rule at work. No SQL: the rules need look-around."""
    return masked_kinds(spread(_table(spark, sf_dir, "documents")))


def masked_kinds(docs: DataFrame) -> DataFrame:
    rows = masking.mask(docs.select("doc_id", "text"), "text").select("doc_id", F.explode_outer("mapping").alias("m")).filter("m is not null")  # outer: else the rules are inlined into a filter
    return rows.groupBy("doc_id", masking.kind_of(F.col("m.token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unmask(mask(text)) is the text, with every rule at work."""
    docs = masking.mask(spread(_table(spark, sf_dir, "documents")).select("doc_id", "text"), "text")
    return docs.select("doc_id", F.sha2(masking.unmask(F.col("masked"), F.col("mapping")).cast("binary"), 256).alias("digest"))


@query(r"""
WITH w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS words FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, source, text, len(words) AS n, list_sum(list_transform(words, lambda x: CASE WHEN length(trim(lower(x), '.,;:!?''"()')) = 0 THEN 0 WHEN length(trim(lower(x), '.,;:!?''"()')) <= 3 THEN 1
  ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(trim(lower(x), '.,;:!?''"()'), '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]+'))) END)) AS syl,
  len(list_filter(regexp_split_to_array(text, '[.!?]+(?:\s|$)|\n+'), lambda p: regexp_matches(p, '[A-Za-z]'))) AS sent FROM w),
g AS (SELECT source, CASE WHEN sent = 0 OR n = 0 THEN 0.0 ELSE round(greatest(CAST(0.39 AS DOUBLE) * n / sent + CAST(11.8 AS DOUBLE) * syl / n - CAST(15.59 AS DOUBLE), 0), 1) END AS grade FROM s)
SELECT source, count(*) AS n, CAST(floor(avg(grade)) AS BIGINT) AS grade FROM g GROUP BY source
""")
def readability_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents")).filter("lang = 'en'").select("source", tx.fk_grade(F.col("text")).alias("grade"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("grade")).alias("grade"))


@query(r"SELECT lang, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS words FROM documents GROUP BY lang")
def word_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents")).groupBy("lang").agg(F.sum(tx.word_count(F.col("text"))).cast("decimal(38,0)").alias("words"))


_WORDS = tx.WORD_NUMBERS
_PLAIN_NUMBERS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{3})\b', '\1\2', 'g'), '\[[A-Z_]+_\d+\]', ' ', 'g'), '\b(\d{1,2})\s?h\s?(\d{2})\b', '\1:\2', 'g')"
_NORM = r"regexp_replace(regexp_replace(CASE WHEN contains(replace(x, ',', '.'), '.') THEN regexp_replace(replace(x, ',', '.'), '\.?0+$', '') ELSE x END, '^0+(\d)', '\1'), '^\.', '0.')"
_SAID = "|".join(sorted((w.replace(".", r"\.") for w in _WORDS), key=len, reverse=True))


@query(rf"""
WITH n AS (SELECT doc_id, list_sort(list_distinct(list_concat(
    list_transform(regexp_extract_all({_PLAIN_NUMBERS}, '(?:^|[^0-9A-Za-z.])(\d+(?:[.,]\d+)?)', 1), lambda x: {_NORM}),
    list_transform(regexp_extract_all(text, '(?i)\b({_SAID})\b', 1), lambda x: CASE lower(x) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items())} END)))) AS found FROM documents)
SELECT doc_id, len(found) AS n, array_to_string(found, ' ') AS numbers FROM n WHERE len(found) > 0
""")
def numbers_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What numbers_in finds in each document: decimals, separators and number words included."""
    docs = spread(_table(spark, sf_dir, "documents")).select("doc_id", F.array_sort(tx.numbers_in(F.col("text"))).alias("found"))
    return docs.filter("size(found) > 0").select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", " ").alias("numbers"))


@query()
def number_values_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number: what numbers_in finds, decimals, separators and number words included. No SQL."""
    return number_values(spread(_table(spark, sf_dir, "documents")))


def number_values(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode_outer(F.array_distinct(tx.numbers_in(F.col("text")))).alias("number")).filter("number is not null")


@query(r"SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{0e00}-\x{0e7f}]')) AS n FROM documents GROUP BY lang")
def foreign_script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents")).groupBy("lang").agg(F.count_if(lex.foreign_script(F.col("text"), "en") != "").alias("n"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item word for word: met over inner words, then compared whole."""
    return quotes.exact(_table(spark, sf_dir, "benchmark"), spread(_table(spark, sf_dir, "documents")))


@query()
def quote_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc_id: items that a document holds word for word or nearly. No SQL: the similarity is the standard library's; tests compare all pairs."""
    return quotes.near(_table(spark, sf_dir, "benchmark"), spread(_table(spark, sf_dir, "documents")))


_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_TOKENS = rf"list_distinct(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: x NOT IN ({_STOP})), list_transform(regexp_extract_all({_PLAIN_NUMBERS}, '(?:^|[^0-9A-Za-z.])(\d+(?:[.,]\d+)?)', 1), lambda x: {_NORM})))"


@query(f"""
WITH i AS (SELECT item_id, {_TOKENS} AS own FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS said FROM documents),
s AS (SELECT doc_id, item_id, len(list_intersect(own, said)) AS shared, len(own) AS size FROM i, d WHERE len(own) > 0)
SELECT doc_id, item_id, shared, size FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared / size DESC, item_id) AS n FROM s WHERE shared / size >= CAST(0.6 AS DOUBLE)
) WHERE n = 1
""")
def token_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item of which each document holds the largest share of content tokens, from 0.6 on."""
    return overlap.best(_table(spark, sf_dir, "benchmark"), spread(_table(spark, sf_dir, "documents")))


# ------------------------------------------------------------------ quiz, packets, reviews

_QUIZ = f"""
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fact_id) AS n FROM (
  SELECT DISTINCT case_id, fact_id FROM ({EXPECTED}) WHERE k <> 3 AND risk = 'high')
"""


@query(f"SELECT case_id, fact_id, concat('Q', n) AS q_id FROM ({_QUIZ}) WHERE n <= 4")
def quiz_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.pick(_quiz_candidates(spark, sf_dir)).select("case_id", "fact_id", "q_id")


def _quiz_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda own: facts.featured(own, "risk").select("p_partkey", "fact_id", "kind", "risk", "drug")
    own = inputs.facts_of_cases(spark, sf_dir, told).drop("p_partkey")
    said = inputs.sentences(spark, sf_dir).withColumn("pos", F.substring("sent_id", 2, 9).cast("int"))
    return quiz.candidates(own, said)


@query(f"""
SELECT case_id, fact_id, opt, row_number() OVER (PARTITION BY case_id, fact_id ORDER BY sha256(concat_ws('|', CAST(case_id AS VARCHAR), fact_id, opt))) AS place
FROM ({_QUIZ}), (VALUES ('Stop'), ('Keep taking'), ('Ask first')) o(opt) WHERE n <= 4
""")
def quiz_option_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.explode(F.array(F.lit("Stop"), F.lit("Keep taking"), F.lit("Ask first")))
    rows = quiz.pick(_quiz_candidates(spark, sf_dir)).select("case_id", "fact_id", options.alias("opt"))
    return quiz.shuffled(rows, [F.col("case_id"), F.col("fact_id")], F.col("opt"))


@query("SELECT conv_id AS case_id, role AS section, count(*) AS n, sha256(string_agg(text, ' ' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id, role")
def packet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("section"), F.col("turn").alias("pos"), F.col("text").alias("text_en"))
    return packet.sections(rows).select("case_id", "section", "n", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_answer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.first_answers(_table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events),
w AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, since ORDER BY ts RANGE BETWEEN INTERVAL '172799.999999' SECOND PRECEDING AND CURRENT ROW) AS failures FROM s)
SELECT event_id, CAST(failures AS BIGINT) AS failures, failures >= 3 AS blocked FROM w WHERE event_type = 'error'
""")
def throttle_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.throttled(_table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "signup", 3, "interval '172799.999999' second")
    return rows.filter("event_type = 'error'").select("event_id", "failures", "blocked")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("day"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, session
""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("began"), "n")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{sf_dir}/events.parquet") if _is_folder(spark, f"{sf_dir}/events.parquet") else reader.option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def stream_first_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream: the first event of each key by time, whatever order they arrive in."""
    return streams.first_answers(_event_stream(spark, sf_dir), ["user_id", "event_type"], streams.new_folder(spark))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.counted(_event_stream(spark, sf_dir), ["event_type"], streams.new_folder(spark))


@query("""
WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events)
SELECT user_id, event_id FROM (
  SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, since ORDER BY ts RANGE BETWEEN INTERVAL '172799.999999' SECOND PRECEDING AND CURRENT ROW) AS n FROM s
) WHERE event_type = 'error' AND n >= 3
""")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream with state: failures that are the third or later of their user in two days, since the last purchase."""
    kind = F.col("event_type")
    rows = _event_stream(spark, sf_dir).filter(kind.isin("error", "purchase")).select("user_id", "event_id", "ts", (kind == "error").alias("failed"), (kind == "purchase").alias("ok"))
    return streams.throttled(rows, streams.new_folder(spark), limit=3, seconds=172_800)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("""
SELECT event_type AS stage, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id) AS BIGINT) AS completion_tokens,
       round(sum(event_id) / CAST(sum(user_id) AS DOUBLE), 1) AS tokens_per_second FROM events GROUP BY event_type
""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("user_id").cast("double").alias("seconds"), F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"))
    return rollup.usage(calls, ["stage"]).select("stage", "calls", "prompt_tokens", "completion_tokens", "tokens_per_second")


@query("""
SELECT e.user_id, e.event_id, p.event_id AS snapshot_id, p.value AS valid_then FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the snapshot of its user that was valid then; purchases are the snapshots."""
    ev = _table(spark, sf_dir, "events")
    rows = snapshots.as_of(ev.filter("event_type <> 'purchase'").select("user_id", "event_id", "ts"), ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")
    return rows.select("user_id", "event_id", F.col("version.event_id").alias("snapshot_id"), F.col("version.value").alias("valid_then"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'purchase'),
e AS (SELECT e.user_id, count(*) AS under_draft FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE p.n = 1 GROUP BY 1)
SELECT a.user_id, a.value AS at_draft, b.value AS now, a.m AS versions, coalesce(under_draft, 0) AS under_draft
FROM p a JOIN p b ON a.user_id = b.user_id AND a.n = 1 AND b.n = b.m LEFT JOIN e ON a.user_id = e.user_id
""")
def snapshot_draft_and_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the frozen first snapshot, the present one, how many there are, and the events that happened while the first was valid."""
    ev = _table(spark, sf_dir, "events")
    versions = ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    both = snapshots.frozen(versions, ["user_id"], "ts", "event_id")
    then = snapshots.as_of(ev.filter("event_type <> 'purchase'").select("user_id", "ts"), versions, "user_id", "ts", "event_id")
    counts = then.groupBy("user_id", F.col("version.event_id").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows = both.join(counts, (both["user_id"] == counts["user_id"]) & (F.col("at") == F.col("draft.event_id")), "left")
    return rows.select(both["user_id"], F.col("draft.value").alias("at_draft"), F.col("now.value").alias("now"), "versions", F.coalesce("n", F.lit(0)).alias("under_draft"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1")
def evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return review.latest(done, ["o_custkey"], ["o_orderdate", "o_orderkey"], first=True).select("o_custkey", "o_orderkey")


@query("""
WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM o WHERE o_orderstatus = 'F') WHERE n <= total - 8
""")
def store_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes from each customer's store of eight: the oldest finished orders, never one that is open."""
    held = _table(spark, sf_dir, "orders").withColumn("finished", F.col("o_orderstatus") == "F")
    return review.evicted(held, "o_custkey", ["o_orderdate", "o_orderkey"], 8).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def merge_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.merged(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'view')
SELECT e.user_id, concat('edit ', v.event_id) AS text_en, e.event_type = 'error' AS removed, v.event_id IS NOT NULL AS tl_stale
FROM e LEFT JOIN v ON e.user_id = v.user_id AND v.n = 1 WHERE e.n = 1 AND v.event_id IS NOT NULL
""")
def edit_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull())
    action = F.when(F.col("event_type") == "view", "edit").when(F.col("event_type") == "error", "remove").otherwise("approve")
    events = ev.select(F.col("user_id").alias("case_id"), F.lit("S1").alias("sent_id"), F.struct("ts", "event_id").alias("at"), action.alias("action"), F.concat_ws(" ", F.lit("edit"), "event_id").alias("text_en"), F.lit(None).cast("string").alias("text_tl"), F.col("event_type").alias("actor"))
    base = ev.select(F.col("user_id").alias("case_id")).distinct().select("case_id", F.lit("S1").alias("sent_id"), F.lit("first").alias("text_en"), F.lit("primero").alias("text_tl"), F.lit("amber").alias("status"), F.lit(True).alias("needs_review"))
    return review.edited_state(base, events).filter("text_en <> 'first'").select(F.col("case_id").alias("user_id"), "text_en", "removed", "tl_stale")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k")).filter("k is not null")


from . import languages, workflow  # noqa: E402, F401  # they register their queries
