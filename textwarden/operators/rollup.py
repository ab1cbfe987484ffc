"""From checks to statuses, routes, blockers and release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of red sentences above which a translated case goes to an interpreter; money for an hour of a model's time.
RED_SHARE, HOUR_COST = 0.3, 1.99


def severity(status: Column) -> Column:
    """An aggregate: red if a check fails, amber if one warns, else green."""
    worst = F.max(F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0))
    return F.when(worst == 2, "red").when(worst == 1, "amber").otherwise("green")


def statuses(checks: DataFrame, keys: list[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(severity(F.col("status")).alias("status"))


def judged(sentences: DataFrame, checks: DataFrame) -> DataFrame:
    """sentences (with risk) and status (green without checks), needs_review (not green, or high risk)."""
    keys = ["case_id", "sent_id"]
    rows = sentences.join(statuses(checks, keys), keys, "left").withColumn("status", F.coalesce("status", F.lit("green")))
    return rows.withColumn("needs_review", (F.col("status") != "green") | (F.col("risk") == "high"))


def with_status(rows: DataFrame) -> DataFrame:
    """As judged(), of rows that carry their risk and checks (array)."""
    some = lambda status: F.exists("checks", lambda c: c["status"] == status)
    rows = rows.withColumn("status", F.when(some("fail"), "red").when(some("warn"), "amber").otherwise("green")).drop("checks")
    return rows.withColumn("needs_review", (F.col("status") != "green") | (F.col("risk") == "high"))


def case_status(rows: DataFrame) -> DataFrame:
    """One row per case: counts of sentences by status, of high risk and in review, and the route."""
    count = lambda s: F.count_if(F.col("status") == s)
    red_share = count("red") / F.count(F.lit(1))
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("sentences"), count("green").alias("green"), count("amber").alias("amber"), count("red").alias("red"),
        F.count_if(F.col("risk") == "high").alias("high_risk"), F.count_if("needs_review").alias("needs_review"),
        F.when(red_share > RED_SHARE, "interpreter").otherwise("standard").alias("route"),
    )


def blockers(sentences: DataFrame, omissions: DataFrame, facts: DataFrame, med_issues: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, source, item: whatever keeps a case from release, of five sources."""
    no = F.lit(False)
    of = lambda df, source, item: df.select("case_id", F.lit(source).alias("source"), item.cast("string").alias("item"))
    return (
        of(cases.filter("stage <> 'ready'"), "not_ready", F.col("stage"))
        .unionByName(of(sentences.filter(F.col("needs_review") & ~F.coalesce("removed", no)), "sentence", F.col("sent_id")))
        .unionByName(of(omissions, "omission", F.col("fact_id")))
        .unionByName(of(facts.filter((F.col("status") == "red") & ~F.coalesce("dismissed", no)), "fact", F.col("fact_id")))
        .unionByName(of(med_issues.filter(~F.coalesce("resolved", no)), "medicine", F.col("drug")))
    )


def releasable(cases: DataFrame, found: DataFrame) -> DataFrame:
    # Most cases have several blockers: one of each is enough, and is shuffled.
    return cases.join(found.select("case_id").distinct(), "case_id", "left_anti")


def issue_histogram(checks: DataFrame) -> DataFrame:
    """name, n: checks that don't pass, the most frequent first."""
    return checks.filter("status <> 'pass'").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, seconds, tokens, tokens a second and cost of model calls (seconds, prompt_tokens, completion_tokens)."""
    s, out = F.sum("seconds"), F.sum("completion_tokens")
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.round(s, 2).alias("seconds"), F.sum("prompt_tokens").alias("prompt_tokens"), out.alias("completion_tokens"),
        F.when(s > 0, F.round(out / s, 1)).alias("tokens_per_second"), F.when(s > 0, F.round(s * HOUR_COST / 3600, 4)).alias("cost"),
    )


def totals(sentences: DataFrame, facts: DataFrame, omissions: DataFrame, med_issues: DataFrame) -> DataFrame:
    """One row: live sentences by status and risk, those flagged (not green, or high risk), facts, omissions and medicine issues of all cases.

    It is also what is frozen of a draft, before anyone edits it: written then, and read later beside the totals of the day.
    """
    count = lambda s: F.count_if(F.col("status") == s)
    high = F.col("risk") == "high"
    live = sentences.filter(~F.coalesce("removed", F.lit(False))) if "removed" in sentences.columns else sentences
    row = live.agg(F.count(F.lit(1)).alias("live"), count("green").alias("green"), count("amber").alias("amber"), count("red").alias("red"), F.count_if(high).alias("high_risk"), F.count_if((F.col("status") != "green") | high).alias("flagged"))
    for df, name in ((facts, "facts"), (omissions, "omissions"), (med_issues, "med_issues")):
        row = row.join(df.agg(F.count(F.lit(1)).alias(name)))  # rows of one each
    return row


def check_sets(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bad: the set of (name, status) of the checks that don't pass, in order of names."""
    return checks.filter("status <> 'pass'").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("name", "status"))).alias("bad"))


def new_signals(clean: DataFrame, mutated: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, status: checks that don't pass now and did not fail alike before."""
    bad = lambda df: df.filter("status <> 'pass'").select(*keys, "name", "status").distinct()
    return bad(mutated).join(bad(clean), [*keys, "name", "status"], "left_anti")


def bars(checks: DataFrame, omissions: DataFrame, med_issues: DataFrame) -> DataFrame:
    """name, n, most: the histogram of issues with omissions and medicine issues, and its longest bar."""
    of = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    rows = issue_histogram(checks).unionByName(of(omissions, "omissions")).unionByName(of(med_issues, "medicines")).filter("n > 0")
    return rows.join(rows.agg(F.max("n").alias("most")))  # a row per name, and one row


def first_blockers(found: DataFrame, most: int = 5) -> DataFrame:
    """case_id, first: the first items of each case (case_id, place, item) in order; each task keeps no more than it needs."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("place"))
    rows = found.withColumn("_n", rank).filter(F.col("_n") <= most)
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"]).alias("first"))


def open_alerts(found: DataFrame) -> DataFrame:
    """case_id, n, open, reviewer: alerts of each case, and those that nobody has acknowledged."""
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reviewer").isNull()).alias("open"), F.max("reviewer").alias("reviewer"))


def verified_share(sentences: DataFrame) -> DataFrame:
    """One row: sentences that are not green or high risk (caught), and the share in percent that needs nobody."""
    caught = F.count_if((F.col("status") != "green") | (F.col("risk") == "high"))
    return sentences.agg(caught.alias("caught"), F.round(100 * (F.count(F.lit(1)) - caught) / F.count(F.lit(1))).alias("verified_percent"))


def throughput(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of runs (ok, seconds) by keys: how many there are and went well, packets an hour and the cost of one."""
    ok, s = F.count_if("ok"), F.sum("seconds")
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), ok.alias("ok"), F.round(3600 * ok / s, 2).alias("packets_per_hour"), F.when(ok > 0, F.round(HOUR_COST * s / 3600 / ok, 4)).alias("cost_per_packet"))
