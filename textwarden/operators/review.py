"""Review as events: the current state is a fold of what reviewers did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.dims import SECTIONS
from ..functions.text import spell_dates


def latest(events: DataFrame, keys: list[str], by: list[str], first: bool = False) -> DataFrame:
    """The last (or first) event of each key in the order of `by`; one row of a key leaves each task, so hot keys don't gather."""
    row, order = F.struct(*events.columns), F.struct(*by)
    return events.groupBy(*keys).agg((F.min_by if first else F.max_by)(row, order).alias("_row")).select("_row.*")


def first_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The first answer of each key counts; ties by event_id."""
    return latest(answers, keys, ["ts", "event_id"], first=True)


def edited_state(sentences: DataFrame, events: DataFrame) -> DataFrame:
    """sentences after events (case_id, sent_id, at, action, text_en, text_tl, actor): approve, edit or remove.

    The last edit gives the texts; English edited without its translation makes that stale. The last event is the review; a red sentence can't be approved.
    """
    keys = ["case_id", "sent_id"]
    edits = latest(events.filter("action = 'edit'"), keys, ["at"]).select(*keys, F.col("text_en").alias("new_en"), F.col("text_tl").alias("new_tl"))
    last = latest(events, keys, ["at"]).select(*keys, F.col("action").alias("last_action"), F.col("actor").alias("reviewer"))
    rows = sentences.join(edits, keys, "left").join(last, keys, "left")
    stale = F.col("new_en").isNotNull() & (F.col("new_en") != F.col("text_en")) & (F.col("new_tl").isNull() | F.col("new_tl").eqNullSafe(F.col("text_tl")))
    approved = (F.col("last_action") == "approve") & (F.col("status") != "red")
    return rows.withColumns({
        "tl_stale": F.coalesce(stale, F.lit(False)),
        "removed": F.coalesce(F.col("last_action") == "remove", F.lit(False)),
        "needs_review": F.col("needs_review") & ~F.coalesce(approved, F.lit(False)),
    }).withColumns({"text_en": F.coalesce("new_en", "text_en"), "text_tl": F.coalesce("new_tl", "text_tl")}).drop("new_en", "new_tl")


def throttled(events: DataFrame, key: str, ts: str, failed: Column, ok: Column, limit: int, window: str) -> DataFrame:
    """Events with `failures` (those in the window before and with each, since the last success) and `blocked` (limit reached).

    Time is cut into stretches as long as the window. What a row counts lies in its own stretch or the one before, so a key's stretches are worked on
    apart, each with the failures and successes of the one before it: a key with a third of all rows is as many groups as it has stretches.
    Only what happens to one key within one window stays together. Time is counted in microseconds, whatever the session's zone. Rows without a time
    count each other.
    """
    span = events.sparkSession.sql(f"select {times.interval_micros(window)}").head()[0]
    rows = events.select(F.col(key).alias("_key"), times.micros(events, ts).alias("_at"), F.coalesce(ok, F.lit(False)).alias("_ok"), failed.cast("int").alias("_failed"), F.struct(*events.columns).alias("_row"))
    own = F.expr(f"(_at - pmod(_at, {span}L)) div {span}L")
    matters = F.col("_ok") | (F.col("_failed") == 1)
    stretches = F.when(matters & F.col("_at").isNotNull(), F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("_key", "_at", "_ok", "_failed", "_row", F.posexplode(stretches).alias("_later", "_stretch"))
    rows = rows.withColumn("_row", F.when(F.col("_later") == 0, F.col("_row")))  # what is there for the next stretch needs no more than its time
    rows = rows.withColumn("_since", F.sum(F.col("_ok").cast("int")).over(Window.partitionBy("_key", "_stretch").orderBy("_at")))
    recent = Window.partitionBy("_key", "_stretch", "_since").orderBy("_at").rangeBetween(-span, Window.currentRow)
    found = rows.withColumn("failures", F.sum("_failed").over(recent)).filter("_later = 0").select("_row.*", "failures")
    return found.withColumn("blocked", F.col("failures") >= limit)


#: Characters that a reason has at least.
MIN_REASON = 8
#: The section of a sentence that is added for a fact, by the fact's kind.
SECTION_OF = {"medication": "medicines", "warning_sign": "warning_signs", "follow_up": "appointments"}


def _no_reason(reason: str) -> Column:
    return F.char_length(F.btrim(F.coalesce(F.col(reason), F.lit("")))) < MIN_REASON


def dismissed(facts: DataFrame, dismissals: DataFrame) -> DataFrame:
    """dismissals (case_id, fact_id, reason) with `error`: 'no fact', 'high risk' or 'no reason', null if the fact may go.

    facts: case_id, fact_id, risk, status, origin. A high-risk fact goes only if it isn't in the source (red) or a rule has found it.
    """
    known = facts.select("case_id", "fact_id", "risk", "status", "origin", F.lit(True).alias("known"))
    rows = dismissals.join(known, ["case_id", "fact_id"], "left")
    held = (F.col("risk") == "high") & (F.col("status") != "red") & ~F.col("origin").eqNullSafe(F.lit("rule"))
    error = F.when(F.col("known").isNull(), "no fact").when(held, "high risk").when(_no_reason("reason"), "no reason")
    return rows.withColumn("error", error).drop("risk", "status", "origin", "known")


def resolved(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """resolutions (case_id, drug, reason) with `error`: 'no issue' or 'no reason', null if the medicine's issues (case_id, drug) are resolved."""
    known = issues.select("case_id", "drug", F.lit(True).alias("known")).distinct()
    rows = resolutions.join(known, ["case_id", "drug"], "left")
    return rows.withColumn("error", F.when(F.col("known").isNull(), "no issue").when(_no_reason("reason"), "no reason")).drop("known")


def added(facts: DataFrame, sentences: DataFrame, additions: DataFrame) -> DataFrame:
    """Sentences that reviewers add (case_id, at, fact_id, text_en) for known facts: case_id, sent_id, section, text_en, fact_ids.

    Numbers go on from the greatest that a case's sentences have (S and digits), in the order of `at`; US dates are spelled.
    """
    rows = additions.join(facts.select("case_id", "fact_id", "kind"), ["case_id", "fact_id"])
    last = sentences.groupBy("case_id").agg(F.max(F.when(F.col("sent_id").rlike(r"^.\d+$"), F.substring("sent_id", 2, 9).cast("int"))).alias("last"))
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("at", "fact_id"))
    section = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SECTION_OF.items() for x in pair)), F.col("kind")), F.lit("daily_care"))
    numbered = rows.join(last, "case_id", "left").withColumn("sent_id", F.concat(F.lit("S"), (F.coalesce("last", F.lit(0)) + nth).cast("string")))
    return numbered.select("case_id", "sent_id", section.alias("section"), F.btrim(spell_dates(F.col("text_en"))).alias("text_en"), F.array("fact_id").alias("fact_ids"))


def alerts(answers: DataFrame, questions: DataFrame, facts: DataFrame) -> DataFrame:
    """case_id, alert_id, q_id, fact_id, message, ts: one for each question whose first answer is wrong, numbered by time in a case.

    answers: case_id, q_id, choice, ts, event_id; questions: case_id, q_id, fact_id, right (the right choice); facts: case_id, fact_id, detail.
    """
    first = first_answers(answers, ["case_id", "q_id"]).join(questions, ["case_id", "q_id"]).filter("choice <> right")
    rows = first.join(facts.select("case_id", "fact_id", "detail"), ["case_id", "fact_id"])
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "event_id"))
    return rows.select("case_id", F.concat(F.lit("A"), nth.cast("string")).alias("alert_id"), "q_id", "fact_id", F.concat(F.lit("Re-explain: "), F.col("detail")).alias("message"), "choice", "ts")


def acknowledged(found: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with who first acknowledged each (case_id, alert_id, ts, event_id, reviewer), null where it is open."""
    first = first_answers(acks, ["case_id", "alert_id"]).select("case_id", "alert_id", "reviewer")
    return found.join(first, ["case_id", "alert_id"], "left")


def alert_view(found: DataFrame, facts: DataFrame, questions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Alerts with what a nurse sees: the fact's detail, the question, the sentence that explains it and the option chosen; null where absent."""
    rows = found.join(facts.select("case_id", "fact_id", F.col("detail").alias("fact_detail")), ["case_id", "fact_id"], "left")
    rows = rows.join(questions.select("case_id", "q_id", "prompt", "sent_id", "options"), ["case_id", "q_id"], "left")
    rows = rows.join(sentences.select("case_id", "sent_id", "text_en"), ["case_id", "sent_id"], "left")
    return rows.withColumn("chosen", F.get("options", F.col("choice").cast("int"))).drop("options")


def queue(omissions: DataFrame, issues: DataFrame, facts: DataFrame, sentences: DataFrame, by: str = "pos") -> DataFrame:
    """case_id, place, id, state, done: what a reviewer goes through, in order.

    What is missing first, then open medicine issues, then facts that aren't in the source (unless missing), then sentences by section
    that need review or have had it. omissions: case_id, fact_id, rule, seq; issues: case_id, drug, resolved; facts: case_id, fact_id, status,
    dismissed; sentences: case_id, sent_id, pos, section, status, needs_review, reviewed, removed. by: what orders items of one kind, 'pos'
    (each item has a place) or 'id' (equal ids share one).
    """
    no = F.lit(False)
    row = lambda df, rank, at, item, state, done: df.select("case_id", F.lit(rank).alias("rank"), at.cast("string").alias("at"), item.alias("id"), state.alias("state"), done.alias("done"))
    red = F.lit("red")
    lost = facts.filter((F.col("status") == "red") & ~F.coalesce("dismissed", no)).join(omissions.select("case_id", "fact_id").distinct(), ["case_id", "fact_id"], "left_anti")
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")), F.lit(0))
    live = sentences.filter(~F.coalesce("removed", no) & (F.col("needs_review") | F.coalesce("reviewed", no)))
    state = F.when(~F.col("needs_review"), "done").when(F.col("status") == "green", "high").otherwise(F.col("status"))
    place = F.format_string("%03d/%09d", order.cast("int"), F.col("pos").cast("int"))
    items = (
        row(omissions, 0, F.format_string("%s/%s", "fact_id", "rule"), F.col("fact_id"), red, no)
        .unionByName(row(issues.filter(~F.coalesce("resolved", no)), 1, F.col("drug"), F.col("drug"), red, no))
        .unionByName(row(lost, 2, F.col("fact_id"), F.col("fact_id"), red, no))
        .unionByName(row(live, 3, place, F.col("sent_id"), state, ~F.col("needs_review")))
    )
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "at")) if by == "pos" else F.dense_rank().over(Window.partitionBy("case_id").orderBy("rank", "id"))
    return items.select("case_id", nth.alias("place"), "id", "state", "done")


def same_sample(cases: DataFrame, samples: DataFrame) -> DataFrame:
    """cases (sample_id, source, language) whose sample_id stays only if text and language are the stored sample's (id, source, language)."""
    stored = samples.select(F.col("id").alias("_id"), F.sha2("source", 256).alias("_digest"), F.col("language").alias("_language"))
    rows = cases.withColumn("_own", F.sha2("source", 256)).join(stored, F.col("sample_id") == F.col("_id"), "left")
    same = (F.col("_own") == F.col("_digest")) & (F.col("language") == F.col("_language"))
    return rows.withColumn("sample_id", F.when(same, F.col("sample_id"))).select(*cases.columns)


def next_ids(items: DataFrame, case_col: str, id_col: str, prefix: str) -> DataFrame:
    """case, next_id: one more than the greatest number of a case's ids."""
    number = F.regexp_extract(F.col(id_col), r"(\d+)", 1).try_cast("int")
    return items.groupBy(case_col).agg(F.concat(F.lit(prefix), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_id"))


def newest(log: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """An append-only log with each row's place in its key, newest first."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in by))))


def evicted(held: DataFrame, key: str, by: list[str], most: int) -> DataFrame:
    """The rows that must go so that `most` of all rows of each key stay: the oldest finished ones (finished boolean)."""
    total = held.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    done = held.filter("finished").withColumn("_n", nth)
    return done.join(total, key).filter(F.col("_n") <= F.col("_total") - most).drop("_n", "_total")
