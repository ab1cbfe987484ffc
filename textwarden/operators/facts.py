"""Facts read from a source text: normalised, re-classified and checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as tx
from ..functions.dims import ACTIONS, CRITICAL_KINDS, CUES, DEFAULT, KINDS, Lexicon
from ..functions.fuzzy import near_quote
from ..sources.stores import stored

Check = tuple[str, Column, Column]  # name, when it fails, when it warns


def checks_of(rows: DataFrame, keys: list[str], checks: list[Check], passes: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """keys, seq, name, status: a row for each check (of `only`) that fails or warns, and for each named in passes that does neither."""
    found = []
    for seq, (name, fails, warns) in enumerate(checks):
        if only is not None and name not in only:
            continue
        status = F.when(F.coalesce(fails, F.lit(False)), F.lit("fail")).when(F.coalesce(warns, F.lit(False)), F.lit("warn"))
        status = status.otherwise(F.lit("pass")) if name in passes else status
        found.append(F.when(status.isNotNull(), F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), status.alias("status"))))
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("c")).select(*keys, "c.*")


def clean_id(value: Column) -> Column:
    """An id of one or two letters, up to three digits and perhaps an x, upper-case and without blanks; else null."""
    bare = F.replace(F.upper(F.regexp_replace(value, r"\s+", "")), F.lit("X"), F.lit("x"))
    return F.when(bare.rlike(r"^[A-Z]{1,2}\d{1,3}x?$"), bare)


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def objects_in(raw: DataFrame, prefix: str, wanted: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """raw: case_id, payload (JSON array). case_id, pos, id, item (variant): the objects of the payload, or those for which `wanted` of their
    fields holds; malformed JSON gives no rows.

    An id that is missing or malformed is made from the item's place (F3); one that an earlier item has, made ids included, becomes F3x.
    """
    def wish(item: Column, at: Column) -> Column:
        field = lambda name: F.try_variant_get(item, f"$.{name}", "string")
        given = F.coalesce(clean_id(field("id")), F.concat(F.lit(prefix), (at + 1).cast("string")))
        ok = F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))
        return F.when(ok & wanted(field) if wanted else ok, given)

    def settled(ids: Column, new: Column) -> Column:
        seen = F.coalesce(F.array_contains(ids, new), F.lit(False))
        place = F.concat(F.lit(prefix), (F.size(ids) + 1).cast("string"), F.lit("x"))
        return F.concat(ids, F.array(F.when(new.isNotNull() & seen, place).otherwise(new)))

    rows = raw.select("case_id", F.expr("try_variant_get(try_parse_json(payload), '$', 'array<variant>')").alias("items"))
    rows = rows.withColumn("ids", F.aggregate(F.transform("items", wish), F.array().cast("array<string>"), settled))
    rows = rows.select("case_id", "ids", F.posexplode("items").alias("at", "item"))
    return rows.select("case_id", (F.col("at") + 1).alias("pos"), F.get("ids", F.col("at")).alias("id"), "item").filter("id is not null")


def normalise(raw: DataFrame) -> DataFrame:
    """raw: case_id, payload (JSON array of facts). One row per object in it: case_id, pos, fact_id and fields.

    Items that are no objects are dropped; bad kinds become `other`, bad actions null. Ids as objects_in() says.
    """
    field = lambda name: F.expr(f"try_variant_get(item, '$.{name}', 'string')")
    return objects_in(raw, "F").select(
        "case_id",
        "pos",
        F.when(field("kind").isin(*KINDS), field("kind")).otherwise("other").alias("kind"),
        F.when(field("med_action").isin(*ACTIONS), field("med_action")).alias("med_action"),
        *(field(n).alias(n) for n in ("drug", "dose", "frequency")),
        *(F.coalesce(field(n), F.lit("")).alias(n) for n in ("detail", "source_quote")),
        F.col("id").alias("fact_id"),
    )


def risk(kind: Column, action: Column, drug: Column, named: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """'high' for warning signs, medicines to stop, hold or change, and high-alert medicines; else 'normal'.

    A medicine is judged by its own drug, any other fact by all the medicines it names (array).
    """
    alert = F.exists(named, lambda d: d.isin(*lexicon.high_alert))
    high = (kind == "warning_sign") | ((kind == "medication") & action.isin("stop", "hold", "changed"))
    high = high | F.when(kind == "medication", lex.is_high_alert(drug, lexicon)).otherwise(alert)
    return F.when(F.coalesce(high, F.lit(False)), "high").otherwise("normal")


def needs() -> dict[str, Column]:
    """What a fact's quote says that its reader must be told: arrays, as columns of their own (a struct's fields would be pruned through the
    generator of coverage's rules, which loses its rows in Spark 4.1)."""
    quote, dose = F.coalesce("source_quote", F.lit("")), F.coalesce("dose", F.lit(""))
    current = F.regexp_replace(quote, r"(?i)\b(?:from|was|previously)\s+(?:[a-z]+\s+){0,2}?\d+(?:[.,]\d+)?", "")
    return {
        "need_dose": tx.digits_in(dose),
        "need_numbers": F.array_except(tx.digits_in(current), tx.date_numbers(quote)),
        "need_days": F.transform(tx.dates_in(quote), lambda x: F.concat_ws("/", x["month"], x["day"])),
        "need_clock": F.transform(tx.times_in(quote), lambda x: F.concat_ws(":", x["hour"], x["minute"])),
        "need_limits": F.array_except(tx.digits_in(tx.strip_times(tx.strip_dates(quote))), F.array(F.lit("1"))),
        "need_tokens": lex.placeholders_in(quote),
    }


def features(facts: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """facts with what their texts say: canon, numbers, drugs, quote_drugs, units, steps, dates, need_*, quote_polarity and risk.
    doubtful (not found in the source, or a medicine the lists disagree on) is false unless given.

    Facts that have these columns already are returned as they are: compute them where a fact is one row.
    """
    if "quote_polarity" in facts.columns:
        return facts
    whole = F.concat_ws(" ", "dose", "frequency", "detail", "source_quote")
    named = F.array_distinct(F.concat(lex.drugs_in(F.col("drug"), lexicon), lex.drugs_in(F.col("source_quote"), lexicon), lex.drugs_in(F.col("detail"), lexicon)))
    out = facts.withColumns({
        "canon": lex.canonical_drug(F.col("drug"), lexicon),
        "numbers": tx.numbers_in(whole),
        "claimed": tx.numbers_in(F.concat_ws(" ", "dose", "frequency")),
        "drugs": named,
        "quote_drugs": lex.drugs_in(F.col("source_quote"), lexicon),
        "units": tx.quantities(whole),
        "steps": tx.scale_steps(F.col("source_quote")),
        "dates": tx.dates_in(F.col("source_quote")),
        "per_day": tx.per_day(F.concat_ws(" ", "frequency", "source_quote")),
        "prn": lex.has_cue(F.col("source_quote"), "en", "prn"),
        # A fixed schedule first, then as needed: what stands before the first cue found, cue by cue.
        "then": F.coalesce(*(F.when(F.col("source_quote").rlike(f"(?iU){p}"), F.regexp_extract(F.col("source_quote"), f"(?isU)^(.*?){p}", 1).rlike(r"(?i)\bthen\b")) for p in CUES["en"]["prn"]), F.lit(False)),
        **needs(),
        "doubtful": F.col("doubtful") if "doubtful" in facts.columns else F.lit(False),
        "quote_polarity": lex.polarity(F.col("source_quote")),
    })
    return out.withColumn("risk", risk(F.col("kind"), F.col("med_action"), F.col("drug"), F.col("drugs"), lexicon))


#: What a fact says and features() are made of; `doubtful` with it.
SAYS = ["kind", "med_action", "drug", "dose", "frequency", "detail", "source_quote"]


def saying(facts: DataFrame) -> Column:
    """What a fact says, as one narrow struct: facts that are alike in it have the same features."""
    doubtful = F.col("doubtful") if "doubtful" in facts.columns else F.lit(False)
    return F.struct(*(F.col(c).cast("string").alias(c) for c in SAYS), F.coalesce(doubtful, F.lit(False)).alias("doubtful"))


def key_of(*values: Column) -> Column:
    """16 bytes that stand for values wherever rows that are alike in them meet."""
    return F.unhex(F.md5(F.to_json(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))))


def featured(facts: DataFrame, *names: str, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """facts with the named ones of their features, read once for facts that say the same."""
    rows = facts.withColumn("_said", key_of(saying(facts)))
    known = features(rows.select("_said", saying(facts).alias("_fact")).distinct().select("_said", "_fact.*"), lexicon)
    return rows.join(known.select("_said", *names), "_said").drop("_said")


def source_line(quote: Column, source: Column) -> Column:
    """The line of the source that a quote comes from, so that a label which the quote dropped is seen; the quote itself if none."""
    plain = lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))
    head = F.lower(F.substring(F.regexp_replace(F.regexp_replace(quote, r"^\s+|\s+$", ""), r"\s+", " "), 1, 40))
    line = F.get(F.filter(F.split(source, r"\R"), lambda x: F.contains(plain(x), head)), F.lit(0))
    return F.coalesce(F.when(F.length(head) > 0, F.regexp_replace(line, r"^\s+|\s+$", "")), quote)


def classify(facts: DataFrame, lexicon: Lexicon = DEFAULT, source: Column | None = None) -> DataFrame:
    """kind and med_action as the quote, or its line in the source, reads; the given ones in model_kind and model_action. Kinds that matter are not re-derived."""
    quote = F.col("source_quote")
    if source is not None:
        facts = facts.withColumn("_line", source_line(quote, source))
    line = quote if source is None else F.col("_line")
    acts, named = lex.text_action(line), F.coalesce(lex.canonical_drug(F.col("drug"), lexicon), F.get(F.array_sort(lex.drugs_in(quote, lexicon)), F.lit(0)))
    medicine = named.isNotNull() & (quote.rlike(lex.DOSE) | acts.isNotNull())
    kind = F.when(F.col("kind").isin(*CRITICAL_KINDS), F.col("kind")).when(medicine, "medication").when(quote.rlike(lex.WARNING), "warning_sign").when(quote.rlike(lex.FOLLOW_UP), "follow_up").otherwise(F.col("kind"))
    out = facts.withColumns({"model_kind": F.col("kind"), "model_action": F.col("med_action"), "_said": F.when(lex.is_labelled(line), acts).otherwise(lex.text_action(quote)), "_named": named}).withColumn("kind", kind)
    is_medicine = F.col("kind") == "medication"
    out = out.withColumn("drug", F.when(is_medicine & F.col("drug").isNull(), F.col("_named")).otherwise(F.col("drug")))
    return out.withColumn("med_action", F.when(is_medicine, F.coalesce("_said", "med_action")).otherwise(F.col("med_action"))).drop("_said", "_named", "_line")


def fact_checks(facts: DataFrame, sources: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """case_id, fact_id, seq, name, status of facts (after classify) against sources (case_id, source)."""
    rows = features(facts, lexicon).join(sources, "case_id", "left")
    quote = F.col("source_quote")
    unlabelled = F.regexp_replace(quote, r"^[A-Z][A-Za-z -]{2,25}:\s*", "")
    found = tx.contained(quote, F.col("source")) | ((F.length(unlabelled) >= 20) & tx.contained(unlabelled, F.col("source")))
    never, medicine = F.lit(False), F.col("kind") == "medication"
    # Window by window only where containment fails: other rows have no quote for it.
    rows = rows.withColumn("_found", F.coalesce(found, never))
    left = lambda q: near_quote(F.when(~F.col("_found"), tx.squash(q)), F.when(~F.col("_found"), tx.squash(F.col("source"))))
    rows = rows.withColumns({"_near": left(quote), "_near_unlabelled": left(F.when(F.length(unlabelled) >= 20, unlabelled))})
    found = F.col("_found") | F.col("_near") | F.col("_near_unlabelled")
    return checks_of(
        rows,
        ["case_id", "fact_id"],
        [
            ("cross_check", never, F.col("model_action").isNotNull() & (F.col("model_action") != F.col("med_action")) & medicine),
            ("classification", never, F.col("model_kind") != F.col("kind")),
            ("quote", ~F.coalesce(found, never), never),
            ("numbers", F.size(F.array_except("claimed", tx.numbers_in(quote))) > 0, never),
            ("drug", never, medicine & F.col("canon").isNotNull() & ~F.array_contains("quote_drugs", F.col("canon"))),
            ("action", never, medicine & F.col("med_action").isNull()),
        ],
        passes=("quote",),
    )


def medicine_lines(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """lines: case_id, line_no, line. Medicines read by rule: case_id, line_no, drug, action, line.

    A line without a medicine that says what to do and ends with a colon heads those that follow, up to a blank line. A labelled line is about
    its first medicine only.
    """
    bare = F.btrim("line", F.lit(" \t\r"))
    rows = lines.select("case_id", "line_no", bare.alias("line"))
    rows = rows.withColumn("action", lex.text_action(F.col("line"))).withColumn("drugs", lex.drugs_in(F.col("line"), lexicon))
    block = F.sum((F.col("line") == "").cast("int")).over(Window.partitionBy("case_id").orderBy("line_no"))
    rows = rows.withColumn("block", block)
    heads = (F.size("drugs") == 0) & F.col("action").isNotNull() & F.endswith("line", F.lit(":"))
    before = Window.partitionBy("case_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("context", F.last(F.when(heads, F.col("action")), ignorenulls=True).over(before))
    drugs = F.when(lex.is_labelled(F.col("line")), F.slice("drugs", 1, 1)).otherwise(F.col("drugs"))
    return rows.select("case_id", "line_no", F.explode(drugs).alias("drug"), F.coalesce("action", "context").alias("action"), "line")


def cross_check(facts: DataFrame, medicines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Medicines whose actions by rule and in the facts have nothing in common: case_id, drug, text_actions, model_actions, line."""
    own = facts.filter("kind = 'medication'").select("case_id", lex.canonical_drug(F.col("drug"), lexicon).alias("drug"), "med_action").filter("drug is not null")
    own = own.groupBy("case_id", "drug").agg(F.array_sort(F.collect_set("med_action")).alias("model_actions"))
    parsed = medicines.groupBy("case_id", "drug").agg(F.array_sort(F.collect_set("action")).alias("text_actions"), F.min_by("line", "line_no").alias("first"), F.min_by(F.when(F.col("action").isNotNull(), F.col("line")), F.when(F.col("action").isNotNull(), F.col("line_no"))).alias("acting"))
    both = parsed.join(own, ["case_id", "drug"]).filter((F.size("text_actions") > 0) & ~F.arrays_overlap("text_actions", "model_actions"))
    return both.select("case_id", "drug", "text_actions", "model_actions", F.coalesce("acting", "first").alias("line"))


def instruction_units(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """case_id, line_no, pos, unit: the parts of a source's lines that tell someone to do something."""
    skip = r"(?i)^\W*(?:patient|name|mrn|dob|date of birth|attending|surgeon|discharge date|principal diagnosis|diagnosis|hospital course|procedure|discharge summary|discharge instructions)\b"
    cue = r"(?i)\b(?:take|do not|don't|never|call|return|go to|weigh|walk|avoid|check|use|keep|restriction|follow-?up|appointment|clinic|shower|lift|drive|smoke|exercise|eat|drink|sodium|fluid|injection|inhaled|record|recheck|until)\b"
    rows = lines.select("case_id", "line_no", F.btrim("line").alias("line")).filter((F.length("line") > 0) & ~F.col("line").rlike(skip) & (F.upper("line") != F.col("line")))
    rows = rows.withColumn("line", F.regexp_replace("line", r"^[A-Z][A-Za-z -]{2,25}:\s*", ""))
    parts = rows.select("case_id", "line_no", F.posexplode(F.split("line", r"(?<=[.;])\s+(?=[A-Z(])|;\s*")).alias("pos", "part"))
    parts = parts.withColumn("unit", F.btrim("part", F.lit(" .;"))).filter(F.length("unit") > 8)
    return parts.filter(F.col("unit").rlike(cue) | (F.size(lex.drugs_in(F.col("unit"), lexicon)) > 0)).select("case_id", "line_no", "pos", "unit")


def uncovered(units: DataFrame, facts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Instructions that no fact of their case covers by a share of `threshold` of their words: rows of units, `covered` the best share.

    Facts are met over shared words, so an instruction is compared with those facts only that have one. The instructions of a case are then
    folded in order: one that an uncovered instruction before it covers is left out.
    """
    key = ["case_id", "line_no", "pos"]
    # Read once for both of its uses; the file's size is not that of its words, so they are not sent through the driver.
    tokens = stored(units.withColumn("tokens", lex.content_tokens(F.col("unit"))).filter(F.size("tokens") > 0)).hint("merge")
    words = tokens.select(*key, F.explode("tokens").alias("word"))
    theirs = facts.select("case_id", "fact_id", F.explode(lex.content_tokens(F.concat_ws(" ", "source_quote", "detail"))).alias("word"))
    shared = words.join(theirs, ["case_id", "word"]).groupBy(*key, "fact_id").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(*key).agg(F.max("n").alias("n"))
    rows = tokens.join(best, key, "left").withColumn("covered", F.coalesce("n", F.lit(0)) / F.size("tokens")).filter(F.col("covered") < threshold)
    listed = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "pos", "unit", "tokens", "covered"))).alias("units"))
    none = F.filter("units", lambda u: F.lit(False))
    keep = F.aggregate("units", none, lambda acc, u: F.when(F.exists(acc, lambda a: F.size(F.array_intersect(a["tokens"], u["tokens"])) >= threshold * F.size(u["tokens"])), acc).otherwise(F.concat(acc, F.array(u))))
    return listed.select("case_id", F.posexplode(keep).alias("n", "u")).select("case_id", F.concat(F.lit("R"), (F.col("n") + 1).cast("string")).alias("fact_id"), "u.line_no", "u.pos", "u.unit", "u.covered")


def with_rule_facts(facts: DataFrame, missed: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The model's facts and those that rules add for what it has missed (rows of uncovered()): origin 'rule', amber, to be covered in any case."""
    unit = F.col("unit")
    found = missed.select(
        "case_id", "fact_id", F.lit("other").alias("kind"), F.lit(None).cast("string").alias("med_action"), F.get(F.array_sort(lex.drugs_in(unit, lexicon)), F.lit(0)).alias("drug"),
        F.nullif(F.regexp_extract(unit, lex.DOSE, 0), F.lit("")).alias("dose"), unit.alias("detail"), unit.alias("source_quote"), F.lit("rule").alias("origin"), F.lit("amber").alias("status"),
    )
    by_rule = classify(found, lexicon).drop("model_kind", "model_action").withColumn("must_cover", F.lit(True))
    both = facts.unionByName(by_rule, allowMissingColumns=True)
    return both.withColumn("must_cover", F.coalesce("must_cover", F.lit(False)))
