"""Queries over facts, sentences and reviews of cases that are written by key from `part` and `events`, with SQL from the keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.quiz_texts import QUIZ, WRONG_BY_ACTION, WRONG_OTHERWISE
from ..operators import coverage, facts, mutation, packet, quiz, review, rollup, sentences
from ..sources import readers
from ..sources.stores import stored
from .inputs import FACTS, pick
from .languages import VALUES, made, wanted
from .registry import chosen, query, rows_of, table, written

# ------------------------------------------------------------------ facts read from payloads and sources

_PAYLOADS = [
    '[\1"id":"F1","kind":"medication","med_action":"stop","drug":"{drug}","source_quote":"STOP: {drug}"\2,"no object",\1"id":"f 2","kind":"odd","detail":{n}\2,\1"id":"F1","kind":"follow_up"\2,\1"kind":"pending_result","med_action":"give"\2]',
    "\1broken {n}",
    '[\1"id":"F{d}x","kind":"diet","dose":"{n} g","frequency":"daily"\2,[1],\1"id":"F1000","drug":null,"kind":"warning_sign","detail":"call"\2]',
    '[\1"kind":"diet"\2,\1"id":"F1","kind":"test"\2,\1"id":"F3x","kind":"activity","detail":"{n}"\2,\1"id":"f3X"\2,\1"id":"X9","med_action":"hold"\2]',
]
#: As the texts of a draft: a repeated id, blank texts that take no id, an id that a made one has taken, a lone cited id.
_DRAFTS = [
    '[\1"id":"S1","section":"why","text":" You were ill. ","fact_ids":["f1","F {d}","bad id"]\2,\1"id":"S1","text":"Take {n}.","fact_ids":"F1"\2,\1"id":"S4","text":"  "\2,\1"id":"S4","section":"odd","text":"Call {d}"\2,\1"section":"why","text":"x"\2,"no"]',
    '[\1"text":"First."\2,\1"id":"s 1","text":"Second."\2,\1"id":"S2x","text":"Third.","section":"medicines"\2]',
]


def _braces(sql: str) -> str:
    return sql.replace("\1", "{").replace("\2", "}")


@query(_braces(wanted(_PAYLOADS, [
    (0, "1", "F1", "medication", "stop", "{drug}", "", "STOP: {drug}"), (0, "3", "F2", "other", None, None, "{n}", ""), (0, "4", "F4x", "follow_up", None, None, "", ""), (0, "5", "F5", "pending_result", None, None, "", ""),
    (2, "1", "F{d}x", "diet", None, None, "", ""), (2, "3", "F3", "warning_sign", None, None, "call", ""),
    (3, "1", "F1", "diet", None, None, "", ""), (3, "2", "F2x", "other", None, None, "", ""), (3, "3", "F3x", "activity", None, None, "{n}", ""),
    (3, "4", "F4x", "other", None, None, "", ""), (3, "5", "F5", "other", "hold", None, "", ""),
], "pos fact_id kind med_action drug detail source_quote")))
def fact_extract_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rows_of(spark, sf_dir, _braces(made(_PAYLOADS)), "part").select(F.col("p_partkey").alias("case_id"), F.col("text").alias("payload"))
    return facts.normalise(raw).select(F.col("case_id").alias("p_partkey"), F.col("pos").cast("string").alias("pos"), "fact_id", "kind", "med_action", "drug", "detail", "source_quote")


@query(_braces(wanted(_DRAFTS, [
    (0, "1", "S1", "why", "You were ill.", "F1/F{d}"), (0, "2", "S2x", "daily_care", "Take {n}.", "F1"), (0, "4", "S4", "daily_care", "Call {d}", ""), (0, "5", "S5", "why", "x", ""),
    (1, "1", "S1", "daily_care", "First.", ""), (1, "2", "S2x", "daily_care", "Second.", ""), (1, "3", "S3x", "medicines", "Third.", ""),
], "pos sent_id section text_en fact_ids")))
def draft_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rows_of(spark, sf_dir, _braces(made(_DRAFTS)), "part").select(F.col("p_partkey").alias("case_id"), F.col("text").alias("payload"))
    return sentences.normalise(raw).select(F.col("case_id").alias("p_partkey"), F.col("pos").cast("string").alias("pos"), "sent_id", "section", "text_en", F.array_join("fact_ids", "/").alias("fact_ids"))


#: The source of every case; drug and drug2 differ.
_SOURCE = (
    "STOP taking these medicines:\nNaproxen 400 mg\n{drug} {n} mg\n\n{drug2} 25 mg twice daily\nCONTINUE: Lasix {n} mg daily, keep potassium in range\nNEW: Eliquis 5 mg\n"
    "Patient: someone\nWeigh yourself every {d} days; Take furosemide {n} mg daily.\nACTIVITY\nFollow-up: Call the clinic about swollen legs. Weigh yourself each {d} days"
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = rows_of(spark, sf_dir, f"SELECT p_partkey AS case_id, {written(_SOURCE, VALUES)} AS source FROM part", "part")
    return cases.select("case_id", F.posexplode(F.split("source", "\n")).alias("line_no", "line"))


def _each(rows: list[tuple], columns: str) -> str:
    return wanted([""], [(0, *r) for r in rows], columns)


@query(_each([("1", "naproxen", "stop"), ("2", "{drug}", "stop"), ("4", "{drug2}", None), ("5", "furosemide", "continue"), ("6", "apixaban", "new"), ("8", "furosemide", None)], "line_no drug action"))
def med_list_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.medicine_lines(_lines(spark, sf_dir))
    return found.select(F.col("case_id").alias("p_partkey"), F.col("line_no").cast("string").alias("line_no"), "drug", "action")


@query(f"""
SELECT p_partkey, {pick(["naproxen", "apixaban"], "(p_partkey % 2)")} AS drug, {pick(["stop", "new"], "(p_partkey % 2)")} AS text_actions, {pick(["continue", "stop"], "(p_partkey % 2)")} AS model_actions FROM part
""")
def med_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact that disagrees with the source, one that agrees, one without an action in the source, and one that is no medicine."""
    own = rows_of(spark, sf_dir, f"""
        SELECT p_partkey AS case_id, 'medication' AS kind, {pick(["Naproxen", "Eliquis"], "(p_partkey % 2)")} AS drug, {pick(["continue", "stop"], "(p_partkey % 2)")} AS med_action FROM part
        UNION ALL SELECT p_partkey, 'medication', 'furosemide', 'continue' FROM part
        UNION ALL SELECT p_partkey, 'medication', {VALUES["drug2"]}, 'hold' FROM part WHERE {VALUES["drug2"]} <> 'furosemide'
        UNION ALL SELECT p_partkey, 'diagnosis', {pick(["apixaban", "naproxen"], "(p_partkey % 2)")}, 'new' FROM part""", "part")
    found = facts.cross_check(own, facts.medicine_lines(_lines(spark, sf_dir)))
    return found.select(F.col("case_id").alias("p_partkey"), "drug", F.array_join("text_actions", "/").alias("text_actions"), F.array_join("model_actions", "/").alias("model_actions"))


_QUOTE = written("STOP taking these medicines: Naproxen 400 mg {drug} {n} mg {drug2} 25 mg twice daily Lasix {n} mg daily, keep potassium in range Eliquis 5 mg Take furosemide {n} mg daily", VALUES)


@query(f"""
SELECT p_partkey, 'R1' AS fact_id, {written("Weigh yourself every {d} days", VALUES)} AS unit FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'R2' ELSE 'R1' END, 'Call the clinic about swollen legs' FROM part
""")
def uncovered_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where p_partkey is odd a fact covers the weighing."""
    units = facts.instruction_units(_lines(spark, sf_dir))
    own = rows_of(spark, sf_dir, f"SELECT p_partkey AS case_id, 'F1' AS fact_id, {_QUOTE} AS source_quote, CASE WHEN p_partkey % 2 = 1 THEN {written('weigh yourself every {d} days', VALUES)} ELSE '' END AS detail FROM part", "part")
    return facts.uncovered(units, own).select(F.col("case_id").alias("p_partkey"), "fact_id", "unit")


# ------------------------------------------------------------------ what a sentence says against what it cites

#: kind, action, drug, frequency, quote, sentence, cited ids, checks that must not pass.
MEANING: list[tuple[str, str | None, str | None, str, str, str, str, list[tuple[str, str]]]] = [
    ("medication", "new", "{drug}", "twice daily", "NEW: {drug} {n} mg twice daily", "Take {drug} {n} mg twice daily.", "F1", []),
    ("medication", "continue", "insulin", "", "CONTINUE: insulin 201-250 give {n} units", "Keep taking insulin: for 201-250 take 9{n} units.", "F1", [("numbers", "fail"), ("scale", "fail")]),
    ("medication", "continue", "insulin", "", "CONTINUE: insulin 201-250 give {n} units", "Keep taking insulin: for 201-250 take {n} units.", "F1", []),
    ("follow_up", None, None, "", "See the clinic on {en_month} {d}, {y}", "See the clinic on {en_month} {d}, {y}.", "F1", []),
    ("follow_up", None, None, "", "See the clinic on {en_month} {d}, {y}", "See the clinic on the {d} {en_month} 19{mm}.", "F1", [("numbers", "fail"), ("dates", "fail")]),
    ("medication", "new", "{drug}", "twice daily", "NEW: {drug} 9{n} mg twice daily", "Take {drug} 9{n} mg every 12 hours or three times a day.", "F1", [("numbers", "fail"), ("frequency", "fail")]),
    ("medication", "new", "{drug}", "twice daily", "NEW: {drug} {n} mg twice daily, not like digoxin", "Once a day take digoxin, {drug} {n} mg twice daily, digoxin once a day.", "F1", []),
    ("medication", "new", "{drug}", "", "NEW: {drug} {n} mg as needed for pain", "Take {drug} {n} mg every day.", "F1", [("as_needed", "fail")]),
    ("medication", "new", "{drug}", "", "NEW: {drug} {n} mg as needed for pain", "Take {drug} {n} mg only if you have pain.", "F1", []),
    ("medication", "new", "{drug}", "", "NEW: {drug} {n} mg daily for {d} days, then as needed", "Take {drug} {n} mg every day for {d} days.", "F1", []),
    ("medication", "new", "{drug}", "", "NEW: {drug} as needed, maximum {n} a day", "Take at most {n} of {drug}.", "F1", []),
    ("warning_sign", None, None, "", "Call 911 for chest pain", "Chest pain is normal.", "F1", [("reassurance", "warn")]),
    ("warning_sign", None, None, "", "Mild swelling is normal, call if it grows", "Swelling is normal.", "F1", []),
    ("diet", None, None, "", "Limit sodium to {n} g", "Eat less than {n} g of salt.", "F1", [("salt_sodium", "fail")]),
    ("diet", None, None, "", "Limit sodium (salt) to {n} g", "Eat less than {n} g of salt.", "F1", []),
    ("follow_up", None, None, "", "Call [PHONE_1] about it", "Call [PHONE_2] about it.", "F1", [("placeholder", "fail")]),
    ("follow_up", None, None, "", "Call [PHONE_1] about it", "Call [PHONE_1] about it.", "F1", []),
    ("activity", None, None, "", "Walk {n} minutes", "Walk {n} minutes.", "F1,F77", [("citation", "fail")]),
    ("activity", None, None, "", "Walk {n} minutes", "Walk {n} minutes.", "", [("citation", "fail"), ("numbers", "fail")]),
    ("medication", "hold", "{drug}", "", "HOLD: {drug} until your visit", "Stop {drug}.", "F1", [("meaning_polarity", "warn")]),
    ("medication", "stop", "{drug}", "", "STOP: {drug}", "Never skip {drug}.", "F1", [("meaning_polarity", "fail")]),
    ("medication", "new", "{drug}", "", "NEW: {drug} {n} mcg", "Take {drug} {n} mg.", "F1", [("units", "fail")]),
    ("medication", "new", "{drug}", "", "NEW: {drug} {n} mg", "Take {drug} {n} mg and digoxin.", "F1", [("drug", "fail")]),
    ("medication", "changed", "{drug}", "", "CHANGED: {drug} {n} mg", "Take {drug} {n} mg.", "F1", [("cited_fact", "warn")]),
]
_AT = f"(p_partkey % {len(MEANING)})"


def _column(i: int) -> str:
    return f"CASE {_AT} " + " ".join(f"WHEN {k} THEN {'CAST(NULL AS VARCHAR(20))' if m[i] is None else written(m[i], VALUES)}" for k, m in enumerate(MEANING)) + " END"


_MEANT = f"""
SELECT p_partkey, p_partkey AS case_id, {_AT} AS k, 'F1' AS fact_id, 'S1' AS sent_id, {_column(0)} AS kind, {_column(1)} AS med_action, {_column(2)} AS drug, CAST(NULL AS VARCHAR(20)) AS dose,
       {_column(3)} AS frequency, '' AS detail, {_column(4)} AS source_quote, {_column(5)} AS text_en, {_column(6)} AS ids, {_AT} = 23 AS doubtful FROM part
"""


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of _MEANT, their facts, and their sentences with risk and checks: those that are alike are read once."""
    rows = rows_of(spark, sf_dir, _MEANT, "part")
    own = rows.drop("text_en", "sent_id", "ids", "k")
    said = rows.select("case_id", "sent_id", "text_en", F.filter(F.split("ids", ","), lambda x: x != "").alias("fact_ids"))
    return rows, own, sentences.checked(said, own)


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", "sent_id", F.explode("checks").alias("c")).select("case_id", "sent_id", "c.name", "c.status")


@query(wanted([m[5] for m in MEANING], [(k, name, status) for k, m in enumerate(MEANING) for name, status in m[7]], "name status"))
def sentence_meaning_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _long(_checked(spark, sf_dir)[2])
    return checks.filter("status <> 'pass'").select(F.col("case_id").alias("p_partkey"), "name", "status")


@query(wanted([m[5] for m in MEANING], [(k, written_set) for k, m in enumerate(MEANING) if m[7] for written_set in [",".join(sorted(f"{n}:{s}" for n, s in m[7]))]], "bad"))
def check_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that don't pass, as one set for each sentence."""
    sets = rollup.check_sets(_long(_checked(spark, sf_dir)[2]), ["case_id", "sent_id"])
    return sets.select(F.col("case_id").alias("p_partkey"), F.array_join(F.transform("bad", lambda b: F.concat_ws(":", b["name"], b["status"])), ",").alias("bad"))


#: kind, action, drug, other medicine, quote, sentence, translation: what errors are put into.
MUTATED: list[tuple[str, str | None, str | None, str | None, str, str, str]] = [
    ("medication", "stop", "{drug}", "{drug2}", "STOP: {drug}", "Stop taking {drug}.", "Deje de tomar {drug}."),
    ("medication", "hold", "{drug}", "{drug2}", "HOLD: {drug} until your visit", "Hold {drug} until your visit.", "Suspenda {drug} hasta su visita."),
    ("medication", "continue", "omeprazole", "digoxin", "CONTINUE: omeprazole {n} mg", "Keep taking omeprazole {n} mg.", "Siga tomando omeprazole {n} mg."),
    ("warning_sign", None, None, None, "Call 911 for chest pain", "Call 911 for chest pain.", "Llame al 911 por dolor de pecho."),
    ("medication", "new", "omeprazole", None, "NEW: omeprazole {n} mg as needed", "Take omeprazole {n} mg only if needed.", "Tome omeprazole {n} mg solo si lo necesita."),
    ("follow_up", None, None, None, "Call [PHONE_1] today", "Call [PHONE_1] today.", "Llame a [PHONE_1] hoy."),
]
_M = f"(p_partkey % {len(MUTATED)})"
_MUTATIONS: list[tuple[str, list[int], str]] = [
    ("omission", [0, 1, 2, 3, 4, 5], "blocked"), ("flip_stop_to_keep", [0, 1], "blocked"), ("translation_flip", [0, 1], "blocked"), ("hold_as_permanent_stop", [1], "flagged"),
    ("number_changed", [2, 3, 4, 5], "blocked"), ("translation_number_changed", [2, 3, 4, 5], "blocked"), ("emergency_number_dropped", [3], "blocked"), ("as_needed_dropped", [4], "blocked"),
    ("hallucinated_medicine", [0, 1, 2, 3, 4, 5], "blocked"), ("unsupported_sentence", [0, 1, 2, 3, 4, 5], "blocked"), ("contact_lost_in_translation", [5], "blocked"),
    ("wrong_medicine_named", [0, 1, 2], "blocked"), ("other_unit", [2, 4], "blocked"), ("clean", [0, 1, 3], "in review"), ("clean", [2, 4, 5], "slipped"),
]


def _mut(i: int) -> str:
    return f"CASE {_M} " + " ".join(f"WHEN {k} THEN {'CAST(NULL AS VARCHAR(20))' if m[i] is None else written(m[i], VALUES)}" for k, m in enumerate(MUTATED)) + " END"


@query(" UNION ALL ".join(f"SELECT '{name}' AS mutation, '{outcome}' AS outcome, count(*) AS n FROM part WHERE {_M} IN ({', '.join(map(str, ks))})" for name, ks, outcome in _MUTATIONS))
def mutation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of error in translated sentences, against the checks of the sentence, of its translation and of coverage."""
    rows = rows_of(spark, sf_dir, f"""SELECT p_partkey AS case_id, 'F1' AS fact_id, {_mut(0)} AS kind, {_mut(1)} AS med_action, {_mut(2)} AS drug, {_mut(3)} AS other, '' AS dose, '' AS frequency, '' AS detail,
        {_mut(4)} AS source_quote, {_mut(5)} AS text_en, {_mut(6)} AS text_tl FROM part""", "part")
    # Cases apart from each other fare alike if they are alike: one stands for all of them, n.
    alike = stored(rows.groupBy(*(c for c in rows.columns if c != "case_id")).agg(F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("n")))
    rows = alike.drop("n").hint("merge")
    own = rows.select("case_id", "fact_id", "kind", "med_action", "drug", "dose", "frequency", "detail", "source_quote")
    said = rows.select("case_id", "kind", "med_action", "drug", "other", "text_en", "text_tl", F.col("text_en").alias("back_en"), F.array("fact_id").alias("fact_ids"), F.lit(True).alias("critical"))
    made = mutation.mutants(said, F.col("other")).withColumn("sent_id", F.col("mutation"))
    cited = sentences.with_cited(made.filter("not removed"), own).withColumn("about_medicine", F.exists("cited", lambda f: f["kind"] == "medication"))
    checks = sentences.sentence_checks(cited).unionByName(sentences.translation_checks(cited, "es"))
    high = cited.select("case_id", "sent_id", F.exists("cited", lambda f: f["risk"] == "high").alias("high"))
    worst = rollup.statuses(checks, ["case_id", "sent_id"])
    runs = made.select("case_id", "sent_id", "mutation").join(high, ["case_id", "sent_id"], "left").join(worst, ["case_id", "sent_id"], "left")
    runs = runs.withColumn("needs_review", F.coalesce("high", F.lit(False)) | (F.coalesce("status", F.lit("green")) != "green"))
    # Each mutant is a packet of its own: its case is (case, mutation).
    packets = lambda df: df.withColumn("case_id", F.concat_ws("/", "case_id", "mutation"))
    told = packets(made).select("case_id", "text_en", "fact_ids", "removed")
    missing = coverage.omissions(packets(own.join(made.select("case_id", "mutation"), "case_id")), told)
    lost = missing.filter("case_id not like '%/clean' and case_id not like '%/unsupported_sentence'").select(F.split_part("case_id", F.lit("/"), F.lit(1)).cast("long").alias("case_id"), F.split_part("case_id", F.lit("/"), F.lit(2)).alias("sent_id"))
    clean = checks.filter("sent_id = 'clean'").drop("sent_id").join(made.select("case_id", "sent_id").filter("sent_id <> 'clean'"), "case_id")
    signals = rollup.new_signals(clean, checks.filter("sent_id <> 'clean'"), ["case_id", "sent_id"])
    done = mutation.outcomes(runs, signals, lost, ["case_id", "sent_id"]).join(alike.select("case_id", "n").hint("merge"), "case_id")
    return done.groupBy("mutation", "outcome").agg(F.sum("n").alias("n"))


@query(f"""
SELECT p_partkey, 'S1' AS sent_id, {written("Take {drug} {n} mg.", VALUES)} AS text_en, CASE WHEN p_partkey % 3 = 0 THEN 'Tome eso.' ELSE {written("Tome {drug} {n} mg.", VALUES)} END AS text_tl FROM part
UNION ALL SELECT p_partkey, 'S2', 'Walk.', 'Camine.' FROM part WHERE p_partkey % 3 <> 1 UNION ALL SELECT p_partkey, 'S9', 'Run.', 'Corra.' FROM part WHERE p_partkey % 3 = 2
""")
def packet_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet with patches: a translation replaced, a sentence dropped, one added."""
    base = rows_of(spark, sf_dir, f"SELECT p_partkey, 'S1' AS sent_id, {written('Take {drug} {n} mg.', VALUES)} AS text_en, {written('Tome {drug} {n} mg.', VALUES)} AS text_tl FROM part UNION ALL SELECT p_partkey, 'S2', 'Walk.', 'Camine.' FROM part", "part")
    patches = rows_of(spark, sf_dir, "SELECT p_partkey, 'S1' AS sent_id, CAST(NULL AS VARCHAR(20)) AS text_en, 'Tome eso.' AS text_tl, false AS drop FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'S2', NULL, NULL, true FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'S9', 'Run.', 'Corra.', false FROM part WHERE p_partkey % 3 = 2", "part")
    return mutation.variant(base, patches, ["p_partkey", "sent_id"])


#: kind, action, drug, quote, must_cover, dismissed, sentence, whether it is removed, rules that must be found.
COVERED: list[tuple[str, str | None, str | None, str, bool, bool, str, bool, list[str]]] = [
    ("follow_up", None, None, "See us on {en_month} {d}, {y} at 9:{mm} am", False, False, "See us on {en_month} {d} at 9:{mm}.", False, []),
    ("follow_up", None, None, "See us on {en_month} {d}, {y} at 9:{mm} am", False, False, "See us on {en_month} {d}.", False, ["appointment_never_stated"]),
    ("follow_up", None, None, "See us on {en_month} {d}, {y}", False, False, "See us soon.", False, ["appointment_never_stated"]),
    ("follow_up", None, None, "See us on {en_month} {d}, {y}", False, True, "See us soon.", False, []),
    ("warning_sign", None, None, "Call [PHONE_1] for fever above 3{d}", False, False, "Call [PHONE_1] for fever above 3{d}.", False, []),
    ("warning_sign", None, None, "Call [PHONE_1] for fever above 3{d}", False, False, "Call [PHONE_1] for fever.", False, ["threshold_never_stated"]),
    ("warning_sign", None, None, "Call [PHONE_1] for fever", False, False, "Call us for fever.", False, ["threshold_never_stated"]),
    ("warning_sign", None, None, "Call [PHONE_1] for fever", False, False, "Call [PHONE_1] for fever.", True, ["not_explained"]),
    ("diet", None, None, "Eat less salt", False, False, "", True, []),
    ("diet", None, None, "Eat less salt", True, False, "", True, ["not_explained"]),
    ("medication", "new", "{drug}", "NEW: {drug} {n} mg as needed", False, False, "Take {drug} {n} mg.", False, ["as_needed_not_told"]),
    ("medication", "new", "{drug}", "NEW: {drug} {n} mg as needed", False, False, "Take {drug} {n} mg if needed.", False, []),
    ("medication", "continue", "{drug}", "CONTINUE: {drug} within {d}77 hours, from 9{mm} mg", False, False, "Keep taking {drug}.", False, ["numbers_never_stated"]),
    ("medication", "changed", "{drug}", "CHANGED: {drug} from 9{mm} mg", False, False, "Take {drug} now.", False, []),
    ("medication", "stop", "{drug}", "STOP: {drug}", False, False, "Do not take it.", False, ["never_named"]),
    ("medication", "hold", "{drug}", "HOLD: {drug}", False, False, "Ask about {drug}.", False, ["stop_not_clear"]),
]
_C = f"(p_partkey % {len(COVERED)})"


def _of(i: int) -> str:
    return f"CASE {_C} " + " ".join(f"WHEN {k} THEN {'CAST(NULL AS VARCHAR(20))' if m[i] is None else written(m[i], VALUES)}" for k, m in enumerate(COVERED)) + " END"


def _flag(i: int) -> str:
    return f"({_C} IN ({', '.join(['-1', *(str(k) for k, m in enumerate(COVERED) if m[i])])}))"


@query(wanted([m[6] for m in COVERED], [(k, rule) for k, m in enumerate(COVERED) for rule in m[8]], "rule"))
def coverage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of coverage, with facts to cover in any case, dismissed facts and removed sentences."""
    rows = rows_of(spark, sf_dir, f"""SELECT p_partkey AS case_id, 'F1' AS fact_id, {_of(0)} AS kind, {_of(1)} AS med_action, {_of(2)} AS drug, '' AS dose, '' AS frequency, '' AS detail,
        {_of(3)} AS source_quote, {_flag(4)} AS must_cover, {_flag(5)} AS dismissed, {_of(6)} AS text_en, {_flag(7)} AS removed FROM part""", "part")
    said = rows.select("case_id", "text_en", "removed", F.array("fact_id").alias("fact_ids"))
    return coverage.omissions(rows.drop("text_en", "removed"), said).select(F.col("case_id").alias("p_partkey"), "rule")


@query(wanted(["", "", "", ""], [(0, "R1", "rule", "true"), (0, "F1", None, "false"), (1, "F1", None, "false"), (2, "R1", "rule", "true"), (2, "F1", None, "false"), (3, "F1", None, "false")], "fact_id origin must_cover"))
def fact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's facts and those that the rules add, which must be covered."""
    lines = rows_of(spark, sf_dir, f"SELECT p_partkey AS case_id, CAST(0 AS INT) AS line_no, {chosen(['Weigh yourself every morning.', 'Take {drug} {n} mg.', 'Never drive a car at night.', 'Nothing.'], '(p_partkey % 4)', VALUES)} AS line FROM part", "part")
    own = rows_of(spark, sf_dir, f"SELECT p_partkey AS case_id, 'F1' AS fact_id, 'medication' AS kind, {written('Take {drug} {n} mg.', VALUES)} AS source_quote, '' AS detail FROM part", "part")
    both = facts.with_rule_facts(own, facts.uncovered(facts.instruction_units(lines), own))
    return both.select(F.col("case_id").alias("p_partkey"), "fact_id", "origin", F.col("must_cover").cast("string").alias("must_cover"))


# ------------------------------------------------------------------ what reviewers do

_REASONS = ["not needed by the patient", "short", "", "the patient knows this well"]
_RISK, _STATUS, _ORIGIN = pick(["high", "normal", "high"], "(p_partkey % 3)"), pick(["red", "green", "amber", "green", "green"], "(p_partkey % 5)"), pick(["model", "rule"], "(CAST(floor(p_partkey / 7) AS BIGINT) % 2)")
_DISMISS = f"""SELECT p_partkey, p_partkey AS case_id, CASE WHEN p_partkey % 11 = 0 THEN 'F9' ELSE 'F1' END AS fact_id, {pick(_REASONS, "(p_partkey % 4)")} AS reason, {_RISK} AS risk, {_STATUS} AS status, {_ORIGIN} AS origin FROM part"""


@query(f"""
SELECT p_partkey, CASE WHEN fact_id = 'F9' THEN 'no fact' WHEN risk = 'high' AND status <> 'red' AND origin <> 'rule' THEN 'high risk' WHEN length(reason) < 8 THEN 'no reason' END AS error FROM ({_DISMISS})
""")
def dismissal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, _DISMISS, "part")
    own = rows.select("case_id", F.lit("F1").alias("fact_id"), "risk", "status", "origin")
    return review.dismissed(own, rows.select("case_id", "fact_id", "reason")).select(F.col("case_id").alias("p_partkey"), "error")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no issue' WHEN length({pick(_REASONS, "(p_partkey % 4)")}) < 8 THEN 'no reason' END AS error FROM part""")
def resolution_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, f"SELECT p_partkey AS case_id, p_partkey % 5 = 0 AS other, {pick(_REASONS, '(p_partkey % 4)')} AS reason FROM part", "part")
    issues = rows.select("case_id", F.when(F.col("other"), "aspirin").otherwise("warfarin").alias("drug"))
    return review.resolved(issues.unionAll(issues), rows.select("case_id", F.lit("warfarin").alias("drug"), "reason")).select(F.col("case_id").alias("p_partkey"), "error")


@query(f"""
SELECT p_partkey, concat('S', CAST(p_partkey % 5 + n AS VARCHAR(20))) AS sent_id, CASE (p_partkey + n) % 4 WHEN 0 THEN 'medicines' WHEN 1 THEN 'warning_signs' WHEN 2 THEN 'appointments' ELSE 'daily_care' END AS section,
       {written("Come on {en_month} {d}, {y}", {**VALUES, "en_month": pick([m.title() for m in ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]], "(p_partkey % 12)")})} AS text_en
FROM part, (VALUES (1), (2)) t(n)
""")
def added_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two additions to each case, whose sentences go up to S0 .. S4."""
    kinds = pick(["medication", "warning_sign", "follow_up", "diet"], "((p_partkey + n) % 4)")
    rows = rows_of(spark, sf_dir, f"SELECT p_partkey AS case_id, n AS at, concat('F', CAST(n AS VARCHAR(20))) AS fact_id, {kinds} AS kind, {written('Come on {m}/{d}/{y}', VALUES)} AS text_en FROM part, (VALUES (1), (2)) t(n)", "part")
    there = rows_of(spark, sf_dir, "SELECT p_partkey AS case_id, concat('S', CAST(n AS VARCHAR(20))) AS sent_id FROM part, (VALUES (1), (2), (3), (4)) t(n) WHERE n <= p_partkey % 5 UNION ALL SELECT p_partkey, 'Sx' FROM part", "part")
    return review.added(rows.select("case_id", "fact_id", "kind"), there, rows.select("case_id", "at", "fact_id", "text_en")).select(F.col("case_id").alias("p_partkey"), "sent_id", "section", "text_en")


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 AND event_id % 3 <> 0"
_ALERTS = f"SELECT user_id, event_type, event_id, concat('A', CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR(20))) AS alert_id FROM ({_FIRST})"


def _alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alerts of users as cases: an event type is a question on the fact of its name, and an event the choice of an option, the first of three being right."""
    ev = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null")
    answers = ev.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("q_id"), (F.col("event_id") % 3).alias("choice"), "ts", "event_id")
    asked = answers.select("case_id", "q_id").distinct()
    questions = asked.select("case_id", "q_id", F.col("q_id").alias("fact_id"), F.lit(0).alias("right"), F.concat(F.lit("About "), "q_id").alias("prompt"), F.when(F.col("q_id") != "view", F.concat(F.lit("S-"), "q_id")).alias("sent_id"), F.array(F.lit("yes"), F.lit("no"), F.lit("ask")).alias("options"))
    own = asked.select("case_id", F.col("q_id").alias("fact_id"), F.concat(F.lit("the "), "q_id").alias("detail"))
    return review.alerts(answers, questions, own), questions, own


@query(f"SELECT user_id, alert_id, event_type AS q_id, concat('Re-explain: the ', event_type) AS message FROM ({_ALERTS})")
def wrong_answer_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir)[0].select(F.col("case_id").alias("user_id"), "alert_id", "q_id", "message")


@query(f"""
SELECT user_id, alert_id, concat('the ', event_type) AS fact_detail, concat('About ', event_type) AS prompt, CASE WHEN event_type <> 'view' THEN concat('Text of ', event_type) END AS text_en,
       CASE event_id % 3 WHEN 1 THEN 'no' ELSE 'ask' END AS chosen FROM ({_ALERTS})
""")
def alert_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, questions, own = _alerts(spark, sf_dir)
    said = questions.filter("sent_id is not null").select("case_id", "sent_id", F.concat(F.lit("Text of "), "q_id").alias("text_en"))
    return review.alert_view(found, own, questions, said).select(F.col("case_id").alias("user_id"), "alert_id", "fact_detail", "prompt", "text_en", "chosen")


@query(f"SELECT user_id, count(*) AS n, count(*) FILTER (WHERE user_id % 3 <> 0 OR alert_id <> 'A1') AS open, max(CASE WHEN user_id % 3 = 0 AND alert_id = 'A1' THEN 'first' END) AS reviewer FROM ({_ALERTS}) GROUP BY user_id")
def alerts_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every third user's first alert, two acknowledgements: the earlier one counts."""
    found = _alerts(spark, sf_dir)[0]
    some = found.filter("case_id % 3 = 0 and alert_id = 'A1'").select("case_id", "alert_id", "ts")
    acks = some.select("case_id", "alert_id", F.explode(F.array(F.struct((F.col("ts") + F.expr("interval 2 hours")).alias("ts"), F.lit(1).alias("event_id"), F.lit("second").alias("reviewer")), F.struct((F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.lit(2).alias("event_id"), F.lit("first").alias("reviewer")))).alias("a")).select("case_id", "alert_id", "a.*")
    return rollup.open_alerts(review.acknowledged(found, acks)).withColumnRenamed("case_id", "user_id")


_QUEUE = f"""
SELECT p_partkey, 0 AS r, 'F1/dose' AS o, 'F1' AS id, 'red' AS state, false AS done FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 0, 'F1/name', 'F1', 'red', false FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 1, 'warfarin', 'warfarin', 'red', false FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 2, 'F1', 'F1', 'red', false FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 2, 'F2', 'F2', 'red', false FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 3, 'b', 'S2', 'high', false FROM part
UNION ALL SELECT p_partkey, 3, 'a', 'S3', 'done', true FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 3, 'c', 'S1', {pick(["red", "amber"], "(p_partkey % 2)")}, false FROM part
"""


@query(f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY r, o) AS INTEGER) AS place, id, state, done FROM ({_QUEUE})")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omissions, open medicine issues, red facts that aren't missing, then sentences by section; removed and unneeded ones are out."""
    rows = lambda sql: rows_of(spark, sf_dir, sql, "part")
    omissions = rows("SELECT p_partkey AS case_id, 'F1' AS fact_id, 'dose' AS rule FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'F1', 'name' FROM part WHERE p_partkey % 4 = 0")
    issues = rows("SELECT p_partkey AS case_id, 'warfarin' AS drug, p_partkey % 3 <> 0 AS resolved FROM part")
    own = rows("SELECT p_partkey AS case_id, 'F1' AS fact_id, 'red' AS status, p_partkey % 5 = 0 AS dismissed FROM part UNION ALL SELECT p_partkey, 'F2', CASE WHEN p_partkey % 7 = 0 THEN 'red' ELSE 'amber' END, false FROM part")
    said = rows(f"""SELECT p_partkey AS case_id, 'S1' AS sent_id, 1 AS pos, 'daily_care' AS section, {pick(["red", "amber"], "(p_partkey % 2)")} AS status, true AS needs_review, false AS reviewed, false AS removed FROM part
        UNION ALL SELECT p_partkey, 'S2', 2, 'medicines', 'green', true, false, false FROM part UNION ALL SELECT p_partkey, 'S3', 3, 'why_here', 'green', false, p_partkey % 2 = 0, false FROM part
        UNION ALL SELECT p_partkey, 'S4', 4, 'medicines', 'red', true, true, true FROM part""")
    return review.queue(omissions, issues, own, said).withColumnRenamed("case_id", "p_partkey")


@query("""
SELECT user_id, string_agg(event_type, ', ' ORDER BY ts, event_id) AS first_five FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL) WHERE n <= 5 GROUP BY user_id
""")
def first_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five blockers of each case, as a refusal to sign names them."""
    ev = table(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").alias("case_id"), F.struct("ts", "event_id").alias("place"), F.col("event_type").alias("item"))
    return rollup.first_blockers(ev).select(F.col("case_id").alias("user_id"), F.array_join("first", ", ").alias("first_five"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE user_id IS NOT NULL")
def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log of each case, newest first."""
    ev = table(spark, sf_dir, "events").filter("user_id is not null").withColumnRenamed("user_id", "case_id")
    return review.newest(ev, ["case_id"], ["ts", "event_id"]).select("event_id", "place")


@query(f"SELECT CASE WHEN med_action IN ('stop', 'changed', 'new', 'hold', 'continue') THEN med_action ELSE 'other' END AS action, count(*) AS n, CAST(CASE med_action WHEN 'stop' THEN 1 WHEN 'hold' THEN 2 WHEN 'changed' THEN 3 WHEN 'new' THEN 4 WHEN 'continue' THEN 5 ELSE 6 END AS INTEGER) AS place FROM (SELECT CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE med_action END AS med_action FROM ({FACTS})) GROUP BY med_action")
def medicines_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, FACTS, "part").withColumn("med_action", F.when(F.col("p_partkey") % 6 != 0, F.col("med_action")))
    return packet.by_action(rows).groupBy("action", "place").agg(F.count(F.lit(1)).alias("n"))


_WARNINGS = ["Call 911 for chest pain.", "Go to the EMERGENCY room.", "Call us about {n} days of fever.", "Dial 112 now.", "Room 9112 is closed."]


@query(f"SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS emergency FROM part")
def warning_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, made(_WARNINGS), "part")
    return rows.select("p_partkey", packet.is_emergency(F.col("text")).alias("emergency"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN concat('s', CAST(o_orderkey % 10 AS VARCHAR(20))) END AS sample_id FROM orders
""")
def sample_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that name a sample: some have its text changed, some its language, some name none that exists."""
    rows = lambda sql: rows_of(spark, sf_dir, sql, "orders")
    samples = rows("SELECT DISTINCT concat('s', CAST(o_orderkey % 10 AS VARCHAR(20))) AS id, concat('text ', CAST(o_orderkey % 10 AS VARCHAR(20))) AS source, 'es' AS language FROM orders")
    cases = rows("SELECT o_orderkey, concat('s', CAST(o_orderkey % 10 AS VARCHAR(20))) AS sample_id, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'other ' ELSE 'text ' END, CAST(o_orderkey % 10 AS VARCHAR(20))) AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'es' ELSE 'fr' END AS language FROM orders")
    return review.same_sample(cases, samples).select("o_orderkey", "sample_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 END AS seconds FROM orders")
def recheck_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that lacks some timings takes them from an earlier one."""
    orders = table(spark, sf_dir, "orders")
    run = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("seconds"))
    earlier = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("seconds"))
    return readers.with_timings(run, earlier, ["o_orderkey"])


@query("""
SELECT event_type AS concurrency, count(*) AS runs, count(*) FILTER (WHERE event_id % 5 <> 0) AS ok, round(3600.0 * count(*) FILTER (WHERE event_id % 5 <> 0) / sum(user_id), 2) AS packets_per_hour,
       round(1.99 * sum(user_id) / 3600 / count(*) FILTER (WHERE event_id % 5 <> 0), 4) AS cost_per_packet FROM events GROUP BY event_type
""")
def benchmark_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("concurrency"), (F.col("event_id") % 5 != 0).alias("ok"), F.col("user_id").cast("double").alias("seconds"))
    return rollup.throughput(runs, ["concurrency"])


@query(f"""
SELECT name, n, max(n) OVER () AS most FROM (
  SELECT 'omissions' AS name, count(*) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'medicines', count(*) FROM part WHERE p_partkey % 3 = 0
  UNION ALL {" UNION ALL ".join(f"SELECT '{name}', count(*) FROM part WHERE {_AT} IN ({', '.join(str(k) for k, m in enumerate(MEANING) for n, _ in m[7] if n == name)})" for name in sorted({n for m in MEANING for n, _ in m[7]}))}) WHERE n > 0
""")
def caught_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was caught, by name, with the omissions and medicine issues and the longest bar."""
    rows, _, checked = _checked(spark, sf_dir)
    return rollup.bars(_long(checked), rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 3 = 0"))


@query(f"""
SELECT count(*) AS live, count(*) FILTER (WHERE {_AT} NOT IN ({', '.join(str(k) for k, m in enumerate(MEANING) if not m[7])}) OR {_AT} IN (1, 2, 11, 12, 19, 20, 23) OR ({_AT} IN (0, 5, 6, 7, 8, 9, 10, 21, 22) AND {VALUES["drug"]} IN ('warfarin', 'insulin', 'oxycodone')) ) AS flagged,
       count(*) AS facts, count(*) FILTER (WHERE p_partkey % 2 = 0) AS omissions, count(*) FILTER (WHERE p_partkey % 3 = 0) AS med_issues FROM part
""")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all cases: live sentences, those flagged, facts, omissions and medicine issues."""
    rows, own, checked = _checked(spark, sf_dir)
    return rollup.totals(rollup.with_status(checked), own, rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 3 = 0")).select("live", "flagged", "facts", "omissions", "med_issues")


#: Letters, marks above and below, and what is between names: a customer's name as a reviewer might type it.
_LETTERS, _MARKS, _GAPS = "aeiouyAEOUcnsdzôêăơưαωι", "\u0301\u0300\u0302\u0303\u0308\u030a\u030c\u0323\u0327\u0328\u0331\u031b\u0306\u0345", " \t\u00a0\u200b\u2003"
_pick = lambda letters, at: f"substring('{letters}', CAST(1 + ({at}) % {len(letters)} AS INT), 1)"
_TYPED = f"""concat({_pick(_LETTERS, "c_custkey")}, {_pick(_MARKS, "c_custkey")}, {_pick(_MARKS, "c_custkey * 5 + 2")}, {_pick(_GAPS, "c_custkey")}, {_pick(_GAPS, "c_custkey * 3 + 1")},
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_mktsegment, {_pick(_MARKS, "c_custkey + 1")}) END, {_pick(_GAPS, "c_custkey + 2")})"""


@query(f"""
WITH c AS (SELECT c_custkey, trim(regexp_replace(replace(regexp_replace(nfc_normalize({_TYPED}), '[ \t\u00a0\u2003]+', ' ', 'g'), '\u200b', ''), ' +', ' ', 'g')) AS name FROM customer)
SELECT c_custkey, name, c_custkey % 4 <> 0 AS is_real FROM c
""")
def reviewer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names typed with marks apart, invisible characters and odd spaces, cleaned; and whether a name has two letters. Without the segment there is one."""
    rows = rows_of(spark, sf_dir, f"SELECT c_custkey, {_TYPED} AS typed FROM customer", "customer")
    return masking.reviewers(rows, "typed").select("c_custkey", "name", "is_real")


#: A case of three facts and three sentences for each part: medicine and what to do with it, language, and whether the first sentence is removed, by key.
_LANGS, _DRUGS, _DO = [*QUIZ, "xx"], ["warfarin", "insulin", "furosemide"], [*WRONG_BY_ACTION, "other"]
_ASKED = f"""SELECT p_partkey AS case_id, {pick(_LANGS, f"(p_partkey % {len(_LANGS)})")} AS language, {pick(_DRUGS, "(p_partkey % 3)")} AS drug,
 {pick(_DO, f"(CAST(floor(p_partkey / 3) AS BIGINT) % {len(_DO)})")} AS med_action, p_partkey % 5 = 0 AS gone, p_partkey % 2 = 0 AS visit FROM part"""
_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_by = lambda column, values: f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in values.items() if k != "en") + f" ELSE {values['en']} END"
_list = lambda texts: f"[{', '.join(map(_quoted, texts))}]"
_wrong_of = lambda t: f"CASE med_action {' '.join(f'WHEN {_quoted(a)} THEN ' + _list(t['med_wrong'][k] for k in keys) for a, keys in WRONG_BY_ACTION.items())} ELSE {_list(t['med_wrong'][k] for k in WRONG_OTHERWISE)} END"


@query(f"""
WITH a AS ({_ASKED}),
q AS (
  SELECT case_id, 'F1' AS fact_id, 'S2' AS sent_id, concat('Your ', drug, ' is new.') AS en, language, 1 AS n,
    replace({_by("language", {l: _quoted(t["med_q"]) for l, t in QUIZ.items()})}, '{{drug}}', drug) AS question,
    [replace(w, '{{drug}}', drug) FOR w IN {_by("language", {l: _wrong_of(t) for l, t in QUIZ.items()})}] AS wrong FROM a
  UNION ALL SELECT case_id, 'F2', CASE WHEN gone THEN 'S3' ELSE 'S1' END, CASE WHEN gone THEN 'Call if it hurts.' ELSE 'Read this first.' END, language, 2,
    {_by("language", {l: _quoted(t["warn_q"]) for l, t in QUIZ.items()})}, {_by("language", {l: _list(t["warn_wrong"]) for l, t in QUIZ.items()})} FROM a
  UNION ALL SELECT case_id, 'F3', 'S3', 'Call if it hurts.', language, 3,
    {_by("language", {l: _quoted(t["appt_q"]) for l, t in QUIZ.items()})}, {_by("language", {l: _list(t["appt_wrong"]) for l, t in QUIZ.items()})} FROM a WHERE visit AND NOT gone),
d AS (SELECT *, CASE WHEN language IN ('en', 'xx') THEN en ELSE concat('= ', en) END AS shown,
  list_sort([struct_pack(d := sha256(concat_ws('|', CAST(case_id AS VARCHAR), fact_id, w)), t := w) FOR w IN wrong])[1:2] AS two FROM q)
SELECT case_id, fact_id, sent_id, concat('Q', n) AS q_id, question,
  array_to_string([x.t FOR x IN list_sort(list_append(two, struct_pack(d := sha256(concat_ws('|', CAST(case_id AS VARCHAR), fact_id, shown)), t := shown)))], ' / ') AS options, shown AS answer FROM d
""")
def quiz_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole quizzes: the sentence that names the medicine rather than the first, none that is removed, no sentence twice, two of three warnings, options in a fixed order."""
    rows = rows_of(spark, sf_dir, _ASKED, "part")
    of = lambda fact, kind, risk: F.struct(F.lit(fact).alias("fact_id"), F.lit(kind).alias("kind"), F.lit(risk).alias("risk"))
    own = rows.select("case_id", "language", "drug", "med_action", F.inline(F.array(of("F3", "follow_up", "normal"), of("F2", "warning_sign", "high"), of("F1", "medication", "high"), of("F4", "medication", "normal"))))
    say = lambda pos, text, ids, gone: F.struct(F.lit(f"S{pos}").alias("sent_id"), F.lit(pos).alias("pos"), text.alias("text_en"), ids.alias("fact_ids"), gone.alias("removed"))
    cite = lambda *ids: F.array(*map(F.lit, ids))
    last = F.when(F.col("visit"), cite("F2", "F3")).otherwise(cite("F2"))
    said = rows.select("case_id", F.inline(F.array(
        say(1, F.lit("Read this first."), cite("F1", "F2"), F.col("gone")), say(2, F.concat(F.lit("Your "), "drug", F.lit(" is new.")), cite("F1", "F4"), F.lit(False)), say(3, F.lit("Call if it hurts."), last, F.lit(None).cast("boolean")))))
    found = quiz.built(own, said.withColumn("text_tl", F.concat(F.lit("= "), "text_en")))
    return found.select("case_id", "fact_id", "sent_id", "q_id", "question", F.array_join("options.text", " / ").alias("options"), F.filter("options", lambda o: o["correct"])[0]["text"].alias("answer"))
