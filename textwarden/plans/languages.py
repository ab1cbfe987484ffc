"""Queries over texts in several languages, written by key from `part`: what must be read is known from the key alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions import text as tx
from ..functions.dims import MONTHS
from ..operators import sentences
from ..sources import readers
from .inputs import DRUGS, pick
from .registry import chosen, query, rows_of, written

_NUMBERS = {"n": "(p_size + 2)", "d": "(p_partkey % 28 + 1)", "m": "(p_partkey % 12 + 1)", "y": "(2020 + p_partkey % 10)", "h": "(p_partkey % 11 + 1)", "h24": "(p_partkey % 11 + 13)", "mm": "lpad(CAST(p_partkey % 60 AS VARCHAR(20)), 2, '0')"}
_MONTH = {f"{lang}_month": pick(names, "(p_partkey % 12)") for lang, names in MONTHS.items()}
VALUES = _NUMBERS | _MONTH | {"drug": pick(DRUGS, "(p_partkey % 7)"), "drug2": pick(DRUGS, "((p_partkey + 2) % 7)")}


def made(texts: list[str]) -> str:
    """p_partkey, k, text: the texts in turn, with the key's values."""
    return f"SELECT p_partkey, p_partkey % {len(texts)} AS k, {chosen(texts, f'(p_partkey % {len(texts)})', VALUES)} AS text FROM part"


def wanted(texts: list[str], rows: list[tuple], columns: str) -> str:
    """p_partkey and columns: the rows (k, values...) of the texts; a value is a template."""
    parts = []
    for k, *values in rows:
        named = ", ".join(f"{written(v, VALUES) if v is not None else 'CAST(NULL AS VARCHAR(20))'} AS {c}" for c, v in zip(columns.split(), values, strict=True))
        parts.append(f"SELECT p_partkey, {named} FROM part WHERE p_partkey % {len(texts)} = {k}")
    return " UNION ALL ".join(parts)


def _by_language(df: DataFrame, langs: list[str], read, kind: str):  # noqa: ANN001, ANN202
    lang = F.element_at(F.array(*map(F.lit, langs)), (F.col("k") + 1).cast("int"))
    return reduce(lambda out, x: F.when(lang == x, read(F.col("text"), x)).otherwise(out), sorted(set(langs)), F.lit(None).cast(kind))


_DATES = [
    ("en", "See us on {en_month} {d}, {y}."), ("es", "Venga el {d} de {es_month} de {y}."), ("fr", "Le {d} {fr_month} {y}"), ("it", "il {d} {it_month}"),
    ("vi", "ngày {d} tháng {m} năm {y}"), ("zh", "{y}年{m}月{d}日"), ("en", "on {m}/{d}/{y}"), ("es", "el {d}/{m}/{y}"), ("en", "on {y}-{m}-{d} at noon"), ("en", "take 1/2 cup"),
]


@query(wanted([t for _, t in _DATES], [(k, "{m}/{d}", None if k == 3 else "{y}") for k in range(9)], "day year"))
def dates_multilang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_of(spark, sf_dir, made([t for _, t in _DATES]), "part")
    out = _by_language(df, [x for x, _ in _DATES], tx.dates_in, "array<struct<year:int,month:int,day:int>>")
    return df.select("p_partkey", F.explode(out).alias("d")).select("p_partkey", F.concat_ws("/", "d.month", "d.day").alias("day"), F.col("d.year").cast("string").alias("year"))


_TIMES = [("en", "at {h}:{mm} a.m."), ("vi", "lúc {h} giờ chiều"), ("es", "a las {h} de la mañana"), ("fr", "à {h}h{mm}"), ("zh", "下午{h}点{mm}分"), ("en", "{h24}:{mm}"), ("en", "12:{mm}"), ("it", "alle {h} di sera"), ("en", "take {n} mg")]


@query(wanted([t for _, t in _TIMES], [(0, "{h}", "{mm}", "am"), (1, "{h}", "00", "pm"), (2, "{h}", "00", "am"), (3, "{h}", "{mm}", "?"), (4, "{h}", "{mm}", "pm"), (5, "{h}", "{mm}", "pm"), (6, "0", "{mm}", "pm"), (7, "{h}", "00", "pm")], "hour minute period"))
def times_multilang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_of(spark, sf_dir, made([t for _, t in _TIMES]), "part")
    out = _by_language(df, [x for x, _ in _TIMES], tx.times_in, "array<struct<hour:int,minute:int,period:string>>")
    return df.select("p_partkey", F.explode(out).alias("t")).select("p_partkey", F.col("t.hour").cast("string").alias("hour"), F.format_string("%02d", "t.minute").alias("minute"), "t.period")


_QUANTITIES = [
    "Take {n} mg", "{n},50 ml", "{n} to 99 tablets", "{n}单位", "{n} viên nang", "{n},000 mcg for 3 days", "{n} cuillères à soupe", "{n} libbre", "{n} tiếng", "{n} microgrammi", "{n} pastillas", "{n} giorni",
    "{n} cucchiaini", "{n} lần xịt", "{n} chilogrammi", "{n} inhalaciones", "{n} 个星期", "about {n} things",
]


@query(wanted(_QUANTITIES, [(0, "{n}", "mg"), (1, "{n}.5", "ml"), (2, "{n}", "tablet"), (3, "{n}", "unit"), (4, "{n}", "capsule"), (5, "{n}000", "mcg"), (5, "3", "day"), (6, "{n}", "spoon_tbsp"), (7, "{n}", "lb"), (8, "{n}", "hour"), (9, "{n}", "mcg"), (10, "{n}", "tablet"), (11, "{n}", "day"), (12, "{n}", "spoon_tsp"), (13, "{n}", "puff"), (14, "{n}", "kg"), (15, "{n}", "puff"), (16, "{n}", "week")], "num unit"))
def quantities_multilang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_of(spark, sf_dir, made(_QUANTITIES), "part")
    return df.select("p_partkey", F.explode(tx.quantities(F.col("text"))).alias("q")).select("p_partkey", "q.num", "q.unit")


_SCALES = ["2{d}0-2{d}9: no", "1{mm}-250 give {n} units; 251 to 300 give {m} units", "1{mm} a 200: {n} unidades", "1{mm} đến 200 dùng {n} đơn vị", "1{mm}至200给{n}个单位", "1{mm}-250 give {n} units; 1{mm}-250 give {m} units"]


@query(wanted(_SCALES, [(1, "1{mm}", "250", "{n}"), (1, "251", "300", "{m}"), (2, "1{mm}", "200", "{n}"), (3, "1{mm}", "200", "{n}"), (4, "1{mm}", "200", "{n}"), (5, "1{mm}", "250", "{m}")], "low high dose"))
def dose_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_of(spark, sf_dir, made(_SCALES), "part")
    return df.select("p_partkey", F.explode(tx.scale_steps(F.col("text"))).alias("s")).select("p_partkey", "s.low", "s.high", "s.dose")


_DAILY = [
    "Take {n} mg twice daily", "{n} mg 3 times a day", "{n} mg every 8 hours", "every 8 hours as needed", "take {n} BID", "{n} mg once daily", "at bedtime", "one tablet each day", "every 12 hrs or four times daily",
    "every 7 hours", "{n} mg QID", "two times per day", "as you wish",
]


@query(wanted(_DAILY, [(0, "2"), (1, "3"), (2, "3"), (4, "2"), (5, "1"), (6, "1"), (7, "1"), (8, "2"), (8, "4"), (10, "4"), (11, "2")], "n"))
def per_day_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_of(spark, sf_dir, made(_DAILY), "part")
    return df.select("p_partkey", F.explode(tx.per_day(F.col("text"))).alias("n")).select("p_partkey", F.col("n").cast("string").alias("n"))


#: Language, English, translation, back-translation, whether it is about a medicine, and the checks that must not pass.
TRANSLATIONS: list[tuple[str, str, str, str, bool, list[tuple[str, str]]]] = [
    ("es", "Take {n} mg twice daily.", "Tome {n} mg dos veces al día.", "Take {n} mg twice daily.", True, []),
    ("es", "Take {n} mg on {en_month} {d}, {y}.", "Tome {n} mcg el {d} de {es_month} de {y}.", "Take {n} mcg on {en_month} {d}, {y}.", True, [("translation_units", "fail")]),
    ("es", "Stop taking {drug}.", "Siga tomando {drug}.", "Keep taking {drug}.", True, [("translation_polarity", "fail")]),
    ("es", "Take it only if you need it.", "Tómelo siempre.", "Always take it.", True, [("translation_as_needed", "fail")]),
    ("es", "Less than {n} g of sodium.", "Menos de {n} g de sal.", "Less than {n} g of salt.", False, [("translation_salt_sodium", "fail")]),
    ("es", "Come at 9:{mm} am.", "Venga a las 9:{mm} de la tarde.", "Come at 9:{mm} pm.", False, [("translation_time", "fail")]),
    ("es", "Take ibuprofen.", "Tome ibuprofeno.", "Take ibuprofeno.", True, [("back_drug", "warn")]),
    ("es", "Take {drug}.", "Tome eso.", "Take that.", True, [("back_drug", "fail")]),
    ("es", "Call [PHONE_1].", "Llame.", "Call.", False, [("translation_placeholder", "fail")]),
    ("es", "Walk.", "", "", False, [("translation", "fail")]),
    ("es", "Walk.", "Camine 走.", "", False, [("translation_script", "fail"), ("back_translation", "warn")]),
    ("es", "Take {n} mg.", "Tome 9{n} mg.", "Take {n} mg.", True, [("translation_numbers", "fail")]),
    ("es", "Come on {en_month} {d}, {y}.", "Venga el {d} de {es_month} de 19{mm}.", "Come on {en_month} {d}, {y}.", False, []),
    ("it", "Take {n} mg as needed.", "Prenda {n} mg in caso di bisogno.", "Take {n} mg as needed.", True, []),
    ("it", "Stop taking {drug}.", "Continuare {drug}.", "Keep taking {drug}.", True, [("translation_polarity", "fail")]),
    ("it", "201-250 give {n} units.", "201-250 dare 9{n} unità.", "201-250 give {n} units.", False, [("translation_numbers", "fail"), ("translation_scale", "fail")]),
    ("fr", "Take {n} mg when needed.", "Prenez {n} mg selon vos besoins.", "Take {n} mg when needed.", True, []),
    ("fr", "Keep taking {drug}.", "Ne prenez pas {drug}.", "Do not take {drug}.", True, [("translation_polarity", "fail")]),
    ("fr", "Take {n} mg.", "Prenez {n} mg.", "Take 9{n} mg.", True, [("back_numbers", "fail")]),
    ("vi", "Stop taking {drug}.", "Tiếp tục uống {drug}.", "Stop taking {drug}.", True, [("translation_polarity", "fail")]),
    ("vi", "Take {n} mg as needed.", "Uống {n} mg nếu đau.", "Take {n} mg as needed.", True, []),
    ("vi", "Hold {drug} until told.", "Ngừng {drug} cho đến khi được báo.", "Stop {drug}.", True, [("translation_polarity", "warn")]),
    ("zh", "Keep taking {drug}.", "停用{drug}。", "Keep taking {drug}.", True, [("translation_polarity", "fail")]),
    ("zh", "Take {n} mg as needed.", "如果疼，吃{n}毫克。", "Take {n} mg as needed.", True, []),
    ("zh", "Take {n} mg.", "吃{n}。", "Take {n} mg.", True, [("translation_units", "warn")]),
]
_ENGLISH = [t[1] for t in TRANSLATIONS]


@query(wanted(_ENGLISH, [(k, name, status) for k, t in enumerate(TRANSLATIONS) for name, status in (t[5] if k != 12 else [("translation_dates", "fail")])], "name status"))
def translation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"(p_partkey % {len(TRANSLATIONS)})"
    texts = ", ".join(f"{chosen([t[i] for t in TRANSLATIONS], at, VALUES)} AS {name}" for i, name in ((1, "text_en"), (2, "text_tl"), (3, "back_en")))
    df = rows_of(spark, sf_dir, f"SELECT p_partkey, p_partkey AS case_id, 'S1' AS sent_id, {pick([t[0] for t in TRANSLATIONS], at)} AS lang, {at} IN ({', '.join(str(k) for k, t in enumerate(TRANSLATIONS) if t[4])}) AS about_medicine, {texts} FROM part", "part")
    found = sentences.translations_checked(df, ["es", "it", "fr", "vi", "zh"])
    return found.select(F.col("case_id").alias("p_partkey"), "name", "status")


#: A text in which values stand, what must be masked, and the text that must come out.
MASKED = [
    ("MRN: A{n}B-77 given", "MRN: [MRN_1] given"),
    ("Record no. X9{n}55 and X9{n}55 again", "Record no. [MRN_1] and X9{n}55 again"),
    ("Historia clínica: HC-{n}-123", "Historia clínica: [MRN_1]"),
    ("Insurance ID: ZX{n}-8876", "Insurance ID: [ID_1]"),
    ("Your insurance covers {n} mg. Ask a family member before you drive.", "Your insurance covers {n} mg. Ask a family member before you drive."),
    ("SSN 123-45-67{mm}", "SSN [ID_1]"),
    ("Date of Birth: {m}/{d}/19{mm}", "Date of Birth: [DATE_OF_BIRTH_1]"),
    ("Née le {d} {fr_month} {y}", "Née le [DATE_OF_BIRTH_1]"),
    ("出生日期: {y}年{m}月{d}日", "出生日期: [DATE_OF_BIRTH_1]"),
    ("Discharged on {m}/{d}/{y} and read {n}/2", "Discharged on [DATE_1] and read {n}/2"),
    ("Fecha de alta: {d} de {es_month} de {y}", "Fecha de alta: [DATE_1]"),
    ("Write to a{n}.b@mail-x.org, or A{n}.B@mail-x.org.", "Write to [EMAIL_1], or [EMAIL_1]."),
    ("Phone +44 20 7946 09{mm}", "Phone [PHONE_1]"),
    ("Phone (408) 555-01{mm} or 408-555-09{mm}", "Phone [PHONE_1] or [PHONE_2]"),
    ("Phone 020 7946 09{mm}", "Phone [PHONE_1]"),
    ("Please call us at 555-01{mm}", "Please call us at [PHONE_1]"),
    ("Dose at 0800 1400 2000, {n} mg", "Dose at 0800 1400 2000, {n} mg"),
    ("Home: {n} Old Mill Road, quiet", "Home: [ADDRESS_1], quiet"),
    ("Chez {n} rue du Bac", "Chez [ADDRESS_1]"),
    ("Vive en Calle Mayor {n}", "Vive en [ADDRESS_1]"),
    ("Mail: P.O. Box {n}", "Mail: [ADDRESS_1]"),
    ("in San Jose, CA 951{mm}", "in [ADDRESS_1]"),
    ("Post SW1A 1AA", "Post [ADDRESS_1]"),
    ("Near 750{mm} Paris", "Near [ADDRESS_1]"),
    ("Patient: María Núñez, {n} mg", "Patient: [PATIENT_1], {n} mg"),
    ("Paciente: María Núñez\nMARIA takes {n} mg; Nunez too, maria not.", "Paciente: [PATIENT_1]\n[PATIENT_1] takes {n} mg; [PATIENT_1] too, maria not."),
    ("Name: O’Neil, Mary Ann\nMary Ann O’Neil took {n}.", "Name: [PATIENT_1]\n[PATIENT_1] took {n}."),
    ("Bệnh nhân: Nguyễn Văn Hòa\nhoa NGUYEN VAN HOA {n}", "Bệnh nhân: [PATIENT_1]\nhoa [PATIENT_1] {n}"),
    ("姓名: 王小明 takes {n}, 王小明", "姓名: [PATIENT_1] takes {n}, [PATIENT_1]"),
    ("Patient: Max Hope\nMax {n} tablets; Max Hope left.", "Patient: [PATIENT_1]\nMax {n} tablets; [PATIENT_1] left."),
    ("His daughter Rosa came {n} times; Rosa left, rosa red.", "His daughter [CONTACT_1] came {n} times; [CONTACT_1] left, rosa red."),
    ("Dr. Anil Patel said {n}. Dr. Patel left. Mrs. Jones came.", "[CLINICIAN_1] said {n}. [CLINICIAN_1] left. [PATIENT_1] came."),
    ("Seen by Jane Roe, RN at {n}", "Seen by [CLINICIAN_1] at {n}"),
]


@query(wanted([t for t, _ in MASKED], [(k, out) for k, (_, out) in enumerate(MASKED)], "masked"))
def mask_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on texts that must or must not be masked."""
    df = rows_of(spark, sf_dir, made([t for t, _ in MASKED]), "part")
    return masking.mask(df, "text").select("p_partkey", "masked")


_NAMED = ["Núñez{n}", "Đặng Hòa", "O'Brien-Smith", "Zoë"]
_FOLDED = ["Núñez{n} saw NUNEZ{n}; nuñez{n}, no Nuneziax {n}", "dang HOA met Đặng Hòa, not Dang Hoax", "o'brien-smith and O'BRIEN-SMITH", "zoe, ZOË; zoey"]


@query(wanted(_FOLDED, [(0, "[PATIENT_1] saw [PATIENT_1]; [PATIENT_1], no Nuneziax {n}"), (1, "[PATIENT_1] met [PATIENT_1], not [PATIENT_1] Hoax"), (2, "[PATIENT_1] and [PATIENT_1]"), (3, "[PATIENT_1], [PATIENT_1]; zoey")], "masked"))
def mask_names_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = f"SELECT p_partkey, {chosen(_FOLDED, '(p_partkey % 4)', VALUES)} AS text, {chosen(_NAMED, '(p_partkey % 4)', VALUES)} AS name FROM part"
    df = rows_of(spark, sf_dir, sql, "part")
    return df.select("p_partkey", masking.mask_names(F.col("text"), F.array("name")).alias("masked"))


#: \1 and \2 stand for braces here, which hold values in a template.
_ANSWERS = ['Sure:\n```json\n\1"a": {n}\2\n```', "Here it is: [{n}, 2]", "no json, {n}", '\1"b": [{n}]\2', '```\n[{d}]\n``` and \1"c": 1\2']


def _braces(sql: str) -> str:
    return sql.replace("\1", "{").replace("\2", "}")


@query(_braces(wanted(_ANSWERS, [(0, '\1"a":{n}\2'), (1, "[{n},2]"), (2, None), (3, '\1"b":[{n}]\2'), (4, "[{d}]")], "value")))
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_of(spark, sf_dir, _braces(made(_ANSWERS)), "part")
    return df.select("p_partkey", F.to_json(readers.lenient_json(F.col("text"))).alias("value"))
