"""Sessions: which sheets of a script a recording covers, by its file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of file names that name a pass, in the order in which they are listed.
PASSES = ("pickup", "shouting", "speaking", "louder", "quieter", "combat")
GENERIC_LINES = 80
LEAST_NAME = 5


def _pair(sheets: DataFrame, of) -> DataFrame:
    """One row: the first speaking and the first combat sheet among those that `of` holds for."""
    combat = F.contains(F.lower(F.concat_ws(" ", "name", "voice_header")), F.lit("combat"))
    mine = sheets.where(of)
    first = lambda c: F.min_by(F.when(c, F.col("name")), F.when(c, F.col("sheet_index")))
    ordered = F.array_sort(F.collect_list(F.struct("sheet_index", "name")))
    return mine.agg(first(~combat).alias("speaking"), first(combat).alias("combat"), ordered.alias("all"))


def infer_sessions(audio: DataFrame, sheets: DataFrame) -> DataFrame:
    """(id, enabled, audio, sheets, excel_rows, line_ids, pass, needs_mapping_review), a row a recording.

    audio (name); sheets (name, sheet_index, line_count, voice_header). The longest sheet name of five characters or more
    that the file's name contains wins; then fixed words in the name choose among the large sheets; else all sheets are
    in scope and the mapping needs a look. The sheets of a script are few: their list is one row, joined to recordings.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rec = audio.select("name", stem.alias("stem"), F.lower(stem).alias("low"), T.name_key(stem).alias("key"))
    named = sheets.select(F.col("name").alias("sheet"), "sheet_index", T.name_key(F.col("name")).alias("sheet_key")).where(F.length("sheet_key") >= LEAST_NAME)
    hit = rec.join(named, F.contains(F.col("key"), F.col("sheet_key"))).groupBy("name").agg(F.max_by("sheet", F.struct(F.length("sheet_key"), (-F.col("sheet_index")).alias("i"))).alias("named"))
    generic = _pair(sheets, F.col("line_count") >= GENERIC_LINES)
    large = lambda i: F.get("all", F.lit(i))["name"]
    generic = generic.select(F.coalesce("speaking", large(0)).alias("speaking"), F.coalesce("combat", large(1)).alias("combat"), F.transform("all", lambda x: x["name"]).alias("large"))
    bandit = _pair(sheets, F.contains(F.lower(F.coalesce("voice_header", F.lit(""))), F.lit("bandit"))).select(F.col("speaking").alias("bandit_speaking"), F.col("combat").alias("bandit_combat"))
    every = sheets.agg(F.transform(F.array_sort(F.collect_list(F.struct("sheet_index", "name"))), lambda x: x["name"]).alias("every"))
    taken = hit.agg(F.collect_set("named").alias("taken"))
    facts = generic.withColumn("k", F.lit(0))
    for more in (bandit, every, taken):
        facts = facts.join(more.withColumn("k", F.lit(0)), "k")
    rows = rec.withColumn("k", F.lit(0)).join(facts, "k").join(hit, "name", "left")
    has = lambda w: F.contains("low", F.lit(w))
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    both_ways = F.when(F.instr("low", "combatgenerics") < F.instr("low", "speakinggenerics"), some(F.col("combat"), F.col("speaking"))).otherwise(some(F.col("speaking"), F.col("combat")))
    rules = [
        (F.col("named").isNotNull(), F.array("named"), F.lit(False)),
        (has("banditgeneric"), some(F.col("bandit_speaking")), None),
        (has("banditcombat"), some(F.col("bandit_combat")), None),
        (has("combatgenerics") | has("speakinggenerics"), both_ways, None),
        (has("misctabs"), F.array_except(F.array_except("every", "large"), "taken"), F.lit(False)),
        (has("generic"), some(F.col("speaking"), F.col("combat")), F.lit(True)),
        (has("combat"), some(F.col("combat")), None),
        (F.lit(True), F.col("every"), F.lit(True)),
    ]
    found, review = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for when, sheets_of, flag in rules[1:]:
        found, review = found.when(when, sheets_of), review.when(when, F.size(sheets_of) == 0 if flag is None else flag)
    row = F.regexp_extract("low", r"row[_ -]?(\d+)", 1)
    passes = F.array_join(F.filter(F.array(*[F.when(has(p), p) for p in PASSES]), lambda x: x.isNotNull()), "+")
    return rows.select(
        T.slug(F.col("stem")).alias("id"),
        F.lit(True).alias("enabled"),
        F.col("name").alias("audio"),
        found.alias("sheets"),
        F.when(row != "", F.array(row.try_cast("int"))).otherwise(F.array().cast("array<int>")).alias("excel_rows"),
        F.array().cast("array<string>").alias("line_ids"),
        F.when(passes == "", "main").otherwise(passes).alias("pass"),
        review.alias("needs_mapping_review"),
    )


def lines_for_sessions(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    """Each enabled session beside its lines: of its sheets, rows and ids where those are given; (session_id, nth, ...)."""
    of = sessions.where("enabled").select(F.col("id").alias("session_id"), "excel_rows", "line_ids", F.posexplode("sheets").alias("sheet_at", "sheet"))
    met = of.join(lines, "sheet").where(((F.size("excel_rows") == 0) | F.array_contains("excel_rows", F.col("excel_row"))) & ((F.size("line_ids") == 0) | F.array_contains("line_ids", F.col("line_id"))))
    from pyspark.sql import Window as W

    order = W.partitionBy("session_id").orderBy("sheet_at", "excel_row")
    return met.withColumn("line_index", F.row_number().over(order) - 1).drop("excel_rows", "line_ids", "sheet_at")


def mapping_violations(sessions: DataFrame, sheets: DataFrame) -> DataFrame:
    """(id, violation): sessions without a sheet, with an unknown one, or still to be looked at."""
    on = sessions.where("enabled")
    none = on.where(F.size("sheets") == 0).select("id", F.lit("NO_SHEET").alias("violation"))
    unknown = on.select("id", F.explode("sheets").alias("name")).join(sheets.select("name"), "name", "left_anti").select("id", F.lit("UNKNOWN_SHEET").alias("violation")).distinct()
    look = on.where("needs_mapping_review").select("id", F.lit("NEEDS_REVIEW").alias("violation"))
    return none.unionByName(unknown).unionByName(look)
