"""From printed rows to normalized observations: resolution with unit disambiguation, and the normalization chain.

The reference list is folded into one row for each key and for each set of words, so every row meets it in two equi joins;
what follows is column expressions. Nothing is collected; the size of the lists is left to Spark's join choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labloom.functions import lab

CONFIDENT = 0.90


def candidates_by_key(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names`` (candidate_code, canonical_label, ordinal, expected_ucum_units, k) folded by key, entries of that very name alone where there are any, and by set of words."""
    entry = F.struct("ordinal", "candidate_code", F.lower(F.trim("canonical_label")).alias("name"), F.coalesce("expected_ucum_units", F.array().cast("array<string>")).alias("units"))
    own = lab.label_key(F.col("canonical_label")) == F.col("k")
    d = names.select("k", lab.token_signature(F.col("k")).alias("s"), own.alias("own"), entry.alias("e")).distinct()
    by_key = d.where("k <> ''").groupBy("k").agg(F.array_sort(F.collect_set(F.when(F.col("own"), F.col("e")))).alias("own"), F.array_sort(F.collect_set("e")).alias("every"))
    by_key = by_key.select("k", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every")).alias("by_key"))
    by_words = d.where("s is not null").groupBy("s").agg(F.array_sort(F.collect_set("e")).alias("by_words"))
    return by_key, by_words


def resolve(rows: DataFrame, names: DataFrame, label: Column, unit: Column) -> DataFrame:
    """``rows`` with candidate_code (null if none is accepted) and reason.

    By key, else by words where only one entry has them. Several codes of one canonical label, of which any declares units, are
    told apart by the unit: exactly one must expect it, else 'unit_required' (no unit) or 'unit_mismatch'. Other ties go to
    the first entry. An empty label has neither code nor reason; a label in no list has reason 'unsupported_alias'; words
    of several codes 'ambiguous_tokens'.
    """
    by_key, by_words = candidates_by_key(names)
    keyed = rows.withColumn("k", lab.label_key(label)).withColumn("s", lab.token_signature(F.col("k"))).withColumn("_unit", lab.unit_token(unit))
    j = keyed.join(by_key, "k", "left").join(by_words, "s", "left")
    codes = lambda a: F.size(F.array_distinct(F.transform(a, lambda e: e["candidate_code"])))
    ambiguous = F.col("by_key").isNull() & F.col("by_words").isNotNull() & (codes("by_words") > 1)
    found = F.coalesce("by_key", F.when(~ambiguous, F.col("by_words")))
    j = j.withColumn("_found", F.when(F.col("k") != "", found)).withColumn("_ambiguous", (F.col("k") != "") & ambiguous)
    one_name = F.size(F.array_distinct(F.transform("_found", lambda e: e["name"]))) == 1
    by_unit = (codes("_found") > 1) & one_name & F.exists("_found", lambda e: F.size(e["units"]) > 0)
    fitting = F.filter("_found", lambda e: F.exists(e["units"], lambda u: lab.unit_token(u) == F.col("_unit")) & (F.col("_unit") != ""))
    fitting = F.array_distinct(F.transform(fitting, lambda e: e["candidate_code"]))
    code = F.when(by_unit, F.when(F.size(fitting) == 1, F.get(fitting, F.lit(0)))).otherwise(F.get("_found", F.lit(0))["candidate_code"])
    reason = (
        F.when(F.col("k") == "", None)
        .when(F.col("_ambiguous"), "ambiguous_tokens")
        .when(F.col("_found").isNull(), "unsupported_alias")
        .when(by_unit & (F.size(fitting) != 1), F.when(F.col("_unit") == "", "unit_required").otherwise("unit_mismatch"))
    )
    return j.withColumn("candidate_code", code).withColumn("reason", reason).drop("k", "s", "_unit", "by_key", "by_words", "_found", "_ambiguous")


def normalize(rows: DataFrame, names: DataFrame, metrics: DataFrame) -> DataFrame:
    """The normalization chain over printed rows: id, support_state, candidate_code, reasons, value, profile_id, canonical_value, canonical_unit.

    1. A row of a confidence below CONFIDENT is unsupported ('low_extraction_confidence') and goes no further.
    2. Its label is resolved; the outcome is its support state, the reason for none one of its reasons.
    3. The number is the parsed one, else what is left of the value without what isn't numeric.
    4. A supported code of ``metrics`` (candidate_code, numeric, profile_id) that is numeric must have a number, else the row is
       partial ('missing_numeric_value'); with a number it takes the profile, or bears 'unresolved_reference_profile'.
    5. A row with a number and a unit has them in the canonical spelling where that unit is known, else as they stand.

    Null confidences pass the gate; an empty list of names leaves every label unsupported.
    """
    r = resolve(rows, names, F.col("raw_analyte_label"), F.col("raw_unit_string")).join(metrics.select("candidate_code", "numeric", "profile_id"), "candidate_code", "left")
    gated = F.coalesce(F.col("extraction_confidence") < CONFIDENT, F.lit(False))
    value = F.when(~gated, F.coalesce("parsed_numeric_value", lab.clean_number(F.col("raw_value_string"))))
    code = F.when(~gated, F.col("candidate_code"))
    numeric = code.isNotNull() & F.coalesce("numeric", F.lit(False))
    state = F.when(gated | code.isNull(), "unsupported").when(numeric & value.isNull(), "partial").otherwise("supported")
    reasons = F.array(
        F.when(gated, "low_extraction_confidence"), F.when(~gated, F.col("reason")), F.when(numeric & value.isNull(), "missing_numeric_value"),
        F.when(numeric & value.isNotNull() & F.col("profile_id").isNull(), "unresolved_reference_profile"),
    )
    unit = F.when(value.isNotNull() & (F.col("raw_unit_string") != ""), F.col("raw_unit_string"))
    bypass = lab.collapse(F.lower(unit)).isin(lab.BYPASS_UNITS)
    spelled = F.when(unit.isNotNull(), F.when(bypass, unit).otherwise(F.coalesce(lab.canonical_spelling(unit), unit)))
    return r.select(
        "id", state.alias("support_state"), code.alias("candidate_code"), F.array_join(F.array_sort(F.array_compact(reasons)), ",").alias("reasons"), value.alias("value"),
        F.when(numeric & value.isNotNull(), F.col("profile_id")).alias("profile_id"), F.when(spelled.isNotNull(), value).alias("canonical_value"), spelled.alias("canonical_unit"),
    )


def comparable(observation: DataFrame) -> DataFrame:
    """For every observation the latest supported one of another job that can be compared: id, previous_id, value, previous_value, previous_at.

    It has the same code; where there is none the same display; where there is none the same label. Its unit is the same if
    the observation has one; specimen and method are the same, null to null. Observations without a code, display and label,
    and those without a comparable one, have null. Of a key only the latest observation of the two latest jobs matters, so
    nothing is compared pairwise and a frequent code is aggregated before the shuffle.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    o = observation.select(
        "id", F.coalesce("job_id", F.lit("")).alias("job"), "created_at", "support_state", F.coalesce("canonical_value", "parsed_numeric_value").alias("value"), F.coalesce("canonical_unit", F.lit("")).alias("unit"),
        *[F.coalesce(F.concat(F.lit("="), said(c)), F.lit("")).alias(n) for c, n in (("specimen_context", "specimen"), ("method_context", "method"))],
        *[said(c).alias(n) for c, n in (("accepted_analyte_code", "code"), ("accepted_analyte_display", "display"), ("raw_analyte_label", "label"))],
    )
    key = ["kind", "name", "with_unit", "key_unit", "specimen", "method"]
    names = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("name")) for i, c in enumerate(("code", "display", "label"))])
    units = F.array(F.struct(F.lit(True).alias("with_unit"), F.col("unit").alias("key_unit")), F.struct(F.lit(False).alias("with_unit"), F.lit("").alias("key_unit")))
    known = o.where("support_state = 'supported'").select("*", F.explode(names).alias("x")).where("x.name is not null").select("*", F.explode(units).alias("u")).select("x.*", "u.*", "specimen", "method", "job", F.struct("created_at", "id", "value").alias("o"))
    per_job = known.groupBy(*key, "job").agg(F.max("o").alias("o"))
    first = per_job.groupBy(*key).agg(F.max(F.struct("o", "job")).alias("first"))
    second = per_job.join(first, key).where(F.col("job") != F.col("first.job")).groupBy(*key).agg(F.max("o").alias("second"))
    own = F.when(F.col("code").isNotNull(), 0).when(F.col("display").isNotNull(), 1).when(F.col("label").isNotNull(), 2)
    mine = o.select("id", "job", "value", own.alias("kind"), F.coalesce("code", "display", "label").alias("name"), (F.col("unit") != "").alias("with_unit"), F.col("unit").alias("key_unit"), "specimen", "method")
    j = mine.join(first, key, "left").join(second, key, "left").withColumn("p", F.when(F.col("job") == F.col("first.job"), F.col("second")).otherwise(F.col("first.o")))
    return j.select("id", F.col("p.id").alias("previous_id"), "value", F.col("p.value").alias("previous_value"), F.col("p.created_at").alias("previous_at"))
