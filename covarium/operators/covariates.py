"""From clinical tables to one note table with normalised covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.categories import DICTIONARIES, recode
from covarium.functions.text import group_string, normalize_label

PATIENT_COLS = ["age_group", "gender", "ethnicity", "language", "religion", "marital_status", "insurance"]
ENCOUNTER_COLS = ["caregiver_role", "admission_type", "length_of_stay", "mortality"]
#: Lower limits (years, whole days) and their labels.
AGE_BUCKETS = [(80, "Elderly"), (65, "Aged"), (45, "Middle_Aged"), (24, "Adult"), (19, "Young_Adult"), (13, "Adolescent"), (2, "Child")]
STAY_BUCKETS = [(30, "Long"), (14, "Prolonged"), (7, "Extended"), (3, "Moderate")]
#: Null keys are spread over this many salts, so that they don't meet in one task.
NULL_SALTS = 1024


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole periods of 24 hours, towards zero."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def bucket(value: Column, limits: list[tuple[int, str]], below: str, null_bucket: str | None = None) -> Column:
    """Label of the highest limit reached; null gives `null_bucket` or else the lowest label."""
    out = F.when(value.isNull(), F.lit(null_bucket if null_bucket is not None else below))
    for limit, label in limits:
        out = out.when(value >= limit, F.lit(label))
    return out.otherwise(F.lit(below))


def age(admitted: Column, born: Column) -> Column:
    return F.floor(whole_days(admitted, born) / F.lit(365.0))


def age_group(years: Column) -> Column:
    return bucket(years, AGE_BUCKETS, "Infant")


def stay_group(days: Column) -> Column:
    return bucket(days, STAY_BUCKETS, "Short")


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on one key. Null keys never match, so they get a salt and spread over the partitions; join strategy and hot keys are left to adaptive execution."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c != "TEXT"]), F.lit(NULL_SALTS))).otherwise(F.lit(0))
    return left.withColumn("_salt", salt).join(right.filter(F.col(key).isNotNull()).withColumn("_salt", F.lit(0).cast("bigint")), [key, "_salt"], "left").drop("_salt")


#: Estimated bytes of one side up to which it is broadcast; its estimate is Spark's own.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def merge_notes(notes: DataFrame, patients: DataFrame, admissions: DataFrame, caregivers: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Notes with 7 patient and 4 encounter covariates.

    If every other table's estimated size allows it to be broadcast, the notes aren't shuffled at all. Else the joins run over the notes' distinct keys, without their texts, and the covariates
    come back to the notes in one join on all keys, so texts are shuffled once, however many tables there are.
    """
    died = F.when(F.col("HOSPITAL_EXPIRE_FLAG") == 1, "Dead").otherwise("Alive")
    adm = admissions.select(
        F.expr("try_cast(HADM_ID AS BIGINT)").alias("HADM_ID"), "ADMITTIME", "DISCHTIME", "ADMISSION_TYPE", "INSURANCE", "LANGUAGE", "RELIGION", "MARITAL_STATUS", "ETHNICITY", died.alias("mortality")
    )
    cg = caregivers.select(F.expr("try_cast(CGID AS BIGINT)").alias("CGID"), F.col("LABEL").alias("caregiver_role"))
    pat = patients.select(F.expr("try_cast(SUBJECT_ID AS BIGINT)").alias("SUBJECT_ID"), "DOB", "GENDER")
    n = notes.select("ROW_ID", *[F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("SUBJECT_ID", "HADM_ID", "CGID")], "TEXT")
    if max(map(estimated_bytes, (cg, pat, adm))) <= broadcast_bytes:
        for side, key in ((cg, "CGID"), (pat, "SUBJECT_ID"), (adm, "HADM_ID")):
            n = n.join(F.broadcast(side), key, "left")  # of a checked size
    else:
        keys = n.select("SUBJECT_ID", "HADM_ID", "CGID").distinct()
        wide = left_join(left_join(left_join(keys, cg, "CGID"), pat, "SUBJECT_ID"), adm, "HADM_ID")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys.columns]
        n = n.alias("n").join(wide.alias("w"), same[0] & same[1] & same[2], "left").select("n.*", *[F.col(f"w.{c}") for c in wide.columns if c not in keys.columns])
    times = {c: F.try_to_timestamp(F.col(c)) for c in ("ADMITTIME", "DISCHTIME", "DOB")}
    n = n.withColumns(times)
    n = n.withColumns({"age_group": age_group(age(F.col("ADMITTIME"), F.col("DOB"))), "length_of_stay": stay_group(whole_days(F.col("DISCHTIME"), F.col("ADMITTIME")))})
    n = n.withColumns({c: recode(F.col(raw), DICTIONARIES[c]) for c, raw in (("religion", "RELIGION"), ("language", "LANGUAGE"), ("ethnicity", "ETHNICITY"), ("caregiver_role", "caregiver_role"))})
    n = n.withColumns({"gender": F.col("GENDER"), "marital_status": F.col("MARITAL_STATUS"), "insurance": F.col("INSURANCE"), "admission_type": F.col("ADMISSION_TYPE")})
    return n.select("SUBJECT_ID", "ROW_ID", *[normalize_label(F.col(c)).alias(c) for c in PATIENT_COLS + ENCOUNTER_COLS], "TEXT")


def with_groups(merged: DataFrame) -> DataFrame:
    """`merged` with patient_group and encounter_group strings."""
    return merged.withColumns({"patient_group": group_string(PATIENT_COLS), "encounter_group": group_string(ENCOUNTER_COLS)})
