"""Corpus files: grouped lines, query triples, clinical source tables, and a synthetic generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, ArrayType

from covarium.functions.hashing import portable_int
from covarium.functions.text import GROUP_SEP, split_groups, tokens
from covarium.session import materialize

ADMISSIONS = "HADM_ID long, ADMITTIME string, DISCHTIME string, ADMISSION_TYPE string, INSURANCE string, LANGUAGE string, RELIGION string, MARITAL_STATUS string, ETHNICITY string, HOSPITAL_EXPIRE_FLAG int"
PATIENTS = "SUBJECT_ID long, DOB string, GENDER string"
CAREGIVERS = "CGID long, LABEL string"
NOTES = "ROW_ID long, SUBJECT_ID long, HADM_ID long, CGID long, TEXT string"
SENTENCES = StructType([StructField("SUBJECT_ID", LongType()), StructField("ROW_ID", LongType()), StructField("patient_group", StringType()), StructField("encounter_group", StringType()), StructField("Sentences", ArrayType(StringType()))])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by column names: only the columns of `schema` are kept, cast without errors (what can't be cast is null)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.upper(): c for c in raw.columns}
    want = StructType.fromDDL(schema)
    cols = []
    for f in want:
        if f.name.upper() not in names:
            raise ValueError(f"{path}: no column {f.name}")
        cols.append(F.expr(f"try_cast(`{names[f.name.upper()]}` AS {f.dataType.simpleString()})").alias(f.name))
    return raw.select(*cols)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str | None = None) -> None:
    """Notes hold line ends and quotes, so records are read across lines."""
    df = read_csv(spark, source, schema) if schema else spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True).csv(source)
    write_parquet(df, target)


def write_parquet(df: DataFrame, path: str, block_mb: int = 128) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(block_mb << 20)).parquet(path)


def missing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths, in any file system, that don't exist."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(conf).exists(at):
            out.append(p)
    return out


# ---------------------------------------------------------------- grouped lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that are not empty."""
    return spark.read.text(path).filter(F.length("value") > 0)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): all lines with their place in the files, in the order of the files' names. Lines stay where they are read: a split's lines are numbered as they come, and only a count for each split meets in one place."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = materialize(read, "lines", "zstd")  # numbers of splits hold for one reading
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select("file", "block", "first", before.alias("before"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("place"), "value")  # one row for each split


def count_lines(lines: DataFrame) -> int:
    """Lines that aren't empty, whether or not they parse."""
    return lines.filter(F.length("value") > 0).count()


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """`lines` with patient, encounter and words (arrays) and `n_groups`; a carriage return at the end of a line is white space."""
    g = split_groups(F.col(value))
    part = lambda i: F.coalesce(tokens(F.try_element_at(g, F.lit(i))), F.array().cast("array<string>"))
    return lines.withColumns({"n_groups": F.size(g), "patient": part(1), "encounter": part(2), "words": part(3)})


def training_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Strict reading: exactly three groups and at least one word."""
    return parsed(lines, value).filter((F.col("n_groups") == 3) & (F.size("words") > 0)).drop("n_groups")


def counting_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lenient reading for counts: three groups, and words may be missing, so that groups of such lines still enter the vocabulary."""
    return parsed(lines, value).filter(F.col("n_groups") == 3).drop("n_groups")


def bad_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that strict reading rejects, with the reason."""
    p = parsed(lines, value).filter((F.col("n_groups") != 3) | (F.size("words") == 0))
    return p.select(*lines.columns, "n_groups", F.when(F.col("n_groups") != 3, "groups").otherwise("no_words").alias("reason"))


def line(patient: Column, encounter: Column, words: Column) -> Column:
    """A corpus line. Null groups become empty, so that no field is lost."""
    e = F.lit("")
    return F.concat(F.coalesce(patient, e), F.lit(GROUP_SEP), F.coalesce(encounter, e), F.lit(GROUP_SEP), F.coalesce(words, e))


def write_lines(df: DataFrame, path: str, value: Column, compression: str = "none") -> None:
    """`compression`: of the files, none or gzip; lines are read from either alike, but a task reads whole files of the latter."""
    df.select(value.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def query_triples(lines: DataFrame, value: str = "value") -> DataFrame:
    """(words, patient, encounter) of query lines, whose order differs from corpus lines and whose separator needs no blanks. Blank lines are skipped; further groups are ignored; fewer than three are an error."""
    g = F.split(F.trim(F.col(value)), r"\|\|\|", -1)
    at = lambda i: tokens(F.when(F.size(g) >= 3, F.element_at(g, i)).otherwise(F.raise_error(F.concat(F.lit("query line with fewer than three groups: "), F.col(value)))))
    return lines.filter(F.length(F.trim(F.col(value))) > 0).select(*[c for c in lines.columns if c != value], at(1).alias("words"), at(2).alias("patient"), at(3).alias("encounter"))


# ---------------------------------------------------------------- synthetic corpus

# The vocabulary of the demonstration corpus.
FIELDS = {
    "age": ["infant", "child", "adolescent", "young_adult", "adult", "middle_aged", "aged", "elderly"],
    "gender": ["male", "female"],
    "ethnicity": ["white", "black", "hispanic", "asian", "other"],
    "language": ["english", "spanish", "portuguese", "mandarin", "other"],
    "marital": ["single", "married", "divorced", "widowed"],
    "insurance": ["medicare", "medicaid", "private", "self_pay", "government"],
}
ENCOUNTER_FIELDS = {
    "title": ["attending", "resident_physician", "fellow", "nurse", "nurse_practitioner", "physician_assistant", "social_worker", "physical_therapist"],
    "admission": ["emergency", "elective", "urgent", "newborn"],
}
TEMPLATES = [
    "The patient was admitted with {complaint} and required immediate evaluation.",
    "Physical examination revealed {finding} consistent with {diagnosis}.",
    "The patient reported {symptom} for the past {duration}.",
    "Laboratory results showed {lab_finding} suggesting {diagnosis}.",
    "The patient was started on {treatment} with good response.",
    "Follow-up imaging demonstrated {finding} compared to prior studies.",
    "The patient was discharged in stable condition after {treatment}.",
    "Vital signs were stable with {vital} within normal limits.",
    "The patient denied {symptom} at the time of evaluation.",
    "Family history was significant for {condition}.",
    "The patient has a history of {condition} managed with {treatment}.",
    "Neurological examination was intact without focal {finding}.",
    "Cardiovascular examination revealed {finding} on auscultation.",
    "The patient was counseled on {topic} prior to discharge.",
    "Surgical pathology confirmed {diagnosis} with clear margins.",
    "Chronic {condition} was noted on review of prior records.",
    "The patient responded well to {treatment} over the course of admission.",
    "An echocardiogram was obtained showing {finding}.",
    "The patient was evaluated by {specialist} for further management.",
    "Social work was consulted to address {topic} prior to discharge.",
]
SLOTS = {
    "complaint": ["chest pain", "shortness of breath", "abdominal pain", "altered mental status", "fever", "syncope", "weakness", "headache", "back pain", "falls"],
    "finding": ["cardiomegaly", "consolidation", "effusion", "atelectasis", "normal sinus rhythm", "ST changes", "focal deficits", "murmur", "tenderness", "organomegaly"],
    "diagnosis": ["pneumonia", "heart failure", "sepsis", "COPD exacerbation", "acute MI", "pulmonary embolism", "urinary tract infection", "cellulitis", "anemia", "dehydration"],
    "symptom": ["dyspnea", "nausea", "vomiting", "diarrhea", "fatigue", "chest tightness", "palpitations", "dizziness", "diaphoresis", "lower extremity edema"],
    "duration": ["two days", "one week", "three days", "several hours", "one month"],
    "treatment": ["antibiotics", "diuretics", "anticoagulation", "supplemental oxygen", "IV fluids", "vasopressors", "bronchodilators", "insulin", "analgesics", "steroids"],
    "vital": ["blood pressure", "heart rate", "oxygen saturation", "temperature", "respiratory rate"],
    "condition": ["hypertension", "diabetes mellitus", "coronary artery disease", "COPD", "chronic kidney disease", "atrial fibrillation", "heart failure", "hypothyroidism", "obesity", "depression"],
    "topic": ["fall precautions", "medication compliance", "diet modifications", "follow-up appointments", "wound care", "smoking cessation", "activity restrictions"],
    "specialist": ["cardiology", "pulmonology", "nephrology", "neurology", "gastroenterology", "infectious disease", "hematology", "endocrinology"],
    "lab_finding": ["elevated troponin", "leukocytosis", "anemia", "hyponatremia", "elevated creatinine", "elevated lactate", "thrombocytopenia", "hypokalemia", "coagulopathy"],
}


def _draw(seed: int, what: str, n: int) -> Column:
    """A number from 0 to n - 1 for each row id and purpose."""
    return portable_int(F.concat_ws("-", F.lit(str(seed)), F.lit(what), F.col("id").cast("string"))) % n


def _choice(seed: int, what: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(seed, what, len(values)) + 1).cast("int"))


def _sample(seed: int, what: str, fields: dict[str, list[str]], most: int) -> Column:
    """Between 0 and `most` of the fields' values, in an order of their own."""
    keyed = [F.struct(portable_int(F.concat_ws("-", F.lit(str(seed)), F.lit(f"{what}-order-{k}"), F.col("id").cast("string"))).alias("k"), F.lit(k).alias("name"), _choice(seed, f"{what}-{k}", v).alias("v")) for k, v in fields.items()]
    return F.array_join(F.transform(F.slice(F.array_sort(F.array(*keyed)), 1, _draw(seed, f"{what}-count", most + 1).cast("int")), lambda s: s["v"]), " ")


def synthetic_corpus(spark: SparkSession, rows: int = 1_000_000, seed: int = 42) -> DataFrame:
    """(id, value): demonstration lines with 0 to 5 of six patient fields, 0 to 2 encounter fields and a filled template. Every draw hashes seed, purpose and row, so partitions don't matter."""
    text = _choice(seed, "template", TEMPLATES)
    for slot, values in SLOTS.items():
        text = F.replace(text, F.lit("{" + slot + "}"), _choice(seed, slot, values))
    return spark.range(rows).select("id", line(_sample(seed, "patient", FIELDS, 5), _sample(seed, "encounter", ENCOUNTER_FIELDS, 2), text).alias("value"))
