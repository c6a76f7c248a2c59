"""Input discovery: shuffled packages and answer keys among files, their labels, types and slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.functions.text import pad_label, slug

# Words of file names and the types they tell, the first hit wins.
TYPE_WORDS = (
    ("1003", "URLA_1003"), ("urla", "URLA_1003"), ("loan application", "URLA_1003"), ("credit", "CREDIT_REPORT"), ("title", "TITLE_REPORT"), ("commitment", "TITLE_REPORT"),
    ("prelim", "TITLE_REPORT"), ("income", "INCOME_DOC"), ("p & l", "INCOME_DOC"), ("p&l", "INCOME_DOC"), ("profit", "INCOME_DOC"), ("transcript", "INCOME_DOC"), ("w-2", "INCOME_DOC"),
    ("w2", "INCOME_DOC"), ("1040", "INCOME_DOC"), ("paystub", "INCOME_DOC"), ("paycheck", "INCOME_DOC"),
)
PACKAGE_WORD = "shuffled"


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path of all files below a folder; only names are read, not contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path")


def discover(paths: DataFrame) -> DataFrame:
    """path, name, role (package, answer_key, unrecognized), label (packages), doc_type (answer keys), slug.

    Paths with a ``reference`` folder are left out.  A package's label is the number its name starts with, else its ordinal; if two
    packages would share a label all get ordinals.  Packages are few, so their ordinals come from one window.
    """
    rows = paths.filter(~F.col("path").rlike("/reference/")).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    low = F.lower("name")
    kind = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(t)) for w, t in TYPE_WORDS))
    role = F.when(F.contains(low, F.lit(PACKAGE_WORD)), "package").when(kind.isNotNull(), "answer_key").otherwise("unrecognized")
    rows = rows.withColumn("role", role).withColumn("doc_type", F.when(F.col("role") == "answer_key", kind)).withColumn("slug", slug(F.col("stem")))
    found = rows.filter("role = 'package'")
    number = F.nullif(F.regexp_extract("name", r"(?U)^(\d+)\b", 1), F.lit(""))
    every = Window.partitionBy("role")
    found = found.withColumn("at", F.row_number().over(every.orderBy("path")).cast("string")).withColumn("label", pad_label(F.coalesce(number, F.col("at"))))
    clash = F.size(F.collect_set("label").over(every)) < F.count("*").over(every)
    found = found.withColumn("label", F.when(clash, pad_label(F.col("at"))).otherwise(F.col("label")))
    out = ["path", "name", "role", "label", "doc_type", "slug"]
    return found.select(*out).unionByName(rows.filter("role <> 'package'").withColumn("label", F.lit(None).cast("string")).select(*out))


def warnings(found: DataFrame) -> DataFrame:
    """path, warning for files that are neither packages nor answer keys."""
    return found.filter("role = 'unrecognized'").select("path", F.lit("name tells neither a package nor a type").alias("warning"))


def require(found: DataFrame) -> None:
    """Raise if there are no files or no packages."""
    roles = {r["role"] for r in found.select("role").distinct().collect()}
    if not roles:
        raise FileNotFoundError("no input files")
    if "package" not in roles:
        raise ValueError("no packages among the input files")
