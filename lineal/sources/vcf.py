"""Phased diploid VCF text."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import fresh_path

HEADER = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def write(long: DataFrame, path: str | None = None) -> str:
    """Write (haplotype from 0, position, derived) as VCF, two haplotypes an individual, a line per
    marker; an odd last haplotype is left out. The path, a fresh one in the shared folder if none is given."""
    spark = long.sparkSession
    path = path or fresh_path(spark, "vcf")
    n = long.agg(F.max("haplotype")).first()[0]
    people = (n + 1) // 2 if n is not None else 0
    own = long.where(F.col("haplotype") < 2 * people)
    calls = own.groupBy("position", F.floor(F.col("haplotype") / 2).alias("person")).agg(F.max(F.when(F.col("haplotype") % 2 == 0, F.col("derived").cast("int"))).alias("x"), F.max(F.when(F.col("haplotype") % 2 == 1, F.col("derived").cast("int"))).alias("y"))
    lines = calls.groupBy("position").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("person", F.concat_ws("|", "x", "y").alias("gt")))), lambda c: c.gt), "\t").alias("gts"))
    fixed = F.concat_ws("\t", F.lit("1"), F.col("position").cast("long"), F.lit("."), F.lit("A"), F.lit("T"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "gts")
    head = spark.range(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.concat_ws("\t", *(F.lit(x) for x in HEADER), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(people - 1, 0))), lambda i: F.concat(F.lit("s"), i)), "\t")))).alias("value"))
    head.coalesce(1).write.text(path)
    lines.select(fixed.alias("value")).write.mode("append").text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(haplotype from 0, position, derived) of phased calls; any allele but 0 is derived; plain or gzip text."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    cells = rows.select(F.split("value", "\t").alias("c"))
    calls = cells.select(F.col("c")[1].cast("double").alias("position"), F.posexplode(F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0)))).alias("person", "gt"))
    alleles = calls.select("position", "person", F.posexplode(F.split(F.element_at(F.split("gt", ":"), 1), r"\|")).alias("k", "a"))
    return alleles.select((2 * F.col("person") + F.col("k")).cast("int").alias("haplotype"), "position", (F.col("a") != "0").alias("derived"))
