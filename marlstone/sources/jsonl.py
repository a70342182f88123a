"""Bulk load from JSON lines: good rows and rejects with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import fields, keys


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) without blank lines and ``//`` comments."""
    text = spark.read.text(path).select(F.col("value").alias("line"))
    t = F.trim("line")
    return text.where((t != "") & ~t.startswith("//"))


def typed_id(v: Column, name: str, key_type: str) -> Column:
    """Document key of a field: numbers or decimal text for u64 and u128, text for uuid; null if it is no such key."""
    as_text = F.try_variant_get(v, fields._path(name), "string")
    k = fields.kind(v, name)
    if key_type == "uuid":
        return F.when(k == "STRING", keys.uuid_column(as_text))
    number = F.when(k.rlike(r"^(STRING|BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$") & F.trim(as_text).rlike(r"^\d+$"), F.trim(as_text))
    return F.when(F.length(number) <= 20, keys.u64_column(number.try_cast("decimal(20,0)"))) if key_type == "u64" else keys.u128_column(number)


def split_documents(src: DataFrame, id_field: str, key_type: str, declared: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows (key, doc) and rejects (line, reason) of lines of JSON documents."""
    v = fields.variant(F.col("line"))
    rows = src.select("line", v.alias("v"))
    bad_field = F.coalesce(*[F.when(fields.misfit(F.col("v"), n, t), F.lit(f"field {n} is no {t}")) for n, t in (declared or {}).items()], F.lit(None).cast("string"))
    key = typed_id(F.col("v"), id_field, key_type)
    rows = rows.select("line", key.alias("key"), F.col("v").isNull().alias("broken"), (~fields.is_object(F.col("line"))).alias("flat"), bad_field.alias("bad_field"))
    reason = F.when(F.col("broken"), "not JSON").when(F.col("flat"), "not an object").when(F.col("key").isNull(), "no usable id").otherwise(F.col("bad_field"))
    rows = rows.select("line", "key", reason.alias("reason"))
    return rows.where("reason is null").select("key", F.col("line").alias("doc")), rows.where("reason is not null").select("line", "reason")


def split_values(src: DataFrame, key_field: str, value_field: str, key_type: str, value_type: str) -> tuple[DataFrame, DataFrame]:
    """Good rows (key, value) and rejects of lines for a key-value store."""
    v = F.col("v")
    rows = src.select("line", fields.variant(F.col("line")).alias("v"))
    key = fields.field(v, key_field, key_type)
    value = typed_value(v, value_field, value_type)
    rows = rows.select("line", v.isNull().alias("broken"), key.alias("key"), value.alias("value"))
    reason = F.when(F.col("broken"), "not JSON").when(F.col("key").isNull(), "no usable key").when(F.col("value").isNull(), "no usable value")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("key", "value"), rows.where("reason is not null").select("line", "reason")


def typed_value(v: Column, name: str, value_type: str) -> Column:
    if value_type in ("str", "int"):
        return fields.field(v, name, value_type)
    number = r"^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"
    if value_type == "f32":
        return F.when(fields.kind(v, name).rlike(number), F.try_variant_get(v, fields._path(name), "double").cast("float"))
    got = F.try_variant_get(v, fields._path(name), "array<double>")
    good = fields.kind(v, name).startswith("ARRAY<") & ~F.exists(got, lambda x: x.isNull())
    return F.when(good, F.transform(got, lambda x: x.cast("float")))


def write_rejects(bad: DataFrame, path: str) -> None:
    bad.write.mode("overwrite").json(path)


def summary(good: DataFrame, bad: DataFrame) -> dict[str, int]:
    return {"loaded": good.count(), "skipped": bad.count()}
