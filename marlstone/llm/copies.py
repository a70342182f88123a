"""Problem 6: records that are identical but for formatting or field order.

Method: progressive partition refinement. Every record gets cheap invariants
that need no normalising: how often each of a few letters occurs in its values
in lower case. Only records whose class of equal invariants has several members
get the costly key, the normalised fields, and only these keys are shuffled and
compared. Records are read and parsed once, into a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import Table, hot_rows, join_hot, scratch

NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: Letters of the histogram; stripping never removes one, so equal keys have equal counts whatever letters are chosen.
COUNTED = "eationr"


def stripped(c: Column) -> Column:
    """Lower case without anything but letters and digits; null stays null."""
    return F.regexp_replace(F.lower(c), NOT_ALNUM, "")


def invariant(values: Column) -> Column:
    """A 64-bit class number from the counts of some letters in an array of raw values; records of equal keys have equal numbers."""
    low = F.lower(F.array_join(values, "\u0001"))
    counts = []
    for x in COUNTED:  # what a letter leaves is shorter for the next one
        rest = F.replace(low, F.lit(x))
        counts.append(F.length(low) - F.length(rest))
        low = rest
    return F.xxhash64(F.size(values), *counts)


def key_of(fields: Column) -> Column:
    """The costly key: names and stripped values, sorted; null values differ from empty ones."""
    named = F.transform(fields, lambda e: F.concat(e["name"], F.lit("\u0002"), F.coalesce(stripped(e["value"]), F.lit("\u0003"))))
    return F.array_join(F.array_sort(named), "\u0001")


def payload_fields(payload: Column) -> Column:
    """Raw fields of a received payload as array of (name, value), names in lower case.

    A payload is a JSON object or ``name=value`` fields split by ``|``. Null,
    empty or broken payloads and payloads without any field give null. Of a
    name given twice both values stay in the array.
    """
    text = F.trim(payload)
    as_json = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), e["value"].alias("value")))
    cut = F.filter(F.split(payload, r"\|"), lambda x: F.instr(x, "=") > 0)
    as_pairs = F.transform(
        cut,
        lambda x: F.struct(F.lower(F.trim(F.regexp_replace(F.substring_index(x, "=", 1), r"(?U)^\s+|\s+$", ""))).alias("name"), F.regexp_replace(x, r"^[^=]*=", "").alias("value")),
    )
    fields = F.when(text.startswith("{"), as_json).otherwise(as_pairs)
    return F.when(F.size(fields) > 0, fields)


def refine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, id, key) of records whose key may have copies, (src, id) of the others).

    ``records`` has src, id and fields (raw). The first stage reads only
    (src, inv) and keeps classes of several records, counted on the map side;
    the key is computed and shuffled for members of those alone.
    """
    table = Table(records.select("src", "id", invariant(F.transform("fields", lambda e: e["value"])).alias("inv"), "fields"), "records").df
    sized = table.groupBy("src", "inv").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    classes = Table(sized, "classes").df
    several = classes.where("n > 1").select("src", "inv")
    members = join_hot(table, several, ["src", "inv"], hot_rows(classes, ["src", "inv"], "n"), "left_semi")
    return members.select("src", "id", key_of(F.col("fields")).alias("key")), classes.where("n = 1").select("src", "id")


def copy_groups(members: DataFrame) -> DataFrame:
    """(src, key, first_id, n_copies) for each class of equal keys; partial aggregation takes up hot classes."""
    ids = members.groupBy("src", "key", "id").agg(F.count(F.lit(1)).alias("__n"))
    return ids.groupBy("src", "key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).cast("bigint").alias("n_copies"))


def job_records(jobs: DataFrame, fields: tuple[str, ...] = ("agency", "jobTitle"), row_id: str = "jobId") -> DataFrame:
    """(src, id, fields) of rows whose id and fields aren't null."""
    rows = jobs.select(F.col(row_id).alias("id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    whole = reduce(lambda a, b: a & b, [F.col(f"f{i}").isNotNull() for i in range(len(fields))], F.col("id").isNotNull())
    named = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.col(f"f{i}").alias("value")) for i in range(len(fields))])
    return rows.where(whole).select(F.lit("jobs").alias("src"), "id", named.alias("fields"))


def raw_records(raw: DataFrame, payload: str = "payload", row_id: str = "raw_id") -> DataFrame:
    """(src, id, fields) of readable payloads; field order, layout and letter case of names don't matter."""
    rows = raw.select(F.col(row_id).alias("id"), payload_fields(F.col(payload)).alias("fields")).where("fields is not null and id is not null")
    return rows.select(F.lit("raw_jobs").alias("src"), "id", "fields")


def found(records: DataFrame) -> DataFrame:
    """(src, first_id, copy_id): one row for each id of a class but its smallest.

    Nulls: records without id or, in ``jobs``, with a null field aren't in any
    class; a null value inside a payload equals only null. Repeated rows of an
    id count once. A class with more than 1/256 of all members is joined by
    broadcast (there can be at most 256 such classes), all others by shuffle.
    """
    with scratch():
        members = Table(refine(records)[0], "copies").df
        groups = Table(copy_groups(members).where("n_copies > 1"), "copygroups").df
        ids = join_hot(members, groups.select("src", "key", "first_id"), ["src", "key"], hot_rows(groups, ["src", "key"], "n_copies"))
        return Table(ids.where("id <> first_id").select("src", "first_id", F.col("id").alias("copy_id")).distinct(), "found", keep=True).df


def one_per_group(records: DataFrame) -> DataFrame:
    """(src, first_id, n_copies): one record for each group, single ones with 1.

    Members of single-record invariant classes never build a costly key: they
    come out of the first stage.
    """
    with scratch():
        members, single = refine(records)
        groups = copy_groups(members).select("src", "first_id", "n_copies")
        return Table(single.select("src", F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("n_copies")).unionByName(groups), "groups", keep=True).df
