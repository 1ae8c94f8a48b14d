"""Rules that input must meet: they fail the query instead of dropping rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that may not reach inference, by place of the check.
LABEL_COLUMNS = {
    "split": {"answer", "label", "correct_answer", "correct_prefix", "answer_label"},
    "worker": {"answer", "label", "correct_answer", "correct_prefix", "answer_label"},
    "joint": {"correct_answer", "correct_prefix", "answer_label"},
    "avspeaker": {"answer", "correct_answer", "label"},
}
#: Questions of each dataset.
QUESTION_COUNTS = {"joint": 2853, "avspeaker": 3212}


def required(value: Column, condition: Column, message: str) -> Column:
    """value, or an error where the condition isn't true."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def reject_labels(df: DataFrame, place: str) -> DataFrame:
    if found := sorted(set(df.columns) & LABEL_COLUMNS[place]):
        raise ValueError(f"label columns: {', '.join(found)}")
    return df


def reject_label_keys(raw: DataFrame, place: str, line: str = "value") -> DataFrame:
    """The same for ragged JSON lines, by the keys of each."""
    keys = F.array_intersect(F.json_object_keys(line), F.array(*map(F.lit, sorted(LABEL_COLUMNS[place]))))
    return raw.withColumn(line, required(F.col(line), F.size(keys) == 0, "label columns in a row"))


def unique(df: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """df, after a check that key repeats nowhere (and that there are `count` rows)."""
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if seen["most"] > 1:
        raise ValueError(f"{key} repeats")
    if count is not None and seen["rows"] != count:
        raise ValueError(f"{seen['rows']} rows, not {count}")
    return df


def valid_options(options: Column) -> Column:
    """Four options, A to D, all different."""
    values = F.map_values(options)
    return (F.array_sort(F.map_keys(options)) == F.array(*map(F.lit, "ABCD"))) & (F.size(F.array_distinct(values)) == 4)


def stays_inside(path: Column) -> Column:
    """A relative path that never climbs above where it starts."""
    parts = F.split(path, "/")
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(s["low"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("low"),
        ),
    )
    return ~F.startswith(path, F.lit("/")) & (depth["low"] >= 0)


def existing(rows: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """rows, with an error for a path that leaves the root or names no file there. files: file, relative to the root."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(^|/)(?:\./+)+", "$1"), r"/{2,}", "/")
    asked = rows.withColumn("_file", required(plain, F.coalesce(stays_inside(F.col(path)), F.lit(False)), "a path leaves its root"))
    found = asked.join(files.select(F.col("file").alias("_file"), F.lit(True).alias("_there")).distinct(), "_file", "left")
    return found.withColumn(path, required(F.col(path), F.col("_there"), "a file is not there")).select(*rows.columns)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def parity(keys: list[str], left: str, right: str) -> Column:
    """map<key,boolean>: whether two structs agree; two missing values agree."""
    pairs = [x for k in keys for x in (F.lit(k), F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")))]
    return F.create_map(*pairs)


def manifest_difference(left: DataFrame, right: DataFrame, one_way: bool = False) -> DataFrame:
    """path, left, right where two tables of path and digest disagree (one_way: only paths of left)."""
    joined = left.select("path", F.col("digest").alias("left")).join(right.select("path", F.col("digest").alias("right")), "path", "left" if one_way else "full_outer")
    return joined.where(~F.col("left").eqNullSafe(F.col("right")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
