"""A catalogue of Parquet datasets with roles in column names: group_* keys, *_label labels, meta_* notes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators.tables import scale_by_max

FOLDERS = {"": "main", "extensive_collection": "extensive", "extracted_fixations": "extracted"}


def dataset_kind(name: str) -> str:
    return "gaze" if name.endswith(("_gaze", "_gazes")) else "fixation"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files and folders right below folder, by the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(n[: -len(".parquet")] for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".parquet")) if fs.exists(path) else []


def list_datasets(spark: SparkSession, root: str, parts: Sequence[str] = ("main", "extensive", "extracted"), kind: str | None = None) -> DataFrame:
    """(name, kind, part, path), by name; of a name that several parts have, each."""
    rows = [(n, dataset_kind(n), part, f"{root}/{sub + '/' if sub else ''}{n}.parquet") for sub, part in FOLDERS.items() if part in parts for n in _names(spark, f"{root}/{sub}".rstrip("/"))]
    return spark.createDataFrame(sorted(r for r in rows if kind in (None, r[1])), "name string, kind string, part string, path string")


def number(c: str) -> Column:
    """Text with a decimal comma as a number; null if it is none."""
    return F.expr(f"try_cast(replace(`{c}`, ',', '.') as double)")


def repair(df: DataFrame, normalize: bool = False) -> DataFrame:
    """Numbers from text in x and y, the mean of both eyes where one place is missing, nan as null, and, if asked, shares of the table's maximum."""
    kinds = dict(df.dtypes)
    df = df.withColumns({c: number(c) for c in ("x", "y", "x_left", "x_right", "y_left", "y_right") if kinds.get(c) == "string"})
    df = df.withColumns({a: (F.col(f"{a}_left") + F.col(f"{a}_right")) / 2 for a in ("x", "y") if a not in kinds and {f"{a}_left", f"{a}_right"} <= set(kinds)})
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k in ("double", "float")})
    for a in ("x", "y") if normalize else ():
        if a in df.columns and f"norm_pos_{a}" not in df.columns:
            df = scale_by_max(df, a, f"norm_pos_{a}")
    return df


def load_dataset(spark: SparkSession, root: str, name: str, normalize: bool = False) -> tuple[DataFrame, dict | None]:
    """The dataset from the first part that has it, and its entry in meta.json, if there is a readable one."""
    for sub in FOLDERS:
        folder = f"{root}/{sub}".rstrip("/")
        if name in _names(spark, folder):
            return repair(spark.read.parquet(f"{folder}/{name}.parquet"), normalize), load_meta(spark, folder, name)
    raise FileNotFoundError(f"{name} in {root}")


def load_meta(spark: SparkSession, folder: str, name: str) -> dict | None:
    try:
        text = spark.read.text(f"{folder}/meta.json", wholetext=True).first()
        return json.loads(text[0]).get(name) if text else None
    except Exception as e:  # no file, or none that can be read
        if type(e).__name__ in ("AnalysisException", "JSONDecodeError", "AttributeError"):
            return None
        raise


def key_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("group_")]


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_label")]


def meta_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("meta_")]


def with_duration(df: DataFrame) -> DataFrame:
    """duration from ends and starts, where it is missing."""
    for a, b in (("timestamp_start", "timestamp_end"), ("start_time", "end_time")):
        if "duration" not in df.columns and {a, b} <= set(df.columns):
            df = df.withColumn("duration", F.col(b) - F.col(a))
    return df


def column_roles(df: DataFrame) -> dict[str, str | None]:
    """Which columns hold x, y, t and duration, by preference."""
    wanted = {"x": ("norm_pos_x", "x"), "y": ("norm_pos_y", "y"), "t": ("timestamp", "timestamp_start", "start_time", "t"), "duration": ("duration",)}
    return {role: next((c for c in names if c in df.columns), None) for role, names in wanted.items()}


def write_folds(df: DataFrame, path: str, how: str = "parquet") -> None:
    """One folder for each fold."""
    df.write.mode("overwrite").partitionBy("fold").format(how).option("header", True).save(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def write_split_info(split: DataFrame, path: str, key: str, label: str, keys: Sequence[str]) -> None:
    """One JSON line at path: the ids (column key, as text) of each fold, and what they were made by. split: key and fold, a row for each group."""
    ids = split.groupBy("fold").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("ids"))
    whole = ids.agg(F.map_from_entries(F.collect_list(F.struct("fold", "ids"))).alias("folds"), F.lit(key).alias("split_pk"), F.lit(label).alias("label_col"), F.array(*[F.lit(k) for k in keys]).alias("pk_cols"))
    whole.coalesce(1).write.mode("overwrite").json(path)


def read_split_info(spark: SparkSession, path: str) -> DataFrame:
    """(key, fold) of what write_split_info wrote; key is text."""
    info = spark.read.schema("folds map<string,array<string>>, split_pk string, label_col string, pk_cols array<string>").json(path)
    key = info.select("split_pk").first()[0]
    return info.select(F.explode("folds").alias("fold", "ids")).select(F.explode("ids").alias(key), "fold")


def log_result(spark: SparkSession, path: str, **values: object) -> None:
    """Add a row of results to the log at path (a folder of JSON lines)."""
    spark.createDataFrame([{k: str(v) for k, v in values.items()}]).write.mode("append").json(path)
