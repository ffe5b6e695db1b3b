"""Event-log readers: contract, formats, normalisation (locations become plain doubles)."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspark.functions import scalars as S

_LOC = T.ArrayType(T.DoubleType())

# The columns of the event contract and their types.
REQUIRED = {
    "id": T.StringType(), "index": T.LongType(), "match_id": T.LongType(),
    "period": T.IntegerType(), "minute": T.IntegerType(), "second": T.IntegerType(),
    "type": T.StringType(), "team": T.StringType(), "possession": T.LongType(),
    "possession_team": T.StringType(), "play_pattern": T.StringType(), "location": _LOC}
OPTIONAL = {
    "duration": T.DoubleType(), "pass_end_location": _LOC, "carry_end_location": _LOC,
    "shot_end_location": _LOC, "pass_outcome": T.StringType(), "shot_outcome": T.StringType(),
    "shot_statsbomb_xg": T.DoubleType(), "under_pressure": T.BooleanType(),
    "counterpress": T.BooleanType(), "player": T.StringType(), "player_id": T.LongType(),
    "team_id": T.LongType(), "obv_for_net": T.DoubleType(), "obv_against_net": T.DoubleType(),
    "obv_total_net": T.DoubleType(), "pass_type": T.StringType()}
LOCATIONS = {"location": "start", "pass_end_location": "pass_end",
             "carry_end_location": "carry_end", "shot_end_location": "shot_end"}
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in {**REQUIRED, **OPTIONAL}.items()])
FORMATS = ("parquet", "csv", "ndjson", "jsonl")


def require_columns(df: DataFrame, needed) -> DataFrame:
    """Fail before any job when a needed column is missing, naming all of them."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError("missing required columns: " + ", ".join(missing))
    return df


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with every null token handled.

    Columns are read as text and cast to the contract, so a rare column that is empty in the
    first rows keeps its type. Without a schema the whole file is sampled for inference. Files are
    split between tasks unless values may hold line breaks (``multi_line``).
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        df = reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path)
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        return df.withColumns({c: S.null_tokens_to_null(F.col(c)) for c in texts})
    df = reader.csv(path)
    cols = []
    for name in df.columns:
        value = S.null_tokens_to_null(F.col(f"`{name}`"))
        kind = schema[name].dataType if name in schema.names else T.StringType()
        # locations stay text here; normalise() reads both forms
        cols.append((value if isinstance(kind, (T.ArrayType, T.StringType))
                     else value.try_cast(kind)).alias(name))
    return df.select(*cols)


def _reader(spark: SparkSession, fmt: str, path, schema):
    if fmt == "parquet":
        return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    if fmt == "csv":
        return scan_csv(spark, path, schema)
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_events(spark: SparkSession, src: str, schema: T.StructType | None = EVENT_SCHEMA
                ) -> DataFrame:
    """A file, or a folder searched in the order parquet, csv, ndjson, jsonl."""
    suffix = os.path.splitext(src)[1].lstrip(".").lower()
    if suffix in FORMATS:
        return _reader(spark, suffix, src, schema)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(src)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path) or not fs.getFileStatus(fs_path).isDirectory():
        raise ValueError(f"unsupported source: {src}")
    files = fs.listFiles(fs_path, True)
    seen = set()
    while files.hasNext():
        seen.add(os.path.splitext(files.next().getPath().getName())[1].lstrip(".").lower())
    for fmt in FORMATS:
        if fmt in seen:
            options = spark.read.option("pathGlobFilter", f"*.{fmt}").option(
                "recursiveFileLookup", True)
            if fmt == "parquet":
                return options.option("mergeSchema", True).parquet(src)
            if fmt == "csv":
                return _csv_folder(spark, src, schema)
            return (options.schema(schema) if schema else options).json(src)
    raise FileNotFoundError(f"no readable files in {src}")


def _csv_folder(spark: SparkSession, src: str, schema) -> DataFrame:
    raw = (spark.read.option("header", True).option("escape", '"')
           .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(src))
    out = raw.withColumns({c: S.null_tokens_to_null(F.col(f"`{c}`")) for c in raw.columns})
    if schema is None:
        return out
    return out.withColumns({
        f.name: F.col(f.name).try_cast(f.dataType) for f in schema
        if f.name in out.columns and not isinstance(f.dataType, (T.ArrayType, T.StringType))})


def normalise(df: DataFrame) -> DataFrame:
    """Contract columns with locations as start_x/y, pass_end_x/y, carry_end_x/y, shot_end_x/y.

    Nothing is sorted: every order-dependent operator names (match_id, index) itself.
    """
    require_columns(df, REQUIRED)
    contract = {**REQUIRED, **OPTIONAL}
    cols = []
    for name, kind in contract.items():
        if name in LOCATIONS:
            prefix = LOCATIONS[name]
            found = df.schema[name].dataType if name in df.columns else T.NullType()
            x, y = S.location_xy(F.col(name) if name in df.columns else F.lit(None), found)
            cols += [x.alias(f"{prefix}_x"), y.alias(f"{prefix}_y")]
        elif name in df.columns:
            # a column without any value arrives untyped or as text; the contract types it
            cols.append(F.col(name).cast(kind).alias(name))
    for name in ("pass_outcome", "shot_outcome", "player"):
        if name not in df.columns:
            cols.append(F.lit(None).cast("string").alias(name))
    return df.select(*cols)


def to_parquet(df: DataFrame, dst: str, partition_by: str | None = None) -> None:
    """Columnar copy of a log; partitioned output is clustered first to avoid tiny files."""
    if partition_by:
        df = df.repartition(partition_by, F.pmod(F.xxhash64(*[
            c for c in ("match_id", "index") if c in df.columns] or [F.lit(0)]), F.lit(32)))
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(dst)


def unify_parts(parts: list[DataFrame], required=None) -> DataFrame:
    """Union of parts with drifting schemas: wider numeric type wins, all-null becomes text."""
    rank = [T.BooleanType, T.IntegerType, T.LongType, T.DoubleType, T.StringType]
    target: dict[str, T.DataType] = {}
    for part in parts:
        for f in part.schema:
            kind = f.dataType
            if isinstance(kind, T.NullType):
                target.setdefault(f.name, T.NullType())
                continue
            old = target.get(f.name)
            if old is None or isinstance(old, T.NullType) or old == kind:
                target[f.name] = kind
                continue
            order = {c: i for i, c in enumerate(rank)}
            numeric = {T.IntegerType, T.LongType, T.DoubleType}
            if type(old) in numeric and type(kind) in numeric:
                target[f.name] = old if order[type(old)] >= order[type(kind)] else kind
            else:
                target[f.name] = T.StringType()
    final = {n: T.StringType() if isinstance(t, T.NullType) else t for n, t in target.items()}
    aligned = [p.select(*[F.col(c).cast(final[c]).alias(c) for c in p.columns]) for p in parts]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    return require_columns(out, required or [])
