"""Files whose paths carry entities, and sinks that write them.

A tidy file set is a folder of CSV files below `key=value` folders, or of files whose names carry the entities
(`sub-<subject>_task-<task>_desc-<description>_<suffix>.csv`). Spark lists, prunes and reads them; no file is opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialgrid.sources.work import work_path

#: Entities by their short names in file names; fixed values.
SHORT = {"subject": "sub", "session": "ses", "task": "task", "acquisition": "acq", "run": "run", "processing": "proc", "space": "space", "description": "desc"}
#: Folder name of a null key, as Spark writes it, and of an empty string, which Spark would write alike.
NULL, EMPTY = "__HIVE_DEFAULT_PARTITION__", "__EMPTY__"


def _decoded(c: Column) -> Column:
    """Percent escapes as characters, plus signs as they are; as it is where it has a percent sign that is no escape."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def write_tidy(df: DataFrame, keys: list[str], name: str) -> str:
    """One folder a key combination (`key=value/...`), CSV with a header; the path of the set.

    Nulls and empty strings have folders of their own; a value that ends in the name of one of these gets one more underscore in front.
    """
    path = work_path(df.sparkSession, name)
    special = F.array(F.lit(NULL), F.lit(EMPTY))

    def named(k: str) -> Column:
        c = F.col(k).cast("string")
        return F.when(c == "", EMPTY).when(F.exists(special, lambda x: F.endswith(c, x)), F.concat(F.lit("_"), c)).otherwise(c)

    df.withColumns({k: named(k) for k in keys}).write.partitionBy(*keys).option("header", True).csv(path)
    return path


def path_entity(key: str) -> Column:
    """The value of `key=value` in a row's file path: null without one, the path's own escapes and those of its folder names undone."""
    raw = F.regexp_extract(F.col("_metadata.file_path"), f"/{key}=([^/]*)/", 1)
    value = _decoded(_decoded(raw))
    inner = F.exists(F.array(F.lit(NULL), F.lit(EMPTY)), lambda x: F.endswith(value, x))
    return F.when((raw == "") | (value == NULL), None).when(value == EMPTY, "").when(inner, F.substring(value, F.lit(2), F.length(value))).otherwise(value)


def file_name() -> Column:
    """The name of a row's file, without folders."""
    return _decoded(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1))


def name_entity(key: str) -> Column:
    """The value of `key-value` in a row's file name, by the long or short name of the entity; null without one.

    `suffix` is what stands behind the last underscore (without a dash), `extension` all from the first full stop behind it, `datatype` the file's folder.
    """
    name = file_name()
    if key == "datatype":
        return F.nullif(_decoded(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)/[^/]*$", 1)), F.lit(""))
    if key == "extension":
        return F.nullif(F.regexp_extract(name, r"(?:^|_)[^_.]*(\.[^_]*)$", 1), F.lit(""))
    if key == "suffix":
        return F.nullif(F.regexp_extract(name, r"(?:^|_)([^_.-]*)(?:\.[^_]*)?$", 1), F.lit(""))
    return _decoded(F.nullif(F.regexp_extract(name, f"(?:^|_){SHORT.get(key, key)}-([^_.]*)", 1), F.lit("")))


def scan_tidy(spark: SparkSession, roots: list[str], schema: str | StructType, entities: list[str], glob: str = "*.csv") -> DataFrame:
    """Rows of all matching files below the roots, at any depth, with the entities of their folders as columns."""
    # without inference of partitions, so that several roots and depths read alike
    return _scan(spark, roots, schema, glob).withColumns({e: path_entity(e) for e in entities})


def scan_named(spark: SparkSession, roots: list[str], schema: str | StructType, entities: list[str], match: dict[str, str | None] | None = None, glob: str = "*.csv") -> DataFrame:
    """Rows of all files below the roots whose names have the entities in `match` (None: lack them), with `entities` as columns. Other files are not read."""
    rows = _scan(spark, roots, schema, glob)
    for key, value in (match or {}).items():
        rows = rows.filter(name_entity(key).isNull() if value is None else name_entity(key) == value)
    return rows.withColumns({e: name_entity(e) for e in entities})


def _scan(spark: SparkSession, roots: list[str], schema: str | StructType, glob: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(roots)


def write_named(df: DataFrame, entities: list[str], suffix: str, name: str) -> str:
    """One CSV file a combination of entities, `sub-..._desc-..._<suffix>.csv` in the order given, null entities left out; the path of the set.

    Characters that names use themselves are written as percent escapes. A combination's rows are written by one task, as they are one file; the files are renamed
    after the write, one metadata step each.
    """
    spark = df.sparkSession
    path = work_path(spark, name)

    def part(key: str) -> Column:
        value = F.col(key).cast("string")
        for c in "%_-./\\:":  # the percent sign first
            value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
        return F.concat(F.lit(f"{SHORT.get(key, key)}-"), value)

    named = df.withColumn("__file", F.concat_ws("_", *(part(k) for k in entities), F.lit(suffix))).drop(*entities)
    named.repartition("__file").write.partitionBy("__file").option("header", True).csv(path)
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for own in fs.listStatus(folder):
        label = own.getPath().getName()
        if label.startswith("__file="):
            for file in fs.listStatus(own.getPath()):
                fs.rename(file.getPath(), jvm.Path(folder, spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(label[7:]) + ".csv"))
            fs.delete(own.getPath(), True)
    return path


def scan_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, number of damaged rows by file) of CSV files in which some lines don't fit the schema."""
    rows = spark.read.schema(f"{schema}, __bad string").option("header", False).option("columnNameOfCorruptRecord", "__bad").csv(path).withColumn("__file", F.col("_metadata.file_path"))
    # a column of data has to be read along, else Spark would not parse the lines
    first = rows.columns[0]
    damaged = rows.groupBy(F.col("__file").alias("file")).agg(F.count("__bad").alias("damaged"), F.count_if(F.col("__bad").isNull()).alias("good"), F.count(first).alias(f"with_{first}"))
    return rows.filter("__bad is null").drop("__bad", "__file"), damaged


def lookup_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) from lines `id name ...` of text files; comments, blank lines and lines that don't begin with a digit are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.rlike("value", F.lit(r"^\s*[0-9]"))).select(parts[0].try_cast("int").alias("id"), parts[1].alias("name"))


def with_columns(sources: dict[str, DataFrame], needed: list[str]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Sources that have all needed columns, and (source, missing column) of the others. Only schemas are read."""
    missing = [(name, c) for name, df in sources.items() for c in needed if c not in df.columns]
    bad = {name for name, _ in missing}
    return {name: df for name, df in sources.items() if name not in bad}, missing


def write_with_params(df: DataFrame, params: dict[str, str], name: str) -> str:
    """A long table next to one row of the run's parameters."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(f"{path}/data")
    df.sparkSession.createDataFrame([tuple(map(str, params.values()))], list(params)).write.parquet(f"{path}/run_params")
    return path


def read_with_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").join(F.broadcast(spark.read.parquet(f"{path}/run_params")), F.lit(True))  # one row


def run_params(spark: SparkSession, path: str, kinds: dict[str, str]) -> dict:
    """The parameters of the run that wrote `path`, cast to `kinds` (name: type); those without a kind stay text."""
    rows = spark.read.parquet(f"{path}/run_params")
    return rows.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in rows.columns)).first().asDict()  # one row


def job_grid(df: DataFrame, keys: list[str], lists: dict[str, list]) -> DataFrame:
    """One row a job: every distinct key with every combination of the listed parameters."""
    out = df.select(*keys).distinct()
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(x) for x in values))))
    return out
