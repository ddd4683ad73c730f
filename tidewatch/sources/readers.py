"""Sources and sinks: Parquet, JDBC with key lists, catalogs, CSV trees, YAML, JSON, Markdown tables, text corpora."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of a cohort table that are no features.
ROLES = ("order_key", "label", "subgroup", "anchor_year_group")


def read_cohort(spark: SparkSession, path: str, roles: tuple[str, ...] = ROLES) -> tuple[DataFrame, list[str]]:
    """A cohort table and its feature columns: all that have no other role."""
    df = spark.read.parquet(path)
    return df, [c for c in df.columns if c not in roles]


def read_jdbc(
    spark: SparkSession, url: str, query: str, key: str, cohort: DataFrame, items: list[int] | None = None, item: str = "itemid", partitions: int = 1, **options
) -> DataFrame:
    """A query's rows for cohort members. The few items and the cohort's range of integer keys go into the query, the many
    keys into a left-semi join; `partitions` reads share out the range, so that each connection reads its own keys. An
    empty cohort reads nothing."""
    low, high = cohort.agg(F.min(key).cast("long"), F.max(key).cast("long")).first()
    where = "1 = 0" if low is None else f"{key} BETWEEN {low} AND {high}"
    if items:
        where += f" AND {item} IN ({', '.join(str(int(i)) for i in items)})"
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT * FROM ({query}) q WHERE {where}) r", **options)
    if low is not None and partitions > 1 and high > low:
        # The upper bound only sets the stride; rows beyond it would go to the last read.
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=partitions)
    return reader.load().join(cohort.select(key).distinct(), key, "left_semi")


def run_aggregate(spark: SparkSession, sql: str, counts: list[str]) -> DataFrame:
    """A read-only statement with its counts suppressed where cells are small."""
    from tidewatch.operators.features import suppressed

    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT statements are run")
    return suppressed(spark.sql(sql), counts)


def catalog_dump(columns: DataFrame, sizes: DataFrame, system: tuple[str, ...] = ("pg_catalog", "information_schema")) -> DataFrame:
    """columns(schema, table, column, type, ordinal), sizes(schema, table, reltuples): a row for each user table."""
    own = columns.where(~F.col("schema").isin(*system))
    listed = own.groupBy("schema", "table").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column", "type"))).alias("columns"))
    n = sizes.select("schema", "table", F.when(F.col("reltuples") >= 0, F.col("reltuples")).cast("long").alias("estimated_rows"))
    return listed.join(n, ["schema", "table"], "left")


def spark_catalog(spark: SparkSession) -> DataFrame:
    """table, column, type of the session's own tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def _root(spark: SparkSession, root: str):
    """The root's file system and its full address."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def file_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (relative to root), length and content of every file below root whose name fits, on any file system; content
    is read only where it is selected. Empty files have no row, as Spark's readers pass over them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.substr("path", F.lit(len(_root(spark, root)[1].toString()) + 2)).alias("path"), "length", "content")


def listed(spark: SparkSession, root: str, endings: tuple[str, ...]) -> dict[str, str]:
    """Relative path to full address of every file below root with one of the endings, empty ones too, in order."""
    fs, at = _root(spark, root)
    files, found, cut = fs.listFiles(at, True), {}, len(at.toString()) + 1
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(endings):
            found[name[cut:]] = name
    return dict(sorted(found.items()))


def csv_tree(spark: SparkSession, root: str, count_rows: bool = False) -> DataFrame:
    """path (relative), columns, rows of every .csv and .csv.gz file below root, on any file system; an empty file has none.
    Names and headers come to the driver, rows are counted by Spark."""
    out = []
    for path, file in listed(spark, root, (".csv", ".csv.gz")).items():
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(file)
        out.append((path, df.columns, df.count() if count_rows and df.columns else (0 if count_rows else None)))
    return spark.createDataFrame(out, "path string, columns array<string>, rows long")


def read_yaml(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Records of YAML lists in the order of file names, with _source."""
    import yaml

    rows = []
    for p in sorted(paths):
        for r in yaml.safe_load(Path(p).read_text()) or []:
            rows.append({**r, "_source": os.path.basename(p)})
    return spark.createDataFrame(rows, schema + ", _source string")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def pilot_rows(lines: DataFrame) -> DataFrame:
    """Rows of Markdown result tables: lines(n, value). A heading `### Label lag N` holds until the next."""
    lag = F.regexp_extract("value", r"^### Label lag (\d+)", 1)
    out = lines.withColumn("lag", F.last(F.when(lag != "", lag.cast("int")), ignorenulls=True).over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    out = out.withColumn("c", cells).where((F.size("c") >= 12) & F.element_at("c", 1).rlike(r"^SC\d+$") & F.element_at("c", 4).rlike(r"^\d+$"))
    number = r"(-?\d+(?:\.\d+)?) \[(-?\+?\d+(?:\.\d+)?), (-?\+?\d+(?:\.\d+)?)\]"
    cols = ["n", "lag", F.element_at("c", 1).alias("scenario"), F.element_at("c", 2).alias("level"), F.element_at("c", 3).alias("shape"), F.element_at("c", 4).cast("int").alias("replicates")]
    for k, name in ((9, "first"), (10, "second")):
        cell = F.regexp_replace(F.element_at("c", k), r"\+", "")
        cols += [F.regexp_extract(cell, number, g).try_cast("double").alias(f"{name}{s}") for g, s in ((1, ""), (2, "_lo"), (3, "_hi"))]
    return out.select(*cols).where(F.col("first").isNotNull() & F.col("second").isNotNull())


def matrix_rows(lines: DataFrame) -> DataFrame:
    """Rows of a Markdown table whose first cell is bold: construct and the remaining cells."""
    bold = F.regexp_extract("value", r"^\|\s*\*\*([^*]+)\*\*\s*\|", 1)
    parts = F.split("value", r"\|")
    cells = F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda c: F.trim(c))
    return lines.where(bold != "").select(bold.alias("construct"), F.filter(cells, lambda c: c != "").alias("cells"))


def corpus(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """files(group, path relative to root): the texts of each group's files in the order of paths, joined by line ends."""
    text = file_tree(spark, root).select("path", F.col("content").cast("string").alias("value"))
    both = files.join(text, "path")
    return both.groupBy("group").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"])).alias("text"))


def read_replicates(spark: SparkSession, path: str, scenarios: list[str] | None = None) -> DataFrame:
    """A replicate store; only the folders of the named scenarios are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("scenario").isin(*scenarios)) if scenarios is not None else df


def tagged(records: DataFrame, column: str, tag: str) -> DataFrame:
    """Records whose array column has the tag; a null array has none."""
    return records.where(F.array_contains(column, tag))


def environment() -> dict[str, str]:
    """Versions that results depend on, for the record of a run. Draws need no seed: they are functions of ids and salts."""
    import platform
    from importlib.metadata import version

    return {"python": platform.python_version(), "platform": platform.platform(), **{p: version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}}


def with_number(text: str, record: str, field: str, value: float) -> str:
    """YAML text in which the number of one field of one list record is replaced, and nothing else: layout and comments
    stay. ValueError unless the record and the field are there exactly once."""
    from tidewatch.functions.scalar import format_level

    items = re.split(r"(?m)^(?=- )", text)
    own = [k for k, item in enumerate(items) if re.search(rf"(?<![\w.])id:\s*['\"]?{re.escape(record)}(?![\w.])", item)]
    if len(own) != 1:
        raise ValueError(f"{len(own)} records {record}")
    new, n = re.subn(rf"(?<![\w.])({re.escape(field)}:\s*)([^,}}\]\n]*)", lambda m: m[1] + format_level(m[2], value), items[own[0]])
    if n != 1:
        raise ValueError(f"{n} fields {field} in {record}")
    return "".join([*items[: own[0]], new, *items[own[0] + 1 :]])


# --- sinks -----------------------------------------------------------------------------------------------------------


def write_features(df: DataFrame, path: str, keep: list[str]) -> None:
    """Only the kept columns leave; identifiers don't."""
    df.select(*keep).write.mode("overwrite").parquet(path)


def write_replicates(df: DataFrame, path: str) -> None:
    df.repartition("scenario").write.mode("overwrite").partitionBy("scenario").parquet(path)


def write_json(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one JSON file; larger ones are refused, df.write.json is for those."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in rows], indent=1, default=str))


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else " ".join(str(v).replace("|", "\\|").split())
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def setting(name: str, given: str | None, default: str) -> str:
    """Argument before environment before default."""
    return given if given is not None else os.environ.get(name, default)
