"""Panel sources and sinks: CSV folders, Parquet, tables; adjustment; run artifacts; bundle integrity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.session import cut, ship

PRICES = ["open", "high", "low", "close"]
COLUMNS = ["date", "symbol", *PRICES, "volume"]


def load_csv_dir(spark: SparkSession, folder: str, symbols: list[str] | None = None) -> DataFrame:
    """One CSV per symbol; the symbol is the upper-cased file stem, headers are lower-cased with underscores. Files are read as one scan
    per header; an adj_close column rescales all prices."""
    from pyspark.errors import AnalysisException

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(F.col("path"), F.substring_index(F.substring_index(F.decode("content", "utf-8"), "\n", 1), "\r", 1).alias("header"))
    heads = names.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()  # one row per shape of header
    if not heads:
        raise AnalysisException(f"no CSV files in {folder}")
    parts = []
    for row in heads:
        raw = spark.read.option("header", True).csv(row["paths"])
        raw = raw.select("*", F.col("_metadata.file_name").alias("file_"))
        named = raw.select(*[F.col(f"`{c}`").alias(c if c == "file_" else c.strip().lower().replace(" ", "_")) for c in raw.columns])
        named = named.withColumn("symbol", F.upper(F.regexp_replace("file_", r"\.csv$", "")))
        if symbols:
            named = named.filter(F.col("symbol").isin([s.upper() for s in symbols]))
        parts.append(adjust(named) if "adj_close" in named.columns else named.select(*COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjust(raw: DataFrame) -> DataFrame:
    """Prices times adj_close / close. With a column adjustment_state, rows that are adjusted already stay; any unknown state is an error."""
    close = F.expr("try_cast(close as double)")
    factor = F.expr("try_cast(adj_close as double)") / F.when(close != 0, close)
    if "adjustment_state" in raw.columns:
        factor = F.when(F.col("adjustment_state") == "adjusted", F.lit(1.0)).when(F.col("adjustment_state") == "unadjusted", factor).otherwise(
            F.raise_error(F.concat(F.lit("unknown adjustment state: "), F.coalesce("adjustment_state", F.lit("null")))).cast("double"))
    return raw.select("date", "symbol", *[(F.expr(f"try_cast({c} as double)") * factor).alias(c) for c in PRICES], F.expr("try_cast(volume as double)").alias("volume"))


def load_panel(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame | None]:
    """(panel, benchmark) from a config with source csv, parquet or table; benchmark names the symbol that is split off."""
    source = config.get("source")
    if source == "csv":
        raw = load_csv_dir(spark, config["path"], config.get("symbols"))
    elif source == "parquet":
        raw = spark.read.parquet(config["path"])
    elif source == "table":
        raw = spark.table(config["table"])
    else:
        raise ValueError(f"unknown source: {source!r}")
    rows = typed(raw)
    name = config.get("benchmark")
    return rows, rows.filter(F.col("symbol") == name) if name else None


def typed(raw: DataFrame) -> DataFrame:
    """The panel's columns and types; what cannot be read, and NaN, is null."""
    number = lambda c: F.when(~F.isnan(F.expr(f"try_cast({c} as double)")), F.expr(f"try_cast({c} as double)")).alias(c)
    return raw.select(F.expr("try_cast(date as date)").alias("date"), F.col("symbol").cast("string").alias("symbol"), *[number(c) for c in [*PRICES, "volume"]])


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str) -> str:
    """Named tables of one run; a run that exists is never written over."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{run_id}/{name}")
    return f"{folder}/{run_id}"


#: Bytes of a file that a task holds while it digests it.
CHUNK = 4 << 20


def file_digests(paths: DataFrame) -> DataFrame:
    """(path, found_sha, found_rows) of the files of paths (path: URIs): sha256 over the bytes and the rows in a Parquet footer, null where a
    file is no Parquet. Paths are dealt to tasks, and a file is read in chunks through its file system, so that a task holds one chunk of a
    file of any size; a digest is sequential, so a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                scheme, rest = path.split(":", 1)  # Spark's paths are not escaped
                host, place = rest[2:].split("/", 1) if rest.startswith("//") else ("", rest.lstrip("/"))
                store, place = fs.FileSystem.from_uri(f"{scheme}://{host}/{quote(place)}")
                digest, block = hashlib.sha256(), bytearray(CHUNK)
                with store.open_input_file(place) as file:
                    while n := file.readinto(block):
                        digest.update(memoryview(block)[:n])
                    try:
                        rows = pq.ParquetFile(file).metadata.num_rows
                    except (pa.ArrowInvalid, OSError):
                        rows = None
                found.append((path, digest.hexdigest(), rows))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], names=["path", "found_sha", "found_rows"])

    ship(paths.sparkSession)
    return paths.select("path").repartition("path").mapInArrow(run, "path string, found_sha string, found_rows long")


def bundle_integrity(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, rule, expected, found) of every part that differs from the manifest (path, rows, sha256): missing and surplus files, hashes
    and row counts. Empty when the bundle is whole. Spark lists the folder, without files that
    have no bytes, which count as missing; contents are read by file_digests() alone."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder).select("path")
    files = cut(file_digests(listed), "digests").select(name("path").alias("file"), "found_sha", "found_rows")
    both = manifest.select(name("path").alias("file"), "rows", "sha256").hint("merge").join(files.hint("merge"), "file", "full_outer")
    rule = F.when(F.col("found_sha").isNull(), "missing").when(F.col("sha256").isNull(), "surplus").when(F.col("sha256") != F.col("found_sha"), "sha256").when(F.col("rows") != F.coalesce("found_rows", F.lit(0)), "rows")
    return both.withColumn("rule", rule).filter("rule is not null").select(F.col("file").alias("path"), "rule", F.concat_ws("/", F.col("rows").cast("string"), "sha256").alias("expected"), F.concat_ws("/", F.col("found_rows").cast("string"), "found_sha").alias("found"))
