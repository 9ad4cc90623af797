"""Readers and writers: hit tables, sidecars, frame dumps, folder and archive indexes, labels, manifests, particle tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave import functions as fn
from hitweave.operators.particles import log_energy
from hitweave.operators.sampling import stable_int

#: Fixed names of the hit table's columns, with their types here.
HIT_COLUMNS = {"Index": "bigint", "Matrix Index": "int", "ToA": "bigint", "ToT": "int", "FToA": "int", "Overflow": "smallint"}
#: Fixed header of the human label table.
GOLD_COLUMNS = {"source_path": "string", "window_path": "string", "hit_source_row": "bigint", "gold_particle_id": "bigint", "gold_object_label": "int", "annotator": "string", "notes": "string"}
FRAME = "sample INT, set_index INT, acq_unix DOUBLE, hw_t0_ns DOUBLE, hw_t_proc_ns DOUBLE, matrix STRUCT<shape: ARRAY<INT>, nnz: INT, entries: ARRAY<STRUCT<x: INT, y: INT, energy: DOUBLE>>>"
SIDECAR_HEAD = re.compile(r'^"([^"]*)"\s*\("([^"]*)"\):\s*$')


def read_hit_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated hit tables, markers included, with pixel and path; a missing column is an error, others are ignored."""
    raw = spark.read.csv(path, sep="\t", header=True, enforceSchema=False, mode="FAILFAST", recursiveFileLookup=True, pathGlobFilter="*.t3pa")
    if not raw.columns:
        return spark.createDataFrame([], "source_path string, row_index bigint, matrix_index int, toa bigint, tot int, ftoa int, overflow smallint, x int, y int")
    missing = [c for c in HIT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"hit table lacks columns: {', '.join(missing)}")
    names = ("row_index", "matrix_index", "toa", "tot", "ftoa", "overflow")
    rows = raw.select(F.col("_metadata.file_path").alias("source_path"), *(F.col(f"`{c}`").cast(t).alias(n) for n, (c, t) in zip(names, HIT_COLUMNS.items())))
    index = F.when(F.col("matrix_index") < 0, F.raise_error(F.lit("matrix index is negative")).cast("int")).otherwise(F.col("matrix_index"))
    return rows.withColumn("x", fn.pixel_x(index).cast("int")).withColumn("y", fn.pixel_y(index))


def load_hits(spark: SparkSession, path: str, markers: bool = False, most_rows: int | None = None, seed: int = 0) -> DataFrame:
    """Decoded hits by file: fine time, ticks from the file's first, log energy, and the row's place among the loaded ones.

    most_rows takes one contiguous span of raw rows a file, its start fixed by a hash of the path, before markers are left out.
    """
    raw = read_hit_table(spark, path)
    w = Window.partitionBy("source_path").orderBy("_at")
    rows = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("source_row", F.row_number().over(w) - 1)
    if most_rows:
        n = F.count("*").over(Window.partitionBy("source_path"))
        start = F.pmod(stable_int(F.concat(F.lit(f"{seed}:"), "source_path"), 12), F.greatest(n - most_rows + 1, F.lit(1)))
        rows = rows.withColumn("_start", start).where((F.col("source_row") >= F.col("_start")) & (F.col("source_row") < F.col("_start") + most_rows)).drop("_start")
    kept = rows if markers else rows.where("overflow = 0")
    fine = fn.fine_time(F.col("toa"), F.col("ftoa").cast("bigint"))
    return kept.withColumn("fine", fine).withColumn("time", (F.col("fine") - F.min("fine").over(Window.partitionBy("source_path"))) / 16.0).withColumn("energy", log_energy(F.col("tot"))).drop("_at")


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines less the header, by file."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.t3pa").select(F.col("_metadata.file_path").alias("source_path"))
    return lines.groupBy("source_path").agg(F.greatest(F.lit(0), F.count("*") - 1).alias("rows"))


def parse_sidecar(text: str) -> dict[str, dict]:
    """Blocks of a sidecar: a quoted key and description, a type line, then the next line that isn't blank as the value."""
    out, state, key, note, kind = {}, 0, "", "", ""
    for line in text.splitlines():
        m = SIDECAR_HEAD.match(line.strip())
        if m and state != 2:
            key, note, state = m[1], m[2], 1
        elif state == 1:
            kind, state = line.strip(), 2
        elif state == 2 and line.strip():
            name = re.sub(r"[^a-z0-9]+", "_", key.lower()).strip("_") or "unknown"
            raw = line.strip()
            out[name] = {"type": kind, "description": note, "raw": raw, "values": [raw] if kind.startswith("char") else raw.split()}
            state = 0
    return out


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, key, type, description, raw, values, number) of sidecar files; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.info").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, v["type"], v["description"], v["raw"], v["values"]) for p, c in zip(pdf["path"], pdf["content"]) for k, v in parse_sidecar(bytes(c).decode("utf-8", "replace")).items()]
            yield pd.DataFrame(rows, columns=["source_path", "key", "type", "description", "raw", "values"])

    return files.mapInPandas(parse, "source_path string, key string, type string, description string, raw string, values array<string>").withColumn("number", F.when(~F.col("type").startswith("char"), F.get("values", F.lit(0)).try_cast("double")))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a dump: blocks parted by five dashes, each a word and a JSON object."""
    blocks = spark.read.text(path, lineSep="-----").select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value")).where("value <> ''")
    return blocks.select(F.split("value", " ").getItem(0).alias("token"), F.from_json(F.regexp_extract("value", r"^\S+\s+(\{.*)$", 1), FRAME).alias("f")).select("token", "f.*")


def frame_hits(frames: DataFrame) -> DataFrame:
    """(sample, set_index, x, y, time 0, energy) of every entry."""
    return frames.select("sample", "set_index", F.explode("matrix.entries").alias("e")).select("sample", "set_index", "e.x", "e.y", F.lit(0.0).alias("time"), "e.energy")


def index_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: relative path, top folder, extension, size, time, row count of hit tables, sidecar values by name stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = "file:" + root if root.startswith("/") else root
    relative = F.regexp_replace("path", "^" + re.escape(base).replace("file:", "file:/*") + "/*", "")
    named = files.select("path", relative.alias("name"), F.col("length").alias("bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"))
    ext = F.when(F.col("name").endswith(".t3pa.info"), ".t3pa.info").otherwise(F.coalesce(F.nullif(F.regexp_extract("name", r"(\.[^./]+)$", 1), F.lit("")), F.lit("<none>")))
    table = named.withColumn("extension", ext).withColumn("folder", F.when(F.col("name").contains("/"), F.split_part("name", F.lit("/"), F.lit(1))).otherwise("."))
    norm = lambda c: F.regexp_replace(c, "^file:/*", "/")
    rows = count_rows(spark, root).select(norm("source_path").alias("_p"), "rows")
    meta = read_sidecars(spark, root).groupBy(norm(F.regexp_replace("source_path", r"\.info$", "")).alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("key", "raw"))).alias("metadata"))
    stem = norm(F.regexp_replace("path", r"\.info$", ""))
    return table.withColumn("_file", norm("path")).withColumn("_p", stem).join(rows.withColumnRenamed("_p", "_file"), "_file", "left").join(meta, "_p", "left").drop("_p", "_file")


def index_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, bytes, modified) of the members of zip archives, a leading raw_data/ left out."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows += [(p, i.filename.removeprefix("raw_data/"), i.file_size, "%04d-%02d-%02dT%02d:%02d:%02d" % i.date_time) for i in sorted(z.infolist(), key=lambda i: i.filename) if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "name", "bytes", "modified"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(members, "archive string, name string, bytes bigint, modified string")


def unsafe_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Member names that mustn't be unpacked: absolute, with a drive, backslash, NUL or parent step, or given twice."""
    n = F.col(column)
    bad = n.startswith("/") | n.rlike(r"^[A-Za-z]:") | n.contains("\\") | n.contains("\x00") | n.rlike(r"(^|/)\.\.(/|$)")
    return names.withColumn("_n", F.count("*").over(Window.partitionBy(column))).where(bad | (F.col("_n") > 1)).select(column, F.when(bad, "unsafe").otherwise("repeated").alias("reason")).distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Human labels; the header must be there whole. A path without a file gives no rows."""
    schema = ", ".join(f"{k} {v}" for k, v in GOLD_COLUMNS.items())
    try:
        raw = spark.read.csv(path, header=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    missing = [c for c in GOLD_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"label table lacks columns: {', '.join(missing)}")
    return raw.select(*(F.col(c).cast(t).alias(c) for c, t in GOLD_COLUMNS.items()))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of files(path, size, sha256) that a manifest doesn't know, lacks, or has otherwise."""
    a, b = found.select("path", F.col("size").alias("s1"), F.col("sha256").alias("h1"), F.lit(1).alias("in1")), manifest.select("path", F.col("size").alias("s2"), F.col("sha256").alias("h2"), F.lit(1).alias("in2"))
    problem = F.when(F.col("in1").isNull(), "missing").when(F.col("in2").isNull(), "unexpected").when(F.col("s1") != F.col("s2"), "size").when(F.col("h1") != F.col("h2"), "sha256")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, by: str = "component") -> DataFrame:
    """Per component: files, bytes, and one SHA-256 over its sorted (path, size, sha256) rows."""
    line = F.concat_ws(" ", "path", F.col("size").cast("string"), "sha256")
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("tree_sha256"))


def union_rows(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_rows(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").option("header", "true").format(kind).save(path)


def write_table(df: DataFrame, path: str) -> str:
    """Write as Parquet, or as CSV where Parquet can't hold the columns; the format that was used."""
    try:
        df.write.mode("overwrite").parquet(path)
        return "parquet"
    except Exception as e:
        if "UNSUPPORTED" not in str(e) and "INVALID_COLUMN" not in str(e):
            raise
        flat = df.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema))
        flat.write.mode("overwrite").option("header", "true").csv(path)
        return "csv"


def write_chunks(rows: DataFrame, path: str, by: str = "split", chunk: int = 2048) -> None:
    """Rows (edge windows, views, voxel grids) as Parquet, parted by `by`, at most `chunk` rows a file."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", chunk).partitionBy(by).parquet(path)


def chunk_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_path, chunk_row, ...) of every row that `write_chunks` wrote: its file and its place there."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("_metadata.file_path").alias("chunk_path"), F.col("_metadata.row_index").alias("chunk_row"), *rows.columns)


def index_markdown(index: DataFrame, most_folders: int = 1000) -> str:
    """A report of an index by top folder: files, tables, bytes and rows, the five largest files; the folders with the most files first.

    The report is read by people, so it has at most `most_folders` folders and says how many it leaves out.
    """
    from hitweave.functions import human_bytes

    folders = index.groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("extension") == ".t3pa").alias("tables"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("extension") == ".t3pa", F.col("rows"))).alias("rows"))
    total = folders.agg(F.count("*").alias("n"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).withColumn("size", human_bytes(F.coalesce("bytes", F.lit(0)))).first()
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.col("bytes").desc(), "name"))
    shown = folders.orderBy(F.col("files").desc(), "folder").limit(most_folders)
    largest = index.select("folder", "name", "bytes").withColumn("_r", rank).where("_r <= 5").join(F.broadcast(shown.select("folder")), "folder").groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("_r", "name", human_bytes(F.col("bytes")).alias("size")))).alias("largest"))
    kinds = index.groupBy("extension").count().orderBy(F.col("count").desc(), "extension").collect()
    lines = ["# Index", "", f"{total['files'] or 0} files, {total['size']}, {total['rows'] or 0} rows", "", *(f"* {k['extension']}: {k['count']}" for k in kinds), "", "| Folder | Files | Tables | Size | Rows | Largest |", "|---|---|---|---|---|---|"]
    for r in shown.join(largest, "folder").withColumn("size", human_bytes(F.col("bytes"))).orderBy(F.col("files").desc(), "folder").collect():
        lines.append(f"| {r['folder']} | {r['files']} | {r['tables']} | {r['size']} | {r['rows'] or 0} | " + ", ".join(f"{x['name']} ({x['size']})" for x in r["largest"]) + " |")
    if total["n"] > most_folders:
        lines.append(f"\n{total['n'] - most_folders} folders are left out.")
    return "\n".join(lines) + "\n"


def clustering_params(path: str | None = None) -> dict[str, float]:
    """eps, min_samples and time_scale of a JSON file; the wide defaults where there is no such file."""
    import json
    from pathlib import Path

    found = json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
    return {k: type(v)(found.get(k, v)) for k, v in {"eps": 4.0, "min_samples": 3, "time_scale": 15e6}.items()}


def write_particles(hits: DataFrame, parts: DataFrame, path: str) -> None:
    """Labelled hits by source, ordered by particle with noise last, and the particle table; both committed by the engine's writer."""
    order = [F.when(F.col("label") < 0, 1).otherwise(0), "label", "fine", "hit_id"]
    hits.repartition("source").sortWithinPartitions("source", *order).write.mode("overwrite").partitionBy("source").parquet(f"{path}/hits")
    parts.write.mode("overwrite").parquet(f"{path}/particles")


def read_particle(spark: SparkSession, path: str, source: int, label: int) -> DataFrame:
    """Hits of one particle, by partition and row-group pruning."""
    return spark.read.parquet(f"{path}/hits").where((F.col("source") == source) & (F.col("label") == label))


def top_folder(path) -> T.StringType:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(".")
