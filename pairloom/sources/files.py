"""Readers and writers of the pipeline's files.  Every reader that keeps order adds a dense ``pos``."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import strip_all, without_contrast


def with_pos(df: DataFrame) -> DataFrame:
    """Rows numbered 0, 1, ... in the order they are read; only the sizes of partitions reach the driver."""
    from pyspark.sql import Window

    ids = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["count"]) for r in ids.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    rows = ids.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_id")) - 1
    return rows.withColumn("pos", (F.col("_before") + place).cast("bigint")).select(*df.columns, "pos")


def read_jsonlines(spark: SparkSession, path: str, schema: str, begin: int | None = None, count: int = -1) -> DataFrame:
    """Rows of a JSON-lines file with ``pos``; from ``begin`` on, ``count`` of them (-1: all; without ``begin`` always all)."""
    rows = with_pos(spark.read.schema(schema).json(path))
    if begin is None:
        return rows
    return rows.where((F.col("pos") >= begin) & ((F.col("pos") < begin + count) if count >= 0 else F.lit(True)))


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds a JSON list (also on one line), JSON lines, or one object, with ``pos``.

    Files named as JSON lines may hold a list.  Each line is parsed as a list or an object; if the
    file is no sequence of such lines, it is read as one document.  Unreadable lines give no row.
    """
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"array<struct<{schema}>>")
    bad = lines.where(F.trim("value") != "").where(parsed.isNull()).limit(1).count()
    rows = spark.read.schema(schema).option("multiLine", True).json(path) if bad else lines.select(F.inline(parsed))
    return with_pos(rows)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(readable rows, unreadable lines); nothing is repeated in place of a bad line."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"struct<{schema}, _corrupt_record string>")
    ok = F.col("_r._corrupt_record").isNull()
    rows = text.withColumn("_r", parsed)
    return rows.where(ok).select("_r.*").drop("_corrupt_record"), rows.where(~ok).select("value")


def write_jsonlines(rows: DataFrame, path: str) -> None:
    """JSON lines, replacing what was there."""
    rows.write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON list with an indent of four, written by the driver row after row: for small tables such as settings and summaries."""
    jvm, jsc = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(b"["))
        for k, line in enumerate(rows.toJSON().toLocalIterator()):
            text = json.dumps(json.loads(line), indent=4, ensure_ascii=False)
            out.write(bytearray(("," if k else "").encode() + ("\n" + text).replace("\n", "\n    ").encode()))
        out.write(bytearray(b"\n]\n"))
    finally:
        out.close()


def write_statistics(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables of statistics as comma-separated files with a header, one folder for each name; what was there is replaced."""
    for name, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def read_logps(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cached log-probability tables of a folder, or None if there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/*logp*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return spark.read.parquet(*[str(f.getPath()) for f in found]) if found else None


def write_logps(rows: DataFrame, folder: str, name: str, per_file: int = 5000, overwrite: bool = False, pos: str | None = None) -> None:
    """Parquet files of at most ``per_file`` rows in ``folder/name-logp.parquet``.

    A table that is there already is an error unless ``overwrite``.  With ``pos``, places from 0, each run of ``per_file`` rows goes to one folder of its own that is
    named by its number, ``shard=k``.
    """
    path = f"{folder}/{name}-logp.parquet"
    if not overwrite and find_paths(rows.sparkSession, path):
        raise ValueError(f"{path} is there already")
    if pos is None:
        rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)
        return
    sharded = rows.withColumn("shard", F.floor(F.col(pos) / per_file).cast("int"))
    sharded.repartition("shard").sortWithinPartitions("shard", pos).write.mode("overwrite").partitionBy("shard").parquet(path)


def find_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern with wildcards names, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_tsv(spark: SparkSession, path: str, n_columns: int, most_rows: int | None = 500_000) -> DataFrame:
    """(pos, source, c1, c2, ...) of a tab-separated file, cells stripped; more than ``most_rows`` rows are an error (None: no limit)."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    cells = F.split("value", "\t")
    rows = with_pos(spark.read.text(path)).select("pos", strip(F.get(cells, F.lit(0))).alias("source"), *[strip(F.get(cells, F.lit(k))).alias(f"c{k}") for k in range(1, n_columns)])
    if most_rows is not None and (n := rows.count()) > most_rows:
        raise ValueError(f"{n} rows; at most {most_rows}")
    return rows


def tsv_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows at the places of (pos), each as often as it is asked for; places beyond the file give none."""
    return wanted.select("pos").join(rows, "pos")


def rows_in_name(name: str) -> int | None:
    """N of a file name that ends with ``-N.tsv``."""
    m = re.search(r"-(\d+)\.tsv$", name)
    return int(m[1]) if m else None


def find_files(spark: SparkSession, root: str, suffix: str = "", part: str = "", pattern: str | None = None) -> list[str]:
    """Paths below ``root`` that end with ``suffix`` and contain ``part``, sorted: at any depth, or those that ``root/pattern`` names."""
    if pattern is not None:
        return [p for p in find_paths(spark, f"{root}/{pattern}") if p.endswith(suffix) and part in p]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        p = files.next().getPath().toString()
        if p.endswith(suffix) and part in p:
            out.append(p)
    return sorted(out)


def concat_shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of shard files in the order of the list, with one ``pos`` through all."""
    out = None
    for k, p in enumerate(paths):
        part = with_pos(spark.read.schema(schema).json(p)).withColumn("shard", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no shards")
    sizes = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    before = [sum(sizes.get(j, 0) for j in range(k)) for k in range(len(paths))]
    return out.withColumn("pos", F.col("pos") + F.get(F.array(*[F.lit(b) for b in before]), F.col("shard")))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the output yet: what a resumed run still has to do."""
    return rows.join(done.select(key), key, "left_anti")


def image_bytes(c: Column) -> Column:
    """Image text as bytes: more than 100 characters are base64, less a path, which gives null."""
    return F.when(F.length(c) > 100, F.unbase64(c))


def read_captions(rows: DataFrame, original: DataFrame | None = None, contrast: bool = False) -> DataFrame:
    """(question_id, image_id, question, caption) of answers whose fields have one of several names; the speaker tag goes.

    Rows of a layout that keeps its captions in a map ``imgToEval`` give one row an entry.  Rows without
    an image_id take that of ``original`` (pos, image_id) at the same ``pos``.  ``contrast`` keeps what contrast
    marks leave.  A field that no column holds is null.
    """
    if "imgToEval" in rows.columns:
        rows = rows.select(F.explode(F.map_values("imgToEval")).alias("x")).select("x.*")
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    caption = strip_all(F.replace(first("text", "answer", "caption"), F.lit("Assistant:"), F.lit("")))
    fields = {"question_id": first("question_id"), "image_id": first("image_id", "image"), "question": first("prompt", "question", "raw_question"), "caption": without_contrast(caption) if contrast else caption}
    out = rows.select(*(["pos"] if original is not None else []), *[c.alias(n) for n, c in fields.items()])
    if original is not None:
        out = out.join(original.select("pos", F.col("image_id").cast("string").alias("_original")), "pos", "left").withColumn("image_id", F.coalesce("image_id", "_original"))
    return out.select(*fields)


class Registry:
    """Named builders; a name may be given once."""

    def __init__(self):
        self.builders: dict[str, object] = {}

    def register(self, name: str, builder) -> None:
        if name in self.builders:
            raise KeyError(f"{name} is registered already")
        self.builders[name] = builder

    def __getitem__(self, name: str):
        return self.builders[name]

    def __contains__(self, name: str) -> bool:
        return name in self.builders

    def items(self):
        return self.builders.items()
