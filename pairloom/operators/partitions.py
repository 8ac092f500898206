"""Slices, repetition, shards, weighted interleaving and lookup by cumulative borders, all by arithmetic on ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.core.staging import running_sum


def slice_rows(rows: DataFrame, start: int, end: int, n: int, dialect: str = "a", pos: str = "pos") -> DataFrame:
    """Rows of [start, end) by ``pos``; n is their number.

    a: end > 0 is cut to n, -1 means n, 0 gives nothing; b: a negative end or one beyond n means n.
    """
    stop = (min(end, n) if end > 0 else n if end == -1 else end) if dialect == "a" else (n if end < 0 or end > n else end)
    return rows.where((F.col(pos) >= start) & (F.col(pos) < stop))


def repeat_rows(rows: DataFrame, times: int, start: int = 0, pos: str = "pos") -> DataFrame:
    """Each row ``times`` times, adjacent, with question_id = times * (start + place) + copy."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else rows.withColumn("copy", F.lit(0)).where(F.lit(False))
    return out.withColumn("question_id", F.lit(times) * (F.col(pos) + start) + F.col("copy"))


def chunk_of(pos: Column, n: int, k: int) -> Column:
    """Chunk of contiguous pieces of size ceil(n / k); the last chunks may be empty."""
    return F.floor(pos / F.lit(max(1, -(-n // k)))).cast("int")


def shard_of(pos: Column, n: int, w: int) -> Column:
    """Shard of w balanced contiguous ones: the first n mod w hold one row more."""
    q, r = divmod(n, w)
    cut = r * (q + 1)
    return F.when(pos < cut, F.floor(pos / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((pos - cut) / F.lit(max(q, 1)))).cast("int")


def interleave(spark, sources: list[tuple[int, int]]) -> DataFrame:
    """(pos, source, inner) of a weighted round robin over sources given as (rows, weight).

    One round takes ``weight`` rows of each source in turn; there are as many rounds as the
    longest source needs, and shorter ones start over.  Empty sources or weights of 0 or less are an error.
    """
    if not sources or any(n < 1 or w < 1 for n, w in sources):
        raise ValueError("every source needs rows and a positive whole weight")
    total = sum(w for _, w in sources)
    size = max(n // w for n, w in sources) * total
    turns = [(s, k, w, n) for s, (n, w) in enumerate(sources) for k in range(w)]
    slots = spark.createDataFrame([(o, s, k, w, n) for o, (s, k, w, n) in enumerate(turns)], "o int, source int, k int, w int, n bigint")
    rows = spark.range(size).select(F.col("id").alias("pos"), F.pmod("id", F.lit(total)).cast("int").alias("o"))
    inner = F.pmod(F.floor(F.col("pos") / total) * F.col("w") + F.col("k"), F.col("n"))
    return rows.join(F.broadcast(slots), "o").select("pos", "source", inner.alias("inner"))


def border_lookup(positions: DataFrame, sizes: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, file_no, row_no): which file of (file_no, n_rows) holds a global position; none for positions beyond all.

    Files lie one after the other by file_no; empty ones hold nothing.  Positions and files meet
    in bins as wide as the mean file, so a file is in as many bins as it is long and the bins of all
    files are at most twice their number; no bin holds more than the files that touch it.
    """
    borders = running_sum(sizes.where("n_rows > 0"), [F.col("file_no")], "n_rows", "low").withColumn("high", F.col("low") + F.col("n_rows"))
    n, total = borders.agg(F.count("*"), F.max("high")).first()
    width = max(1, -(-(total or 0) // max(1, n)))
    bins = borders.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    asked = positions.where(F.col(pos) >= 0).select(F.col(pos).alias("_p")).withColumn("bin", F.floor(F.col("_p") / width))
    return asked.join(bins, "bin").where("_p >= low and _p < high").select(F.col("_p").alias(pos), "file_no", (F.col("_p") - F.col("low")).alias("row_no"))


def repeat_then_slice(rows: DataFrame, times: int, start: int, end: int, n: int, pos: str = "pos") -> DataFrame:
    """Rows repeated ``times`` times, adjacent, with question_id = times * place + copy; then [start, end) of places, times ``times``.

    An end that is negative or beyond the rows means all; n is the number of rows.
    """
    out = repeat_rows(rows, times, 0, pos)
    stop = times * n if end < 0 or end > n else times * end
    return out.where((F.col("question_id") >= times * start) & (F.col("question_id") < stop))


def without_keys(struct: Column, fields: list[str], keys: tuple[str, ...] = ("image_id", "question", "image")) -> Column:
    """A struct of the ``fields`` that are not among ``keys``."""
    return F.struct(*[struct[f].alias(f) for f in fields if f not in keys])


def global_sample(rows: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows of all, chosen by a seeded hash of ``keys``, ties by the keys; all rows if there are fewer or n is negative."""
    return rows if n < 0 else rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def shuffle_order(rows: DataFrame, chunk: int = 5000, seed: int = 0, pos: str = "pos") -> DataFrame:
    """Rows with an ``order_key``: whole chunks in hash order, hash order inside, the incomplete chunk last."""
    n = rows.agg(F.max(pos)).first()[0]
    full = 0 if n is None else (n + 1) // chunk
    c = F.floor(F.col(pos) / chunk)
    return rows.withColumn("order_key", F.struct((c >= full).alias("tail"), F.xxhash64(F.lit(seed), c).alias("chunk"), F.xxhash64(F.lit(seed), F.col(pos)).alias("row"), F.col(pos).alias("pos")))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): the numbers of distinct rows that one side has alone; both are 0 for equal sets.  Nulls are equal to each other."""
    one, two = a.distinct().withColumn("_side", F.lit(1)), b.distinct().withColumn("_side", F.lit(2))
    sides = one.unionByName(two).groupBy(*a.columns).agg(F.sum("_side").alias("_side"))
    return sides.agg(F.count(F.when(F.col("_side") == 1, 1)).alias("only_a"), F.count(F.when(F.col("_side") == 2, 1)).alias("only_b"))
