"""Columnar shredding of nested records, and flat tables rebuilt from the level columns.

``shred`` turns every leaf path of a nested column into a sequence of (repetition level,
definition level, value) as a columnar file format would store it.  ``assemble`` rebuilds, for one
repeated ancestor, a flat table from those sequences alone: its ordinals come from the repetition
levels and tell the parent of each row.

Both are narrow but for one exchange on the record key, which later windows and groupings reuse.
A record is one group, so the largest group is the largest record and never a key of many records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    """A leaf path: the repeated ancestors above it, outermost first, each with the definition level its elements reach."""

    path: str
    repeated: tuple[tuple[str, int], ...]
    max_def: int


def leaves(dtype: T.DataType, path: str = "", level: int = 0, repeated: tuple = ()) -> list[Leaf]:
    """All leaf paths of a type, in schema order."""
    if isinstance(dtype, T.StructType):
        return [x for f in dtype.fields for x in leaves(f.dataType, f"{path}.{f.name}" if path else f.name, level + 1, repeated)]
    if isinstance(dtype, T.ArrayType):
        return leaves(dtype.elementType, path, level + 2, (*repeated, (path, level + 2)))
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return leaves(entry, path, level + 2, (*repeated, (path, level + 2)))
    return [Leaf(path, repeated, level + 1)]


def _entries(c: Column, dtype: T.DataType, path: str, rep: Column, level: int, depth: int) -> Column:
    """The level entries of one leaf path below ``c``; ``rep`` is the level its first entry gets."""

    def stop(at: int) -> Column:
        return F.array(F.struct(rep.cast("int").alias("r"), F.lit(at).alias("d"), F.lit(None).cast("string").alias("v")))

    if isinstance(dtype, T.StructType):
        name, _, rest = path.partition(".")
        below = _entries(c[name], dtype[name].dataType, rest, rep, level + 1, depth)
        return F.when(c.isNull(), stop(level)).otherwise(below)
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return _entries(F.map_entries(c), T.ArrayType(entry), path, rep, level, depth)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x, i: _entries(x, dtype.elementType, path, F.when(i == 0, rep).otherwise(F.lit(depth + 1)), level + 2, depth + 1))
        return F.when(c.isNull(), stop(level)).when(F.size(c) == 0, stop(level + 1)).otherwise(F.flatten(items))
    return F.array(F.struct(rep.cast("int").alias("r"), F.when(c.isNull(), F.lit(level)).otherwise(F.lit(level + 1)).alias("d"), c.cast("string").alias("v")))


def shred(df: DataFrame, key: str, column: str, below: str | None = None) -> DataFrame:
    """Rows (key, path, seq, r, d, v): the level sequence of every leaf path of ``column``.

    ``below`` keeps only the leaves whose nearest repeated ancestor it names ('' for those that
    have none), so a table that is rebuilt reads just its own leaf columns.

    Keys must be distinct and not null; rows with a null key are dropped.  A null column gives one
    entry of definition level 0 for each path.  Other columns of ``df`` are ignored, whatever their
    names.  An empty table gives an empty table.
    """
    dtype = df.schema[column].dataType
    paths = [F.struct(F.lit(x.path).alias("path"), _entries(F.col(column), dtype, x.path, F.lit(0), 0, 0).alias("levels")) for x in leaves(dtype) if below is None or (x.repeated[-1][0] if x.repeated else "") == below]
    each = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*paths)).alias("leaf"))
    return each.select("key", F.col("leaf.path").alias("path"), F.posexplode("leaf.levels").alias("seq", "e")).select("key", "path", "seq", "e.r", "e.d", "e.v")


def assemble(levels: DataFrame, dtype: T.DataType, ancestor: str) -> DataFrame:
    """The flat table of one repeated ancestor: key, n1..nk (ordinals from 0) and its own leaf columns.

    n1..n(k-1) are the row's link to its parent's table.  Leaf columns are named by what follows
    the ancestor's path (``value`` if nothing does) and typed string.  Elements that are absent
    (null or empty lists) give no row; null leaves give null.
    """
    own = [x for x in leaves(dtype) if x.repeated and x.repeated[-1][0] == ancestor]
    if not own:
        raise ValueError(f"no leaf has {ancestor} as its nearest repeated ancestor")
    depth, least = len(own[0].repeated), own[0].repeated[-1][1]
    out = levels.where(F.col("path").isin([x.path for x in own]))
    ordinals: list[str] = []
    for k in range(1, depth + 1):
        w = Window.partitionBy("key", "path", *ordinals).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"n{k}", (F.sum((F.col("r") <= k).cast("int")).over(w) - 1).cast("int"))
        ordinals.append(f"n{k}")
    columns = [F.max(F.when(F.col("path") == x.path, F.col("v"))).alias(x.path[len(ancestor):].strip(".").replace(".", "_") or "value") for x in own]
    return out.where(F.col("d") >= least).groupBy("key", *ordinals).agg(*columns)
