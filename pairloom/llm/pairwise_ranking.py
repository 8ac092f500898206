"""One global ranking of items from the outcomes of comparisons: skew-symmetric spectral ranking.

The margin of two items is the log-odds of their outcomes (half a comparison added to each side),
normalised by its precision v into weight v / (v + 1), so that pairs compared often count in full and rare ones
little.  If item i has strength s_i, the margins are s_i - s_j: a skew-symmetric matrix of rank two
whose leading singular plane holds the vector of ones and s.  The plane is found by a distributed
block Lanczos process: the sparse part of the matrix is applied to 1 and s a few times, each time by one join
and one grouped sum over the compared pairs; all vectors are written as one table, and one grouped sum gives
their products, from which the driver makes them orthonormal and finds the plane in their span.
The strength vector is the direction of the plane that agrees best with the outcomes.  What the
weights leave open (rare and absent pairs) is filled with the margins of the last result, a
rank-two matrix that is never written out, and the process is repeated until it stands still.

To the driver come only scalars: products of 2 (``steps`` + 1) vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.core.staging import drop_stage, ranked, stage


def name_key(c: Column) -> Column:
    """A name without its path, case, blanks and punctuation ('' for null)."""
    last = F.element_at(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s/]+$", ""), "/"), -1)
    return F.regexp_replace(last, r"[^\p{L}\p{N}]", "")


def pair_outcomes(reviews: DataFrame, items: DataFrame, *, key: str, a: str, b: str, score: str, item: str, name: str) -> DataFrame:
    """(i, j, n, net) for each pair i < j compared: number of comparisons, and wins of i less wins of j.

    A comparison counts once for each ``key`` (rows with a null key are dropped) if its score is
    -1, 0 or 1 and its names denote two different items; of items whose names have one key the
    least id stands for all.  Comparisons are summed by names before they meet the item table.
    """
    rows = reviews.where(F.col(key).isNotNull() & F.col(score).isin(-1, 0, 1)).select(key, name_key(F.col(a)).alias("ka"), name_key(F.col(b)).alias("kb"), F.col(score).cast("int").alias("s"))
    once = rows.dropDuplicates([key]).groupBy("ka", "kb").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    ids = items.where(F.col(item).isNotNull()).groupBy(name_key(F.col(name)).alias("k")).agg(F.min(item).alias("id")).where("k <> ''")
    pairs = once.join(ids.select(F.col("k").alias("ka"), F.col("id").alias("ia")), "ka").join(ids.select(F.col("k").alias("kb"), F.col("id").alias("ib")), "kb").where("ia <> ib")
    lower = F.col("ia") < F.col("ib")
    return pairs.groupBy(F.least("ia", "ib").alias("i"), F.greatest("ia", "ib").alias("j")).agg(F.sum("n").alias("n"), F.sum(F.when(lower, -F.col("s")).otherwise(F.col("s"))).alias("net"))


def krylov_table(edges: DataFrame, state: DataFrame, steps: int) -> DataFrame:
    """(item, d, h, u, vu), written once: u has each item's entries of 1, R 1, ..., R^steps 1, s, R s, ..., R^steps s.

    R is the sparse part of the margins, of entries w (m - (s_i - s_j)) over ``edges`` (i, j, v, w, wm); vu has
    the entries of V, of entries v, applied to all but the last power of both chains.  ``state`` is (item,
    s, d, h).  Each step is one join and one grouped sum, for both chains together, and s_i is taken out of the sums.
    """
    x = state.select("item", "s", "d", "h", F.lit(1.0).alias("a"), F.col("s").alias("b"), *[F.array(c).alias(n) for c, n in ((F.lit(1.0), "ua"), (F.col("s"), "ub"))], *[F.array().cast("array<double>").alias(n) for n in ("va", "vb")])
    for _ in range(steps):
        met = edges.join(x.select(F.col("item").alias("j"), "a", "b", F.col("s").alias("sj")), "j")
        sums = [F.sum(F.col(f) * F.col(c)).alias(f"{f}{c}_") for c in "ab" for f in ("wm", "w", "v")]
        sums += [F.sum(F.col("w") * F.col("sj") * F.col(c)).alias(f"q{c}_") for c in "ab"]
        x = x.drop("a", "b").join(met.groupBy(F.col("i").alias("item")).agg(*sums), "item", "left").fillna(0.0)
        for c in "ab":
            x = x.withColumn(c, F.col(f"wm{c}_") - F.col("s") * F.col(f"w{c}_") + F.col(f"q{c}_"))
        x = x.select("item", "s", "d", "h", "a", "b", *[F.concat(f"{t}{c}", F.array(c if t == "u" else f"v{c}_")).alias(f"{t}{c}") for t in "uv" for c in "ab"])
    return stage(x.select("item", "d", "h", F.concat("ua", "ub").alias("u"), F.concat("va", "vb").alias("vu")), "krylov")


def gram(table: DataFrame, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u' u, u' (D - V) u over all but the last powers, u' h): summed in each batch, then over batches."""
    size = 2 * (steps + 1)
    inner = [k for k in range(size) if k not in (steps, size - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size + len(inner) ** 2 + size)
        for b in batches:
            if b.num_rows:
                d, h = b.column(0).to_numpy(), b.column(1).to_numpy()
                u, vu = (np.array(b.column(k).to_pylist()) for k in (2, 3))
                total += np.concatenate([(u.T @ u).ravel(), (u[:, inner].T @ (d[:, None] * u[:, inner] - vu)).ravel(), u.T @ h])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "x"])

    got = {r["k"]: r["x"] for r in table.select("d", "h", "u", "vu").mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    flat = np.array([got.get(k, 0.0) for k in range(size * size + len(inner) ** 2 + size)])
    form = np.zeros((size, size))
    form[np.ix_(inner, inner)] = flat[size * size : -size].reshape(len(inner), -1)
    return flat[: size * size].reshape(size, size), (form + form.T) / 2, flat[-size:]


def leading_plane(products: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Two coefficient vectors over the columns of the table: the leading singular plane of R + s 1' - 1 s' in their span.

    The last power of each chain only serves to apply R to the one before.
    """
    size = len(products)
    ones, s = 0, steps + 1
    inner = [k for k in range(size) if k not in (steps, size - 1)]
    g = products[np.ix_(inner, inner)]
    moved = products[np.ix_(inner, [k + 1 for k in inner])]
    skew = moved + np.outer(products[inner, s], products[ones, inner]) - np.outer(products[inner, ones], products[s, inner])
    # columns of very different lengths are brought to one before the span is made orthonormal
    length = np.sqrt(np.maximum(np.diag(g), 1e-300))
    values, vectors = np.linalg.eigh(g / np.outer(length, length))
    kept = values > 1e-10 * values.max()
    basis = vectors[:, kept] / np.sqrt(values[kept]) / length[:, None]
    small = basis.T @ skew @ basis
    roots, plane = np.linalg.eig((small - small.T) / 2)
    y = basis @ plane[:, int(np.argmax(roots.imag))]
    out = np.zeros((2, size))
    out[0, inner], out[1, inner] = y.real, y.imag
    return out[0], out[1]


def spectral_strengths(pairs: DataFrame, *, steps: int = 2, settled: float = 1e-3, rounds: int = 500) -> DataFrame:
    """(item, strength, converged) of every item in ``pairs`` (i, j, n, net), strengths in log-odds about a mean of 0.

    The process ends when a round changes the strengths by at most ``settled`` of their length; ``converged``
    tells whether it did, or was stopped after ``rounds`` rounds.  An empty table gives an empty table.  Parts of the
    comparison graph that no comparison links are placed about the common mean.  Strengths tie where outcomes are the same.
    """
    win = (F.col("n") + F.col("net")) / 2 + 0.5
    p = win / (F.col("n") + 1)
    both = pairs.select("i", "j", F.ln(p / (1 - p)).alias("m"), (F.col("n") * p * (1 - p)).alias("v"))
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("m")).alias("m"), "v"))
    w = F.col("v") / (F.col("v") + 1)
    edges = stage(both.select("i", "j", "v", w.alias("w"), (w * F.col("m")).alias("wm"), (F.col("v") * F.col("m")).alias("vm")), "margins")
    state = edges.groupBy(F.col("i").alias("item")).agg(F.lit(0.0).alias("s"), F.sum("v").alias("d"), F.sum("vm").alias("h"))
    edges, before, converged = edges.drop("vm"), None, False
    for _ in range(rounds):
        table = krylov_table(edges, state, steps)
        products, form, fit = gram(table, steps)
        if products[0, 0] < 2:
            state, converged = table.select("item", F.lit(0.0).alias("s")), True
            break
        a, b = leading_plane(products, steps)
        # the direction of the plane whose differences fit the outcomes best: sums over pairs of v (x_i - x_j) (y_i - y_j) are x' (D - V) y
        plane = np.stack([a, b])
        new = np.linalg.lstsq(plane @ form @ plane.T, plane @ fit, rcond=1e-12)[0] @ plane
        new[0] -= new @ products[0] / products[0, 0]
        # lengths follow from the products, the strengths before being the column s
        change = new.copy()
        change[steps + 1] -= 1
        moved, length = change @ products @ change, new @ products @ new
        combined = sum((F.lit(float(x)) * F.col("u")[k] for k, x in enumerate(new) if x), F.lit(0.0))
        state = table.select("item", combined.alias("s"), "d", "h")
        if before is not None:
            drop_stage(before)
        before = table
        if moved <= settled**2 * max(length, 1e-300):
            converged = True
            break
    return state.select("item", F.col("s").alias("strength"), F.lit(converged).alias("converged"))


def ranking(reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """(model_id, strength, converged, rank_no) of every registered model that a valid comparison names.

    Equal strengths are ordered by model_id.
    """
    pairs = pair_outcomes(reviews, registry, key="review_id", a="modela", b="modelb", score="score", item="model_id", name="model_name")
    strengths = spectral_strengths(stage(pairs, "outcomes")).withColumnRenamed("item", "model_id")
    return ranked(strengths, [F.desc("strength"), F.asc("model_id")])
