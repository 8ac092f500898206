"""From scored facts to sampled and length-balanced preference pairs.

Nulls: a null score or label never wins a comparison; rows with a null key form no pair.  Empty
tables give empty results.  Operators read only the columns they name, so clashing names of other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import strip_all, word_count


def yes_label(yes: Column, yes_cap: Column, no: Column, no_cap: Column) -> Column:
    """1 if yes + Yes exceeds no + No, else 0: a tie, or any null, is 0."""
    return F.coalesce((yes + yes_cap > no + no_cap).cast("int"), F.lit(0))


def answer_scores(facts: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n_facts, score): minus the number of facts not accepted; null labels count as not accepted."""
    return facts.groupBy(key).agg(F.count("*").alias("n_facts"), (F.coalesce(F.sum(label), F.lit(0)) - F.count("*")).alias("score"))


def judge_maps(facts: DataFrame, key: str, question: str, label: str, pos: str) -> DataFrame:
    """(key, judge): question to label; of a question asked twice the last by ``pos`` counts."""
    last = facts.where(F.col(question).isNotNull()).groupBy(key, question).agg(F.max_by(label, pos).alias("_label"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(question, "_label")))).alias("judge"))


def ids_by_group(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """The distinct ids of each group, sorted; null ids don't count.  Repeated ids are dropped before a group is gathered."""
    return rows.select(*group, item).distinct().groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("ids"))


def score_pairs(rows: DataFrame, group: list[str], item: str, score: str, diff: float, part: int = 1000) -> DataFrame:
    """(group..., chosen, rejected, chosen_score, rejected_score) of two items of a group whose scores differ by ``diff`` or more.

    Items meet ordered by id; on equal scores (only if diff <= 0) the lesser id is chosen.  A group
    of more than ``part`` rows is split in parts of about so many by a hash of the id, and the left side
    repeated for each, so that a hot group spreads over tasks as it grows; the result itself is as large as the definition makes it.
    """
    r = rows.where(F.col(item).isNotNull() & F.col(score).isNotNull()).select(*group, F.col(item).alias("_i"), F.col(score).alias("_s"))
    large = r.groupBy(*group).count().where(F.col("count") > part).select(*group, F.ceil(F.col("count") / part).cast("int").alias("_parts"))
    r = r.join(large, group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = r.select(*group, F.col("_i").alias("_j"), F.col("_s").alias("_t"), F.pmod(F.xxhash64("_i"), "_parts").cast("int").alias("_salt"))
    both = left.join(right, [*group, "_salt"]).where((F.col("_i") < F.col("_j")) & (F.abs(F.col("_s") - F.col("_t")) >= diff))
    first = F.col("_s") >= F.col("_t")
    pick = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return both.select(*group, pick("_i", "_j", "chosen"), pick("_j", "_i", "rejected"), pick("_s", "_t", "chosen_score"), pick("_t", "_s", "rejected_score"))


def first_runs(rows: DataFrame, key: list[str], pos: str, per_range: int = 1_000_000) -> DataFrame:
    """Rows whose key is the one that was first seen last, in the order of ``pos`` (distinct integers).

    A key that comes back after a newer one was seen is dropped; null keys are one key.  First places are
    minima taken in part before any exchange.  The running maximum is taken in two levels, within
    ranges of ``pos`` of about ``per_range`` rows and over one maximum for each range before, so no task sees all rows.
    """
    p = F.col(pos)
    low, high, n = rows.agg(F.min(p), F.max(p), F.count("*")).first()
    if low is None:
        return rows.where(F.lit(False))
    ranges = max(64, -(-n // per_range))
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(p).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    seen = rows.join(first, same).drop(*[f"_k{i}" for i in range(len(key))])
    cut = seen.withColumn("_range", F.floor((p - F.lit(low)) * ranges / F.lit(high - low + 1)).cast("int"))
    tops = cut.groupBy("_range").agg(F.max("_first").alias("_top"))
    before = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("_range").orderBy(pos)
    last = F.greatest(F.max("_first").over(w), F.col("_before"))
    return cut.join(F.broadcast(before), "_range").withColumn("_last", last).where("_first = _last").drop("_first", "_range", "_before", "_last")


def kept_rows(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the kept ones."""
    return rows.join(kept.select(key).distinct(), key, "left_semi")


def facts_match(judge: Column, facts: Column) -> Column:
    """Whether the map has as many questions as there are facts that are not ''; false for null parts."""
    return F.coalesce(F.cardinality(judge) == F.size(F.filter(facts, lambda f: f != "")), F.lit(False))


def length_kept(chosen: Column, rejected: Column, ratio) -> Column:
    """Whether a pair stays: (rejected - chosen) / rejected words at most ``ratio``, and the texts differ.

    A rejected text without words has no ratio and is dropped, as are nulls.
    """
    c, r = word_count(chosen), word_count(rejected)
    bound = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.coalesce((F.try_divide((r - c).cast("double"), r.cast("double")) <= bound) & (strip_all(chosen) != strip_all(rejected)), F.lit(False))


def pair_lengths(pairs: DataFrame) -> DataFrame:
    """(c, r, same): words of both texts of each pair and whether they are equal after stripping."""
    return pairs.where("chosen is not null and rejected is not null").select(word_count(F.col("chosen")).alias("c"), word_count(F.col("rejected")).alias("r"), (strip_all(F.col("chosen")) == strip_all(F.col("rejected"))).alias("same"))


def pair_statistics(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs, mean words of both sides, and the shares with a shorter and a longer chosen text."""
    return lengths.groupBy(*(by or [])).agg(
        F.count("*").alias("n_pairs"),
        F.avg("c").alias("avg_win"),
        F.avg("r").alias("avg_lose"),
        F.avg((F.col("c") < F.col("r")).cast("int")).alias("p_shorter"),
        F.avg((F.col("c") > F.col("r")).cast("int")).alias("p_longer"),
    )


def balance_grid(pairs: DataFrame, steps: int = 50, step: float = 0.02, use_len: bool = True) -> DataFrame:
    """One row a ratio: statistics of the pairs it keeps, and the objective.

    Each pair is reduced to the least grid ratio that keeps it before anything is grouped, so the
    pairs are read once and only ``steps`` sums meet; the grid is never multiplied with the pairs.
    """
    d = F.try_divide((F.col("r") - F.col("c")).cast("double"), F.col("r").cast("double"))
    lengths = pair_lengths(pairs).where("not same and r > 0").withColumn("need", F.greatest(F.ceil(d / step) - 1, F.lit(0)).cast("int"))
    # the division above may be off by one at a grid point; the comparison with the point itself decides
    exact = F.array_min(F.filter(F.array(F.col("need"), F.col("need") + 1, F.col("need") + 2), lambda k: k.cast("double") * F.lit(step) >= d))
    sums = lengths.withColumn("need", exact).where(F.col("need") < steps).groupBy("need").agg(F.count("*").alias("n"), F.sum("c").alias("sc"), F.sum("r").alias("sr"), F.sum((F.col("c") < F.col("r")).cast("int")).alias("ns"), F.sum((F.col("c") > F.col("r")).cast("int")).alias("nl"))
    grid = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("step_no"))
    w = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = grid.join(F.broadcast(sums), F.col("step_no") == F.col("need"), "left").select("step_no", (F.col("step_no") * F.lit(step)).alias("ratio"), total("n").alias("n_pairs"), total("sc").alias("sc"), total("sr").alias("sr"), total("ns").alias("ns"), total("nl").alias("nl"))
    win, lose = F.try_divide(F.col("sc").cast("double"), F.col("n_pairs")), F.try_divide(F.col("sr").cast("double"), F.col("n_pairs"))
    shorter, longer = F.try_divide(F.col("ns").cast("double"), F.col("n_pairs")), F.try_divide(F.col("nl").cast("double"), F.col("n_pairs"))
    objective = F.try_divide(F.abs(win - lose), lose) if use_len else F.abs(shorter - longer)
    return rows.select("step_no", "ratio", "n_pairs", win.alias("avg_win"), lose.alias("avg_lose"), shorter.alias("p_shorter"), longer.alias("p_longer"), objective.alias("objective"))


def best_ratio(grid: DataFrame) -> DataFrame:
    """The grid row of least objective; of equal ones the lowest ratio.  Empty if no ratio keeps a pair."""
    best = grid.where("objective is not null").agg(F.min(F.struct("objective", "step_no", "ratio", "n_pairs")).alias("b"))
    return best.where("b is not null").select("b.ratio", "b.n_pairs", "b.objective")


def sample_per_group(rows: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows a group, chosen by a seeded hash of ``keys``; ties by the keys themselves.

    Groups are first thinned within 32 parts of each, so a hot group never sits in one task whole.
    """
    h = F.xxhash64(F.lit(seed), *keys)
    part = Window.partitionBy(group, "_part").orderBy("_h", *keys)
    whole = Window.partitionBy(group).orderBy("_h", *keys)
    thinned = rows.withColumn("_h", h).withColumn("_part", F.pmod("_h", F.lit(32))).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
    return thinned.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n).drop("_h", "_part", "_rn")


def yes_no_questions(answers: DataFrame, facts: str = "facts", changed: str = "changed_facts") -> DataFrame:
    """One row for each fact with its rewritten question, as far as both lists go, with both whole lists."""
    n = F.least(F.size(facts), F.size(changed))
    zipped = F.arrays_zip(F.slice(F.col(facts), F.lit(1), n).alias("fact"), F.slice(F.col(changed), F.lit(1), n).alias("changed"))
    rows = answers.where(n > 0).select("*", F.posexplode(zipped).alias("fact_no", "_z"))
    return rows.select(*answers.columns, "fact_no", F.col("_z.fact").alias("origin_fact"), F.concat(F.col("_z.changed"), F.lit(" Please answer yes or no.")).alias("question_text"))
