"""Objects named in captions, against the objects an image holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import bound, strip_all, word_count, word_count_single_space
from pairloom.operators.sequences import noun_objects, simple_lemmas


def merged_places(tokens: Column, pairs: dict[str, str], keep_all: bool = True) -> Column:
    """(idx, word) of the greedy merge from left to right of two tokens whose pair is known; idx is the place of the first of the two.

    A merge uses up both.  keep_all keeps other tokens; otherwise only merged pairs are returned.
    Null gives null, an empty array an empty one.  The walk yields one digit a token, whether a merge begins
    there; the words follow from the digits, so nothing grows with each step but a text of digits.
    """
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def walk(t: Column) -> Column:
        two = F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda x, y: F.element_at(table, F.concat(x, F.lit(" "), y)))
        digits = lambda m: F.aggregate(m, F.lit(""), lambda acc, x: F.concat(acc, F.when(x.isNotNull() & ~F.endswith(acc, F.lit("1")), F.lit("1")).otherwise(F.lit("0"))))

        def words(m: Column) -> Column:
            def pick(d: Column) -> Column:
                at = F.sequence(F.lit(0), F.size(t) - 1)
                word = lambda i: F.when(F.get(d, i) == "1", F.get(m, i)).when((i > 0) & (F.get(d, i - 1) == "1"), F.lit(None)).otherwise(F.get(t, i) if keep_all else F.lit(None))
                return F.filter(F.transform(at, lambda i: F.struct(i.alias("idx"), word(i).alias("word"))), lambda x: x["word"].isNotNull())

            return bound(F.split(digits(m), ""), pick)

        return bound(two, words)

    none = F.array().cast("array<struct<idx:int,word:string>>")
    return F.when(tokens.isNull(), None).when(F.size(tokens) == 0, none).otherwise(bound(tokens, walk))


def merge_bigrams(tokens: Column, pairs: dict[str, str], keep_all: bool = True) -> Column:
    """The words of ``merged_places``."""
    return F.transform(merged_places(tokens, pairs, keep_all), lambda x: x["word"])


def synonyms(lines: DataFrame, value: str = "value") -> DataFrame:
    """(word, cls) of lines of words between commas, the first of which names the class; of a word in two lines the last counts.

    Lines are told apart by ``pos``; blank lines and words give nothing.
    """
    words = F.filter(F.transform(F.split(value, ","), strip_all), lambda w: w != "")
    rows = lines.select("pos", words.alias("w")).where(F.size("w") > 0).select("pos", F.get("w", F.lit(0)).alias("cls"), F.explode("w").alias("word"))
    return rows.groupBy("word").agg(F.max_by("cls", "pos").alias("cls"))


#: Animals that come young and grown, and vehicles for passengers.
ANIMALS = ("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "animal", "cub")
VEHICLES = ("jet", "train")


def double_words(names: list[str], animals: Sequence[str] = ANIMALS, vehicles: Sequence[str] = VEHICLES) -> dict[str, str]:
    """The pairs to merge: two-word names, young and grown animals, passenger vehicles, and some fixed ones."""
    pairs = {w: w for w in names if len(w.split()) == 2} | {w: w for w in ("home plate", "train track")}
    pairs |= {f"{age} {a}": a for a in animals for age in ("baby", "adult")} | {f"passenger {v}": v for v in vehicles}
    # fixed values
    return pairs | {"bow tie": "tie", "toilet seat": "toilet", "wine glas": "wine glass"}


def known_objects(tokens: Column, classes: Column) -> Column:
    """(word, class) of the tokens in the map ``classes``, in order and with repetitions; of toilet and seat, seat goes."""
    bare = F.when(F.array_contains(tokens, "toilet") & F.array_contains(tokens, "seat"), F.filter(tokens, lambda t: t != "seat")).otherwise(tokens)
    named = F.transform(bare, lambda t: F.struct(t.alias("word"), F.element_at(classes, t).alias("cls")))
    return F.filter(named, lambda x: x["cls"].isNotNull())


def caption_objects(captions: DataFrame, classes: Column, pairs: dict[str, str], caption: str = "caption") -> DataFrame:
    """Adds ``found``: (idx, word, cls) of the known objects a caption names, in order and with repetitions.

    The caption is lowered, split into words, each reduced to its singular by rule, two-word names
    merged; of toilet and seat, seat goes.  idx is the place of the object's first word.  A null caption has none.
    """
    words = captions.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce(caption, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    merged = simple_lemmas(words, "_w", "_l").withColumn("_m", merged_places(F.col("_l"), pairs))
    has = lambda w: F.exists("_m", lambda x: x["word"] == w)
    bare = F.when(has("toilet") & has("seat"), F.filter("_m", lambda x: x["word"] != "seat")).otherwise(F.col("_m"))
    named = F.transform(bare, lambda x: F.struct(x["idx"].alias("idx"), x["word"].alias("word"), F.element_at(classes, x["word"]).alias("cls")))
    return merged.withColumn("found", F.filter(named, lambda x: x["cls"].isNotNull())).drop("_w", "_l", "_m")


def judged_objects(rows: DataFrame, caption: str, listed: str) -> DataFrame:
    """Sets the objects a judge listed to none for captions of three words or fewer, which need no judge; null captions count as empty."""
    short = F.coalesce(word_count(F.col(caption)), F.lit(0)) <= 3
    return rows.withColumn(listed, F.when(short, F.array().cast("array<string>")).otherwise(F.col(listed)))


def listed_objects(rows: DataFrame, listed: str, pairs: dict[str, str]) -> DataFrame:
    """Adds ``objs``: the distinct objects, in order, of the names a judge listed.

    A name that holds known pairs gives those; another gives its runs of nouns.  Null lists give none.
    """
    lists = rows.withColumn("_w", F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.concat(F.lit("a "), F.lower(x))))
    lemmas = noun_objects(lists, "_w", "_l")
    each = F.transform("_l", lambda x: bound(merge_bigrams(x["words"], pairs, keep_all=False), lambda two: F.when(F.size(two) > 0, two).otherwise(x["nouns"])))
    return lemmas.withColumn("objs", F.array_distinct(F.flatten(each))).drop("_w", "_l")


def class_truth(instances: DataFrame, categories: DataFrame, dim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(image_id, cls) of annotated instances: category_id to its name, the name to its class, for wanted images only.

    Instances of unknown categories, and names without a class, give no row.  The two dimension
    tables are small, but joined without a hint, so that their sizes decide.
    """
    named = instances.join(wanted.select("image_id").distinct(), "image_id", "left_semi").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("word")), "category_id")
    return named.join(dim, "word").select("image_id", "cls").distinct()


def caption_judgement(objects: Column, truth: Column, places: bool = False) -> list[Column]:
    """Of one caption: the hallucinated (word, class), their share, whether there is any, and the distinct right classes.

    ``places`` adds the places of the hallucinated words, if the objects have an idx.
    """
    wrong = F.filter(objects, lambda o: ~F.array_contains(truth, o["cls"]))
    right = F.array_distinct(F.transform(F.filter(objects, lambda o: F.array_contains(truth, o["cls"])), lambda o: o["cls"]))
    places = [] if not places else [F.transform(wrong, lambda o: o["idx"]).alias("wrong_idx")]
    return [*places, wrong.alias("wrong"), F.try_divide(F.size(wrong).cast("double"), F.size(objects)).alias("chair_i"), (F.size(wrong) > 0).cast("int").alias("chair_s"), right.alias("right")]


def truth_sets(segments: DataFrame, captions: DataFrame, image: str = "image_id", cls: str = "cls") -> DataFrame:
    """(image, truth): the classes that either source names for an image."""
    return segments.select(image, cls).unionByName(captions.select(image, cls)).where(F.col(cls).isNotNull()).groupBy(image).agg(F.array_sort(F.collect_set(cls)).alias("truth"))


def micro_averages(captions: DataFrame) -> DataFrame:
    """Corpus rates of (caption, objects, truth): by caption, by caption with objects, by object, recall and mean words; null without a base."""
    rows = captions.select("caption", "objects", "truth", *caption_judgement(F.col("objects"), F.col("truth")))
    some = (F.size("objects") > 0).cast("int")
    return rows.agg(
        F.count("*").alias("n_captions"),
        F.avg("chair_s").alias("chair_s"),
        F.try_divide(F.sum("chair_s").cast("double"), F.sum(some)).alias("chair_s_refine"),
        F.try_divide(F.sum(F.size("wrong")).cast("double"), F.sum(F.size("objects"))).alias("chair_i"),
        F.try_divide(F.sum(F.size("right")).cast("double"), F.sum(F.size("truth"))).alias("recall"),
        F.avg(word_count_single_space(F.col("caption"))).alias("avg_words"),
    )
