"""Shredding and the tables rebuilt from levels, against plain loops over the records."""

import json

from pyspark.sql import functions as F

from pairloom.operators import pair_records
from pairloom.operators.shredding import assemble, leaves, shred

TYPE = "k bigint, rec struct<a:string,xs:array<struct<b:int,ys:array<string>>>,m:map<string,string>>, value string"
ROWS = [
    (1, ("p", [(1, ["u", None]), (2, []), None, (3, None)], {"q": "1"}), "clash"),
    (2, (None, [], {}), None),
    (3, None, "x"),
    (4, ("s", None, None), "x"),
    (5, ("t", [(7, ["v"] * 3)], {"q": "1", "r": None}), "x"),
    (None, ("lost", None, None), "x"),
]


def test_levels_follow_the_format(spark):
    df = spark.createDataFrame(ROWS, TYPE)
    got = {}
    for r in shred(df, "k", "rec").where("path = 'xs.ys'").orderBy("key", "seq").collect():
        got.setdefault(r["key"], []).append((r["r"], r["d"], r["v"]))
    # rec 1, xs 2, an entry 3, its struct 4, ys 5, an entry 6, its value 7
    assert got[1] == [(0, 7, "u"), (2, 6, None), (1, 5, None), (1, 3, None), (1, 4, None)]
    assert [x[0] for x in got[5]] == [0, 2, 2]
    assert got[3] == [(0, 0, None)] and len(got[2]) == len(got[4]) == 1
    assert None not in got


def test_tables_keep_their_links(spark):
    df = spark.createDataFrame(ROWS, TYPE)
    dtype = df.schema["rec"].dataType
    levels = shred(df, "k", "rec")
    ys = {(r["key"], r["n1"], r["n2"], r["value"]) for r in assemble(levels, dtype, "xs.ys").collect()}
    want = {(k, i, j, y) for k, rec, _ in ROWS if k and rec for i, x in enumerate(rec[1] or []) if x for j, y in enumerate(x[1] or [])}
    assert ys == want
    xs = {(r["key"], r["n1"], r["b"]) for r in assemble(levels, dtype, "xs").collect()}
    assert xs == {(k, i, str(x[0]) if x else None) for k, rec, _ in ROWS if k and rec for i, x in enumerate(rec[1] or [])}
    assert len(leaves(dtype)) == 5
    assert assemble(shred(df.limit(0), "k", "rec"), dtype, "xs").count() == 0


LINES = [
    {"pair_id": 1, "org_infos": {"chosen_infos": {"facts": ["A.", " ", None, "B."], "changed_facts": ["A?", "x", "y"]}, "scores": {"chosen": {"judge": {"A?": "1"}}}}},
    [{"pair_id": 2, "org_infos": {"rejected_infos": {"facts": [{"fact": "C.", "judge": {"label": 0}}, {"fact": "D.", "changed_fact": "D?"}]}, "scores": {"rejected": {"judge": [{"question": "D?", "label": 1}]}}}}],
    {"pair_id": 3, "org_infos": json.dumps({"chosen_infos": {"facts": [{"fact": "E.", "judge": "1"}]}})},
    {"pair_id": 4, "org_infos": None},
    {"pair_id": "no", "org_infos": {}},
    {"pair_id": 1, "org_infos": {"chosen_infos": {"facts": ["again"]}}},
]


def test_lines_of_all_layouts(spark):
    texts = [json.dumps(x) for x in LINES] + ['{"pair_id": 9, "org_in', "", None]
    lines = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "line_no bigint, shard string, line string")
    pairs = spark.read.parquet("/root/testdata/sf0.001/preference_pairs.parquet").limit(0)
    got = {tuple(r) for r in pair_records.fact_verdicts(pairs, lines).collect()}
    assert got == {(1, "chosen", 0, "1"), (1, "chosen", 3, "none"), (2, "rejected", 0, "0"), (2, "rejected", 1, "1"), (3, "chosen", 0, "1")}


def test_whole_small_tables(spark):
    d = "/root/testdata/sf0.01"
    pairs = spark.read.parquet(f"{d}/preference_pairs.parquet")
    got = pair_records.fact_verdicts(pairs, spark.read.parquet(f"{d}/raw_pairs.parquet").limit(0))
    want = set()
    for pid, o in {r["pair_id"]: r["org_infos"] for r in pairs.select("pair_id", "org_infos").collect()}.items():
        for side in pair_records.SIDES:
            infos, score = o and o[f"{side}_infos"], o and o["scores"] and o["scores"][side]
            asked = infos and infos["changed_facts"] or []
            for k, f in enumerate(infos and infos["facts"] or []):
                if f and f.strip():
                    want.add((pid, side, k, (score and score["judge"] or {}).get(asked[k] if k < len(asked) else None) or "none"))
    assert {tuple(r) for r in got.collect()} == want
    assert got.where(F.col("verdict").isNull()).count() == 0
