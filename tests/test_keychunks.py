import collections
import random

from docquarry.operators.keychunks import key_stats, number_rows
from tests.conftest import rows


def make(spark, n=4000, seed=1):
    r = random.Random(seed)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None, "c"]), r.choice([None, *map(str, range(40))]), i, "x") for i in range(n)]
    return data, spark.createDataFrame(data, "k string, v string, __key long, row_no string").repartition(5)


def test_stats_match_brute_force(spark):
    data, df = make(spark)
    for chunk in (7, 100, 10**6):
        got = {r[0]: tuple(r)[1:5] for r in key_stats(df, "k", "v", chunk_rows=chunk).collect()}
        groups = collections.defaultdict(list)
        for k, v, *_ in data:
            groups[k].append(v)
        exp = {k: (len(v), len({x for x in v if x is not None}), min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None)) for k, v in groups.items()}
        assert got == exp


def test_one_key_and_one_value_hold_everything(spark):
    df = spark.createDataFrame([("k", "v")] * 3000 + [("k", "w")], "k string, v string").repartition(7)
    assert rows(key_stats(df, "k", "v", chunk_rows=50).drop("n_chunks")) == [("k", 3001, 2, "v", "w")]
    assert max(len(x) for x in key_stats(df, "k", "v").rdd.glom().collect()) <= 1


def test_numbers_are_exact_and_chunks_equal(spark):
    data, df = make(spark)
    got = number_rows(df, "k", ["v", "__key"], chunk_rows=64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.k].append((r.row_no, r.v, r["__key"], r.chunk_no))
    for k, own in by.items():
        own.sort()
        assert [o[0] for o in own] == list(range(len(own)))
        assert [(o[1] is not None, o[1] or "", o[2]) for o in own] == sorted((v is not None, v or "", i) for key, v, i, _ in data if key == k)
        assert all(o[3] == o[0] // 64 for o in own)


def test_partitions_are_balanced(spark):
    from docquarry.operators.keychunks import _sorted_rows

    df = spark.createDataFrame([("hot", str(i % 3)) for i in range(9000)], "k string, v string")
    sizes = [len(p) for p in _sorted_rows(df, "k", ["v"]).rdd.glom().collect()]
    assert max(sizes) < 2 * 9000 / len(sizes)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert rows(key_stats(df, "k", "v")) == [] and rows(number_rows(df, "k", ["v"])) == []
