import datetime as dt
import random

from docquarry.operators.snapshots import snapshot_changes
from tests.conftest import rows

SHAPE = "s int, k string, p string, h string, u string, t timestamp, into string, sign int, field string"


def brute(data):
    best = {}
    for s, k, p, h, u, t, *_ in data:
        new = (t is not None, t or dt.datetime.min, h is not None, h or "", u is not None, u or "")
        if (s, k, p) not in best or new > best[s, k, p][0]:
            best[s, k, p] = (new, h, u)
    numbers, out = sorted({d[0] for d in data}), set()
    for a, b in zip(numbers, numbers[1:]):
        old, now = ({x[1:]: v[1:] for x, v in best.items() if x[0] == n} for n in (a, b))
        for x in old.keys() | now.keys():
            if x not in old or x not in now:
                out.add((b, *x, "added" if x not in old else "removed", ()))
            elif old[x] != now[x]:
                out.add((b, *x, "changed", tuple(f for f, i in (("h", 0), ("u", 1)) if old[x][i] != now[x][i])))
    return out


def test_matches_brute_force(spark):
    r = random.Random(3)
    data = [(r.choice([1, 2, 4]), r.choice(["a", None]), str(r.randrange(30)), r.choice(["x", "y", None]), r.choice(["1", None]), r.choice([None, *(dt.datetime(2025, 1, i) for i in (1, 2, 3))]), "c", 1, "d") for _ in range(400)]
    got = snapshot_changes(spark.createDataFrame(data, SHAPE), "s", ["k", "p"], ["h", "u"], "t").collect()
    assert {(x[0], x[1], x[2], x[3], tuple(x[4])) for x in got} == brute(data) and len(got) == len(brute(data))


def test_single_snapshot_and_empty_table(spark):
    one = [(1, "a", "p", "x", None, None, None, None, None)]
    assert rows(snapshot_changes(spark.createDataFrame(one, SHAPE), "s", ["k", "p"], ["h"], "t")) == []
    assert rows(snapshot_changes(spark.createDataFrame([], SHAPE), "s", ["k", "p"], ["h"], "t")) == []


def test_repeats_of_one_key_don_t_matter(spark):
    t = dt.datetime(2025, 1, 1)
    data = [(1, "a", "p", "x", None, t, None, None, None)] * 500 + [(2, "a", "p", "x", None, t, None, None, None)] * 300
    assert rows(snapshot_changes(spark.createDataFrame(data, SHAPE), "s", ["k", "p"], ["h"], "t")) == []
