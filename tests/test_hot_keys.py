"""Operators on keys that hold most rows, in many cells, against plain loops; interval joins of very different lengths."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallystone.operators import joins, ranks
from tallystone.operators import sequences as sq


@pytest.fixture
def many_cells(spark):
    """Range partitions stay apart, however small."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_rows(seed, n=600):
    """One key with most rows, a null key and small ones; many rows share a start."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 12 + ["a", "b", None])
        start = float(rng.choice([0, 5, 5, 5, rng.randint(0, 900)]))
        rows.append((key, i, start, start + rng.choice([0.0, 1.0, 3.0, 40.0]), rng.choice(["x", "y", None]), rng.choice([None, rng.random()])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, s double, e double, who string, v double").repartition(5)


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values_carry_over_cells(spark, many_cells, seed):
    rows = hot_rows(seed)
    df, order = frame(spark, rows), ["s", "i"]
    cells = ranks.celled(df, ["k"], order, {}).where("k = 'hot'").select("_cell").distinct().count()
    assert cells > 3  # the hot key, and the rows with equal starts, are dealt over cells
    want = groups(rows)
    got = {r["i"]: r for r in ranks.running(df, ["k"], order, {"n": F.lit(1).cast("long"), "t": F.col("v")}).collect()}
    peak = {r["i"]: r["x"] for r in sq.running_maximum(df, ["k"], "v", order, "x").collect()}
    low = {r["i"]: r["x"] for r in sq.suffix_minimum(df, ["k"], "v", order, "x").collect()}
    near = {r["i"]: r for r in ranks.neighbours(df, ["k"], order, "v").collect()}
    beside = {r["i"]: r for r in ranks.beside(df, ["k"], order, {"p": "v", "q": "i"}, {"z": "i"}).collect()}
    assert len(got) == len(peak) == len(low) == len(near) == len(beside) == len(rows)
    for part in want.values():
        for n, r in enumerate(part):
            i, values = r[1], [x[5] for x in part]
            assert got[i]["n"] == n and got[i]["t"] == pytest.approx(sum(x or 0 for x in values[:n]))
            assert peak[i] == max((x for x in values[: n + 1] if x is not None), default=None)
            assert low[i] == min((x for x in values[n:] if x is not None), default=None)
            assert near[i]["prior"] == next((x for x in values[n::-1] if x is not None), None)
            assert near[i]["next"] == next((x for x in values[n:] if x is not None), None)
            assert (beside[i]["p"], beside[i]["q"]) == ((values[n - 1], part[n - 1][1]) if n else (None, None))
            assert beside[i]["z"] == (part[n + 1][1] if n + 1 < len(part) else None)
    whole = {r["i"]: r["n"] for r in ranks.numbered(df, [], order).collect()}
    assert whole == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}


@pytest.mark.parametrize("speaker", [None, "who"])
def test_sessions_timeline_clusters(spark, many_cells, speaker):
    rows = hot_rows(3)
    df, order = frame(spark, rows), ["s", "i"]
    ses = {r["i"]: r for r in sq.sessions(df, ["k"], "s", "e", order, 2.0, speaker).collect()}
    tl = {r["i"]: r for r in sq.timeline(df, ["k"], "s", "e", order).collect()}
    cl = {r["i"]: r["cluster"] for r in sq.clusters(df, ["k"], "s", "e", ["i"], 1.5).collect()}
    half = {r["i"]: (r["seg_start"], r["seg_end"]) for r in sq.halfway(df, ["k"], "s", "e", order).collect()}
    back = {r["k"]: (r["n_backward"], r["n_overlap"]) for r in sq.backward_steps(df, ["k"], "s", "e", ["i"]).collect()}
    for key, part in groups(rows).items():
        session, reach, offset, cluster = -1, None, 0.0, -1
        for n, (_, i, s, e, who, _) in enumerate(part):
            last = part[n - 1] if n else None
            reason = "first" if not n else "speaker" if speaker and who != last[4] else "gap" if s - last[3] >= 2.0 else None
            session += reason is not None
            assert (ses[i]["reason"], ses[i]["session"], ses[i]["gap"]) == (reason, session, None if not n else s - last[3])
            cluster += reach is None or s > reach + 1.5
            silence = max(s - reach, 0.0) if n else 0.0
            trim = max(min(reach - s, e - s), 0.0) if n else 0.0
            assert cl[i] == cluster and (tl[i]["silence"], tl[i]["trim"]) == (silence, trim)
            assert tl[i]["offset"] == pytest.approx(offset + silence)
            offset += silence + e - s - trim
            reach = e if reach is None else max(reach, e)
            assert half[i] == ((last[3] + s) / 2 if n else s, (e + part[n + 1][2]) / 2 if n + 1 < len(part) else e)
        part = sorted(part, key=lambda r: r[1])
        pairs = list(zip(part, part[1:]))
        assert back[key] == (sum(b[2] < a[2] - 0.01 for a, b in pairs), sum(b[2] < a[3] for a, b in pairs))


def test_percentiles_of_hot_values(spark, many_cells):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 1.0, 1.0, 2.0, rng.random() * 9])) for _ in range(400)] + [("a", None), ("a", 3.0)]
    got = {r["k"]: r["p"] for r in ranks.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for key in ("hot", "a"):
        v = sorted(x for k, x in rows if k == key and x is not None)
        at = lambda s: (lambda r: v[int(r)] + (r - int(r)) * (v[min(int(r) + 1, len(v) - 1)] - v[int(r)]))(s * (len(v) - 1))  # noqa: B023, E731
        assert got[key] == pytest.approx([at(s) for s in (0.0, 0.25, 0.5, 0.9, 1.0)])


def intervals(seed, n, name):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.uniform(0, 3000), float(rng.randint(-40, 40))])
        rows.append((rng.choice(["hot"] * 5 + ["a"]), i, start, start + rng.choice([0.0, 1.0, 7.5, 300.0, 1e7, rng.expovariate(1 / 20)])))
    return [*rows, ("hot", n, None, 5.0), ("hot", n + 1, 5.0, None), ("b", n + 2, 3.0, 1.0)], f"k string, {name} long, {name}s double, {name}e double"


@pytest.mark.parametrize("closed, slack", [(False, 0.0), (False, 2.0), (True, 0.0)])
def test_overlap_pairs_of_any_lengths(spark, closed, slack):
    a, b = intervals(1, 150, "x"), intervals(2, 120, "y")
    left, right = spark.createDataFrame(*a), spark.createDataFrame(*b)
    got = joins.overlap_pairs(left, right, ["k"], ("xs", "xe"), ("ys", "ye"), 4.0, slack, closed).collect()
    want = {}
    for k, i, s, e in a[0]:
        for q, j, t, f in b[0]:
            if k == q and None not in (s, e, t, f):
                common = min(e, f) - max(s, t)
                if common >= 0 if closed else common > slack:
                    want[i, j] = common
    assert len(got) == len(want) and {(r["x"], r["y"]): r["overlap"] for r in got} == want


def test_long_intervals_make_few_rows(spark):
    """An interval of a million cells is a row for each level of the other side, not one for each cell."""
    df = spark.createDataFrame([("k", 1, 0.0, 4e6)], "k string, x long, xs double, xe double")
    cells = joins._within_cells(joins._levelled(df, "xs", "xe", 4.0).withColumn("_at", F.col("_level")), F.col("_at"), 4.0)
    assert cells.count() <= 2


def test_nearest_across_cells(spark, many_cells):
    a, b = intervals(3, 80, "x"), intervals(4, 60, "y")
    left, right = spark.createDataFrame(*a).dropna(), spark.createDataFrame(*b).dropna()
    got = {(r["k"], r["x"], r["y"]) for r in joins.overlap_or_nearest(left, right, ["k"], ("xs", "xe"), ("ys", "ye"), ["x"], "y", 4.0, least=1e6).where("nearest").collect()}
    hit = {r["x"] for r in joins.overlap_pairs(left, right, ["k"], ("xs", "xe"), ("ys", "ye"), 4.0, 1e6).collect()}
    want = set()
    for k, i, s, e in a[0]:
        if s is None or e is None or i in hit:
            continue
        near = [(abs((s + e) / 2 - (t + f) / 2), j) for q, j, t, f in b[0] if q == k and t is not None and f is not None]
        if near:
            want.add((k, i, min(near)[1]))
    assert got == want


def test_packing_a_long_key_is_linear(spark):
    df = spark.range(50_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).cast("double").alias("x"))
    start = time.perf_counter()
    bins = sq.packed(df, ["k"], ["id"], F.col("x"), 20, 9).collect()
    assert time.perf_counter() - start < 10 and len(bins) == 50_000
    group = filled = count = 0
    for r in sorted(bins, key=lambda r: r["id"]):
        if count and (count >= 9 or filled + r["x"] > 20):
            group, filled, count = group + 1, r["x"], 1
        else:
            filled, count = filled + r["x"], count + 1
        assert r["bin"] == group
