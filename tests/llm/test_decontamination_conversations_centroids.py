"""Benchmark decontamination, conversation repair and centroid clustering against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import centroids, conversations, decontamination, oracles

CLASHING = ("digest", "window", "n_words", "item", "pos", "part", "place", "_conv", "cluster", "distance", "v", "h", "kind", "audit")


def widened(df):
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


# ---- decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_find(docs, items, window):
    out = []
    for i, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for item, t in items:
            x = plain_words(t)
            for k in range(max(1, len(x) - window + 1)) if x else ():
                part = x[k : k + window]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return out


def leaky(seed):
    rng = random.Random(seed)
    vocabulary = "the of Straße naïve l'été x86 7 harbour at dawn left ship a b c".split()
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " — ", "...", "\x00"]) for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((4, 5, 6, 9, 12, 3, 30))] + [(3, "A second text of the third ITEM"), (None, "nobody owns THESE words"), (20, None), (21, " ?! "), (22, "")]
    docs = [(k, prose(40)) for k in range(12)]
    docs += [(30 + k, prose(15) + t.upper().replace("SS", "ß").replace(" ", "  ") + prose(9)) for k, (_, t) in enumerate(items) if t]
    docs += [(60, None), (61, ""), (62, "!!"), (None, items[4][1]), (30, items[6][1]), (30, items[6][1]), (63, (prose(3000) + items[6][1]) * 3)]
    return docs, items


@pytest.mark.parametrize("portion", [decontamination.PORTION, 120])
def test_find_equals_brute_force(spark, portion):
    docs, items = leaky(5)
    got = decontamination.find(widened(spark.createDataFrame(docs, "doc_id long, text string")), widened(spark.createDataFrame(items, "item_id long, text string")), 6, portion)
    rows = got.collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in rows) == collections.Counter(plain_find(docs, items, 6))
    texts = collections.defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    some = 0
    for r in rows:  # the spans hold the hit words, and no more
        if len(texts[r["doc_id"]]) == 1:
            inside = [plain_words(texts[r["doc_id"]][0][s["start"] : s["end"]]) for s in r["spans"]]
            assert sum(map(len, inside)) == r["n_hit"] and all(inside)
            assert all(a["end"] < b["start"] for a, b in itertools.pairwise(r["spans"]))
            some += len(inside)
    assert some > 10


def test_find_on_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.find(docs, items.limit(0)).collect()] == [(1, 2, 0, [], [])]
    assert decontamination.find(docs.limit(0), items).collect() == []
    assert [tuple(r)[:3] for r in decontamination.find(docs, items).collect()] == [(1, 2, 2)]
    nothing = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in decontamination.find(nothing, items).collect()] == [(None, 0, 0, [], [])]


def test_automaton_takes_common_windows_and_words():
    automaton = decontamination.Automaton([(1, b"a a a"), (2, b"a a a"), (3, b"b")])
    n, hit, items = automaton.scan(b"a a a a c b a a" * 1)
    assert (n, hit.tolist(), items) == (8, [0, 1, 2, 3, 5], {1, 2, 3})


# ---- conversations

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    told = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        role, text = told(role), told(text)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_flags(rows):
    """Ordered rows of one conversation with their faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain_audit(flags):
    """The cheapest edits by search over (turns done, roles so far), each with its whole audit."""
    best = {("",): None}
    states = {"": (0, "")}  # roles so far, shortened to what may follow
    short = lambda roles: "" if not roles else roles[-1]

    def closed(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                following = "a" if state == "u" else "u"
                mine = (cost + 2, audit + "I")
                if following not in table or mine < table[following]:
                    table[following] = mine
        return table

    del best
    for _, role, _, fault in flags:
        table, states = closed(dict(states)), {}

        def put(state, cost, audit, states=states):
            if state not in states or (cost, audit) < states[state]:
                states[state] = (cost, audit)

        for state, (cost, audit) in table.items():
            put(state, cost + 3, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in legal:
                put(short(role[:1]), cost + extra, audit + "K")
            for to in set(legal) & set("ua"):
                put(to, cost + 2 + extra, audit + "R")
    table = closed(dict(states))
    return min(table[s] for s in ("", "a") if s in table)


def every_audit(flags, longest):
    """The cheapest edits by trying every audit up to a length."""
    best = None
    for n in range(longest + 1):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(flags):
                continue
            cost, roles, at, sound = 0, [""], 0, True
            for x in letters:
                if x == "I":
                    roles, cost = [r + y for r in roles for y in "ua"], cost + 2
                    continue
                _, role, _, fault = flags[at]
                at += 1
                if x == "D":
                    cost += 3
                    continue
                if fault in ("blank", "duplicate"):
                    sound = False
                    break
                cost += fault == "truncated"
                roles = [r + role[:1] for r in roles] if x == "K" else [r + y for r in roles for y in "ua"]
                cost += 2 * (x == "R")
            if sound and any(GRAMMAR.match(r) for r in roles):
                mine = (cost, "".join(letters))
                best = mine if best is None or mine < best else best
    return best


def plain_repaired(flags, audit):
    out, at = [], 0
    for x in audit:
        last = out[-1][0][:1] if out else ""
        given = "assistant" if last == "u" else "user"
        if x == "I":
            out.append((given, ""))
            continue
        _, role, text, _ = flags[at]
        at += 1
        if x != "D":
            out.append((role if x == "K" else given, text))
    return out


def talk(seed, n_convs=40, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n_convs), None]:
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Hello there.", "No end", "", " \n", "Is it?\t", "…", None, "wait! no", "dup.", "dup."])
            rows.append((c, rng.choice([t, t, t, t + 2, None, 0]), role, text))
    return rows


def test_repair_equals_brute_force(spark):
    rows = talk(1)
    groups = collections.defaultdict(list)
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    df = widened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for piece in (conversations.PIECE, 3, 1):
        whole, turns = conversations.repair(conversations.damaged(df), piece)
        kept = collections.defaultdict(list)
        for r in turns.orderBy("place").collect():
            kept[r["conv_id"]].append((r["role"], r["text"]))
        got = {r["conv_id"]: r for r in whole.collect()}
        assert set(got) == set(groups)
        for conv, mine in groups.items():
            flags = plain_flags(mine)
            cost, audit = plain_audit(flags)
            r = got[conv]
            assert (r["cost"], r["audit"]) == (cost, audit)
            assert kept[conv] == plain_repaired(flags, audit)
            assert GRAMMAR.match("".join(role[:1] for role, _ in kept[conv]))
            told = [t for t, *_ in flags if t is not None]
            assert r["gaps"] == (max(told) - min(told) + 1 - len(set(told)) if told else 0)
            assert [r[k] for k in ("blank", "duplicate", "truncated")] == [sum(f[3] == k for f in flags) for k in ("blank", "duplicate", "truncated")]
            assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(flags))


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_the_cheapest_audit(seed):
    rng = random.Random(seed)
    flags = [(t, rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice([None, None, "truncated", "blank"])) for t in range(rng.randint(0, 4))]
    assert plain_audit(flags) == every_audit(flags, 7)


def test_conversation_query(spark, tmp_path):
    rows = talk(2, 25, 6) + [(100, t, r, "Fine.") for t, r in enumerate(["user", "assistant"] * 700)]
    dropped = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in conversations.op12_conversations(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got[dropped] == dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"conv_id": dropped, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    groups = collections.defaultdict(list)
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    for conv, mine in groups.items():
        flags = plain_flags(mine)
        cost, audit = plain_audit(flags)
        text = "\n".join(f"{r}:{t}" for r, t in plain_repaired(flags, audit))
        assert (got[conv]["cost"], got[conv]["audit"], got[conv]["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet' where conv_id is distinct from 100")
    want = duck.sql(oracles.OP12)
    assert {tuple(r) for r in want.select(*got[dropped]).fetchall()} == {tuple(v.values()) for k, v in got.items() if k != 100}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    whole, turns = conversations.repair(none)
    assert whole.collect() == [] and turns.collect() == []
    whole, turns = conversations.repair(spark.createDataFrame([(None, None, None, None)], none.schema))
    assert [tuple(r) for r in whole.select("conv_id", "gaps", "blank", "cost", "audit").collect()] == [(None, 0, 1, 3, "D")] and turns.collect() == []


# ---- centroids


def plain_clusters(rows, clusters, rounds, dims, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    c = [list(v) for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(c)), key=lambda k: (far(v, c[k]), k))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[nearest(v)].append(v)
        for k, vs in own.items():
            c[k] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, k := nearest(v), far(v, c[k])) for i, v in kept], c


def vectors(seed, n, dims, size=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, size, (5, dims))
    rows = [(i, [float(x) for x in (middles[i % 5] + rng.normal(0, size / 3, dims)).astype(np.float32)]) for i in range(n)]
    rows += [(n, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[1][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * (dims - 1)), (n + 4, [float("nan")] * dims), (n + 5, [None] * dims), (n + 6, [float("inf")] * dims)]
    return rows


@pytest.mark.parametrize("size", [0.01, 1.0, 2e5, 1e10])
def test_clusters_equal_brute_force(spark, size):
    dims, k = 6, 4
    rows = vectors(3, 30 if size > 1e3 else 200, dims, size)
    df = widened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    if size == 1e10:  # distances beyond 64 bits
        with pytest.raises(Exception, match="Overflow|overflow|too big|too large"):
            centroids.clustered(df, k, 5, dims)[0].collect()
        return
    got, centres = centroids.clustered(df, k, 5, dims)
    want, expected = plain_clusters(rows, k, 5, dims)
    assert centres == expected
    rows = got.collect()
    assert collections.Counter((r["vec_id"], r["cluster"], r["distance"]) for r in rows) == collections.Counter(want)
    totals = collections.Counter()
    for _, c, d in want:
        totals[c] += d
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in rows} == {(c, t, sum(totals.values())) for c, t in totals.items()}


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    got, centres = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 6, 3, 2)
    want, expected = plain_clusters(rows, 6, 3, 2)
    assert centres == expected and {(r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()} == set(want)


@pytest.mark.parametrize("size", [50, 5000, 1 << 20, 1 << 26])
def test_intervals_hold_the_exact_value(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (300, 64))
    c = np.concatenate([rng.integers(-size, size, (7, 64)), x[:1] + 1, x[:1]])
    low, high = centroids.intervals(x, c)
    opened = 0
    for i in range(len(x)):
        exact = [sum(int(b) * (int(b) - 2 * int(a)) for a, b in zip(x[i], y)) for y in c]
        assert all(lo <= e <= hi for lo, e, hi in zip(low[i], exact, high[i]))
    own, opened = centroids.nearest(x, np.ones(len(x), bool), c)
    far = ((x[:, None, :] - c[None]).astype(object) ** 2).sum(axis=2)
    assert own.tolist() == [min(range(len(c)), key=lambda k: (f[k], k)) for f in far]
    assert opened < len(x) / 2  # the screening decides most


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    for some in (df, df.limit(0)):
        got, centres = centroids.clustered(some)
        assert got.collect() == [] and centres == []
    alone, centres = centroids.clustered(spark.createDataFrame([(7, [0.5] * 64)], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in alone.collect()] == [(7, 0, 0, 0, 0)] and centres == [[512] * 64]
