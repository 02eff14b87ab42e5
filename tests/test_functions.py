"""Functions and operators on small literal rows: nulls, ties, empties, touching spans."""

import difflib
import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallystone.functions import spans as sp
from tallystone.functions import statistics as st
from tallystone.functions import text as tx
from tallystone.operators import alignment, models, votes
from tallystone.operators import records as rc
from tallystone.operators import evaluation as ev
from tallystone.operators import sequences as sq
from tallystone.operators.containment import contained


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def spans(*pairs):
    return F.array(*(sp.span(F.lit(a), F.lit(b)) for a, b in pairs)) if pairs else F.array().cast(sp.KIND)


def test_published_rates(spark):
    """Rates of a small published evaluation: 14 true and 8 false positives, 13 true negatives."""
    rows = [(True, True)] * 14 + [(True, False)] * 8 + [(False, False)] * 13 + [(True, None)]
    r = ev.confusion(spark.createDataFrame(rows, "p boolean, g boolean"), F.col("p"), F.col("g"), []).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["unknown"]) == (14, 8, 0, 13, 1)
    assert [round(r[c], 3) for c in ("accuracy", "precision", "recall", "f1")] == [0.771, 0.636, 1.0, 0.778]
    for k, n, low, high in ((4, 10, 0.17, 0.69), (9, 100, 0.05, 0.16)):
        ci = value(spark, st.wilson(F.lit(k), F.lit(n)))
        assert (round(ci["lo"], 2), round(ci["hi"], 2)) == (low, high)
    assert value(spark, st.wilson(F.lit(0), F.lit(0))) is None
    assert value(spark, st.wilson(F.lit(0), F.lit(9), clamped=True))["lo"] == 0


def test_exact_tests(spark):
    rows = [(0, 0), (1, 5), (10, 10), (0, 12), (300, 400), (1200, 1300), (None, 1)]
    got = [r["p"] for r in spark.createDataFrame(rows, "b int, c int").select(st.mcnemar_exact("b", "c").alias("p")).collect()]
    for (b, c), p in zip(rows[:-1], got):
        m = b + c
        want = min(Fraction(1), 2 * sum(Fraction(math.comb(m, i), 2**m) for i in range(min(b, c) + 1)))
        assert p == pytest.approx(float(want), rel=1e-6)
    assert got[-1] is None
    assert st._mcnemar(50_000_000, 50_000_000) == 1.0 and st._mcnemar(0, 2000) == pytest.approx(2.0**-1999, rel=1e-9)
    for b, c in ((49_995_000, 50_005_000), (4_000_000, 4_002_000)):  # the normal limit with continuity
        z = (abs(b - c) - 1) / math.sqrt(b + c)
        assert st._mcnemar(b, c) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)
    for df in (1, 2, 3, 8, 9):  # the density's integral by Simpson's rule
        x, n = 5.0, 20_000
        f = lambda t: math.exp((df / 2 - 1) * math.log(t) - t / 2 - math.lgamma(df / 2) - df / 2 * math.log(2))  # noqa: B023, E731
        h = 200 / n
        whole = sum((f(x + i * h) + 4 * f(x + (i + 0.5) * h) + f(x + (i + 1) * h)) * h / 6 for i in range(n))
        assert st._chi_square_tail(x, df) == pytest.approx(whole, rel=1e-9)
    tail = [r["p"] for r in spark.createDataFrame([(3.841459, 1.0), (5.991465, 2.0), (0.0, 3.0), (40.0, 2.0), (1.0, 0.0)], "x double, k double").select(st.chi_square_tail("x", "k").alias("p")).collect()]
    assert tail[:4] == pytest.approx([0.05, 0.05, 1.0, math.exp(-20)], rel=1e-5) and tail[4] is None


def test_holm_keeps_order_and_grows(spark):
    rows = [("a", 0.01, 1), ("a", 0.04, 2), ("a", 0.03, 3), ("a", None, 4), ("b", 0.5, 1)]
    got = {(r["g"], r["i"]): r["p_holm"] for r in st.holm(spark.createDataFrame(rows, "g string, p double, i int"), "p", ["g"], ["i"]).collect()}
    assert got[("a", 1)] == pytest.approx(0.03) and got[("a", 3)] == pytest.approx(0.06) and got[("a", 2)] == pytest.approx(0.06)
    assert got[("a", 4)] is None and got[("b", 1)] == 0.5


def test_agreement_with_itself(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1), (4, None, 1)], "u int, a int, b int")
    r = st.agreement(df, "a", "b").first()
    assert (r["n"], r["kappa"], r["ac1"]) == (3, 1.0, 1.0)
    same = st.agreement(df.where("a = 1"), "a", "b").first()
    assert same["kappa"] is None
    long = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y"), (3, "x")], "u int, v string")
    assert st.krippendorff_alpha(long, "u", "v").first()["alpha"] == 1.0


def test_spans(spark):
    assert value(spark, sp.merged(spans((5, 9), (1, 3), (3, 5), (8, 12), (2, 3)))) == [(1, 3), (3, 5), (5, 12)]
    assert value(spark, sp.merged(spans())) == [] and value(spark, sp.merged(F.lit(None).cast(sp.KIND))) == []
    assert value(spark, sp.merged(sp.merged(spans((1, 6), (4, 9))))) == [(1, 9)]
    assert value(spark, sp.shared(spans((0, 4), (6, 9)), spans((2, 7)))) == 3 == value(spark, sp.shared(spans((2, 7)), spans((0, 4), (6, 9))))
    text = F.lit("a😀bc abc")
    assert value(spark, sp.place(text, F.lit(1), F.lit(3), F.lit("😀b"))) == (1, 3)
    assert value(spark, sp.place(text, F.lit(0), F.lit(2), F.lit("bc"))) == (2, 4)
    assert value(spark, sp.place(text, F.lit(0), F.lit(2), F.lit("zz"))) is None and value(spark, sp.place(text, F.lit(9), F.lit(2), F.lit(""))) is None
    assert value(spark, sp.relocate(text, F.lit("BC"), F.lit(5), F.lit(8))) == (2, 4)
    assert value(spark, sp.overlap(F.lit(3), F.lit(3), F.lit(3), F.lit(5))) and not value(spark, sp.overlap(F.lit(1), F.lit(3), F.lit(3), F.lit(5)))
    assert value(spark, sp.words(F.lit(" ab  cd "))) == [("ab", 1, 3), ("cd", 5, 7)] and value(spark, sp.words(F.lit(""))) == []
    assert value(spark, sp.marked(F.lit("abcd"), F.lit(1), F.lit(3))) == "a«bc»d"


def test_texts(spark):
    assert value(spark, tx.squeezed(F.lit(" a b \n c "))) == "a b c"
    assert value(spark, tx.unique_labels(F.array(*(F.lit(x) for x in ("a", "b", "a", "a (2)", "a"))))) == ["a", "b", "a (2)", "a (2) (2)", "a (3)"]
    assert value(spark, tx.filled("{a} {b} {c}", {"a": F.lit("{b}"), "b": F.lit(2)})) == "{b} 2 {c}"
    assert value(spark, tx.common_prefix(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d")))) == 1
    assert value(spark, tx.media_type(F.lit(bytearray(b"OggS1234")))) == "ogg"
    assert value(spark, tx.verdict(F.lit("so I say pass, no: fail"))) == "fail" and value(spark, tx.verdict(F.lit("?"))) == "error"
    got = spark.createDataFrame([("kappa mu", "alpha KAPPA MU nu"), ("kappa mux", "a kappa mu b"), ("zzz", "abc"), (None, "a")], "n string, t string").select(tx.fuzzy_place()("n", "t").alias("s")).collect()
    assert [tuple(r["s"]) if r["s"] else None for r in got] == [(6, 14), (2, 10), (None, None), (None, None)]


def test_longest_common():
    rng = random.Random(4)
    for _ in range(2000):
        needle, text = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (12, 60))
        block = difflib.SequenceMatcher(None, needle, text, autojunk=False).find_longest_match(0, len(needle), 0, len(text))
        assert tx.longest_common(needle, text) == ((block.b, block.size) if block.size else (0, 0))


def test_fuzzy_place_takes_every_document(spark, sf):
    from tallystone.plans import catalog

    got = {r["doc_id"]: (r["start"], r["end"]) for r in catalog.QUERIES["i3_fuzzy_place"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and max(len(r["text"]) for r in docs) > 400
    for r in (r for r in docs if r["text"] and len(r["text"]) <= 3000):
        needle = r["text"][5:19] + "##"
        block = difflib.SequenceMatcher(None, needle, r["text"], autojunk=False).find_longest_match(0, len(needle), 0, len(r["text"]))
        want = (block.b, block.b + block.size) if block.size >= max(4, 0.6 * len(needle)) else (None, None)
        assert got[r["doc_id"]] == want or needle.lower() in r["text"].lower()


def test_votes(spark):
    rows = [("k", 1, None, "d"), ("k", 2, True, None), ("k", 3, False, "e"), ("m", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, o int, g boolean, d string")
    got = {r["k"]: r for r in df.groupBy("k").agg(*votes.combined_gold("g", "d", "o"), votes.all_votes("g").alias("all"), votes.segment_outcome("g").alias("out")).collect()}
    assert (got["k"]["g"], got["k"]["d"], got["k"]["disagreement"], got["k"]["all"], got["k"]["out"]) == (True, None, True, False, True)
    assert (got["m"]["g"], got["m"]["disagreement"], got["m"]["all"], got["m"]["out"]) == (None, False, None, None)
    flags = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (1, 3, 6), (1, 4, 20)], "s int, o int, at int")
    kept = votes.greedy_distinct(flags, ["s"], ["o"], lambda a, b: F.abs(a["at"] - b["at"]) < 5)
    assert [r["o"] for r in kept.orderBy("o").collect()] == [1, 3, 4]


def test_sequences(spark):
    rows = [(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 4.0, 5.0), (1, 5.5, 9.0)]
    df = spark.createDataFrame(rows, "d int, s double, e double")
    got = [r["session"] for r in sq.sessions(df, ["d"], "s", "e", ["s"], 2.0).orderBy("s").collect()]
    assert got == [0, 0, 1, 1]  # a gap equal to the threshold breaks
    merged = [(r["start"], r["end"], r["parts"]) for r in sq.merge_short(df, ["d"], "s", "e", 2.0).orderBy("seg").collect()]
    assert merged == [(0.0, 5.0, 3), (5.5, 9.0, 1)]  # the shortest joins its shorter neighbour
    sizes = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([3, 3, 9, 1, 1, 1, 1])], "d int, i int, x double")
    assert [r["bin"] for r in sq.packed(sizes, ["d"], ["i"], F.col("x"), 6, 3).orderBy("i").collect()] == [0, 0, 1, 2, 2, 2, 3]
    assert [r["page"] for r in sq.paginated(sizes, ["d"], ["i"], F.col("x"), 5).orderBy("i").collect()] == [0, 0, 1, 2, 2, 2, 2]


def test_alignment():
    assert alignment.resegment("a b x c d".split(), [["a", "b"], ["c", "d"]]) == [0, 0, 0, 1, 1]
    assert alignment.resegment([], [["a"]]) == [] and alignment.resegment(["a"], []) == [0]
    import numpy as np

    s = np.array([[0.9, 0.1, 0.0], [0.0, 0.8, 0.7]])
    assert alignment.align_sentences(s) == [([0], [0]), ([1], [1, 2])]
    assert alignment.locate_quotes([["b", "c"], ["z"], ["d"]], "a b c d".split()) == [(1, 3), None, (3, 4)]


def test_contained_both_ways(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("abc ") for _ in range(120))) for i in range(30)] + [(99, None), (98, "")]
    needles = [(i, docs[i][1][5 : 5 + n]) for i, n in enumerate((3, 10, 30, 60))] + [(50, ""), (51, None), (52, docs[0][1][5:8])]
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, needle string")
    want = {(i, j, t.find(w)) for i, t in docs if t for j, w in needles if w and w in t}
    assert {tuple(r) for r in contained(d, n).collect()} == want == {tuple(r) for r in contained(d, n, shipped=0).collect()}
    # null and repeated ids keep their rows in both ways
    ids = spark.createDataFrame([(None, docs[0][1]), (7, docs[0][1]), (7, docs[0][1]), (7, docs[1][1])], "doc_id long, text string")
    rows = [sorted(map(repr, contained(ids, n, shipped=k).collect())) for k in (16_000_000, 0)]
    assert rows[0] == rows[1] and len([r for r in rows[0] if "doc_id=None" in r]) == 2


def test_model_boundary(spark):
    prompts = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "key string, prompt string")
    cache = spark.createDataFrame([("a", "old")], "key string, answer string")
    every, fresh = models.answered(prompts, cache, lambda: lambda batch: [None if p == "p3" else p.upper() for p in batch])
    assert {(r["key"], r["answer"], r["cached"]) for r in every.collect()} == {("a", "old", True), ("b", "P2", False), ("c", None, False)}
    assert [tuple(r) for r in fresh.collect()] == [("b", "P2")]
    notes = spark.createDataFrame([("s", "Bad", ["x", "Name"], "9", "e"), ("s", " ", None, None, "e"), ("t", "a", None, "2", "e"), ("s", "zz", None, "x", "e")], "system string, span string, harm_types array<string>, harmfulness string, explanation string")
    got = models.cleaned(notes, F.create_map(F.lit("s"), F.lit("a bad day")), ["Name"]).collect()
    assert [(r["reason"], r["span_start"], r["span_end"], r["types"], r["degree"]) for r in got] == [
        (None, 2, 5, ["Name"], 5), ("empty", None, None, ["Other"], None), ("system", None, None, ["Other"], 2), ("not found", None, None, ["Other"], None)
    ]


def test_sentences_and_answers(spark):
    s = tx.sentences(F.lit("One two. Three? no! Four\nfive. "))
    assert value(spark, s) == [("One two.", 0, 8), ("Three? no!", 9, 19), ("Four\nfive. ", 20, 31)]
    assert value(spark, tx.sentence_of(F.lit(12), s)) == 1 and value(spark, tx.sentence_of(F.lit(8), s)) is None
    assert value(spark, tx.sentences(F.lit(None).cast("string"))) == []
    assert value(spark, tx.rule_list(F.lit('<think>["no"]</think>```json\n["a", " b "]\n```'))) == ["a", "b"]
    assert value(spark, tx.rule_list(F.lit("first “x”, then “y”"))) == ["x", "y"]
    assert value(spark, tx.kinds(F.lit('["a", " ", "b"]'))) == ["a", "b"] and value(spark, tx.kinds(F.lit('" "'))) == ["(none)"]
    assert value(spark, tx.first_path(F.lit('{"a": {"b": "c"}}'), ["$.x", "$.a.b"])) == "c"
    assert value(spark, tx.clock(F.lit(3725.9))) == "1:02:05"
    rows = spark.createDataFrame([(["Hello", " wrold", " uh"], "Hello, world"), ([], "x"), (None, "x")], "w array<string>, e string")
    assert [r["v"] for r in rows.select(tx.retokenised("w", "e").alias("v")).collect()] == [["Hello,", " world"], [], None]


def test_best_quote(spark):
    """The quote that shares its longest part with the text, if that is enough of it."""
    rng = random.Random(6)

    def plain(text, quotes):
        best, most = None, 0
        for q in (q.strip(" ") for q in quotes if q is not None):
            block = difflib.SequenceMatcher(None, text or "", q, autojunk=False).find_longest_match(0, len(text or ""), 0, len(q))
            if q and block.size >= max(3, int(0.7 * len(q))) and block.size > most:
                best, most = q, block.size
        return best

    rows = [("The ship left the harbour at dawn", ["the harbour at dusk", "a ship"]), ("abc", ["ab", "abcd", " abc "]), (None, ["abc"]), ("abc", []), ("abc", [None, "", " "])]
    for _ in range(300):
        text = "".join(rng.choice("ab c") for _ in range(40))
        rows.append((text, ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(4)] + [text[5:15] + "zz"]))
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, q array<string>").select("i", rc.best_quote(F.col("q"), F.col("t")).alias("b")).collect()
    assert {r["i"]: r["b"] for r in got} == {i: plain(t, q) for i, (t, q) in enumerate(rows)}
    assert got[0]["b"] == "the harbour at dusk"
    told = value(spark, tx.quoted(F.lit("It has 'bad news' and \"no\" or ‘fine’ “as is” 'x'")))
    assert told == ["bad news", "no", "fine", "as is"] and value(spark, tx.quoted(F.lit(None).cast("string"))) == []


def test_statistics_of_many_rows(spark):
    """Counts whose products pass 64 bits."""
    many = 4_000_000_000
    levels = spark.range(2).select((F.col("id") == 1).alias("p"), F.col("id").cast("double").alias("s"))
    big = lambda c: F.when(c, F.lit(many)).otherwise(F.lit(0))
    count = F.count_if
    F.count_if = lambda c: F.sum(big(c))
    try:
        assert st.auc(levels, "s", "p").first()["auc"] == 1.0
    finally:
        F.count_if = count


def test_long_lists_of_spans(spark):
    """Unions and common lengths of random lists against sets of places; lists of many thousands in seconds."""
    rng = random.Random(8)

    def some(n, far, long):
        return [(a, a + rng.randint(1, long)) for a in (rng.randint(0, far) for _ in range(n))]

    rows = [(i, some(rng.choice([0, 1, 5, 127, 128, 129, 300]), rng.choice([50, 3000]), rng.choice([2, 40]), ), some(rng.choice([0, 3, 200]), 1000, 9)) for i in range(40)]
    kind = f"i int, a {sp.KIND}, b {sp.KIND}"
    got = spark.createDataFrame(rows, kind).select("i", sp.merged("a").alias("a"), sp.merged("b").alias("b"), sp.shared(sp.merged("a"), sp.merged("b")).alias("c")).collect()
    for r in got:
        for name, given in (("a", rows[r["i"]][1]), ("b", rows[r["i"]][2])):
            want = []
            for x, y in sorted(given):
                if want and x < want[-1][1]:
                    want[-1][1] = max(want[-1][1], y)
                else:
                    want.append([x, y])
            assert [list(s) for s in r[name]] == want
        places = lambda v: {p for x, y in v for p in range(x, y)}
        assert r["c"] == len(places(rows[r["i"]][1]) & places(rows[r["i"]][2]))
    many = spark.createDataFrame([(0, [(3 * k, 3 * k + 2) for k in range(20_000)], [(3 * k + 1, 3 * k + 4) for k in range(20_000)])], kind).cache()
    many.count()
    start = time.perf_counter()
    assert many.select(sp.shared(sp.merged("a"), sp.merged("b")).alias("c")).first()["c"] == 39_999
    assert time.perf_counter() - start < 8
