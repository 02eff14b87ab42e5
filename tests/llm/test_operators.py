"""The operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tallystone.llm import bpe, html_text, line_dedup, packing, quality_grades, quality_rules, shared, similar, simhash, suffix_dedup, topk, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    # names that operators use inside
    for name in ("fp", "kept_id", "component_id", "n_words", "_score", "civility_score", "text_digest", "_kept", "other0", "bucket", "top", "n_chars"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 12, 40, 90, 200)]
    rows = [(i, base[i % 5]) for i in range(12)]
    rows += [(20 + i, base[3].replace("mu", "nu", i % 3) + " tail") for i in range(8)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "word"), (44, "Word"), (None, base[2]), (50, "é" * 60), (51, "x" + "é" * 60), (52, "ab" * 300), (53, "ab" * 300 + "c")]
    rows += [(60, prose(rng, 4000)), (61, prose(rng, 30)), (61, prose(rng, 30))]
    return rows


def components(ids, fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(i)
    return {i: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for i in g}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, corpus):
    got = simhash.near_duplicates(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    fps = [plain_fingerprint(t) for _, t in corpus]
    want = components([i for i, _ in corpus], fps, 3)
    expected = collections.Counter((i, f"{fps[k]:016x}", want[k]) for k, (i, _) in enumerate(corpus))
    assert collections.Counter(map(tuple, got)) == expected


@pytest.mark.parametrize("group", [2, 5, 2048])
def test_simhash_links_split_groups(spark, group):
    """A dense cluster whose keys are split at every level, and pairs at each distance."""
    rng = random.Random(group)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(15):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, group)
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    roots = {r["node"]: r["root"] for r in shared.connected_components(edges).collect()}
    want = components(signed, fps, 3)
    assert {s: want[i] for i, s in enumerate(signed)} == {s: roots.get(s, s) for s in signed}


def test_simhash_keeps_first(spark, corpus):
    docs = documents(spark, corpus)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[5] == 0 and ids[None] == 1


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (x, y))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pipeline_drops_near_copies(spark):
    """Planted copies of similarity 0.8 to 0.9, close ones below it, chains and a large group, against brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(40):
        w = [word() for _ in range(rng.choice((60, 150, 250, 600)))]
        rows.append(" ".join(w))
        for share in (0.005, 0.015, 0.02, 0.03, 0.05):
            x = list(w)
            for i in rng.sample(range(len(x)), max(1, round(share * len(x)))):
                x[i] = word()
            rows.append(" ".join(x))
    chain = [word() for _ in range(120)]
    rows += [" ".join(chain[i : i + 60]) for i in range(0, 60, 4)]  # each like the next, first and last share nothing
    template = [word() for _ in range(50)]
    rows += [" ".join([*template, *(word() for _ in range(n))]) for n in (2,) * 30 + (14,) * 30]
    rows += ["Same  words\there", "same words here", "same words", "", None, " ", rows[0]]
    rng.shuffle(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j, s) for i in range(len(rows)) for j in range(i) if (s := jaccard(rows[i], rows[j])) >= 0.8]
    assert sum(s < 0.9 for _, _, s in pairs) > 50
    for i, j, _ in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    import corpus_pipeline

    kept = corpus_pipeline.near_copies(spark, documents(spark, list(enumerate(rows))), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(rows))})


@pytest.mark.parametrize("block", [similar.BLOCK, 4000])
def test_similar_links_a_family_in_blocks(spark, block):
    """Copies changed so much that some pairs are similar and others just not, among documents that share a passage only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for _ in range(70):
        w = list(base)
        for i in rng.sample(range(len(w)), rng.randint(1, 6)):
            w[i] = word()
        rows.append(" ".join(w))
    rows += [" ".join([*base[:100], *(word() for _ in range(60))]) for _ in range(40)]
    texts = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").select(F.xxhash64("text").alias("digest"), "text")
    made = texts.select("digest", "digest", "text").toDF("doc_id", "digest", "text").mapInArrow(similar._nodes(5), "doc_id long, digest long, node long, keys array<bigint>, size long").drop("doc_id")
    edges = similar.links(made, texts, block=block)
    roots = {r["node"]: r["root"] for r in shared.connected_components(edges).collect()}
    nodes = {r["text"]: r["node"] for r in made.join(texts, "digest").collect()}
    got = collections.defaultdict(set)
    for t, n in nodes.items():
        got[roots.get(n, n)].add(t)
    root = {t: t for t in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(rows):
        for y in rows[:i]:
            if jaccard(x, y) >= 0.8:
                root[find(x)] = find(y)
    want = collections.defaultdict(set)
    for t in nodes:
        want[find(t)].add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 1 < len(want) < 105


def test_similar_keeps_rows_without_ids(spark, corpus):
    docs = documents(spark, corpus)
    kept = similar.keep_first(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[5] == 0 and ids[None] == 1
    assert similar.keep_first(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_of_a_chain_and_a_star(spark, one_task):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)] + [(500, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in shared.connected_components(spark.createDataFrame(chain + star, "a long, b long"), one_task=one_task).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}


def test_topk(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(700, 12)).astype(np.float32)
    m[50:60] = m[40]  # ties
    rows = [(int(i), [float(x) for x in v], 5) for i, v in enumerate(m)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 11, 1), (1002, [float("nan")] * 12, 1), (1003, [float("inf")] * 12, 1), (None, [0.5] * 12, 1), (1100, [1.0, 2.0], 0), (1200, [3.0, -1.0], 0), (1300, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    for blocks, group in ((64, 9000), (4096, topk.GROUP_BYTES)):
        got = topk.search(table, table.where("vec_id % 100 = 0"), block_rows=blocks, query_rows=3, group_bytes=group).collect()
        q = np.floor(1024 * m.astype(float)).astype(int)
        want = set()
        for i in range(0, 700, 100):
            s = q @ q[i]
            best = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:10]
            want |= {(i, r, int(j), int(s[j])) for r, j in enumerate(best, 1)}
        score = 3 * 1024 * 1024 - 2 * 1024 * 1024
        want |= {(1100, 1, 1200, score), (1200, 1, 1100, score)}
        assert {tuple(r) for r in got} == want
    assert topk.search(table.limit(0), table.limit(0)).count() == 0


def test_topk_reads_no_more_than_it_must():
    """Skewed vectors: reading stops early, and the answer is that of brute force, ties and huge components included."""
    rng = np.random.default_rng(2)
    m = np.floor(1024 * rng.exponential(size=(3000, 6)) ** 3).astype(np.int64)
    lists = topk.Lists(np.arange(3000), m)
    looked = []
    partition = np.partition
    for q in (np.array([3, 0, 5, 1, 2, 9]), np.array([-1, 2, -3, 4, 0, 1]), np.zeros(6, np.int64)):
        looked.clear()
        np.partition = lambda *a: looked.append(1) or partition(*a)
        try:
            got = sorted(lists.best(q, 7, 10, -np.inf), key=lambda x: (-x[0], x[1]))[:10]
        finally:
            np.partition = partition
        s = m @ q
        assert got == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(3000), -s)) if i != 7][:10]
        if q.max() > 8:
            assert len(looked) < len(topk.LOOKS)
    big = np.full((30, 6), 1 << 40)
    big[3] += 1
    assert sorted(topk.Lists(np.arange(30), big).best(np.full(6, 1 << 19), -1, 2, -np.inf))[-1] == (6 * ((1 << 40) + 1) * (1 << 19), 3)


@pytest.mark.parametrize("rows", [15, 200])
def test_topk_is_exact_for_many_dimensions(rows):
    """Single products are exact as doubles, their sums aren't."""
    rng = np.random.default_rng(4)
    m, q = rng.integers((1 << 22) - 9, 1 << 22, (rows, 4096)), rng.integers((1 << 22) - 9, 1 << 22, 4096)
    lists = topk.Lists(np.arange(rows), m)
    want = [sum(int(a) * int(b) for a, b in zip(v, q)) for v in m]
    assert not lists.exact(q) and lists.scores(np.arange(rows), q) == want
    best = sorted(lists.best(q, -1, 10, -np.inf), key=lambda x: (-x[0], x[1]))[:10]
    assert best == sorted(((s, i) for i, s in enumerate(want)), key=lambda x: (-x[0], x[1]))[:10]
    assert lists.exact(np.ones(4096, np.int64))


@pytest.fixture(scope="module")
def encoders():
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(encoders):
    mine, library = encoders
    mine.check()
    rng = random.Random(5)
    parts = ["a", "b", " ", "\n", "  ", "\t", "é", "ß", "😀", "1", "23", "'s", "'ll", "!", "..", "\x1c", "\x85", "᠎", "\r\n", "ing", "tion", "　", "中文", " the", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3001, "the" * 2001, " " * 3000, "é" * 2000, "-=" * 1500] + ["".join(rng.choice("etionthsa") for _ in range(2000)) for _ in range(30)]
    for t in texts:
        ids = np.frombuffer(mine.encode(t), "<u4")
        assert ids.tolist() == library.encode_ordinary(t)
        assert bpe.joined(mine.tokens, ids) == t.encode()


def test_bpe_joins_any_cut(encoders):
    mine, _ = encoders
    rng = random.Random(6)
    for _ in range(300):
        piece = "".join(rng.choice("thetionaé ") for _ in range(rng.randint(2, 90))).encode()
        cut = rng.randint(0, len(piece))
        assert mine.join(mine.merge(piece[:cut]), mine.merge(piece[cut:])) == mine.merge(piece)


def test_bpe_tables(spark, corpus, encoders):
    coded = {(r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(documents(spark, corpus))).collect()}
    assert coded == {(i, len(encoders[1].encode_ordinary(t or "")), (t or "").encode()) for i, t in corpus}
    assert coded == {(r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in bpe.round_trip(documents(spark, corpus)).collect()}
    assert bpe.encode(documents(spark, []).limit(0)).count() == 0


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    covered = {k for i in range(n - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, corpus):
    rows = corpus + [(70, "a b c d e f a b c d e g " * 3 + "| # x"), (71, "same line\nsame line\n \n\nother\nsame line"), (72, "\x0bx\x0cy\rz"), (73, "😀 é " * 12)]
    got = quality_rules.judge(documents(spark, rows)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter((r["doc_id"], *(r[f] for f in fields)) for r in got) == collections.Counter((i, *counts(t)) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1
    assert quality_rules.judge(documents(spark, []).limit(0)).count() == 0


def test_quality_learns_kinds_of_junk(spark):
    rng = random.Random(9)
    clean = [(i, ". ".join(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(9)) for _ in range(8))) for i in range(300)]
    symbols = [(1000 + i, " ".join(rng.choice(WORDS) + rng.choice(WORDS) + "###" for _ in range(60))) for i in range(30)]
    capitals = [(2000 + i, " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)).upper()) for i in range(30)]
    docs = documents(spark, clean + symbols + capitals)
    kept = quality_rules.keep_good(docs)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    assert len(ids & set(range(300))) >= 297 and len([i for i in ids if i >= 1000]) <= 2


def plain_posterior(patterns, n_rules, rounds):
    """The label model by plain loops over (votes, count)."""
    p = [quality_rules.START[min(2, sum(v == 0 for v in votes))] for votes, _ in patterns]
    for _ in range(rounds):
        classes = []
        for w in (p, [1 - x for x in p]):
            size = sum(x * n for x, (_, n) in zip(w, patterns))
            rates = [[(sum(x * n for x, (votes, n) in zip(w, patterns) if votes[k] == v) + 0.1) / (size + 0.3) for v in range(3)] for k in range(n_rules)]
            classes.append((size + 0.1, rates))
        p = []
        for votes, _ in patterns:
            good, bad = (size * np.prod([rates[k][v] for k, v in enumerate(votes)]) for size, rates in classes)
            p.append(good / (good + bad))
    return p


def test_quality_label_model(spark):
    """Against plain loops; a rule that errs is overruled, abstentions alone don't reject."""
    rng = random.Random(4)
    counts = collections.Counter()
    for i in range(4000):
        bad = i % 10 == 0
        votes = [(0 if rng.random() < 0.6 else 1 if rng.random() < 0.5 else 2) if bad else (0 if rng.random() < 0.005 else 1 if rng.random() < 0.1 else 2) for _ in range(5)]
        votes.append(0 if rng.random() < 0.2 else 2)  # votes without regard to the text
        counts[tuple(votes)] += 1
    patterns = sorted(counts.items())
    rows = [([v + 3 * k for k, v in enumerate(votes)] + [18], n) for votes, n in patterns]
    table = spark.createDataFrame(rows, "votes array<int>, n long")
    model = quality_rules.fit(table, 6, 8)
    got = {tuple(s % 3 for s in r["votes"][:6]): r["p"] for r in table.select("votes", quality_rules._posterior(model).alias("p")).collect()}
    want = plain_posterior(patterns, 6, 8)
    assert all(abs(got[v] - p) < 1e-9 for (v, _), p in zip(patterns, want))
    odds = lambda votes: sum(model[1][3 * k + v] - model[0][3 * k + v] for k, v in enumerate(votes)) + model[1][18] - model[0][18]
    assert odds([2, 2, 2, 2, 2, 0]) < 0  # kept: only the rule that errs votes bad
    assert odds([1, 1, 2, 2, 2, 0]) < 0  # kept: two abstain, and its weak vote
    assert odds([0, 0, 1, 2, 2, 2]) > 0  # rejected: two good rules agree


def test_quality_verdicts_differ_from_all_must_pass(spark, sf):
    judged = quality_rules.judge(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"))
    against = F.greatest(*(quality_rules.vote(r) == quality_rules.BAD for r in quality_rules.RULES))
    overruled = judged.where(against & F.col("kept"))
    assert overruled.count() > 0 and overruled.where("n_words < 20").count() == overruled.count()


def test_packing_is_optimal(spark, corpus):
    rng = random.Random(2)
    for _ in range(20):
        tops = sorted(rng.sample(range(1, 2000), rng.randint(1, 11)))
        n = [rng.randint(1, 9) for _ in tops]
        k = rng.randint(1, 4)

        def cost(ends):
            return sum(c * next(e for e in ends if e >= t) for t, c in zip(tops, n))

        import itertools

        best = min(cost([*c, tops[-1]]) for r in range(min(k, len(tops))) for c in itertools.combinations(tops[:-1], r))
        got = packing.boundaries(tops, n, k)
        assert len(got) <= k and got[-1] == tops[-1] and cost(got) == best
    rows = packing.pack(documents(spark, corpus * 7), budget=300, buckets=4).collect()
    assert len(rows) == 7 * len(corpus)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in rows) == collections.Counter((i, len((t or "").split())) for i, t in corpus * 7)
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r["bucket"], r["batch"]].append(r)
        assert r["n_tokens"] <= r["bucket_len"]
    last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
    for (b, n), members in batches.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert len(members) * members[0]["bucket_len"] <= 300 or len(members) == 1
        assert n == last[b] or len(members) == members[0]["batch_size"]
    assert packing.pack(documents(spark, []).limit(0)).count() == 0


def repeats(rows, length):
    first = {}
    rank = lambda i: (i is None, i)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s not in first or rank(i) < rank(first[s]):
                first[s] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if rank(first[b[k : k + length]]) < rank(i):
                gone[k : k + length] = [True] * length
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))))
    return collections.Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 900, "bucket_bytes": 400, "hot": 3}])
def test_suffix_dedup(spark, corpus, sizes):
    got = suffix_dedup.remove_repeats(documents(spark, corpus), **sizes).collect()
    for r in got:
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"])
    assert collections.Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got) == repeats(corpus, 50)


def test_suffix_dedup_texts(spark, corpus):
    docs = documents(spark, corpus)
    done = suffix_dedup.without_repeats(docs)
    assert done.columns == docs.columns and dict(done.dtypes) == dict(docs.dtypes)
    rows = {r["doc_id"]: r for r in done.collect()}
    assert rows[51]["text"] == "x" and rows[50]["text"] == "é" * 60 and rows[53]["text"] == "c" and rows[40]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) and r["other0"] == 1 for r in rows.values())
    assert suffix_dedup.remove_repeats(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 3, 12, 50])
def test_transform_and_common_prefixes(length):
    """Order, transform and common-prefix values against sorted suffixes."""
    rng = np.random.default_rng(length)
    texts = [bytes(rng.choice([0, 97, 98, 255], n).astype(np.uint8)) for n in (1, 2, 7, 30, 80, 80)]
    texts += [texts[4][:60] + b"zz", texts[5], b"a" * 70, b"ab" * 40, b"b", b"b"]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    made = suffix_dedup.Transform(data, sizes, length)
    symbols = [[*(x + 1 for x in t), 0] for t in texts]
    flat = [x for t in symbols for x in t]
    suffix = {}
    at = 0
    for t in symbols:
        suffix |= {at + i: t[i:] for i in range(len(t))}
        at += len(t)
    cut = lambda row: suffix[int(made.order[row])][:length]
    n = len(flat)
    assert sorted(made.order.tolist()) == list(range(n))
    assert [cut(r) for r in range(n)] == sorted(s[:length] for s in suffix.values())
    assert made.before.tolist() == [flat[p - 1] for p in made.order]
    assert made.down[made.up].tolist() == list(range(n))
    want = []
    for r in range(n):
        x, y = (cut(r - 1), cut(r)) if r else ([], [])
        same = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        want.append(length if r and x == y else same)
    got = made.common_prefixes(length).tolist()
    inner = [r for r in range(1, n) if cut(r)[0] != suffix_dedup.END]  # ends of texts have no order among each other
    assert [got[r] for r in inner] == [want[r] for r in inner]


def test_least_ranks():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab"), 70)).encode() for _ in range(30)]
    texts += [t[:60] + b"zzzz" for t in texts[:10]] + [texts[0], b"a" * 400, b"a" * 60, b"ab" * 99]
    ranks = rng.permutation(len(texts))
    best = {}
    for t, r in zip(texts, ranks):
        for k in range(len(t) - 49):
            best[t[k : k + 50]] = min(best.get(t[k : k + 50], 99), r)
    got = suffix_dedup.least_ranks(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), ranks, 50)
    assert got.tolist() == [best[t[k : k + 50]] for t in texts for k in range(len(t) - 49)]


def test_toxicity_learns_from_documents_alone(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        sentences = [prose(rng, 8) for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at] + " " + rng.choice(["grmpf", "blorx"]) + " " + prose(rng, 3)
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, None if i == 3 else 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, " .\n"), (903, "123 456")]
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs.drop("_score"), model).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i]["_score"] >= 0.3) == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert got[900]["_score"] == got[901]["_score"] == got[903]["_score"] == 0
    for i in held:
        if i % 5 == 0 and got[i]["_score"] >= 0.3:
            assert any(("grmpf" in rows[i][1][s["start"] : s["end"]]) or ("blorx" in rows[i][1][s["start"] : s["end"]]) for s in got[i]["_spans"])
    civil = toxicity.keep_civil(docs, model)
    assert civil.columns == docs.columns and civil.where("doc_id >= 900").count() == 4
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(toxicity.fit(docs, empty)) == 4 * (toxicity.SLOTS + 1)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, a long sentence about cookies that nobody reads at all.</div>
<div id=wrap><article><h1>Head &amp; line</h1><p>First <b>bold</b>   paragraph with <a href=x>a link</a>, long enough
to be text.<p>Second&nbsp;paragraph&#8230; &lt;not a tag&gt;.<br>After the break.<ul><li>item one<li>item two</ul>
<aside>Related</aside><div class="ad-box">Buy!</div><form><p>Mail</p><input></form><section class="comments"><p>Nice post, I really liked it!</p></section></article>
<div class=sidebar><ul><li><a href=1>s1</a><li><a href=2>s2</a></ul></div></div><footer>&copy; 2024 <p>Terms</p></footer></body></html>"""


def test_training_skips_only_what_does_not_fit(monkeypatch):
    import pyarrow as pa

    texts = ["x" * 50, "ab", None, "y" * 20, "é" * 4, "z" * 40]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2]), pa.array([i, i + 1])], ["text", "label"]) for i in (0, 2, 4)]
    assert shared.fitting(iter(batches), 30) == (["ab", "", "y" * 20, "é" * 4], [1, 2, 3, 4])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 30)
    monkeypatch.setattr(toxicity, "train", lambda t, y: np.array([len(t)], np.float32))
    [out] = toxicity._trained(iter(batches))
    assert np.frombuffer(out.column(0)[0].as_py(), np.float32).tolist() == [4]


def test_html():
    assert html_text.main_text(PAGE) == "\n".join(
        ["Head & line", "First bold paragraph with a link, long enough to be text.", "Second paragraph… <not a tag>.", "After the break.", "item one", "item two"]
    )
    assert html_text.main_text("") == html_text.main_text("<nav>x</nav><script>y</script>") == html_text.main_text("   ") == ""
    assert html_text.main_text("just text &amp;amp;") == "just text &amp;"
    assert html_text.main_text("<p>a<b>c<p>d</b>e") == "ac\nde"
    assert len(html_text.main_text("<p>" + "x <i>y</i> " * 50_000)) == 4 * 50_000 - 1


def test_html_finds_the_body_without_article_tags():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(20)) + "</ul>"
    paragraphs = "".join(f"<p>This is sentence number {i} of a text that goes on for quite a while.</p>" for i in range(6))
    text = html_text.main_text(f"<body><div>{menu}</div><div><div>{paragraphs}</div></div><div>{menu}</div></body>")
    assert text.split("\n") == [f"This is sentence number {i} of a text that goes on for quite a while." for i in range(6)]


def sentences(n, start=0):
    return "".join(f"<p>This is sentence number {i} of a text that goes on for quite a while.</p>" for i in range(start, start + n))


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="layout has-sidebar"><article>{}</article></div></body>',
        '<body><div class="site no-comments"><div>{}</div></div></body>',
        '<body class="with-cookie-notice"><nav>x</nav><div id="page-container"><div class="main-content">{}</div><div class="sidebar"><p>More of this and that, which nobody needs to read here at all.</p></div></div></body>',
        '<body><div class="modal">{}</div></body>',
        '<body><div class="overlay promo"><div>{}</div></div><footer>f</footer></body>',
        '<body><div>{}</div><div id="comments"><p>' + "</p><p>".join(["I read this with joy and can only agree with all that it says, thank you!"] * 12) + "</p></div></body>",
        '<body><main><article>{}<section class="postComments"><p>Nice post, I liked it a lot, really.</p></section></article></main></body>',
        '<body><div><div class="ad-box"><p>Buy this now, it is the best that you can buy anywhere these days, really!</p></div><div>{}</div></div></body>',
        '<body><div><div>{}</div><div class="related links"><ul><li><a href=1>Something else</a></li><li><a href=2>More</a></li></ul></div></div></body>',
    ],
)
def test_html_names_only_lower_scores(page):
    assert html_text.main_text(page.format(sentences(6))).split("\n") == [f"This is sentence number {i} of a text that goes on for quite a while." for i in range(6)]


def test_html_keeps_named_paragraphs_and_headings():
    inner = sentences(2) + '<p class="notice-para">This paragraph of the article has a name that sounds like a notice.</p>' + sentences(2, 2)
    assert "sounds like a notice" in html_text.main_text(f"<body><article>{inner}</article></body>")
    assert "sounds like a notice" in html_text.main_text(f"<body><div>{inner}</div></body>")
    text = html_text.main_text(f"<body><div class=post><h1>The heading</h1><div>{sentences(5)}</div></div><div><a href=/>Home</a> <a href=/a>A</a></div></body>")
    assert text.startswith("The heading\nThis is sentence number 0") and text.endswith("while.")


def test_html_densities(spark):
    """Characters, tags, densities and sums of small trees against a plain recursion."""
    import math

    rng = random.Random(3)

    def build(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.6:
                tag = rng.choice(("div", "section", "span", "a", "b"))
                parts.append((tag, build(depth - 1)))
            else:
                parts.append("x" * rng.randint(1, 40))
        return parts

    def markup(parts):
        return "".join(p if isinstance(p, str) else f"<{p[0]}>{markup(p[1])}</{p[0]}>" for p in parts)

    def plain(tag, parts, share, out):
        kids = [plain(p[0], p[1], share, out) if not isinstance(p, str) else (len(p), 0, 0, 0, None, False) for p in parts]
        chars, tags = sum(k[0] for k in kids), sum(k[1] + (k[4] is not None) for k in kids)
        linked, links = (chars, 1) if tag == "a" else (sum(k[2] for k in kids), sum(k[3] for k in kids))
        ratio = max(chars / max(linked, 1) * max(tags, 1) / max(links, 1), 1.0)
        base = math.log(chars * linked / max(chars - linked, 1) + share * chars + math.e)
        density = chars / max(tags, 1) * math.log(ratio) / math.log(max(base, math.e)) if chars else 0.0
        out.append((tag, chars, tags, round(density, 6), round(sum(k[4] for k in kids if k[5]), 6)))
        return chars, tags, linked, links, density, tag in html_text.BLOCK or any(k[5] for k in kids)

    for _ in range(40):
        parts = build(4)
        order = html_text._measure(html_text.parse(f"<body>{markup(parts)}</body>"))
        body = next(n for n in order if n.tag == "body")
        want = []
        plain("body", parts, body.link_chars / body.chars, want)
        got = [(n.tag, n.chars, n.tags, round(n.density, 6), round(n.total, 6)) for n in order if n is not order[0]]
        assert sorted(got) == sorted(want)


def test_html_pages(spark, sf):
    """All pages against a regular expression for their articles, with and without the tag that says where the article is."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    table = spark.createDataFrame(
        [(r["page_id"], r["url"], r["html"], "x") for r in rows]
        + [(10**6 + r["page_id"], r["url"], r["html"].replace("<article>", "<div>").replace("</article>", "</div>"), "x") for r in rows]
        + [(None, None, None, "x"), (7000, "u", "", "x")],
        "page_id long, url string, html string, text string",
    )
    got = {r["page_id"]: r for r in html_text.extract(table).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article))
        assert got[r["page_id"]]["text"] == got[10**6 + r["page_id"]]["text"] == "\n".join(p for p in parts if p)
    assert got[None]["text"] == got[7000]["text"] == "" and got[7000]["n_chars"] == 0
    assert html_text.extract(table.limit(0)).count() == 0


def test_digest_columns(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op3_byte_bpe(spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]]).hexdigest()


def test_line_dedup(spark):
    a, b = "the first line of some length, surely", "another line that is long enough to count"
    rows = [(2, f"{a}\n{b}\nshort\nshort"), (1, f"x\n{a.upper()}"), (3, f"{b}  \n\n{b}"), (None, a), (4, None), (5, ""), (6, a), (6, a), (7, f"  {b}\n")]
    docs = documents(spark, rows).withColumn("removed", F.lit(9))
    done = line_dedup.without_repeated_lines(docs)
    assert done.columns == [*docs.columns, "removed_"]
    got = collections.Counter((r["doc_id"], r["text"], tuple(map(tuple, r["removed_"]))) for r in done.collect())
    n, m = len(a), len(b)
    assert got == collections.Counter(
        [(2, f"{b}\nshort\nshort", ((0, n),)), (1, f"x\n{a.upper()}", ()), (3, "", ((0, m + 2), (m + 4, 2 * m + 4))), (None, "", ((0, n),)), (4, "", ()), (5, "", ()), (6, "", ((0, n),)), (6, "", ((0, n),)), (7, "", ((0, m + 2),))]
    )
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_sentences(spark):
    """Random documents of repeated sentences, against a plain loop over ranked units."""
    rng = random.Random(12)
    pool = [prose(rng, rng.randint(3, 9)) + rng.choice(". ! ?".split()) for _ in range(30)] + ["Hm.", "3.5", "", "Tab.\tBehind it there is still something."]
    rows = []
    for i in range(60):
        lines = [rng.choice(("", " ", "  ")).join(rng.choice(pool) + rng.choice((" ", "")) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines)))
    seen, want = set(), {}
    for i, text in rows:
        kept, spans, start = [], [], 0
        for line in text.split("\n"):
            cut = [x for x in re.split(r"(?<=[.!?][ \t])", line)]
            norms = [" ".join(x.lower().split()) for x in ([line, *cut] if len(cut) > 1 else [line])]
            gone = []
            for x in norms:
                gone.append(len(x) >= 30 and x in seen)
                seen.add(x)
            if gone[0]:
                spans.append((start, start + len(line)))
            else:
                at, stay = start, []
                for x, g in zip(cut, gone[1:] if len(cut) > 1 else [False]):
                    if g:
                        spans.append((at, at + len(x)))
                    else:
                        stay.append(x)
                    at += len(x)
                if "".join(stay) or len(cut) == 1:
                    kept.append("".join(stay))
            start += len(line) + 1
        want[i] = ("\n".join(kept), tuple(spans))
    done = line_dedup.without_repeated_lines(documents(spark, rows))
    assert {r["doc_id"]: (r["text"], tuple(map(tuple, r["removed"]))) for r in done.collect()} == want
    assert sum(bool(s) for _, s in want.values()) > 30


def test_line_dedup_of_many_lines_is_linear(spark):
    line = "this line is long enough to be counted"
    docs = documents(spark, [(1, "\n".join([line] * 50_000)), (2, "\n".join(f"{line} {i}" for i in range(50_000)) + "\n" + line)])
    got = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[1]["text"] == line and len(got[1]["removed"]) == 49_999
    assert len(got[2]["removed"]) == 1 and got[2]["text"].endswith(" 49999")


def test_quality_grades_gradient_and_scores(spark, monkeypatch):
    """The gradient against finite differences; scores and tails against a plain loop over the words."""
    import math

    monkeypatch.setattr(quality_grades, "SLOTS", 64)
    rng = np.random.default_rng(5)
    texts = ["Good words, here!", "bad*** ### bad", "a a a\na a a", "", "Mixed CASE 12 words", "x"]
    d = quality_grades._Sample(texts, [2, 0, 0, 1, 2, 1])
    p = rng.normal(size=64 + quality_grades.EXTRA + 2) / 3
    _, g = quality_grades._loss(p, d, 2)
    for i in range(len(p)):
        step = np.zeros_like(p)
        step[i] = 1e-5
        assert g[i] == pytest.approx((quality_grades._loss(p + step, d, 2)[0] - quality_grades._loss(p - step, d, 2)[0]) / 2e-5, rel=1e-4, abs=1e-7)
    monkeypatch.undo()
    p = np.concatenate((rng.normal(size=quality_grades.SLOTS), rng.normal(size=quality_grades.EXTRA), [-0.5, 0.7])).astype(np.float32)
    long = "word and more! " * 40_000
    rows = [(i, t) for i, t in enumerate([*texts, long])] + [(0, texts[0]), (None, texts[1]), (9, None)]
    got = collections.Counter((r["doc_id"], *(round(x, 5) for x in r["tails"])) for r in quality_grades.score(documents(spark, rows), p.tobytes()).collect())

    def plain(text):
        words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
        z = sum(float(p[s]) for w in words for s in quality_grades.slots_of(w)) / max(len(words), 1)
        n = len(words)
        whole = [len(set(words)) / n, len(set(lines)) / len(lines), math.log1p(n) / 10, 0.0] if n else [0.0, 0.0, 0.0, 1.0]
        z += sum(x * float(w) for x, w in zip(whole, p[quality_grades.SLOTS :]))
        return tuple(round(1 / (1 + math.exp(float(c) - z)), 5) for c in p[-2:])

    assert got == collections.Counter((i, *plain(t)) for i, t in rows)


def test_toxicity_scores_are_the_noisy_or(spark):
    """Scores and spans against a plain loop over sentences and word features; very long, repeated and empty texts."""
    import math

    rng = np.random.default_rng(6)
    model = np.concatenate((rng.normal(size=toxicity.SLOTS) / 3, [-2.0])).astype(np.float32)
    texts = ["One sentence here. Another stupid one! A third", "", ". . .", "12 34", "Ünïcode wörds\nin lines", "moderately longish words. " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[4]), (8, None)]
    got = toxicity.score(documents(spark, rows).drop("_score"), model.tobytes()).collect()

    def plain(text):
        clean, spans = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = re.findall(r"[^\W\d_]+", sentence.lower())
            if words:
                z = sum(float(model[f]) for w in words for f in toxicity.features_of(w)) - 2.0
                p = 1 / (1 + math.exp(-min(max(z, -60), 60)))
                clean *= 1 - p
                spans += p >= toxicity.THRESHOLD
        return round(1 - clean, 6), spans

    assert collections.Counter((r["doc_id"], round(r["_score"], 6), len(r["_spans"])) for r in got) == collections.Counter((i, *plain(t)) for i, t in rows)
    nothing = documents(spark, []).limit(0).drop("_score")
    assert toxicity.score(nothing, model.tobytes()).count() == 0 and quality_grades.score(nothing, np.zeros(quality_grades.SLOTS + quality_grades.EXTRA + 2, np.float32).tobytes()).count() == 0


def test_quality_grades(spark):
    rng = random.Random(4)
    rows, ratings = [], []
    for i in range(500):
        grade = i % 3
        words = [rng.choice(WORDS) + ("***" if grade == 0 or grade == 1 and rng.random() < 0.4 else "") for _ in range(30)]
        rows.append((i, " ".join(words)))
        ratings.append((i, None if i == 6 else grade))
    rows += [(900, None), (901, ""), (902, " \n")]
    docs = documents(spark, rows)
    model = quality_grades.fit(docs, spark.createDataFrame(ratings + [(None, 1), (7777, 2)], "doc_id long, grade int"), 2)
    got = {r["doc_id"]: r for r in quality_grades.score(docs, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(round(got[i]["expected_grade"]) == i % 3 for i in held) >= 0.9 * len(held)
    for r in got.values():
        assert 1 >= r["tails"][0] >= r["tails"][1] >= 0 and abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9
    assert {900, 901, 902} <= set(got)
    empty = spark.createDataFrame([], "doc_id long, grade int")
    assert {r["expected_grade"] for r in quality_grades.score(docs, quality_grades.fit(docs, empty, 2)).limit(3).collect()} == {1.0}


def test_pipeline_against_plain_stages(spark, sf):
    """``run()`` on the smallest tables against plain loops for each stage: rules, noisy-or, near copies, repeats, buckets."""
    import math

    import regex

    import corpus_pipeline

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    # quality rules
    seen = {}
    for i, text in docs:
        n, chars, symbols, dups, repeats_ = counts(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = dict(n_words=n, word_chars=chars, n_symbols=symbols, n_dup_lines=dups, n_repeat_words=repeats_, n_distinct=len(set(words)), n_marks=len(re.findall("[.!?]", text)))
        f |= dict(n_lines=sum(bool(x.strip(quality_rules.BLANKS)) for x in text.split("\n")), n_letters=len(regex.findall(r"\p{L}", text)), n_capitals=len(regex.findall(r"\p{Lu}", text)))
        votes = tuple(0 if eval(r.bad, {}, f) else 2 if eval(r.good, {}, f) else 1 for r in quality_rules.RULES)
        seen[i] = votes, n < 10 or 100 * repeats_ > 20 * n
    patterns = sorted(collections.Counter(v for v, _ in seen.values()).items())
    posterior = dict(zip((v for v, _ in patterns), plain_posterior(patterns, len(quality_rules.RULES), quality_rules.ROUNDS)))
    docs = [(i, t) for i, t in docs if not seen[i][1] and posterior[seen[i][0]] >= 0.5]
    assert len(docs) < len(seen)
    # toxicity
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    model = np.frombuffer(toxicity.fit(table("documents"), table("labels")), np.float32)

    def toxic(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text):
            if words := re.findall(r"[^\W\d_]+", sentence.lower()):
                z = sum(float(model[k]) for w in words for k in toxicity.features_of(w)) + float(model[-1])
                clean *= 1 - 1 / (1 + math.exp(-min(max(z, -60), 60)))
        return 1 - clean

    docs = sorted((i, t) for i, t in docs if toxic(t) < toxicity.THRESHOLD)
    # near copies: the smallest id of each component of similarity 0.8
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(docs):
        for j, y in docs[:n]:
            if 0.7 < (len(x) + 9) / (len(y) + 9) < 1.5 and jaccard(x, y) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = [(i, t) for i, t in docs if find(i) == i]
    # repeats, in whole characters
    first = {}
    for i, t in docs:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    lengths = {}
    for i, t in docs:
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        kept, at = [], 0
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        lengths[i] = len(re.findall(r"[^\x20\x09-\x0D]+", "".join(kept)))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == lengths
    tops = collections.Counter(max(1, n) for n in lengths.values())
    ends = packing.boundaries(sorted(tops), [tops[x] for x in sorted(tops)])
    for i, r in got.items():
        assert r["bucket_len"] == next(e for e in ends if e >= lengths[i]) and r["bucket"] == ends.index(r["bucket_len"])


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty tables, null ids and texts, and clashing columns go through all stages."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars int"
    rng = random.Random(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    good = ". ".join(prose(rng, 8) for _ in range(12))
    for name, rows in (("none", []), ("some", [(None, None, None, None, None), (None, good, "en", "s", 5), (1, good, "en", "s", 5), (2, "", None, None, 0)])):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame(rows, kind).withColumn("kept_id", F.lit(1)).withColumn("row", F.lit("x"))
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.limit(len(rows)).write.parquet(f"{folder}/labels.parquet")
        for stage in (corpus_pipeline.quality, corpus_pipeline.civility, corpus_pipeline.near_copies, corpus_pipeline.passages):
            assert stage(spark, docs, folder).columns == docs.columns
        assert corpus_pipeline.run(spark, folder).count() <= len(rows)


LINES = [f"This is sentence number {i} of a text that goes on for quite a while." for i in range(9)]
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>"
FOOT = "<footer><p>© 2024 Somebody. All rights reserved.</p></footer>"


def told(a, b):
    return "".join(f"<p>{x}</p>" for x in LINES[a:b])


def sectioned(name, tag="section"):
    return f"<body>{MENU}<article><h1>The title</h1><{tag} id=intro><h2>One</h2>{told(0, 3)}</{tag}><{tag} id={name}><h2>Two</h2>{told(3, 6)}</{tag}><{tag} id=rest><h2>Three</h2>{told(6, 9)}</{tag}></article>{FOOT}</body>"


SECTIONS = ["The title", "One", *LINES[:3], "Two", *LINES[3:6], "Three", *LINES[6:]]
LINKS = "<ul><li><a href=1>first link</a></li><li><a href=2>second link</a></li></ul>"
RELATED = "<div class=related><h3>Related</h3><ul><li><a href=1>Some other story</a></li><li><a href=2>And a third one</a></li></ul></div>"


@pytest.mark.parametrize(
    "page, want",
    [
        *((sectioned(n), SECTIONS) for n in ("navigation", "advertising", "consent", "sharing", "social", "cookies")),
        (sectioned("notice", "div"), SECTIONS),
        (f"<body>{MENU}<main><header><h1>The title</h1></header>{told(0, 9)}</main>{FOOT}</body>", ["The title", *LINES]),
        (f"<body><header><h1>The title</h1></header><div>{told(0, 9)}</div>{FOOT}</body>", ["The title", *LINES]),
        (f"<body><header><a href=/><h1>Site</h1></a>{MENU}</header><article><h1>The title</h1>{told(0, 9)}</article></body>", ["The title", *LINES]),
        (f"<body>{MENU}<article>{told(0, 4)}{LINKS}{told(4, 9)}</article>{FOOT}</body>", [*LINES[:4], "first link", "second link", *LINES[4:]]),
        (f"<body>{MENU}<div><div>{told(0, 4)}{LINKS}{told(4, 9)}</div></div>{FOOT}</body>", [*LINES[:4], "first link", "second link", *LINES[4:]]),
        (f"<body>{MENU}<article>{told(0, 4)}<div class=ad>Buy one and get one for free, this week only.</div>{told(4, 9)}</article>{RELATED}</body>", LINES),
        (f"<body>{MENU}<article>{told(0, 9)}{RELATED}</article><aside><p>Aside text</p></aside></body>", LINES),
        (f"<body><div id=wrapper><div id=main><h2>The title</h2>{told(0, 9)}</div><div id=sidebar><h2>About</h2><p>Somebody writes here, now and then, about this and that.</p></div></div></body>", ["The title", *LINES]),
        (f"<body>{MENU}<table><tr><td>{LINKS}</td><td><div>{told(0, 9)}</div></td></tr></table></body>", LINES),
        (f"<body><div class=cookie-banner><p>We use cookies.</p><button>OK</button></div><main><h1>The title</h1>{told(0, 9)}</main><div id=comments><p>Nice!</p></div></body>", ["The title", *LINES]),
        (f"<body>{MENU}<main><h1>The title</h1><div class=post-content>{told(0, 9)}</div><form><p>Your mail</p></form></main></body>", ["The title", *LINES]),
    ],
)
def test_html_layouts(page, want):
    assert html_text.main_text(page).split("\n") == want


@pytest.mark.parametrize("unit", ['<a "', "<div>", "<span>", '<a ">"', "<li>", "</x><div>", "<span><hr>", "<p>", "<tr><td>", "<!--", "<a '\"", "<ul><li>", "<section id=ad>", "<a href=1>x</a>"])
def test_html_takes_time_in_proportion(unit):
    import time

    def seconds(n):
        page = unit * (n // len(unit))
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    seconds(20_000)
    assert seconds(400_000) < 12 * max(seconds(100_000), 0.02)  # sixteen times for quadratic work


def test_html_deep_stray_tags():
    page = "<span>" * 20_000 + "<hr>" * 20_000 + "</x>" * 20_000 + "<p>text</p>"
    assert html_text.main_text(page) == "text"
