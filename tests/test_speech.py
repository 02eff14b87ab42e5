"""Incremental translation, recordings and clips, retried backends, added systems and verdict streams: faults and restarts included."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallystone.operators import models, resegmentation, systems
from tallystone.plans import alignments, speech
from tallystone.sources import audio
from tallystone.streaming import translation, verdicts

KIND = "doc string, step long, emission_time double, text string, is_final boolean"


def told(steps, rules=translation.Rules(), backend=None):
    """Lines and the final session of one key's steps."""
    stepper = translation.Stepper(translation.Session(), backend or translation.reversing(100), rules)
    lines = [stepper.step(t, f) for t, f in steps]
    return lines, stepper


def test_agreed_words_are_told_once():
    lines, stepper = told([("ab cd", False), ("ab cd ef", False), ("ab cd ef", False), ("", False), ("ab cd ef gh", True), (" ", True)])
    assert lines == [([], ["ba", "dc"]), (["ba", "dc"], ["fe"]), (["fe"], []), None, (["hg"], []), None]
    assert stepper.s.calls == 3 and stepper.s.revisions == 0  # an unchanged source isn't asked again
    assert stepper.s.contexts == [{"source": "ab cd ef gh", "target": "ba dc fe hg"}]


def test_contradicted_words_are_revisions():
    answers = iter(["x y", "x y z", "q y z"])
    lines, stepper = told([("1", False), ("1 2", False), ("1 2 3", True)], backend=lambda *_: next(answers))
    assert lines == [([], ["x", "y"]), (["x", "y"], ["z"]), (["z"], [])] and stepper.s.revisions == 1


def test_prefix_and_context_reach_the_backend():
    asked = []

    def backend(source, start, context, target):
        asked.append((source, start, context, target))
        return " ".join(w.upper() for w in source.split())

    told([("a b", False), ("a b c", False), ("a b c", True), ("d", False), ("d e", True)], backend=backend)
    # the last step of a segment whose source hasn't changed needs no call
    assert asked == [("a b", "", "", ""), ("a b c", "", "", ""), ("d", "", "a b c", "A B C"), ("d e", "", "a b c", "A B C")]
    asked.clear()
    told([("a b", False), ("a b c", False), ("a b c d", False)], backend=backend)
    assert asked[-1] == ("a b c d", "A B", "", "")


def test_budget_splits_and_drops_context():
    rules = translation.Rules(context=2, budget=8)
    lines, stepper = told([("a b c", False), ("a b c d e", False), ("a b c d e f", False), ("a b c d e f g h", True), ("i", False)], rules)
    assert lines == [([], ["a", "b", "c"]), (["a", "b", "c", "d", "e"], []), ([], ["f"]), (["f", "g", "h"], []), ([], ["i"])]
    s = stepper.s
    assert s.splits == 1 and s.without_context == 3 and [c["source"] for c in s.contexts] == ["a b c d e", "f g h"]
    assert stepper.flush() == (["i"], []) and stepper.flush() is None


def growing(seed, docs=3):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        step = 0
        for _ in range(4):
            words = [rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(rng.randint(1, 12))]
            for k in range(0, len(words), 3):
                rows.append((f"d{d}", step, float(step), " ".join(words[: k + 3]), k + 3 >= len(words)))
                step += 1
    return rows


def test_told_words_are_the_translation(spark):
    """Confirmed words of a segment, one after the other, are its translation, whatever its steps."""
    rows = growing(3)
    got = {}
    for r in translation.translated(spark.createDataFrame(rows, KIND), "doc", lambda: translation.reversing(100)).orderBy("doc", "step").collect():
        got.setdefault(r["doc"], []).extend(r["confirmed"].split())
    want = {}
    for doc, _, _, text, final in rows:
        if final:
            want.setdefault(doc, []).extend(w[::-1] for w in text.split())
    assert got == want


def test_translation_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = growing(4)
    steps = spark.createDataFrame(rows, KIND)
    rules = translation.Rules(context=1, budget=14)
    half = max(r[1] for r in rows) // 2

    def run(name, low, high):
        for i in range(low, high):
            steps.where(F.col("step") == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = translation.translated_stream(source, "doc", translation.reversing, rules)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)

    run("first", 0, half)
    before = spark.read.parquet(str(tmp_path / "out")).count()
    run("second", half, max(r[1] for r in rows) + 1)  # a new query from the checkpoint
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in translation.translated(steps, "doc", translation.reversing, rules).collect()}
    assert 0 < before < len(got) and got == want and any(r[-1] for r in want) and any(r[-2] for r in want)


def test_translated_conversations(spark, sf):
    lines = speech.r6_translated(spark, sf).collect()
    texts = {}
    for r in alignments.turns(spark, sf).orderBy("conv_id", "sentence").collect():
        texts.setdefault(r["conv_id"], []).extend(w[::-1] for w in r["text"].split())
    got = {}
    for r in sorted(lines, key=lambda r: (r["conv_id"], r["step"])):
        got.setdefault(r["conv_id"], []).extend(r["confirmed"].split())
    plain = lambda words: [w.rstrip("?") for w in words]  # noqa: E731  an uncertain last word is marked by the stand-in
    assert {c: plain(w) for c, w in got.items()} == {c: plain(w) for c, w in texts.items() if w}
    assert max(r["splits"] for r in lines) > 0 and max(r["without_context"] for r in lines) > 0


# ---- recordings


def wav(data, rate=8, channels=1, bits=8, before=b"", kind=None, size=None, tail=b""):
    kind = audio.pcm(rate, channels, bits) if kind is None else kind
    return b"RIFF\0\0\0\0WAVE" + before + b"fmt " + struct.pack("<I", len(kind)) + kind + b"data" + struct.pack("<I", len(data) if size is None else size) + data + tail


def test_headers_of_odd_files(spark, tmp_path):
    spark.dataSource.register(audio.WavFiles)
    files = {
        "plain": wav(b"x" * 10),
        "list": wav(b"x" * 9, before=b"LIST" + struct.pack("<I", 5) + b"hello\0"),
        "stereo": wav(b"x" * 11, 16000, 2, 16),
        "bogus": wav(b"x" * 7, size=0xFFFFFFFF),
        "tail": wav(b"x" * 6, tail=b"LIST\1\0\0\0z\0"),
        "not": b"RIFF....AVI ", "empty": b"", "nodata": wav(b"")[:-8], "nofmt": b"RIFF\0\0\0\0WAVEdata\1\0\0\0x", "zero": wav(b"x", rate=0),
    }
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / ("sub" if name == "list" else "") / f"{name}.wav").write_bytes(data)
    (tmp_path / "other.txt").write_text("no")
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in spark.read.format("wav").load(str(tmp_path)).collect()}
    assert set(got) == set(files)
    sound = {n: (r["rate"], r["frame_bytes"], r["frames"], r["data_at"]) for n, r in got.items() if r["error"] is None}
    assert sound == {"plain": (8, 1, 10, 44), "list": (8, 1, 9, 58), "stereo": (16000, 4, 2, 44), "bogus": (8, 1, 7, 44), "tail": (8, 1, 6, 44)}
    assert all(r["rate"] is None for r in got.values() if r["error"])


def test_header_reads_no_sound(tmp_path):
    """Only the first chunks are read, of a recording of any length."""
    import tracemalloc

    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(wav(b"", size=300_000_000))
        f.truncate(300_000_044)
    tracemalloc.start()
    assert audio.header(str(path))["frames"] == 300_000_000
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_clips_are_cut_and_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(audio.WavFiles)
    sound = bytes(range(40))
    kind = struct.pack("<HHIIHH", 3, 1, 4, 8, 2, 16)  # not PCM: two bytes a frame, four frames a second
    (tmp_path / "r.wav").write_bytes(wav(sound, kind=kind))
    source = str(tmp_path / "r.wav")
    out = tmp_path / "out"
    rows = [("a", source, 0.5, 1.5, None, None), ("b", source, -3.0, 0.25, None, None), ("c", source, 4.0, 99.0, None, None), ("d", source, 9.0, 9.5, None, None), ("e", None, None, None, bytearray(b"xyz"), bytearray(audio.pcm(8, 1, 8)))]
    spark.createDataFrame(rows, audio.CLIP).repartition(3).write.format("wav").mode("append").save(str(out))
    want = {"a": sound[4:12], "b": sound[:2], "c": sound[32:40], "d": b"", "e": b"xyz"}
    assert {p.name for p in out.iterdir()} == {f"{n}.wav" for n in want}
    for name, data in want.items():
        h = audio.header(str(out / f"{name}.wav"))
        whole = (out / f"{name}.wav").read_bytes()
        assert h["error"] is None and whole[h["data_at"] : h["data_at"] + len(data)] == data and h["frames"] * h["frame_bytes"] == len(data)
        assert struct.unpack("<I", whole[4:8])[0] == len(whole) - 8 and len(whole) % 2 == 0
        assert name == "e" or h["format"] == kind and b"fact" in whole[:60]
    bad = tmp_path / "bad"
    for broken in ([("f", source, 0.0, 1.0, None, None), ("g", str(tmp_path / "none.wav"), 0.0, 1.0, None, None)], [("x", source, 0.0, 1.0, None, None)] * 2, [("../x", source, 0.0, 1.0, None, None)]):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame(broken, audio.CLIP).repartition(2).write.format("wav").mode("append").save(str(bad))
        assert not bad.exists() or list(bad.iterdir()) == []


# ---- retried backends


def test_rounds_go_on_where_a_run_died(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def make(dies):
        def backend(number):
            def answer(prompts):
                if number == dies:
                    raise RuntimeError("lost")
                for p in prompts:
                    (log / f"{number}-{p}-{random.random()}").touch()
                return [f"{p}!" if int(p) % 4 < number else None for p in prompts]

            return answer

        return backend

    prompts = spark.createDataFrame([(str(i), str(i)) for i in range(20)], "key string, prompt string").repartition(3)
    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="lost"):
        models.in_rounds(prompts, make(2), path).collect()
    assert spark.read.parquet(path).count() == 5
    got = {r["key"]: tuple(r)[1:] for r in models.in_rounds(prompts, make(None), path).collect()}
    assert got == {str(i): ("ok", f"{i}!", max(i % 4 + 1, 1)) if i % 4 < 3 else ("ERROR", None, None) for i in range(20)}
    asked = [tuple(map(int, p.name.split("-")[:2])) for p in log.iterdir()]
    assert sorted(p for n, p in asked if n == 1) == sorted([*range(20), *(i for i in range(20) if i % 4)])  # the answers of the first run weren't asked for again
    assert sorted(p for n, p in asked if n == 3) == [i for i in range(20) if i % 4 > 1]
    assert models.in_rounds(prompts.limit(0), make(None), str(tmp_path / "no")).collect() == []


# ---- added systems

RECORD = "doc string, sentence long, beg double, end double, systems_info map<string,struct<lan:string,is_human:boolean>>, text map<string,string>, alignment map<string,string>, extra int"
WORDS = "doc string, pos long, word string, start double, end double, line long"


def add_case():
    records, words = [], []
    for d in ("a", "b", "c", "d", "e"):
        info = {"gold": ("en", True)} | ({"asr": ("en", False)} if d == "d" else {})
        for k, t in enumerate(["one two three", "four five", "six"]):
            records.append((d, k, 2.0 * k, 2.0 * k + 2, info, {"gold": t, "de": "eins"} | ({"asr": "old"} if d == "d" else {}), {"de": "x"} if d == "a" else None, k))
        if d != "e":
            for i, w in enumerate("one too three four five six seven".split()):
                words.append((d, i, None if d == "b" else f" {w} ", i * 0.9, i * 0.9 + 0.5, min(i // 3, 2)))
    words[-1] = (*words[-1][:3], None, None, words[-1][5])
    return records, words


@pytest.mark.parametrize("method", ["mwer", "time", "lines"])
def test_a_failing_document_leaves_the_others(spark, method):
    records, words = add_case()
    if method == "lines":
        words = [w for w in words if w[0] != "c" or w[5] < 2]
    if method == "time":
        words = [(*w[:3], None, None, w[5]) if w[0] == "c" and w[1] == 3 else w for w in words]
    done, errors = systems.add_system(spark.createDataFrame(records, RECORD), spark.createDataFrame(words, WORDS), "doc", "asr", "en", method)
    failed = {r["doc"]: r["error"] for r in errors.collect()}
    assert set(failed) == {"b", "d"} | ({"c"} if method != "mwer" else set()) and "no words" in failed["b"] and "already" in failed["d"]
    got = {(r["doc"], r["sentence"]): r for r in done.collect()}
    assert len(got) == len(records)
    for d, k, beg, end, info, text, alignment, extra in records:
        r = got[d, k]
        if d in failed or d == "e":
            assert (r["text"], r["alignment"], r["extra"], set(r["systems_info"])) == (text, alignment, extra, set(info))
            continue
        assert r["text"].keys() == {"gold", "de", "asr"} and r["alignment"] == (alignment or {}) | {"asr": systems.LABELS[method]} and tuple(r["systems_info"]["asr"]) == ("en", False)
    heard = [w[2].strip() for w in words if w[0] == "a"]
    at = {"mwer": resegmentation.resegment(heard, ["one two three".split(), "four five".split(), ["six"]]), "lines": [w[5] for w in words if w[0] == "a"], "time": [0, 0, 1, 1, 1, 2, 2]}[method]
    assert [got["a", k]["text"]["asr"] for k in range(3)] == [" ".join(w for w, x in zip(heard, at) if x == k) for k in range(3)]
    again, errors = systems.add_system(done, spark.createDataFrame(words, WORDS), "doc", "asr", "en", method, overwrite=True)
    assert "d" not in {r["doc"] for r in errors.collect() if "already" in r["error"]}
    assert {(r["doc"], r["sentence"]): r["text"] for r in again.collect() if r["doc"] == "a"} == {k: r["text"] for k, r in got.items() if k[0] == "a"}
    with pytest.raises(ValueError, match="none of"):
        systems.add_system(done, done, "doc", "asr", "en", "magic")


def test_added_conversations(spark, sf):
    got = {(r["conv_id"], r["sentence"]): r for r in speech.m14_added(spark, sf).collect()}
    refs, heard = {}, {}
    for r in alignments.turns(spark, sf).orderBy("conv_id", "sentence").collect():
        refs.setdefault(r["conv_id"], []).append(r["text"])
    for r in alignments.heard(spark, sf).orderBy("conv_id", "pos").collect():
        heard.setdefault(r["conv_id"], []).append(r["word"])
    import hashlib

    for conv, texts in refs.items():
        at = resegmentation.resegment(heard.get(conv, []), [t.split() for t in texts])
        for k in range(len(texts)):
            r = got[conv, k]
            if conv % 9 == 0 or conv not in heard:
                assert r["digest"] is None and (r["error"] == "no words") == (conv in heard)
            else:
                text = " ".join(w for w, x in zip(heard[conv], at) if x == k)
                assert r["digest"] == hashlib.md5(text.encode()).hexdigest() and r["alignment"] == "mwer" and r["error"] is None


# ---- verdict streams


def test_a_replayed_batch_adds_no_line(spark, tmp_path):
    rows = [("k", "t1", "r1", "pass"), ("k", "t1", "r2", None), ("m", "t2", "r1", "fail")]
    batch = spark.createDataFrame(rows, "key string, target string, rule string, verdict string")
    path = str(tmp_path / "v")
    runs = []

    def judge(df):
        runs.append(1)
        return verdicts.verdict_lines(df)

    write = verdicts.sink(path, judge)
    write(batch, 0)
    write(batch, 0)  # finished: not judged again
    write(batch.where("key = 'm'"), 1)
    assert len(runs) == 2
    lines = [(r["batch"], r["key"], json.loads(r["line"])) for r in verdicts.told(spark, path).orderBy("batch", "key", "place").collect()]
    assert lines == [
        (0, "k", {"type": "verdict", "target": "t1", "rule": "r1", "verdict": "pass"}), (0, "k", {"type": "error", "target": "t1", "rule": "r2"}), (0, "k", {"type": "done", "verdicts": 1, "errors": 1}),
        (0, "m", {"type": "verdict", "target": "t2", "rule": "r1", "verdict": "fail"}), (0, "m", {"type": "done", "verdicts": 1, "errors": 0}),
        (1, "m", {"type": "verdict", "target": "t2", "rule": "r1", "verdict": "fail"}), (1, "m", {"type": "done", "verdicts": 1, "errors": 0}),
    ]
    # a run that died between lines and ledger: nobody reads its lines, and the next run replaces them
    verdicts.verdict_lines(batch).write.parquet(f"{path}/lines/batch=2")
    assert verdicts.told(spark, path).where("batch = 2").count() == 0
    write(batch, 2)
    assert verdicts.told(spark, path).where("batch = 2").count() == 5
