"""Units, ratings and items of all orders against plain loops over the collected records."""

import collections

import pytest

from tallystone.operators import units as u
from tallystone.plans import units as plans


@pytest.fixture(scope="module")
def collected(spark, sf):
    return [r.asDict(recursive=True) for r in plans.records(spark, sf).orderBy("line").collect()]


def place(text, start, end, expected):
    if start is not None and end is not None and 0 <= start < end <= len(text) and (expected is None or text[start:end] == expected):
        return start, end
    at = text.find(expected) if expected else -1
    return (at, at + len(expected)) if at >= 0 else None


def outputs(record):
    """The places of each system's targets, systems in order."""
    out = {}
    for k, t in enumerate(record["targets"]):
        out.setdefault(t["system"], []).append(k)
    return out


def listed(values, n):
    return values if isinstance(values, list) and len(values) == n else [None] * n


def test_units_and_reasons(spark, sf, collected):
    found, lost, seen = set(), collections.Counter(), set()
    for r in collected:
        n = len(r["targets"])
        if r["gold"] is None or len(r["gold"]) != n:
            lost[u.NO_GOLD] += 1
            continue
        details, spans = listed(r["details"], n), listed(r["gold_spans"], n)
        for system, at in outputs(r).items():
            rated = [k for k in at if r["gold"][k] is not None]
            text = next((r["targets"][k]["text"] for k in at if r["targets"][k]["text"] is not None), None)
            raw = next((spans[k] for k in rated if spans[k]), None)
            if (r["segment"], system) in seen:
                lost[u.AGAIN] += 1
            elif not rated:
                lost[u.NULL_GOLD] += 1
            elif text is None:
                lost[u.NO_TEXT] += 1
            elif r["gold"][rated[0]] and raw is None:
                lost[u.NO_SPANS] += 1
            else:
                gold = r["gold"][rated[0]]
                human = [place(text, s["start"], s["end"], s["text"]) for s in raw] if gold else []
                lost[u.HUMAN_LOST] += human.count(None)
                human = [p for p in human if p]
                if gold and not human:
                    lost[u.NOT_LOCATED] += 1
                    continue
                llm = [place(text, t["span_start"], t["span_end"], t["span"]) for t in (r["targets"][k] for k in at) if t["span"] is not None]
                lost[u.MODEL_LOST] += llm.count(None)
                seen.add((r["segment"], system))
                kind = "harmful" if gold else "undecidable" if details[rated[0]] == "undecidable" else "no_harm"
                told = lambda ps: ",".join(f"{a}-{b}" for a, b in filter(None, ps))
                found.add((r["segment"], system, r["line"], system == "asr", kind, told(human), told(llm)))
    assert {tuple(x) for x in plans.a11_units(spark, sf).collect()} == found and len(found) > 300
    assert {x["reason"]: x["n"] for x in plans.a11_reasons(spark, sf).collect()} == {k: n for k, n in lost.items() if n}
    assert len([n for n in lost.values() if n]) == 8


def test_ratings_and_reasons(spark, sf, collected):
    found, lost = {}, collections.Counter()
    for r in collected:
        if r["by_annotator"] is None:
            lost[u.NO_ANNOTATORS] += 1
            continue
        n = len(r["targets"])
        for system, at in outputs(r).items():
            text = next((r["targets"][k]["text"] for k in at if r["targets"][k]["text"] is not None), None)
            if text is None:
                lost[u.NO_TEXT] += 1
                continue
            for user, a in r["by_annotator"].items():
                if a["gold"] is None or len(a["gold"]) != n:
                    lost[u.NOT_MATCHING] += 1
                    continue
                rated = [k for k in at if a["gold"][k] is not None]
                if not rated:
                    continue
                details, spans = listed(a["details"], n), listed(a["spans"], n)
                kind = "harmful" if a["gold"][rated[0]] else "undecidable" if details[rated[0]] == "undecidable" else "no_harm"
                where = []
                if kind == "harmful":
                    raw = next((spans[k] for k in rated if spans[k]), None)
                    if raw is None:
                        lost[u.RATING_NO_SPANS] += 1
                        where = None
                    else:
                        where = [place(text, s["start"], s["end"], s["text"]) for s in raw]
                        lost[u.MARKED_LOST] += where.count(None)
                        where = [p for p in where if p] or None
                if (r["segment"], system, user) in found:
                    lost[u.RATING_AGAIN] += 1
                    continue
                found[r["segment"], system, user] = (system == "asr", kind, None if where is None else ",".join(f"{a}-{b}" for a, b in where))
    got = {(x["segment"], x["system"], x["user"]): (x["asr"], x["kind"], x["spans"]) for x in plans.a32_ratings(spark, sf).collect()}
    assert got == found and len(found) > 500
    assert {x["reason"]: x["n"] for x in plans.a32_reasons(spark, sf).collect()} == {k: n for k, n in lost.items() if n}
    assert {u.NO_ANNOTATORS, u.NO_TEXT, u.NOT_MATCHING, u.RATING_NO_SPANS, u.MARKED_LOST, u.RATING_AGAIN} <= set(lost)
    only, _ = u.rated_units(plans.records(spark, sf), ["ben"])
    assert {(x["segment"], x["system"], x["user"]) for x in only.collect()} == {k for k in found if k[2] == "ben"}


def plain_item(r, include, most):
    name = r["asr_system"] or "asr"
    blamed = any(t["system"] == name or "asr" in (t["error_source"] or "").lower() for t in r["targets"])
    shown = {"off": False, "if_flagged": blamed, "always": True}[include]
    order = list(dict.fromkeys(t["system"] for t in r["targets"]))
    others = [s for s in order if s != name]
    kept = set(others[:most] if most else others) | {name}
    texts, spans, unlocated, differ = {}, collections.defaultdict(list), collections.Counter(), collections.Counter()
    if shown and r["asr"]:
        texts[name] = r["asr"]
    for t in r["targets"]:
        s = t["system"]
        if s not in kept or s == name and not shown:
            continue
        differ[s] += texts.setdefault(s, t["text"] or "") != (t["text"] or "")
        if t["span"] and t["span_start"] is not None:
            at = t["span_start"] if texts[s][t["span_start"] : t["span_end"]] == t["span"] else texts[s].find(t["span"])
            if at < 0:
                unlocated[s] += 1
            else:
                spans[s].append(f"{at}-{at + len(t['span']) - 1}")
    return {(r["key"], n, s, x, ",".join(spans[s]), unlocated[s], differ[s] > 0) for n, (s, x) in enumerate(texts.items())}


def test_items(spark, sf, collected):
    want = set().union(*(plain_item(r, "if_flagged", 2) for r in collected))
    got = {tuple(x) for x in plans.g5_items(spark, sf).collect()}
    assert got == want and any(x[-1] for x in want) and any(x[-2] for x in want)
    for include, most in (("off", 0), ("always", 1)):
        c = u.item_columns(plans.records(spark, sf), include, most).collect()
        got = {(x["key"], x["place"], x["system"], x["text"], ",".join(f"{s['start_i']}-{s['end_i']}" for s in x["spans"]), x["unlocated"], x["differ"]) for x in c}
        assert got == set().union(*(plain_item(r, include, most) for r in collected))
