"""Incremental translation of growing transcripts, in batch and as a stateful stream with the same results.

At each step a backend continues the fixed beginning of a translation. What two translations in a row agree on (whole words) is fixed and told; the rest is an
unconfirmed tail. Finished parts are context for those after them. With a token budget, a prompt that doesn't fit goes without context, and an open part that needs more
than half of the budget is closed by force: what follows is translated on its own.
"""

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: translate(source, beginning of the translation, context source, context translation) -> the whole translation.
Translator = Callable[[str, str, str, str], str]
#: How many tokens the parts of a prompt take together.
Counter = Callable[[str, str, str, str], int]

OUT = "step long, emission_time double, confirmed string, tail string, is_final boolean, revisions long, calls long, without_context long, splits long"
STATE = (
    "contexts array<struct<source:string,target:string>>, heard array<string>, offset long, fixed array<string>, previous array<string>, written array<string>, "
    "asked string, answer array<string>, had_tail boolean, revisions long, calls long, without_context long, splits long"
)
#: Finished parts that a key keeps.
KEPT = 50


def words_of(*parts: str) -> int:
    """A stand-in for a tokenizer: the words of all parts."""
    return sum(len(p.split()) for p in parts)


def agreed(a: list[str], b: list[str]) -> list[str]:
    """The words that two translations begin with."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return b[:n]


@dataclass
class Session:
    """What is known of one key between steps."""

    contexts: list[dict] = field(default_factory=list)
    heard: list[str] = field(default_factory=list)
    offset: int = 0
    fixed: list[str] = field(default_factory=list)
    previous: list[str] = field(default_factory=list)
    written: list[str] = field(default_factory=list)
    asked: str | None = None
    answer: list[str] = field(default_factory=list)
    had_tail: bool = False
    revisions: int = 0
    calls: int = 0
    without_context: int = 0
    splits: int = 0


@dataclass(frozen=True)
class Rules:
    """``context`` finished parts go with each prompt; ``budget`` limits a prompt's tokens (0: no limit), counted by ``count``."""

    context: int = 1
    budget: int = 0
    count: Counter = words_of


class Stepper:
    """Steps of one key: its session, a backend and the rules."""

    def __init__(self, session: Session, translate: Translator, rules: Rules):
        self.s, self.backend, self.rules = session, translate, rules

    def _translation(self, source: list[str]) -> list[str]:
        s, text = self.s, " ".join(source)
        if text == s.asked and s.answer:
            return s.answer
        last = s.contexts[-self.rules.context :] if self.rules.context else []
        before = " ".join(c["source"] for c in last), " ".join(c["target"] for c in last)
        start = " ".join(s.fixed)
        if any(before) and self.rules.budget and self.rules.count(text, start, *before) > self.rules.budget:
            before = "", ""
            s.without_context += 1
        s.calls += 1
        return self.backend(text, start, *before).split()

    def _closed(self, source: list[str], final: bool) -> tuple[list[str], list[str]] | None:
        """Translates a part for good; it becomes context and the next part begins."""
        s = self.s
        whole = self._translation(source) if source else []
        s.revisions += whole[: len(s.written)] != s.written
        rest = whole[len(s.written) :]
        if source:
            s.contexts = [*s.contexts, {"source": " ".join(source), "target": " ".join(whole)}][-KEPT:]
        s.fixed, s.previous, s.written, s.asked, s.answer, s.had_tail = [], [], [], None, [], False
        return (rest, []) if rest or final else None

    def step(self, text: str, final: bool) -> tuple[list[str], list[str]] | None:
        """New words and the tail for the transcript so far of the open segment; None if there is nothing to tell."""
        s, full = self.s, text.split()
        source = full[s.offset :]
        if final:
            if not full:
                return None
            told = self._closed(source, True)
            s.offset, s.heard = 0, []
            return told
        if not source:
            return None
        s.heard = full
        if self.rules.budget and self.rules.count(" ".join(source), " ".join(s.fixed), "", "") > self.rules.budget // 2:
            told = self._closed(source, False)
            s.offset = len(full)
            s.splits += 1
            return told
        now = self._translation(source)
        common = agreed(s.previous, now)
        s.asked, s.answer, s.previous, s.fixed = " ".join(source), now, now, common
        holds = common[: len(s.written)] == s.written
        new = common[len(s.written) :] if holds else []
        s.written = s.written + new
        tail = now[len(s.written) :] if now[: len(s.written)] == s.written else []
        told = (new, tail) if new or tail or s.had_tail else None
        if told:
            s.had_tail = bool(tail)
        return told

    def flush(self) -> tuple[list[str], list[str]] | None:
        """Closes a segment that never got its end."""
        return self.step(" ".join(self.s.heard), True) if self.s.heard else None


def _steps(rows: pd.DataFrame, stepper: Stepper) -> list[tuple]:
    out, s = [], stepper.s
    for r in rows.sort_values("step").itertuples():
        if (told := stepper.step(r.text or "", bool(r.is_final))) is not None:
            out.append((r.step, r.emission_time, " ".join(told[0]), " ".join(told[1]), bool(r.is_final), s.revisions, s.calls, s.without_context, s.splits))
    return out


COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def translated(steps: DataFrame, by: str, make: Callable[[], Translator], rules: Rules = Rules()) -> DataFrame:
    """What each step of a key (``by``, ``step``, ``emission_time``, ``text``, ``is_final``) tells, open segments closed at its end.

    ``text`` is the transcript so far of the open segment; null counts as none. Rows: ``confirmed`` words to append, the ``tail``, whether the segment ends, and
    counts so far: ``revisions`` of words already told, backend ``calls``, those ``without_context`` that wouldn't fit, forced ``splits``.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stepper = Stepper(Session(), make(), rules)
        out = _steps(rows, stepper)
        if (told := stepper.flush()) is not None:
            s = stepper.s
            out.append((int(rows["step"].max()) + 1, float(rows["emission_time"].max()), " ".join(told[0]), "", True, s.revisions, s.calls, s.without_context, s.splits))
        return pd.DataFrame([(key[0], *o) for o in out], columns=[by, *COLUMNS])

    kind = dict(steps.dtypes)[by]
    return steps.select(by, "step", "emission_time", "text", "is_final").groupBy(by).applyInPandas(run, f"{by} {kind}, {OUT}")


class _Processor(StatefulProcessor):
    def __init__(self, make: Callable[[], Translator], rules: Rules):
        self.make, self.rules = make, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)
        self.backend = self.make()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        session = Session()
        if known is not None:
            for name, value in zip(asdict(session), known):
                setattr(session, name, [{"source": c[0], "target": c[1]} for c in value] if name == "contexts" else list(value) if isinstance(getattr(session, name), list) else value)
        out = _steps(pd.concat(list(rows)), Stepper(session, self.backend, self.rules))
        values = asdict(session)
        values["contexts"] = [(c["source"], c["target"]) for c in session.contexts]
        self.state.update(tuple(values.values()))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", *COLUMNS])

    def close(self) -> None:
        pass


def translated_stream(steps: DataFrame, by: str, make: Callable[[], Translator], rules: Rules = Rules()) -> DataFrame:
    """``translated`` over a stream; needs the RocksDB state store. Steps of a key arrive in order, and a segment's end is told by ``is_final``, as a stream has no end.

    A session is the key's only state, so a restart from the checkpoint goes on where the last committed batch ended.
    """
    kind = dict(steps.dtypes)[by]
    return steps.select(by, "step", "emission_time", "text", "is_final").groupBy(by).transformWithStateInPandas(_Processor(make, rules), f"key {kind}, {OUT}", "Append", "None")


def reversing(unstable: int = 5) -> Translator:
    """A stand-in backend: each word reversed; where a source's number of words is a multiple of ``unstable`` its last word is still uncertain."""

    def translate(source: str, start: str, context: str, context_target: str) -> str:
        own = [w[::-1] for w in source.split()]
        if own and len(own) % unstable == 0:
            own[-1] += "?"
        begun = start.split()
        return " ".join([*begun, *own[len(begun) :]])

    return translate
