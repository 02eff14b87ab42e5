"""LocalAgreement-2: what two hypotheses in a row agree on is confirmed.

The rule is one small state machine, used in batch by document and in a stream by key with the same results.
"""

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "step long, emission_time double, confirmed string, tail string, is_final boolean, revisions long"


class Committer:
    """The state of one utterance: the previous hypothesis and the words confirmed since the last final text.

    Words of a final text are confirmed as they are; it counts as a revision if it contradicts confirmed words. A final step
    without words closes nothing: it is a hypothesis of no words.
    """

    def __init__(self, previous: list[str] | None = None, confirmed: list[str] | None = None, had_tail: bool = False, revisions: int = 0):
        self.previous, self.confirmed, self.had_tail, self.revisions = previous or [], confirmed or [], had_tail, revisions

    def step(self, words: list[str], final: bool) -> tuple[list[str], list[str]] | None:
        """Newly confirmed words and the unconfirmed tail; None if there is nothing to tell."""
        known = len(self.confirmed)
        if final and words:
            self.revisions += words[:known] != self.confirmed
            self.previous, self.confirmed, self.had_tail = [], [], False
            return words[known:], []
        same = next((i for i, (a, b) in enumerate(zip(self.previous, words)) if a != b), min(len(self.previous), len(words)))
        new: list[str] = []
        if same > known:
            new, self.confirmed = words[known:same], words[:same]
        tail = words[len(self.confirmed) :]
        told = bool(new or tail or self.had_tail)
        self.previous, self.had_tail = words, bool(tail)
        return (new, tail) if told else None

    def flush(self) -> list[str] | None:
        """What is left at the end of the input; None if no utterance is open."""
        left = self.previous[len(self.confirmed) :] if self.previous or self.confirmed else None
        self.previous, self.confirmed, self.had_tail = [], [], False
        return left


def _run(rows: pd.DataFrame, committer: Committer) -> list[tuple]:
    out = []
    for r in rows.sort_values("step").itertuples():
        if (told := committer.step((r.text or "").split(), bool(r.is_final))) is not None:
            out.append((r.step, r.emission_time, " ".join(told[0]), " ".join(told[1]), bool(r.is_final and (r.text or "").split()), committer.revisions))
    return out


def commit(steps: DataFrame, by: str) -> DataFrame:
    """Confirmed words of each document's steps (``by``, ``step``, ``emission_time``, ``text``, ``is_final``), flushed at its end."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        committer = Committer()
        out = _run(rows, committer)
        if (left := committer.flush()) is not None:
            out.append((int(rows["step"].max()) + 1, float(rows["emission_time"].max()), " ".join(left), "", True, committer.revisions))
        return pd.DataFrame([(key[0], *o) for o in out], columns=[by, "step", "emission_time", "confirmed", "tail", "is_final", "revisions"])

    kind = dict(steps.dtypes)[by]
    return steps.groupBy(by).applyInPandas(run, f"{by} {kind}, {OUT}")


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "previous array<string>, confirmed array<string>, had_tail boolean, revisions long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        committer = Committer(*((list(s[0]), list(s[1]), s[2], s[3]) if (s := self.state.get()) is not None else ()))
        out = _run(pd.concat(list(rows)), committer)
        self.state.update((committer.previous, committer.confirmed, committer.had_tail, committer.revisions))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "step", "emission_time", "confirmed", "tail", "is_final", "revisions"])

    def close(self) -> None:
        pass


def commit_stream(steps: DataFrame, by: str) -> DataFrame:
    """``commit`` over a stream; needs the RocksDB state store. Steps of a key arrive in order; the end of the
    input is told by ``is_final``, as a stream has none."""
    kind = dict(steps.dtypes)[by]
    return steps.groupBy(by).transformWithStateInPandas(_Processor(), f"key {kind}, {OUT}", "Append", "None")
