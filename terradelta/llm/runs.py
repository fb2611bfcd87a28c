"""Ids of texts from the ids of their runs, a whole batch at a time.

A text is cut into runs that can be encoded on their own.  Each distinct run is
encoded once and numbered; the ids of a batch are one gather from flat arrays.
Runs that are used again stay within a bound of bytes, which has no influence
on the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Bytes of remembered runs in a worker, and what a run counts besides its characters and ids.
REMEMBERED_BYTES, RUN_BYTES = 80 << 20, 180


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the slices [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def groups(lengths: list[int | None], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Rows of about size characters, from the length of each text."""
    a = total = 0
    for i, x in enumerate(lengths):
        total += x or 0
        if total >= size:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


class _Numbers(dict):
    """The number of each run; a new one gets the next number and is listed in fresh."""

    def __init__(self, runs: list[str] = ()):
        super().__init__(zip(runs, range(len(runs))))
        self.fresh: list[str] = []

    def __missing__(self, run: str) -> int:
        self[run] = n = len(self)
        self.fresh.append(run)
        return n


class _Growing:
    """A flat array that grows by doubling."""

    def __init__(self, dtype: type, start: list[int] = ()):
        self.room, self.n = np.zeros(1024, dtype), 0
        self.add(np.array(start, dtype))

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + len(values) + 1024, self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.room[: self.n]


class RunIds:
    """Ids by run.  learn(runs) returns how many ids each has, and all of them."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bound: int = REMEMBERED_BYTES):
        self.learn, self.bound = learn, bound
        self.numbers, self.chars = _Numbers(), 0
        self.at, self.ids, self.uses = _Growing(np.int64, [0]), _Growing(np.int32), _Growing(np.int32)

    def take(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int32, int(n.sum()))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            counts, ids = self.learn(fresh)
            self.at.add(self.ids.n + np.cumsum(counts))
            self.ids.add(ids)
            self.uses.add(np.zeros(len(fresh), np.int32))
            self.chars += sum(map(len, fresh))
        at = self.at.all()
        starts = at[which]
        lengths = at[1:][which] - starts
        found = self.ids.all()[ragged(starts, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        per_text = upto[np.cumsum(n)] - upto[np.cumsum(n) - n]
        self.uses.all()[which] += 1  # once for a batch
        if RUN_BYTES * len(self.numbers) + 2 * self.chars + 4 * self.ids.n > self.bound:
            self.forget()
        return found, per_text

    def forget(self) -> None:
        """Keep the runs that most batches use, up to half of the bound; runs of one batch go first."""
        runs, at, uses = list(self.numbers), self.at.all(), self.uses.all()
        self.numbers = _Numbers()  # frees the old numbers before the new ones are made
        lengths = np.diff(at)
        size = RUN_BYTES + 2 * np.fromiter(map(len, runs), np.int64, len(runs)) + 4 * lengths
        order = np.argsort(-uses, kind="stable")
        order = np.sort(order[(np.cumsum(size[order]) <= self.bound // 2) & (uses[order] > 1)])
        ids = self.ids.all()[ragged(at[order], lengths[order])]
        self.at, self.ids, self.uses = _Growing(np.int64, [0]), _Growing(np.int32), _Growing(np.int32)
        self.at.add(np.cumsum(lengths[order]))
        self.ids.add(ids)
        self.uses.add(uses[order] // 2)
        self.numbers = _Numbers([runs[i] for i in order.tolist()])
        self.chars = sum(map(len, self.numbers))
