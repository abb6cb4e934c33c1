"""One pace for the calls of all tasks of a stage.

The tasks run as a barrier stage and meet before each round. Each says how many calls it has waiting; a round has a turn
for every one of them, dealt in rotation, and a task starts its calls at its own turns, counted from the moment that all
have met. So a task without work takes no turns, and one with more than the others gets what they leave.

A call starts at its turn or, if the one before it took longer, when that ends; a turn missed is not made up, and a round
ends no sooner than its turns do. Clocks of machines are not compared. A lost executor repeats the stage, as barrier
stages do, so its calls are made again; land the result before anything else reads it. A cluster needs a free core for
each of `tasks` at once, and all partitions are always read: don't follow it by a bare limit.
"""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np

#: meeting takes about a second, so a round should last much longer
ROUND_SECONDS = 30.0
#: of the items that a task holds for one round: a fast pace needs many of them to fill a round
MOST_BYTES = 64 << 20
#: results that a task gives back at once
PIECE = 10_000


def turns(waiting: list[int], own: int) -> list[int]:
    """The turns of one task in a round: in rotation, every task that still has calls waiting."""
    k = np.arange(waiting[own])
    out = np.zeros(len(k), np.int64)
    for task, n in enumerate(waiting):
        out += np.minimum(n, k + 1 if task < own else k)
    return out.tolist()


def weight(item: Any) -> int:
    """Bytes that an item takes up, its parts counted if it is a tuple."""
    return sys.getsizeof(item) + (sum(map(sys.getsizeof, item)) if isinstance(item, tuple) else 0)


def held_for_a_round(items: Iterator[Any], most: int, most_bytes: int) -> list[Any]:
    """The next items: at most so many, and no more once they take up that many bytes."""
    out, size = [], 0
    while len(out) < most and size < most_bytes:
        try:
            item = next(items)
        except StopIteration:
            break
        out.append(item)
        size += weight(item)
    return out


@dataclass
class SharedPace:
    """At most `per_minute` turns a minute over all `tasks`; `meet` takes a text and returns those of all tasks in order."""

    per_minute: float
    tasks: int
    own: int
    meet: Callable[[str], list[str]]
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        if not self.per_minute > 0:
            raise ValueError("a pace needs more than no call a minute")
        self.gap = 60.0 / self.per_minute
        self.share = max(1, math.ceil(ROUND_SECONDS / self.gap / self.tasks))

    def _until(self, at: float) -> None:
        left = at - self.clock()
        if left > 0:
            self.sleep(left)

    def run(self, items: Iterator[Any], call: Callable[[Any], Any]) -> Iterator[list[Any]]:
        """What `call` returns for the items, in pieces of a round. Every task goes on meeting until none has anything left."""
        while True:
            held = held_for_a_round(items, self.share, MOST_BYTES)
            waiting = [json.loads(n) for n in self.meet(json.dumps(len(held)))]
            start, out = self.clock(), []
            if not any(waiting):
                return
            for item, turn in zip(held, turns(waiting, self.own), strict=True):
                self._until(start + turn * self.gap)
                out.append(call(item))
                if len(out) == PIECE:
                    yield out
                    out = []
            if out:
                yield out
            self._until(start + sum(waiting) * self.gap)


def of_stage(per_minute: float, tasks: int) -> SharedPace:
    """The pace of the barrier stage that this task belongs to."""
    from pyspark import BarrierTaskContext

    context = BarrierTaskContext.get()
    return SharedPace(per_minute, tasks, context.partitionId(), context.allGather)
