"""Passes in which the anchors of a group of buckets choose one after the other, in one go through its rows.

Groups (a month and flow) do not touch and are sorted by Spark: first the rows, then the anchors in their order. A task holds
the rows of one group that are still free, in cells of one account, text and day sorted by amount, and lets anchors stream
by. Groups of more than :data:`MOST_ROWS` rows are left to :func:`ordered.settled`, which holds lists only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.subset import score_of

Member = namedtuple("Member", "id cents day label")
#: Rows of a group that a task holds, some hundreds of bytes each.
MOST_ROWS = 1_000_000
#: Ranked cells and pairs of texts that a task keeps; beyond that they are told anew.
KEPT = 2_000_000


class FreeRows:
    """Free rows of a group: those that rank first for an anchor by score, nearness of the amount and order."""

    def __init__(self, limit: int, tolerance: int, days: int):
        self.limit, self.tolerance, self.days = limit, tolerance, days
        self.cells: dict[tuple, list[tuple]] = {}  # (account, said, day): sorted (cents, ord, id, label)
        self.holding: dict[int, list[tuple]] = {}  # amount: the cells that have had it
        self.ranks: dict[tuple, list[tuple]] = {}
        self.alike: dict[tuple, float] = {}
        self.kept = 0

    def add(self, r) -> None:
        cell = (r.account, r.said, r.day)
        rows, row = self.cells.setdefault(cell, []), (r.cents, r.ord, r.id, r.label)
        at = bisect_left(rows, row)
        if r.cents not in [x[0] for x in rows[max(0, at - 1) : at + 1]]:
            self.holding.setdefault(r.cents, []).append(cell)
        rows.insert(at, row)

    def take(self, place: tuple) -> None:
        cell, row = place
        rows = self.cells[cell]
        del rows[bisect_left(rows, row)]

    def _alike(self, one: str, two: str) -> float:
        if (one, two) not in self.alike:
            if len(self.alike) >= KEPT:
                self.alike.clear()
            self.alike[one, two] = ratio(one, two)
        return self.alike[one, two]

    def _meets(self, r, cell: tuple) -> bool:
        return (not r.account or not cell[0] or cell[0] == r.account) and abs(cell[2] - r.day) <= self.days

    def _ranked(self, r) -> list[tuple]:
        """Levels of cells, highest score first, of rows whose amounts are not near."""
        key = (r.account, r.said, r.day)
        if key not in self.ranks:
            levels: dict[float, list[tuple]] = {}
            known: dict[tuple, float] = {}
            n = 0
            for cell, rows in self.cells.items():
                if rows and self._meets(r, cell):
                    like = (cell[1], abs(cell[2] - r.day))
                    if like not in known:
                        known[like] = score_of(self.tolerance + 1, like[1], self._alike(r.said, cell[1]), self.tolerance, self.days)
                    levels.setdefault(known[like], []).append((cell, rows))
                    n += 1
            if self.kept + n > KEPT:
                self.ranks.clear()
                self.kept = 0
            self.kept += n
            self.ranks[key] = sorted(levels.items(), key=lambda x: -x[0])
        return self.ranks[key]

    def best(self, r) -> list[tuple]:
        """The first ``limit`` rows as places (cell, row)."""
        cents, tolerance, limit = r.cents, self.tolerance, self.limit
        found, n = [], 0
        for score, cells in self._ranked(r):
            for cell, rows in cells:
                if not rows:
                    continue
                at = bisect_left(rows, (cents - tolerance,))
                up = bisect_left(rows, (cents + tolerance + 1,), at)
                some, low = rows[up : up + limit], max(0, at - limit)
                if low:  # of the smallest amount that counts the first rows
                    amount = rows[low][0]
                    first = bisect_left(rows, (amount,), 0, low)
                    behind = bisect_left(rows, (amount + 1,), low, at)
                    some += rows[behind:at] + rows[first : min(behind, first + limit)]
                else:
                    some += rows[:at]
                found += [(-score, abs(x[0] - cents), x[1], x[2], cell, x) for x in some]
                n += len(some)
            if n >= limit:
                break
        for amount in range(cents - tolerance, cents + tolerance + 1):
            for cell in self.holding.get(amount, ()):
                if self._meets(r, cell):
                    rows = self.cells[cell]
                    at = bisect_left(rows, (amount,))
                    far = abs(amount - cents)
                    score = score_of(far, abs(cell[2] - r.day), self._alike(r.said, cell[1]), tolerance, self.days)
                    found += [(-score, far, x[1], x[2], cell, x) for x in rows[at : bisect_left(rows, (amount + 1,), at, min(len(rows), at + limit))]]
        found.sort()
        return [x[4:] for x in found[:limit]]


def one_by_one(anchors: DataFrame, rows: DataFrame, group: list[str], groups: int, choose: Callable[[Member, list[Member]], tuple | None], limit: int, tolerance: int, days: int) -> DataFrame:
    """(anchor, ord, members, score) of the anchors that find something: ``choose`` gets an anchor and the ``limit`` free rows
    that rank first for it, of its account or a blank one, of all accounts if its own is blank. A task for each of ``groups``."""
    fields = ["account", "said", "day", "cents", "ord", "id", "label"]
    both = rows.select(*group, F.lit(0).alias("turn"), *fields).unionByName(anchors.select(*group, F.lit(1).alias("turn"), *fields))
    dealt = both.repartition(groups, *group).sortWithinPartitions(*group, "turn", "ord", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free = None, FreeRows(limit, tolerance, days)
        for batch in batches:
            out = []
            keys = zip(*(batch[c].tolist() for c in group))
            for k, r in zip(keys, batch.astype({c: object for c in ("cents", "ord", "day")}).itertuples(index=False)):
                if k != key:
                    key, free = k, FreeRows(limit, tolerance, days)
                if not r.turn:
                    free.add(r)
                    continue
                places = free.best(r)
                got = choose(Member(r.id, r.cents, r.day, r.label), [Member(row[2], row[0], cell[2], row[3]) for cell, row in places])
                if got:
                    taken = set(got[0])
                    for p in places:
                        if p[1][2] in taken:
                            free.take(p)
                    out.append((r.id, r.ord, *got))
            yield pd.DataFrame(out, columns=["anchor", "ord", "members", "score"])

    return dealt.mapInPandas(run, "anchor string, ord long, members array<string>, score double")
