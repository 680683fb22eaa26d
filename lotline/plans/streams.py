"""Streams that propose features one bundle at a time."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import deque
from collections.abc import Callable, Iterator

from .features import Feature, interaction, is_derived, lagged, power_of, related, same_parent_levels


class Stream:
    """Bundles from a generator, with one looked ahead; remaining() tells how many are left."""

    def __init__(self, name: str, bundles: Iterator[list[Feature]], remaining: Callable[[], int], wanted: Callable[[list[Feature]], bool] = lambda b: True, grows: bool = False):
        """wanted: whether a bundle that was looked ahead is still to be offered; grows: a stream that is empty may have more later."""
        self.name, self._bundles, self._left, self._wanted, self.grows = name, bundles, remaining, wanted, grows
        self._queue: deque[list[Feature]] = deque()

    def remaining(self) -> int:
        return self._left() + max(0, len(self._queue) - 1)

    def _fill(self, n: int) -> None:
        self._queue = deque(b for b in self._queue if self._wanted(b))
        while len(self._queue) < n and (b := next(self._bundles, None)) is not None:
            if self._wanted(b):
                self._queue.append(b)

    def ahead(self, n: int) -> list[list[Feature]]:
        """Up to n bundles that come next, left in the stream."""
        self._fill(n)
        return list(self._queue)[:n]

    def peek(self) -> list[Feature] | None:
        self._fill(1)
        return self._queue[0] if self._queue else None

    def pop(self) -> list[Feature] | None:
        return self._queue.popleft() if self.peek() is not None else None


def counted(name: str, bundles: list[list[Feature]]) -> Stream:
    left = deque(bundles)

    def go():
        while left:
            yield left.popleft()

    return Stream(name, go(), lambda: len(left) + 1)


def cyclic(name: str, features: list[Feature], in_model: set[str], cycles: int = 1) -> Stream:
    """Each feature in turn, those in the model left out, so many times around."""
    ring = [f for f in features if not f.constant]

    def go():
        for _ in range(cycles):
            for f in ring:
                yield [f]

    stream = Stream(name, go(), lambda: 0, lambda b: b[0].name not in in_model)
    stream.remaining = lambda: max(1, sum(f.name not in in_model for f in ring))
    return stream


def queue(name: str, features: list[Feature], priority: Callable[[Feature], float]) -> Stream:
    heap = [(-priority(f), i, f) for i, f in enumerate(features) if not f.constant]
    heapq.heapify(heap)

    def go():
        while heap:
            yield [heapq.heappop(heap)[2]]

    return Stream(name, go(), lambda: len(heap) + 1)


def growing(name: str, source: list[Feature], transform: Callable[[Feature], list[Feature]] = lambda f: [f]) -> Stream:
    """What is made of a list that may grow while the stream is read."""
    at = itertools.count()
    place = [0]

    def go():
        for i in at:
            place[0] = i
            while len(source) <= i:
                yield None
            if bundle := transform(source[i]):
                yield bundle

    return Stream(name, go(), lambda: max(0, len(source) - place[0]), grows=True)


def lags(name: str, f: Feature, most: int, order: list[str], by: list[str], block: int = 1, cycles: int = 1) -> Stream:
    return counted(name, [[lagged(f, k, order, by, block)] for _ in range(cycles) for k in range(1, most + 1)])


def bundles(name: str, features: list[Feature], size: int) -> Stream:
    return counted(name, [list(b) for b in itertools.batched(features, size)])


def polynomials(name: str, features: list[Feature], in_model: set[str], degree: int) -> Stream:
    """For each feature its powers as one bundle, the feature itself unless it is in the model by then."""
    left = deque(f for f in features if not is_derived(f))

    def go():
        while left:
            f = left.popleft()
            yield [*([f] if f.name not in in_model else []), *(power_of(f, p) for p in range(2, degree + 1))]

    return Stream(name, go(), lambda: len(left) + 1)


def models(name: str, terms: list[Feature]) -> Stream:
    """The terms of a model one at a time, also those that it gains while the stream is read."""
    return growing(name, terms)


def neighborhoods(name: str, features: list[Feature], neighbor: Callable[[Feature], Feature]) -> Stream:
    """For each feature that isn't derived the feature of the row that an index names."""
    return counted(name, [[neighbor(f)] for f in features if not is_derived(f)])


def cross_by_prefix(name: str, features: list[Feature], a: str, b: str) -> Stream:
    """Products of the features whose stream begins with one prefix and those of another."""
    of = lambda p: [f for f in features if str(f.attrs.get("stream", "")).startswith(p)]
    return cross_product(name, of(a), of(b))


def calibrations(name: str, fitted: Callable[[], tuple[int, list[Feature]]], q: Callable[[], int] | None = None, gap: int = 1) -> Stream:
    """Calibrating features of the model's fit, for numbers of terms that are gap or more beyond the last that was offered; fitted() tells the number of terms and the features now.

    q tells that number alone, where fitted() has to go over the rows.
    """
    last = [0]
    terms = q or (lambda: fitted()[0])

    def go():
        while True:
            if terms() < last[0] + gap:
                yield None
                continue
            last[0], bundle = fitted()
            yield bundle

    stream = Stream(name, go(), lambda: 0, grows=True)
    stream.remaining = lambda: int(terms() >= last[0] + gap or stream.peek() is not None)
    return stream


def pair_count(p: int, squares: bool = True) -> int:
    return p * (p + 1) // 2 if squares else p * (p - 1) // 2


def pair_at(k: int, p: int, squares: bool = True) -> tuple[int, int]:
    """The k-th of the pairs i <= j of p (i < j without squares), row by row, without listing them."""
    n = p if squares else p - 1
    # rows from the end hold 1, 2, ... pairs: so many of them are wholly at or behind place k
    behind = (math.isqrt(8 * (n * (n + 1) // 2 - 1 - k) + 1) - 1) // 2
    i = n - 1 - behind
    before = i * n - i * (i - 1) // 2
    return i, k - before + i + (0 if squares else 1)


def interactions(name: str, features: list[Feature], squares: bool = True, skip=lambda a, b: same_parent_levels(a, b), start: int = 0) -> Stream:
    """Products of pairs i <= j, without constants, squares of 0/1 features and skipped pairs.

    A pair is made from its number when its turn comes. remaining() is the
    number of pairs that are left, those that will be skipped among them; start
    goes on after so many pairs.
    """
    ok = [f for f in features if not f.constant]
    total, at = pair_count(len(ok), squares), [start]

    def go():
        while at[0] < total:
            a, b = (ok[i] for i in pair_at(at[0], len(ok), squares))
            at[0] += 1
            if not (a is b and a.dummy) and not (a is not b and skip(a, b)):
                yield [interaction(a, b)]

    return Stream(name, go(), lambda: total - at[0] + 1)


def cross_product(name: str, a: list[Feature], b: list[Feature], skip=related) -> Stream:
    """Products of two lists, either of which may grow; each pair once.

    For each feature of a there is a cursor into b; all pairs before it have been
    offered or skipped. remaining() is the number of pairs behind the cursors.
    """
    cursor: list[int] = []
    used, slow, wide = [0], [0], [0]

    def go():
        while True:
            cursor.extend([0] * (len(a) - len(cursor)))
            if len(b) > wide[0]:  # rows that were done have more now
                wide[0], slow[0] = len(b), 0
            while slow[0] < len(a) and cursor[slow[0]] >= len(b):
                slow[0] += 1
            if slow[0] >= len(a):
                yield None
                continue
            x, y = a[slow[0]], b[cursor[slow[0]]]
            cursor[slow[0]] += 1
            used[0] += 1
            if x.name != y.name and not skip(x, y):
                yield [interaction(x, y)]

    stream = Stream(name, go(), lambda: 0, grows=True)
    stream.remaining = lambda: len(a) * len(b) - used[0] + len(stream._queue)
    return stream


def product_with(name: str, f: Feature, others: list[Feature]) -> Stream:
    return counted(name, [[interaction(f, g)] for g in others if g.name != f.name and not same_parent_levels(f, g)])


def transformed(name: str, source: list[list[Feature]], operator: Callable[[list[Feature]], list[Feature]]) -> Stream:
    """Bundles through an operator such as principal components."""
    return counted(name, [operator(b) for b in source])
