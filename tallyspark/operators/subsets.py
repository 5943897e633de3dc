"""Which payments add up to which credits: exact search over amounts with their counts, as helpers for one group of payments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np

#: Sums that each half of a search keeps, over all its steps; beyond, the search is not exhaustive and says so.
MOST_SUMS = 1 << 22
#: Choices for one credit that are tried out on the credits after it.
MOST_TRIES = 20_000
#: Payments of a pool, and pools that are tried, where sums are too many to keep.
POOL, POOLS = 32, 64


class WorkLimit(Exception):
    """A search ended before all choices were seen."""


def _with(sums: np.ndarray, more: int) -> np.ndarray:
    """``sums``, which are in order, and each of them with ``more``, each once and in order: two runs to merge, where np.union1d hashes every sum."""
    both = np.concatenate([sums, sums + more])
    both.sort(kind="stable")
    kept = np.ones(len(both), bool)
    kept[1:] = both[1:] != both[:-1]
    return both[kept]


def _layers(values: np.ndarray, counts: np.ndarray, low: int, high: int, most: int) -> list[np.ndarray] | None:
    """The sums that the first 0, 1, ... amounts reach, each once and in order, or None beyond ``most``.

    Sums that are past ``high``, or that all later amounts do not lift to
    ``low``, are cut where amounts are positive.
    """
    sums, out, held = np.zeros(1, np.int64), [np.zeros(1, np.int64)], 1
    rest = int((values * counts).sum())
    positive = bool((values > 0).all())
    for value, count in zip(values.tolist(), counts.tolist(), strict=True):
        rest -= value * count
        left, step = count, 1
        while left:
            take = min(step, left)
            # Taking up to ``take`` more of what fewer already reach: steps of 1, 2, 4 ... cover all counts.
            sums = _with(sums, take * value)
            if positive:
                sums = sums[sums <= high]
            if held + len(sums) > most:
                return None
            left, step = left - take, 2 * step
        if positive:
            sums = sums[sums >= low - rest]
        out.append(sums)
        held += len(sums)
    return out


def _choices(layers: list[np.ndarray], values: list[int], counts: list[int], total: int) -> Iterator[list[int]]:
    """All counts whose amounts sum up to ``total``: back through the layers, so that no branch is in vain."""
    chosen = [0] * len(values)
    stack = [(len(values) - 1, total, None)]
    while stack:
        at, left, took = stack.pop()
        if took is not None:
            chosen[at + 1] = took
        if at < 0:
            if left == 0:
                yield list(chosen)
            continue
        layer = layers[at]
        for take in range(counts[at] + 1):
            before = left - take * values[at]
            k = int(np.searchsorted(layer, before))
            if k < len(layer) and layer[k] == before:
                stack.append((at - 1, before, take))


def _halves(values: np.ndarray, counts: np.ndarray, low: int, high: int, most: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]] | None:
    """The amounts dealt into two halves, and the layers of each; None beyond ``most`` sums of a half."""
    order = np.argsort(-values, kind="stable")
    sides, layers = [order[0::2], order[1::2]], []
    totals = [int((values[s] * counts[s]).sum()) for s in sides]
    for k, s in enumerate(sides):
        found = _layers(values[s], counts[s], low - totals[1 - k], high, most)
        if found is None:
            return None
        layers.append(found)
    return sides, layers


#: Sums that each half keeps where it is only asked whether a sum is reached at all.
FEW_SUMS = 1 << 14


def unreachable(values: np.ndarray, counts: np.ndarray, low: int, high: int) -> bool:
    """Whether it is certain that no choice sums up to [low, high], from FEW_SUMS sums; amounts are positive."""
    halves = _halves(values, counts, low, high, FEW_SUMS)
    if halves is None:
        return False
    one, two = (layers[-1] for layers in halves[1])
    return not (np.searchsorted(two, low - one) < np.searchsorted(two, high - one, "right")).any()


def _pools(values: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(order, pool): pools of about POOL payments and the order in which others are taken: of neighbouring amounts, and where amounts repeat also of all amounts alike, as copies of few amounts reach few sums."""
    units = int(counts.sum())
    tries = min(POOLS, -(-units // POOL)) if units > POOL else 0
    most = [int(counts.max(initial=0)), -(-POOL // len(values)) if len(values) else 0]
    for each in most[: 1 + (most[1] < most[0])]:
        for n in range(tries):
            turned = np.roll(np.arange(len(values)), -(n * len(values) // tries))
            held = np.minimum(counts[turned], each)
            pool = np.zeros(len(values), np.int64)
            pool[turned] = np.clip(POOL - (np.cumsum(held) - held), 0, held)
            yield turned, pool


def subsets(values: np.ndarray, counts: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """Counts of each amount whose sum lies in [low, high]: all such choices, everything first if it fits.

    Of more than POOL payments, first whole amounts are taken until half of a
    pool of POOL others is missing, which the pool then makes up for: of amounts
    without a pattern it nearly always can, and some choices come twice for it.
    Then all are searched: the amounts are dealt into two halves, whose
    reachable sums meet. Equal sums are kept once, so that round amounts stay
    few however many payments there are, and about 42 payments of any amounts
    are searched whole. Where even these are too many, WorkLimit says that there
    may be further choices.
    """
    if low <= int((values * counts).sum()) <= high:
        yield counts.copy()
    for turned, pool in _pools(values, counts):
        rest = counts - pool
        # What is taken whole: amounts in order, each as often as still fits.
        want = low - int((values * pool).sum()) // 2
        ends = np.cumsum(values[turned] * rest[turned])
        taken = np.zeros(len(values), np.int64)
        begun = ends - values[turned] * rest[turned]
        taken[turned] = np.clip((want - begun) // np.maximum(values[turned], 1), 0, rest[turned])
        whole = int((values * taken).sum())
        inside = np.flatnonzero(pool)
        for some in subsets(values[inside], pool[inside], low - whole, high - whole):
            out = taken.copy()
            out[inside] += some
            yield out
            break
    halves = _halves(values, counts, low, high, MOST_SUMS)
    if halves is not None:
        sides, layers = halves
        one, two = layers[0][-1], layers[1][-1]
        first, last = np.searchsorted(two, low - one), np.searchsorted(two, high - one, "right")
        lists = [(values[s].tolist(), counts[s].tolist()) for s in sides]
        for k in np.flatnonzero(first < last)[::-1]:
            for other in range(first[k], last[k]):
                for x in _choices(layers[0], *lists[0], int(one[k])):
                    for y in _choices(layers[1], *lists[1], int(two[other])):
                        out = np.zeros(len(values), np.int64)
                        out[sides[0]], out[sides[1]] = x, y
                        if not (out == counts).all():
                            yield out
        return
    raise WorkLimit


@dataclass
class Split:
    """What came of a search: ``parts`` (counts for each need) if found; else whether there is none or the work limit was met."""

    status: str
    parts: list[np.ndarray] | None = None
    tried: int = 0


def split(values: np.ndarray, counts: np.ndarray, needs: list[int], slack: int, allowed: list[np.ndarray] | None = None) -> Split:
    """Disjoint choices that meet each need within ``slack``, by going back where a later need cannot be met.

    ``allowed`` has for each need the amounts that it may take. Needs are met
    from the one with the least to choose from; what is left after some needs
    is tried once. The status is found, none (all choices were seen) or limit.
    """
    masks = allowed or [np.ones(len(values), bool)] * len(needs)
    order = sorted(range(len(needs)), key=lambda k: (needs[k], k))
    together = [np.logical_or.reduce([masks[k] for k in order[at:]]) for at in range(len(order))]
    asked = [sum(needs[k] - slack for k in order[at:]) for at in range(len(order))]
    positive = bool((values > 0).all())
    failed: set[tuple[int, bytes]] = set()
    state = Split("none")

    def search(at: int, left: np.ndarray) -> list[np.ndarray] | None:
        if at == len(order):
            return []
        # What is left does not add up to the needs that are: no choice is worth trying.
        if positive and int((values * left)[together[at]].sum()) < asked[at]:
            return None
        if (at, left.tobytes()) in failed:
            return None
        # Nor if no choice is what all these needs together would leave.
        if positive:
            inside = np.flatnonzero(together[at] & (left > 0))
            over = int((values * left)[inside].sum()) - asked[at]
            if unreachable(values[inside], left[inside], over - 2 * slack * (len(order) - at), over):
                return None
        need, open_ = needs[order[at]], np.flatnonzero(masks[order[at]] & (left > 0))
        try:
            for some in subsets(values[open_], left[open_], need - slack, need + slack):
                state.tried += 1
                if state.tried > MOST_TRIES:
                    raise WorkLimit
                part = np.zeros(len(values), np.int64)
                part[open_] = some
                later = search(at + 1, left - part)
                if later is not None:
                    return [part, *later]
        except WorkLimit:
            state.status = "limit"
            return None
        failed.add((at, left.tobytes()))
        return None

    found = search(0, counts)
    if found is not None:
        parts: list[np.ndarray] = [counts] * len(needs)
        for k, part in zip(order, found, strict=True):
            parts[k] = part
        return Split("found", parts, state.tried)
    return state


def attribute(values: np.ndarray, counts: np.ndarray, targets: list[int], slack: int, allowed: list[np.ndarray] | None = None) -> tuple[list[np.ndarray | None], str, str, int]:
    """(parts, method, status, tried) of one group: for each credit the counts that it takes, or None.

    First each credit but one is met within ``slack`` and that one takes what
    is left, if it reaches the credit; the last credit is asked first. Next
    credits that no choice meets are left out and each of the others is met
    within ``slack``. Both are exact. Only then each credit takes, one after the
    other, the largest amounts that fit, and keeps them if they come within six
    per cent: the method says so, and the status, none or limit, says whether
    the exact search had seen all choices.
    """
    total, limited, tried = int((values * counts).sum()), False, 0
    if allowed is None and total >= sum(targets) - slack * len(targets):
        for rest in range(len(targets) - 1, -1, -1):
            others = [k for k in range(len(targets)) if k != rest]
            done = split(values, counts, [targets[k] for k in others], slack)
            tried, limited = tried + done.tried, limited or done.status == "limit"
            if done.parts is not None:
                left = counts - sum(done.parts, np.zeros(len(values), np.int64))
                if int((values * left).sum()) >= targets[rest] - slack:
                    parts: list[np.ndarray | None] = [left] * len(targets)
                    for k, part in zip(others, done.parts, strict=True):
                        parts[k] = part
                    return parts, "all", "found", tried
    masks = allowed or [np.ones(len(values), bool)] * len(targets)
    alone = [split(values, counts, [t], slack, [m]).status for t, m in zip(targets, masks, strict=True)]
    limited = limited or "limit" in alone
    able = [k for k, status in enumerate(alone) if status == "found"]
    if able:
        done = split(values, counts, [targets[k] for k in able], slack, [masks[k] for k in able])
        tried, limited = tried + done.tried, limited or done.status == "limit"
        if done.parts is not None:
            parts = [None] * len(targets)
            for k, part in zip(able, done.parts, strict=True):
                parts[k] = part
            return parts, "some", "found", tried
    left, parts = counts.copy(), [None] * len(targets)
    for k, target in enumerate(targets):
        room, part = target + slack, np.zeros(len(values), np.int64)
        for at in np.argsort(-values, kind="stable"):
            if masks[k][at] and values[at] > 0:
                part[at] = min(int(left[at]), max(0, room) // int(values[at]))
                room -= int(values[at] * part[at])
        if part.any() and int((values * part).sum()) >= target - target * 6 // 100 - 100:
            parts[k], left = part, left - part
    return parts, "greedy", "limit" if limited else "none", tried


def space(counts: np.ndarray) -> float:
    """Two's power of the number of choices among so many payments."""
    return sum(log2(c + 1) for c in counts.tolist())


#: Credits that are searched together; of more, earlier ones take theirs first.
WINDOW_CREDITS = 20


def attribute_in_windows(values: np.ndarray, counts: np.ndarray, targets: list[int], slack: int, allowed: list[np.ndarray] | None = None) -> list[tuple[int, list[np.ndarray | None], str, str, int]]:
    """(first credit, parts, method, status, tried) for each WINDOW_CREDITS credits in order, over what the windows before have left."""
    out, left = [], counts.copy()
    for begin in range(0, len(targets), WINDOW_CREDITS):
        end = begin + WINDOW_CREDITS
        masks = allowed[begin:end] if allowed is not None else None
        if masks is None and end < len(targets):
            # What is left belongs to the credits to come: none of these may take it.
            masks = [np.ones(len(values), bool)] * (min(end, len(targets)) - begin)
        parts, method, status, tried = attribute(values, left, targets[begin:end], slack, masks)
        for part in parts:
            left = left if part is None else left - part
        out.append((begin, parts, method, status, tried))
    return out
