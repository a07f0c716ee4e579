"""Texts that stand in stacks: an ordered sweep down a slide with few open stacks.

A line joins the stack that fits best, so lines are taken in reading order. A
stack stays open only while a line below could still reach it; open stacks are
found by cells of their left edge, and the medians of a stack are kept while it
grows. The work is linear in the lines of a slide, not lines times stacks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass


class RunningMedian:
    """The median of what was added, from the larger half of the small values and the smaller half of the large ones."""

    def __init__(self) -> None:
        self.low: list = []
        self.high: list = []

    def add(self, value) -> None:
        heapq.heappush(self.low, -heapq.heappushpop(self.high, value))
        if len(self.low) > len(self.high):
            heapq.heappush(self.high, -heapq.heappop(self.low))

    def value(self) -> float:
        top = self.high[0]
        return float(top) if len(self.high) > len(self.low) else (top - self.low[0]) / 2.0


@dataclass(frozen=True)
class StackRule:
    """What makes a line fit a stack. Pairs are (pixels, share of a height); the larger of both counts."""

    #: how far left edges may lie apart, by the stack's own height or by the taller of stack and line
    edge: tuple[int, float]
    edge_by_taller: bool
    #: how far the line may lie below the last one, measured from its top or its bottom
    reach: tuple[int, float]
    from_top: bool
    #: how much it may overlap the last line
    overlap: tuple[int, float]
    #: width of the line over that of the stack
    widths: tuple[float, float]
    #: how far a stack may extend, by the height of the image
    extent: tuple[int, float] | None
    #: cost of the distance below, beyond this share of the taller height; cost of a different width
    distance_cost: tuple[float, float]
    width_cost: float
    #: medians as whole pixels
    whole: bool


# Limits of the rules.
LIST_RULE = StackRule(
    edge=(24, 0.95), edge_by_taller=False, reach=(72, 2.3), from_top=False, overlap=(6, 0.35), widths=(0.55, 1.7),
    extent=(220, 0.45), distance_cost=(0.0, 0.22), width_cost=12.0, whole=False)
ENTRY_RULE = StackRule(
    edge=(18, 0.9), edge_by_taller=True, reach=(34, 3.5), from_top=True, overlap=(6, 0.35), widths=(0.45, 2.4),
    extent=None, distance_cost=(2.2, 1.0), width_cost=0.0, whole=True)


class _Stack:
    def __init__(self, top: int) -> None:
        self.top, self.last = top, None
        self.lefts, self.heights, self.widths = RunningMedian(), RunningMedian(), RunningMedian()


class StackSweep:
    """Number of the stack of each line of a slide; lines come from top to bottom."""

    def __init__(self, rule: StackRule) -> None:
        self.rule, self.stacks = rule, []
        self.cells: dict[int, set[int]] = defaultdict(set)
        #: (y from which a stack is out of reach, its number, how many lines it had)
        self.due: list[tuple[float, int, int]] = []
        self.sizes: list[int] = []
        self.places: list[int] = []

    def _limit(self, pair: tuple[int, float], height: float) -> float:
        scaled = height * pair[1]
        return max(pair[0], round(scaled) if self.rule.whole else scaled)

    def _medians(self, stack: _Stack) -> tuple[float, float, float]:
        x, h, w = stack.lefts.value(), stack.heights.value(), stack.widths.value()
        if self.rule.whole:
            x, h, w = round(x), round(h), round(w)
        return x, max(1, h), max(1, w)

    def cost(self, stack: _Stack, x: int, y: int, w: int, h: int, image_h: int) -> float | None:
        """What joining costs, None where the line does not fit."""
        rule, (mid_x, mid_h, mid_w) = self.rule, self._medians(stack)
        above, high = stack.last
        taller, apart, relative = max(mid_h, h), abs(x - mid_x), w / mid_w
        below = y - above if rule.from_top else y - above - high
        edge = self._limit(rule.edge, taller if rule.edge_by_taller else mid_h)
        limits = [
            (apart, 0, edge), (below, None, max(rule.reach[0], round(taller * rule.reach[1]))), (y - above, 0, None),
            (y - above - high, -max(rule.overlap[0], round(min(mid_h, h) * rule.overlap[1])), None), (relative, *rule.widths),
        ]
        if rule.extent:
            limits.append((y - stack.top, None, max(rule.extent[0], round(image_h * rule.extent[1]))))
        if any((low is not None and v < low) or (high_ is not None and v > high_) for v, low, high_ in limits):
            return None
        free, price = rule.distance_cost
        return apart + max(0, below - round(taller * free)) * price + abs(relative - 1.0) * rule.width_cost

    def place(self, x: int, y: int, w: int, h: int, image_h: int, tallest: int, may_join: bool = True) -> int:
        rule, wide = self.rule, max(1, self._limit(self.rule.edge, tallest))
        while self.due and self.due[0][0] < y:
            _y, number, size = heapq.heappop(self.due)
            if self.sizes[number] == size:
                self.cells[self.places[number]].discard(number)
        best = None
        if may_join:
            near = int(x // wide)
            for cell in (near - 1, near, near + 1):
                for number in self.cells.get(cell, ()):
                    cost = self.cost(self.stacks[number], x, y, w, h, image_h)
                    if cost is not None and (best is None or (cost, number) < best):
                        best = (cost, number)
        if best is None:
            number = len(self.stacks)
            self.stacks.append(_Stack(y))
            self.sizes.append(0)
            self.places.append(0)
        else:
            number = best[1]
            self.cells[self.places[number]].discard(number)
        stack = self.stacks[number]
        for median, value in ((stack.lefts, x), (stack.heights, h), (stack.widths, w)):
            median.add(value)
        stack.top, stack.last = min(stack.top, y), (y, h)
        self.sizes[number] += 1
        self.places[number] = int(self._medians(stack)[0] // wide)
        self.cells[self.places[number]].add(number)
        origin = y if rule.from_top else y + h
        heapq.heappush(self.due, (origin + max(rule.reach[0], round(max(tallest, 1) * rule.reach[1])), number, self.sizes[number]))
        return number + 1
