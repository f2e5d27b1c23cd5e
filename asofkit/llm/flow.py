"""Min-cost flow with integer capacities, by successive shortest paths with potentials."""

from __future__ import annotations

import heapq
from collections import deque


class Network:
    """Arcs are added one by one and known by their number; nodes are any hashable values."""

    def __init__(self) -> None:
        self.nodes: dict = {}
        self.out: list[list[int]] = []
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def node(self, name) -> int:
        if name not in self.nodes:
            self.nodes[name] = len(self.out)
            self.out.append([])
        return self.nodes[name]

    def arc(self, a, b, room: int, cost: float) -> int:
        """A new arc, whose number is returned; its reverse has the next number."""
        number = len(self.head)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[self.node(x)].append(len(self.head))
            self.head.append(self.node(y))
            self.room.append(int(r))
            self.cost.append(float(c))
        return number

    def used(self, number: int) -> int:
        return self.room[number + 1]

    def _potentials(self, start: int) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[start], queue, waiting = 0.0, deque([start]), {start}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for k in self.out[x]:
                if self.room[k] and far[x] + self.cost[k] < far[self.head[k]] - 1e-9:
                    far[self.head[k]] = far[x] + self.cost[k]
                    if self.head[k] not in waiting:
                        waiting.add(self.head[k])
                        queue.append(self.head[k])
        return far

    def send(self, a, b, amount: int, while_gaining: bool = False) -> int:
        """Sends up to `amount` from a to b at least cost; the flow that got through. Costs may be negative, cycles of negative cost not.

        With `while_gaining` it ends where the next unit would cost 0 or more.
        """
        start, end, sent = self.node(a), self.node(b), 0
        level = [0.0 if x == float("inf") else x for x in self._potentials(start)]
        while sent < amount:
            far = [float("inf")] * len(self.out)
            by = [-1] * len(self.out)
            far[start], heap = 0.0, [(0.0, start)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for k in self.out[x]:
                    if self.room[k]:
                        y = self.head[k]
                        to = d + max(0.0, self.cost[k] + level[x] - level[y])
                        if to < far[y] - 1e-12:
                            far[y], by[y] = to, k
                            heapq.heappush(heap, (to, y))
            if by[end] < 0:
                break
            level = [p + (d if d < float("inf") else 0.0) for p, d in zip(level, far)]
            if while_gaining and level[end] - level[start] >= -1e-9:
                break
            some, y = amount - sent, end
            while y != start:
                some = min(some, self.room[by[y]])
                y = self.head[by[y] ^ 1]
            y = end
            while y != start:
                self.room[by[y]] -= some
                self.room[by[y] ^ 1] += some
                y = self.head[by[y] ^ 1]
            sent += some
        return sent
