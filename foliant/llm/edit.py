"""The Levenshtein metric, bounded, and structures that use its triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator


def levenshtein(a: str, b: str) -> int:
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = i - 1, i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def within(a: str, b: str, radius: int) -> bool:
    """Whether the distance is at most ``radius``; only the diagonals that can matter are filled."""
    if abs(len(a) - len(b)) > radius:
        return False
    if a == b:
        return True
    far = radius + 1
    row = [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - radius), min(len(b), i + radius)
        diagonal = row[lo - 1]
        row[lo - 1] = i if lo == 1 and i <= far else far
        best = row[lo - 1]
        for j in range(lo, hi + 1):
            up = row[j] if j < i + radius else far
            diagonal, row[j] = row[j], min(up + 1, row[j - 1] + 1, diagonal + (x != b[j - 1]), far)
            best = min(best, row[j])
        if best > radius:
            return False
    return row[len(b)] <= radius


def segments(s: str, radius: int) -> list[tuple[int, int, str]]:
    """``s`` cut into ``radius`` + 1 pieces of about the same size: (length of s, number of the piece, piece)."""
    n = len(s)
    cuts = [n * i // (radius + 1) for i in range(radius + 2)]
    return [(n, i, s[cuts[i] : cuts[i + 1]]) for i in range(radius + 1)]


def probes(s: str, radius: int) -> set[tuple[int, int, str]]:
    """The segments that a string within ``radius`` of ``s`` may have in common with it; at least one of its segments is among these.

    ``radius`` edits leave one of ``radius`` + 1 pieces untouched. A piece with i pieces before it and k behind that is moved by more than i has
    more than i edits before it, so that another piece further back is untouched, and likewise from the other end: only places moved by at
    most i against the start and k against the end need be looked at."""
    n, out = len(s), set()
    for length in range(max(n - radius, 0), n + radius + 1):
        for i in range(radius + 1):
            a, b = length * i // (radius + 1), length * (i + 1) // (radius + 1)
            shift = n - length
            for p in range(max(a - i, a + shift - (radius - i), 0), min(a + i, a + shift + (radius - i), n - (b - a)) + 1):
                out.add((length, i, s[p : p + b - a]))
    return out


class BKTree:
    """Reference strings under the Levenshtein metric; a search visits only children whose edge can hold an entry within the radius.

    Nodes are numbered and kept side by side, so a tree of any depth can be written and read back."""

    def __init__(self) -> None:
        self.keys: list[str] = []
        self.values: list[list] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: str, value: object) -> None:
        at = 0
        while at < len(self.keys):
            d = levenshtein(key, self.keys[at])
            if d == 0:
                self.values[at].append(value)
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.keys)
                break
            at = self.children[at][d]
        self.keys.append(key)
        self.values.append([value])
        self.children.append({})

    def search(self, key: str, radius: int) -> Iterator[tuple[int, str, list]]:
        """Every (distance, key, values) within the radius."""
        todo = [0] if self.keys else []
        while todo:
            at = todo.pop()
            d = levenshtein(key, self.keys[at])
            if d <= radius:
                yield d, self.keys[at], self.values[at]
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
