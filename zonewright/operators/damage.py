"""Which characters a zone's check digits leave for one unknown place of one of its lines.

All checks of a format are linear modulo 10: a weight for each place of each line, -1 for the check digit's own, and a sum that must vanish. So a line with a
place unknown has, for each check, a sum over the places known, and each check that covers the unknown one demands a residue there; only the characters
in the intersection of these demands are readings at all. A lost character is a place unknown between any two others, with all behind it shifted; an
exchange is a line without an unknown place, whose sums must vanish as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from ..functions.checksum import DIGIT_FROM, DIGIT_TO, LETTER_FROM, LETTER_TO, WEIGHTS
from ..schemas import ALPHABET, Layout
from .solve import ALTERNATIVES

_CODE = {c: i for i, c in enumerate(ALPHABET)}
#: Residues by code; the last code is the unknown place.
_RESIDUE = np.array([i % 36 % 10 for i in range(37)] + [0], np.int64)
_UNDO = np.array([0, 1, 0, 7, 0, 0, 0, 3, 0, 9])
#: What a place makes of a character before it is checked: nothing, or a digit or letter of it.
_READ = {None: str.maketrans("", ""), "digit": str.maketrans(DIGIT_FROM, DIGIT_TO), "letter": str.maketrans(LETTER_FROM, LETTER_TO)}
#: Characters that filler repairs look at; all others are alike to them, and MARK stands for those.
_FILLING, MARK = "KL<", "A"
#: By how a place reads: residue to the characters that have it there.
_CLASSES = {kind: [[c for c in ALPHABET if _CODE[c.translate(t)] % 36 % 10 == r] for r in range(10)] for kind, t in _READ.items()}


@lru_cache(None)
def weights(f: Layout) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
    """For each line a matrix of places by checks, the document number's first, and the places of check digits."""
    checks = [([f.number], f.number_check), ([f.birth], (f.birth[0], f.birth[2], f.birth[2] + 1)), ([f.expiry], (f.expiry[0], f.expiry[2], f.expiry[2] + 1))]
    checks += [([f.optional[0]], f.personal_check)] if f.personal_check else []
    checks += [(list(f.composite[0]), f.composite[1])] if f.composite else []
    out, digits = [np.zeros((f.width, len(checks)), np.int64) for _ in range(f.lines)], [set() for _ in range(f.lines)]
    for k, (spans, own) in enumerate(checks):
        places = [(line, i) for line, a, b in spans for i in range(a, b)]
        for n, (line, i) in enumerate(places):
            out[line][i, k] += WEIGHTS[n % 3]
        out[own[0]][own[1], k] += 9
        digits[own[0]].add(own[1])
    return [w % 10 for w in out], [tuple(sorted(d)) for d in digits]


_BYTES = np.full(256, 37, np.int64)
_BYTES[np.frombuffer(ALPHABET.encode(), np.uint8)] = range(37)


def codes(lines: list[str]) -> np.ndarray:
    """Of lines of one length."""
    return _BYTES[np.frombuffer("".join(lines).encode("latin-1", "replace"), np.uint8)].reshape(len(lines), -1)


class Line:
    """Readings of one line of a format: their sums by check, those that no check digit excludes, and those whose number may go on in another field."""

    def __init__(self, f: Layout, line: int, readings: list[str], holes: list[int] | None = None):
        w, digits = weights(f)
        self.readings = readings
        c = codes(readings) if readings else np.zeros((0, f.width), np.int64)
        self.sums = _RESIDUE[c] @ w[line] % 10
        self.legal = np.all([(c[:, i] < 10) | (c[:, i] >= 36) for i in digits[line]], axis=0) if digits[line] else np.ones(len(c), bool)
        own = f.number_check
        self.open = (c[:, own[1]] >= 36) if f.overflow and own[0] == line else np.zeros(len(c), bool)
        at = np.array(holes if holes is not None else [-1] * len(readings), np.int64)
        self.holes = np.where(at[:, None] >= 0, w[line][at], 0) if len(at) else np.zeros((0, self.sums.shape[1]), np.int64)


def _kind(f: Layout, line: int, place: int) -> str | None:
    return next((kind for a, b, kind in f.repairs[line] if kind in ("digit", "letter") and a <= place < b), None)


class Damaged(Line):
    """Readings of a line with one lost or confused character, each with its rank among all of them: place, character, whether it is left unrepaired."""

    def __init__(self, n: str, f: Layout, line: int, lost: bool, repair: Callable[[str, Layout, int], str]):
        rows: list[tuple[str, int, str | None, tuple]] = []  # reading, unknown place or -1, how that place reads, rank
        if lost:
            for i in range(len(n) + 1):
                fill = lambda c: n[:i] + c + n[i:]  # noqa: B023, E731
                hole = lambda s: s[:i] + "?" + s[i + 1 :]  # noqa: B023, E731
                rows.append((hole(repair(fill(MARK), f, line)), i, _kind(f, line, i), (i, 0)))
                rows.append((hole(fill(MARK)), i, None, (i, 1)))
                rows += [(repair(fill(c), f, line), -1, None, (i, 0, _CODE[c])) for c in _FILLING]
        else:
            for i, old in enumerate(n):
                for k, c in enumerate(ALTERNATIVES.get(old, "")):
                    x = n[:i] + c + n[i + 1 :]
                    rows += [(repair(x, f, line), -1, None, (i, 0, k)), (x, -1, None, (i, 1, k))]
        super().__init__(f, line, [r[0] for r in rows], [r[1] for r in rows])
        self.rows = rows

    def fitting(self, others: list[tuple[Line, int]]) -> Iterator[tuple[tuple[int, int, int], str]]:
        """(rank, reading) of those that the checks leave beside readings of the other lines; a number that may go on elsewhere isn't held to its own digit."""
        if not len(self.sums) or not all(o.legal[k] for o, k in others):
            return
        need = (-sum((o.sums[k] for o, k in others), self.sums)) % 10
        free = self.open | any(o.open[k] for o, k in others)
        ok = (need == 0) | (self.holes != 0)
        ok[:, 0] |= free
        for j in np.flatnonzero(ok.all(1) & self.legal):
            text, i, kind, rank = self.rows[j]
            if i < 0:
                yield (rank[0], rank[2], rank[1]), text
                continue
            bound = [k for k in np.flatnonzero(self.holes[j]) if k or not free[j]]
            residues = {int(need[j, k] * _UNDO[self.holes[j, k]] % 10) for k in bound}
            if len(residues) > 1:
                continue
            repaired = rank[1] == 0
            for c in _CLASSES[kind][residues.pop()] if residues else ALPHABET:
                if not (repaired and c in _FILLING):
                    yield (i, _CODE[c], rank[1]), text[:i] + c.translate(_READ[kind]) + text[i + 1 :]
