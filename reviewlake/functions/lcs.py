"""Line alignment of two files on bit vectors.

Row i of the longest-common-subsequence table grows by 0 or 1 from column to
column, so a row is stored as one integer with a bit per column, and a row
follows from the one below it with a few whole-integer operations.  Memory is
bounded by keeping every k-th row and recomputing the block in between.

Where two lines differ, the bit at (i, j) already tells which neighbour is
better: no growth means skipping the right line loses nothing, and on a tie the
right line is taken as added first.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import zip_longest
from math import isqrt


class _Masks:
    """For a line of the left file, the columns of the right file it equals."""

    def __init__(self, right: list[str]):
        self.width = len(right)
        self.full = (1 << self.width) - 1
        self.at = defaultdict(list)
        for j, line in enumerate(right):
            self.at[line].append(self.width - 1 - j)
        # Only lines that repeat often are worth keeping as a mask.
        self.frequent = max(8, isqrt(self.width))
        self.kept = {}

    def __getitem__(self, line: str) -> int:
        bits = self.at.get(line)
        if not bits:
            return 0
        mask = self.kept.get(line)
        if mask is None:
            packed = bytearray(self.width // 8 + 1)
            for p in bits:
                packed[p >> 3] |= 1 << (p & 7)
            mask = int.from_bytes(packed, "little")
            if len(bits) >= self.frequent:
                self.kept[line] = mask
        return mask


def _row_above(row: int, mask: int, full: int) -> int:
    hit = row & mask
    return ((row + hit) | (row - hit)) & full


def _rows(left: list[str], masks: _Masks) -> Iterator[int]:
    """Rows 0, 1, 2, ... of the table; a set bit means no growth at that column."""
    n = len(left)
    step = isqrt(n) + 1
    marks = {}
    row = masks.full
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i + 1] = row
        row = _row_above(row, masks[left[i]], masks.full)
    start = 0
    while start < n:
        end = min(n, (start // step + 1) * step)
        row = marks[end]
        block = []
        for i in range(end - 1, start - 1, -1):
            row = _row_above(row, masks[left[i]], masks.full)
            block.append(row)
        yield from reversed(block)
        start = end


def _paired(removed: list[int], added: list[int]) -> Iterator[tuple]:
    return ((False, i, j) for i, j in zip_longest(removed, added))


def align(left: list[str], right: list[str]) -> Iterator[tuple[bool, int | None, int | None]]:
    """Rows (same, left index, right index) of the two files side by side.

    Runs of removed and added lines between equal ones are paired in order.
    """
    shared = 0
    for a, b in zip(left, right):
        if a != b:
            break
        yield True, shared, shared
        shared += 1
    left, right = left[shared:], right[shared:]
    masks = _Masks(right)
    rows = _rows(left, masks)
    m = len(right)
    j = 0
    removed, added = [], []
    for i, line in enumerate(left):
        row = next(rows)
        # Added lines in front of line i, as long as skipping them is no loss.
        while j < m and right[j] != line and row >> (m - 1 - j) & 1:
            added.append(shared + j)
            j += 1
        if j < m and right[j] == line:
            yield from _paired(removed, added)
            removed, added = [], []
            yield True, shared + i, shared + j
            j += 1
        else:
            removed.append(shared + i)
    added.extend(range(shared + j, shared + m))
    yield from _paired(removed, added)
