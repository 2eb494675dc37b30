"""Edit distance up to a limit, by bit-parallel computation inside a diagonal band."""

from __future__ import annotations


def within(a: str, b: str, limit: int) -> bool:
    """Whether insertions, deletions and substitutions of at most ``limit`` code
    points turn ``a`` into ``b``."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    n = len(a)
    front = _common(a, b, n)
    back = _common(a[front:][::-1], b[front:][::-1], n - front)
    a, b = a[front:n - back], b[front:len(b) - back]
    return not a or banded(a, b, limit) <= limit


def _common(a: str, b: str, n: int) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def banded(a: str, b: str, limit: int) -> int:
    """Distance of ``a`` and ``b`` if it is at most ``limit``, else more than ``limit``.

    Column j of the matrix is kept for the rows j - limit to j + limit: bit r stands
    for row j - limit + r.  ``up`` and ``down`` mark where the value rises or falls
    from the row above; the band moves one row down with every column, so the
    diagonal differences take the place of the shifted horizontal ones.  ``value``
    is the distance at the band's last row, then along the last row of ``a``.
    """
    m, width = len(a), 2 * limit + 1
    whole, last = (1 << width) - 1, 1 << 2 * limit
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # Column 0, seen from the band of column 1: rows 1 - limit to 1 + limit; rows from 1 on rise.
    up, down = whole & ~((1 << limit) - 1), 0
    value = min(limit, m)
    for j, c in enumerate(b, 1):
        at = where.get(c, 0)
        low = j - limit - 1  # bit r stands for the symbol a[low + r]
        match = (at >> low if low >= 0 else at << -low) & whole
        x = match | down
        diagonal = (((x & up) + up) ^ up | x) & whole
        rises, falls = down | whole & ~(up | diagonal), up & diagonal
        row = j + limit  # of the last bit
        if row <= m:
            value += not diagonal & last
        else:
            if m < j - limit:
                return limit + 1
            bit = 1 << m - j + limit
            value += bool(rises & bit) - bool(falls & bit)
        if value > 2 * limit + 1:
            return limit + 1
        below = diagonal >> 1
        up, down = falls | whole & ~(below | rises), rises & below
    return value
