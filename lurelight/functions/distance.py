"""Optimal string alignment within one or two edits, by built-in functions.

Insertions, deletions, substitutions and swaps of neighbours cost one each, and
no swapped pair is edited again. ``levenshtein`` lacks swaps; within small bounds
a swap leaves everything on one side of it equal, so closed forms suffice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 255  # longer strings never match


def _near(a: Column, b: Column, k: int) -> Column:
    """Levenshtein distance of at most k: past its limit the function gives -1."""
    return F.levenshtein(a, b, k) >= 0


def _swapped_at(a: Column, b: Column, i: Column, j: Column) -> Column:
    """a[i], a[i+1] = b[j+1], b[j]; places from 1."""
    one = F.lit(1)
    return (F.substr(a, i, one) == F.substr(b, j + 1, one)) & (F.substr(a, i + 1, one) == F.substr(b, j, one))


def within_one(a: Column, b: Column) -> Column:
    n = F.length(a)
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: _swapped_at(a, b, i, i) & (F.substr(a, i + 2) == F.substr(b, i + 2)) & (F.left(a, i - 1) == F.left(b, i - 1)) & (n > 1),
    )
    return _near(a, b, 1) | ((n == F.length(b)) & _near(a, b, 2) & swap)  # a swap is two edits without swaps


def within_two(a: Column, b: Column) -> Column:
    """Two edits without a swap; or a swap with all equal on its left or right,
    and one more edit on the other side."""
    n, m = F.length(a), F.length(b)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    left = F.exists(places, lambda i: _swapped_at(a, b, i, i) & (F.left(a, i - 1) == F.left(b, i - 1)) & within_one(F.substr(a, i + 2), F.substr(b, i + 2)))

    def mirrored(i: Column) -> Column:
        j = i + m - n
        return (j >= 1) & _swapped_at(a, b, i, j) & (F.substr(a, i + 2) == F.substr(b, j + 2)) & within_one(F.left(a, i - 1), F.left(b, j - 1))

    right = F.exists(places, mirrored)
    return _near(a, b, 2) | ((n > 1) & (m > 1) & (F.abs(n - m) <= 1) & _near(a, b, 4) & (left | right))


def within(a: Column, b: Column, k: int) -> Column:
    short = (F.length(a) < LONGEST) & (F.length(b) < LONGEST)
    if k <= 0:
        return a == b
    if k > 2:
        raise ValueError("at most two edits")
    return (a == b) | (short & (within_one(a, b) if k == 1 else within_two(a, b)))


def missing(token: Column, label: Column) -> Column:
    """Characters of the token that the label lacks altogether; each costs an edit."""
    return F.length(F.call_function("translate", token, label, F.lit("")))


def window_within(label: Column, token: Column, k: int) -> Column:
    """Whether some substring of the label is within k edits of the token; for
    k = 0, whether the label contains it."""
    if k <= 0:
        return (token != "") & (F.instr(label, token) > 0)
    n, t = F.length(label), F.length(token)
    widths = F.sequence(F.greatest(F.lit(1), t - k), F.greatest(F.least(n, t + k), F.greatest(F.lit(1), t - k)))
    found = F.exists(widths, lambda w: (w <= n) & F.exists(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: within(F.substr(label, i, w), token, k)))
    # the cheap tests first: most labels lack too many of the token's characters
    return F.when((label == "") | (token == "") | (n < t - k) | (missing(token, label) > k), False).otherwise(found)


def traces(token: str, k: int) -> list[list[str]]:
    """Parts of the token of which one list must be whole in any text that holds
    the token within k edits. Of k + 1 pieces one survives k edits, but for swaps
    across a boundary, which spoil the ends of both pieces; then the rest of
    those two pieces is there (or, with two such swaps, of all three)."""
    if k <= 0 or k > 2:
        return [[token]] if k <= 0 else []
    n = len(token)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    p = [token[a:b] for a, b in zip(cuts, cuts[1:])]
    out = [[x] for x in p] + [[a[:-1], b[1:]] for a, b in zip(p, p[1:])]
    return out + ([[p[0][:-1], p[1][1:-1], p[2][1:]]] if k == 2 else [])


def may_hold(text: Column, lists: Column) -> Column:
    """Whether the text holds all parts of one of the lists."""
    return F.exists(lists, lambda parts: F.forall(parts, lambda p: F.instr(text, p) > 0))
