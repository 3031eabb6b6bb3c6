"""Line differences of two texts (TXT9): Myers' algorithm in linear space, as unified hunks.

Lines that the other side lacks take part in no match and are set aside first; of the rest the middle snake of a
shortest edit script splits the work in two, so memory is a few numbers a line however many lines differ. Time is
the lines times the edits between the lines that both sides have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import rows


def _middle(a: Sequence[int], b: Sequence[int], low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int, int, int]:
    """The two ends of a middle snake of the box, as places in a and b."""
    n, m = high[0] - low[0], high[1] - low[1]
    delta, size = n - m, n + m + 3
    ahead, back = [0] * size, [0] * size  # by diagonal, negative ones from the end
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            start = x
            while x < n and x - k < m and a[low[0] + x] == b[low[1] + x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and -d < delta - k < d and x + back[delta - k] >= n:
                return low[0] + start, low[1] + start - k, low[0] + x, low[1] + x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            start = x
            while x < n and x - k < m and a[high[0] - 1 - x] == b[high[1] - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta % 2 and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return high[0] - x, high[1] - x + k, high[0] - start, high[1] - start + k
    raise AssertionError("a shortest script has a middle")


def changed(a: Sequence[str], b: Sequence[str]) -> tuple[list[bool], list[bool]]:
    """Which lines of a go and which of b come, in a shortest script."""
    gone, new = [True] * len(a), [True] * len(b)
    names = {line: i for i, line in enumerate(set(a) & set(b))}
    at_a, at_b = ([i for i, line in enumerate(x) if line in names] for x in (a, b))
    u, v = [names[a[i]] for i in at_a], [names[b[i]] for i in at_b]
    work = [(0, 0, len(u), len(v))]
    while work:
        x, y, p, q = work.pop()
        while x < p and y < q and u[x] == v[y]:
            gone[at_a[x]] = new[at_b[y]] = False
            x, y = x + 1, y + 1
        while x < p and y < q and u[p - 1] == v[q - 1]:
            p, q = p - 1, q - 1
            gone[at_a[p]] = new[at_b[q]] = False
        if x < p and y < q:
            left, top, right, bottom = _middle(u, v, (x, y), (p, q))
            for i in range(right - left):
                gone[at_a[left + i]] = new[at_b[top + i]] = False
            work += [(x, y, left, top), (right, bottom, p, q)]
    return gone, new


def hunks(a: Sequence[str], b: Sequence[str], context: int = 3) -> list[str]:
    """The lines of a unified difference without file names; none for equal texts."""
    gone, new = changed(a, b)
    steps, i, j = [], 0, 0  # sign, place in a, place in b
    while i < len(a) or j < len(b):
        if i < len(a) and gone[i]:
            steps.append(("-", i, j))
            i += 1
        elif j < len(b) and new[j]:
            steps.append(("+", i, j))
            j += 1
        else:
            steps.append((" ", i, j))
            i, j = i + 1, j + 1
    edits = [k for k, s in enumerate(steps) if s[0] != " "]
    out, at = [], 0
    while at < len(edits):
        last = at
        while last + 1 < len(edits) and edits[last + 1] - edits[last] <= 2 * context + 1:
            last += 1
        part = steps[max(0, edits[at] - context) : edits[last] + context + 1]
        sizes = [sum(s[0] in kinds for s in part) for kinds in (" -", " +")]
        where = [f"{s + (n > 0)}" + ("" if n == 1 else f",{n}") for s, n in zip(part[0][1:], sizes)]
        out.append(f"@@ -{where[0]} +{where[1]} @@")
        out += [sign + (b[q] if sign == "+" else a[p]) for sign, p, q in part]
        at = last + 1
    return out


def lines_of(text: str) -> list[str]:
    """Lines by line feed; a last line feed ends the last line and begins none."""
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


DIFFERENCE = T.StructType([T.StructField("removed", T.IntegerType()), T.StructField("added", T.IntegerType()), T.StructField("hunks", T.IntegerType()), T.StructField("diff", T.StringType())])


def difference(left: Column, right: Column, context: int = 3) -> Column:
    """TXT9's evidence: struct(removed, added, hunks, diff) of two texts' lines; null where either is null."""

    def one(a: str | None, b: str | None) -> dict:
        found = [] if a is None or b is None else hunks(lines_of(a), lines_of(b), context)
        sign = [line[0] for line in found]
        return {"removed": sign.count("-"), "added": sign.count("+"), "hunks": sign.count("@"), "diff": "\n".join(found)}

    return F.when(left.isNotNull() & right.isNotNull(), rows.of_two_texts(DIFFERENCE, one)(left, right))
