"""Line-by-line differences of text pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablechange.functions.render import field

_UNSET = -1 << 40
NEAR = 64  # steps from each end after which texts are split by bit vectors
_MASK_BYTES = 1 << 26


def _middle(a: list[int], b: list[int], most: int) -> tuple[int, int, int, int] | None:
    """Start and end of a run of equal items in the middle of a shortest edit path (Myers 1986),
    found by searching from both ends at once, so memory stays linear. None if they do not meet within ``most`` steps."""
    n, m = len(a), len(b)
    delta = n - m
    odd = delta % 2 != 0
    ahead: dict[int, int] = {}
    behind: dict[int, int] = {}
    for d in range(min(most, (n + m + 1) // 2) + 1):
        for forward in (True, False):
            mine, other = (ahead, behind) if forward else (behind, ahead)
            for k in range(-d, d + 1, 2):
                down, right = mine.get(k + 1, _UNSET), mine.get(k - 1, _UNSET)
                x = max(down, right + 1) if d else 0
                y = x - k
                if x < 0 or x > n or y < 0 or y > m:
                    mine[k] = _UNSET
                    continue
                x0, y0 = x, y
                if forward:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                mine[k] = x
                if odd == forward and x + other.get(delta - k, _UNSET) >= n and abs(delta - k) <= (d - 1 if forward else d):
                    return (x0, y0, x, y) if forward else (n - x, m - y, n - x0, m - y0)
    return None


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The lengths of longest common subsequences of ``a`` and each beginning of ``b``, the empty one first.

    A row of the table is one whole number, a bit per item of ``b`` (Hyyro 2004): a step takes a few operations
    on it, so items cost a 64th of a cell each. The places of an item are turned into bits when it
    comes up; what is kept of them is bounded.
    """
    m = len(b)
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict[int, int] = {}
    full = row = (1 << m) - 1
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        mask = masks.get(x)
        if mask is None:
            if len(at) == 1:
                mask = 1 << at[0]
            else:
                bits = bytearray((m >> 3) + 1)
                for j in at:
                    bits[j >> 3] |= 1 << (j & 7)
                mask = int.from_bytes(bits, "little")
                if (len(masks) + 1) * (m >> 3) < _MASK_BYTES:
                    masks[x] = mask
        both = row & mask
        row = ((row + both) | (row ^ both)) & full
    rises = 1 - np.unpackbits(np.frombuffer(row.to_bytes((m >> 3) + 1, "little"), np.uint8), bitorder="little")[:m].astype(np.int64)
    return np.concatenate([[0], np.cumsum(rises)])


def _split(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A place on a shortest edit path, as ``_middle`` gives it, by halving the shorter side (Hirschberg 1975)."""
    if len(a) > len(b):
        y0, x0, y1, x1 = _split(b, a)
        return x0, y0, x1, y1
    if len(a) == 1:
        if a[0] not in b:
            return 1, 0, 1, 0
        y = b.index(a[0])
        return 0, y, 1, y + 1
    x = len(a) // 2
    y = int(np.argmax(_lengths(a[:x], b) + _lengths(a[: x - 1 : -1], b[::-1])[::-1]))
    return x, y, x, y


def equal_items(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order. Near texts are searched from both ends; texts that
    differ much are halved by bit vectors, so a whole rewrite is not quadratic in steps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        x0, y0, x1, y1 = _middle(a[i:ie], b[j:je], NEAR) or _split(a[i:ie], b[j:je])
        out.extend((i + x0 + t, j + y0 + t) for t in range(x1 - x0))
        todo += [(i, i + x0, j, j + y0), (i + x1, ie, j + y1, je)]
    return sorted(out)


def edit_script(old: str, new: str) -> list[tuple[str, int | None, int | None, str]]:
    """``(tag, old line number, new line number, line)`` turning ``old`` into ``new``; inside a
    changed stretch deletes come before inserts. Lines are what lies between newlines, so joining
    them by newlines gives the text back."""
    a, b = old.split("\n"), new.split("\n")
    ids: dict[str, int] = {}
    ia, ib = [ids.setdefault(x, len(ids)) for x in a], [ids.setdefault(x, len(ids)) for x in b]
    # a line that occurs on one side only is in no common subsequence
    in_a, in_b = set(ia), set(ib)
    ka, kb = [i for i, x in enumerate(ia) if x in in_b], [j for j, x in enumerate(ib) if x in in_a]
    equal = [(ka[i], kb[j]) for i, j in equal_items([ia[i] for i in ka], [ib[j] for j in kb])]
    out, i, j = [], 0, 0
    for x, y in [*equal, (len(a), len(b))]:
        out += [("delete", t + 1, None, a[t]) for t in range(i, x)]
        out += [("insert", None, t + 1, b[t]) for t in range(j, y)]
        if x < len(a):
            out.append(("equal", x + 1, y + 1, a[x]))
        i, j = x + 1, y + 1
    return out


def line_diff(pairs: DataFrame, id_col: str, old: str, new: str, with_same: bool = False) -> DataFrame:
    """``(id, pos, tag, old_line_no, new_line_no, line)``: a shortest line edit script per pair.

    Pairs of equal texts are removed before Python sees them, unless ``with_same`` asks for their
    lines. A missing text counts as empty. Each pair is independent, so Spark spreads them freely.
    """
    names = ["id", "pos", "tag", "old_line_no", "new_line_no", "line"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, was, now in batch.itertuples(index=False):
                script = edit_script(was, now)
                rows += [(key, pos, tag, x, y, line) for pos, (tag, x, y, line) in enumerate(script, start=1)]
                if len(rows) > 50000:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)

    texts = pairs.select(field(id_col).alias("id"), F.coalesce(field(old), F.lit("")).alias("o"), F.coalesce(field(new), F.lit("")).alias("n"))
    if not with_same:
        texts = texts.filter(F.col("o") != F.col("n"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, pos int, tag string, old_line_no int, new_line_no int, line string")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"old_line_no": "Int32", "new_line_no": "Int32"})


def side_by_side(lines: DataFrame) -> DataFrame:
    """``(id, pos, left, right)``: both texts aligned, with ``"  "``, ``"- "`` and ``"+ "`` in
    front, and blank opposite a line of one side."""
    tag, line = F.col("tag"), F.col("line")
    same = F.concat(F.lit("  "), line)
    left = F.when(tag == "equal", same).when(tag == "delete", F.concat(F.lit("- "), line)).otherwise("")
    right = F.when(tag == "equal", same).when(tag == "insert", F.concat(F.lit("+ "), line)).otherwise("")
    return lines.select("id", "pos", left.alias("left"), right.alias("right"))
