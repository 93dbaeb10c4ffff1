"""Problem 6: pieces under a size limit, cut at natural boundaries.

Method. Dynamic programming over all boundary positions: the cost of a cut depends on the kind of its boundary, and each piece adds
the square of its distance from an even share; pieces must keep the limit with the overlap counted in. A cut that is at no natural
boundary costs more than all others together, so that there are as few of them as can be.

Scale. Each text is on its own; only texts over the limit leave the JVM. Work for a text grows with its length: a piece has at most as
many possible ends as the limit has characters. Blanks, and in runs without any all characters, are possible ends only in stretches
that are too long for a piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 100
#: Cost of a cut by the kind of its boundary, and of a piece.
PENALTY = {"paragraph": 0.0, "line": 0.4, "sentence": 0.8, "word": 1e5, "hard": 1e8, "end": 0.0}
UNNATURAL = ("word", "hard")
PIECE, UNEVEN = 1.0, 2.0

BOUNDARY = re.compile(r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>[\n\r])|(?P<s>[。！？；]|[.!?;](?=\s))")
_BLANK = re.compile(r"\s+")


def boundaries(text: str) -> list[tuple[int, str]]:
    """Natural boundaries as (position, kind), in text order, without the ends of the text."""
    n = len(text)
    return [(m.end(), {"p": "paragraph", "l": "line", "s": "sentence"}[m.lastgroup]) for m in BOUNDARY.finditer(text) if m.end() < n]


def _positions(text: str, most: int, trimmed: bool) -> list[tuple[int, str]]:
    """Possible cuts: natural boundaries, and in stretches over ``most`` characters blanks, in runs over it without blanks all places."""
    out: list[tuple[int, str]] = []
    before = 0
    for pos, kind in [*boundaries(text), (len(text), "end")]:
        stretch = len(text[before:pos].strip()) if trimmed else pos - before
        if stretch > most:
            at = before
            for m in [*_BLANK.finditer(text, before, pos), None]:
                end = m.end() if m and m.end() < pos else pos
                stop = m.start() if m and trimmed else end
                if stop - at > most:
                    out += [(p, "hard") for p in range(at + 1, stop)]
                if end < pos:
                    out.append((end, "word"))
                    at = end
        out.append((pos, kind))
        before = pos
    return out


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, trimmed: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of each piece; one piece if the text is within the limit.

    trimmed: sizes are counted without the white space around a piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    fresh = limit - overlap
    at = [(0, "end"), *(x for x in _positions(text, fresh, trimmed) if x[0] > overlap)]
    # where a piece begins that follows a cut, and where one ends that a cut ends
    first, last = [max(0, p - overlap) for p, _ in at], [p for p, _ in at]
    if trimmed:
        blanks = [m.span() for m in _BLANK.finditer(text)] or [(n, n)]
        opens = [a for a, _ in blanks]
        first = [max(p, blanks[k][1]) if (k := bisect_right(opens, p) - 1) >= 0 else p for p in first]
        last = [blanks[k][0] if (k := bisect_left(opens, p) - 1) >= 0 and blanks[k][1] >= p else p for p in last]
    share = (n - overlap) / -(-(n - overlap) // fresh)
    # (end - start - share) ** 2 * UNEVEN / share ** 2 is the square of a difference of these
    scale = UNEVEN**0.5 / share
    opened, closed = np.array([overlap, *(p + overlap for p in first[1:])], np.float64) * scale + UNEVEN**0.5, (np.array(last) * scale).tolist()
    begun = opened.tolist()
    costs, cost, back = np.full(len(at), np.inf), [0.0] + [float("inf")] * (len(at) - 1), [0] * len(at)
    costs[0] = 0
    low = 0
    for i in range(1, len(at)):
        end = last[i]
        while low < i - 1 and end - first[low] > limit:
            low += 1
        x = closed[i]
        if i - low > 12:  # many possible starts: one vector
            d = opened[low:i] - x
            d *= d
            d += costs[low:i]
            k = int(d.argmin())
            least, back[i] = float(d[k]), low + k
        else:
            least, back[i] = min([(cost[j] + (x - begun[j]) ** 2, j) for j in range(low, i)])
        cost[i] = costs[i] = least + PENALTY[at[i][1]] + PIECE
    ends, i = [], len(at) - 1
    while i:
        ends.append(i)
        i = back[i]
    ends.reverse()
    begins = [0, *(at[i][0] - overlap for i in ends[:-1])]
    return [(s, at[i][0], at[i][1]) for s, i in zip(begins, ends)]


def split_oversized(df: DataFrame, id_col: str = "row_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, trimmed: bool = False) -> DataFrame:
    """(id, chunk_index, start, n_chars, cut, text): the pieces of each text over the limit; others have no row.

    cut is the kind of boundary a piece ends at. Every piece after the first begins with the last ``overlap`` characters of the one
    before it; with ``trimmed`` white space around a piece doesn't count for the limit. Null and empty texts have no row, repeated ids give
    their pieces each, an empty table gives none; other columns are ignored.
    """
    schema = "id long, chunk_index long, start long, n_chars int, cut string, text string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for k, (a, b, kind) in enumerate(cuts(text, limit, overlap, trimmed)):
                    for c, x in zip(cols, (i, k, a, b - a, kind, text[a:b])):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    big = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > limit)
    return big.mapInArrow(run, schema)
