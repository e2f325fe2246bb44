"""Windows of units (lines, sentences) of a text as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = "nth int, first int, last int, start long, stop long, tokens long"
#: What separates lines, and sentences.
LINES, SENTENCES = r"\n", r"(?<=[.!?])\s+"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def unit_spans(text: str, separator: str) -> list[tuple[int, int, int]]:
    """Start, stop and tokens of the units of a text that have any."""
    out, at = [], 0
    for found in [*re.finditer(separator, text), None]:
        stop = found.start() if found else len(text)
        tokens = len(_TOKEN.findall(text, at, stop))
        if tokens:
            out.append((at, stop, tokens))
        at = found.end() if found else stop
    return out


class UnitWindows:
    """Windows of a text: as many units as fit the budget of tokens, one at least;
    each begins with the units at the end of the one before that fit the overlap,
    unless the next unit would not fit beside them."""

    def eval(self, text: str | None, separator: str, budget: int, overlap: int) -> Iterator[tuple]:
        units = unit_spans(text or "", separator)
        total = [0]
        for _, _, n in units:
            total.append(total[-1] + n)
        first = new = nth = 0
        while new < len(units):
            last = new
            while last + 1 < len(units) and total[last + 2] - total[first] <= budget:
                last += 1
            yield nth, first, last, units[first][0], units[last][1], total[last + 1] - total[first]
            nth, new, start = nth + 1, last + 1, last + 1
            while start > first and total[last + 1] - total[start - 1] <= overlap:
                start -= 1
            fits = new < len(units) and total[new + 1] - total[start] <= budget
            first = start if fits else new


def unit_windows(docs: DataFrame, text: str = "text", budget: int = 384, overlap: int = 64, separator: str = LINES) -> DataFrame:
    """``docs`` joined with the windows of each row's text (``WINDOW``).

    ``first`` and ``last`` number the units that have a token, ``start`` and
    ``stop`` are places in the text, so that what is found in a window is found
    in the text. A text without tokens, or null, has no window and gives no
    row; a unit over the budget is a window of its own.
    """
    if budget < 1 or not 0 <= overlap < budget:
        raise ValueError("an overlap is smaller than the budget of its window")
    table = F.udtf(UnitWindows, returnType=WINDOW, useArrow=True)
    return docs.lateralJoin(table(F.col(text).outer(), F.lit(separator), F.lit(budget), F.lit(overlap)))
