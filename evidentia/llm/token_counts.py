"""Edit-aware token counts.

A document is a segment tree over leaves of a few stretches of text each;
every leaf but the last ends in ASCII white space, across which no token
reaches. Nodes hold the sums of characters, tokens and leaves below them. An
edit finds its leaves by the character sums and re-encodes only their text
(and the next leaf, if the edit took away the white space at their end). What
it leaves is cut into leaves of the same few stretches again, so leaves never
grow with the edits; new leaves take empty slots near by, and where these are
scarce the smallest node with enough of them spreads its leaves evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.bpe import Codec, codec
from evidentia.llm.common import gathered, ragged, tidy

LEAF = 16
SLICE_BYTES = 4 << 20
SPACE = " \n\t\r"


class TokenTree:
    """Token count of one document under edits."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.reencoded = 0
        self._open = 0, 0, ""
        size = 1
        while size < len(leaves):
            size *= 2
        self._fill(size, leaves, tokens)

    def _fill(self, size: int, leaves: list[str], tokens: list[int]) -> None:
        """A tree of ``size`` slots; the leaves come first."""
        none = size - len(leaves)
        self.size, self.text = size, leaves + [""] * none
        self.chars = [0] * size + [len(x) for x in self.text]
        self.tokens = [0] * size + tokens + [0] * none
        self.used = [0] * size + [1] * len(leaves) + [0] * none
        for i in range(size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        for sums in (self.chars, self.tokens, self.used):
            sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds a character, and the place within it.

        The end of the text is in the last leaf with any.
        """
        node = 1
        place = min(place, self.chars[1])
        while node < self.size:
            node *= 2
            if place >= self.chars[node] and (self.chars[node + 1] or place > self.chars[node]):
                place -= self.chars[node]
                node += 1
        return node - self.size, place

    def next_leaf(self, leaf: int) -> int | None:
        """The first leaf in use behind this one."""
        node = leaf + self.size
        while node > 1 and (node % 2 or not self.used[node + 1]):
            node //= 2
        if node == 1:
            return None
        node += 1
        while node < self.size:
            node *= 2
            node += not self.used[node]
        return node - self.size

    def edit(self, start: int | None, stop: int | None, new: str | None) -> str:
        """Replace characters; returns the text whose tokens ``settle`` needs.

        Positions are clipped to the text; null stands for its start and end.
        """
        start = max(0, min(start or 0, self.chars[1]))
        stop = self.chars[1] if stop is None else max(start, min(stop, self.chars[1]))
        first, at = self.leaf_at(start)
        last, end = self.leaf_at(stop)
        text = self.text[first][:at] + (new or "") + self.text[last][end:]
        # Boundary context: without white space at its end, the text goes on.
        while not text or text[-1] not in SPACE:
            after = self.next_leaf(last)
            if after is None:
                break
            last = after
            text += self.text[last]
        self._open = first, last, text
        self.reencoded += len(text)
        return text

    def settle(self, tokens: int) -> None:
        """Put the last edit's text in the place of the old leaves, as one leaf."""
        text = self._open[2]
        self.settle_leaves([text] if text else [], [tokens] if text else [])

    def settle_leaves(self, leaves: list[str], tokens: list[int]) -> None:
        """Put the leaves of the last edit's text in the place of the old ones."""
        first, last, _ = self._open
        if len(leaves) <= last - first + 1:
            self._place(first, last + 1, leaves, tokens)
            return
        node, width = first + self.size, 1
        while node > 1:
            node, width = node // 2, width * 2
            low = node * width - self.size
            inside = low <= first and last < low + width
            if inside and 4 * (self.used[node] + len(leaves)) <= 3 * width:
                break
        low, high = (node * width - self.size, (node + 1) * width - self.size) if node > 1 else (0, self.size)
        before = [k for k in range(low, first) if self.used[k + self.size]]
        behind = [k for k in range(last + 1, high) if self.used[k + self.size]]
        texts = [*(self.text[k] for k in before), *leaves, *(self.text[k] for k in behind)]
        counts = [*(self.tokens[k + self.size] for k in before), *tokens, *(self.tokens[k + self.size] for k in behind)]
        if node > 1:
            self._place(low, high, texts, counts)
            return
        size = self.size
        while 4 * len(texts) > 3 * size:
            size *= 2
        self._fill(size, [], [])
        self._place(0, size, texts, counts)

    def _place(self, low: int, high: int, leaves: list[str], tokens: list[int]) -> None:
        """Spread leaves evenly over the slots from ``low`` to ``high``."""
        for k in range(low, high):
            self.text[k] = ""
            self.chars[k + self.size] = self.tokens[k + self.size] = self.used[k + self.size] = 0
        for j, (text, n) in enumerate(zip(leaves, tokens, strict=True)):
            k = low + j * (high - low) // len(leaves)
            self.text[k] = text
            self.chars[k + self.size], self.tokens[k + self.size], self.used[k + self.size] = len(text), n, 1
        low, high = (low + self.size) // 2, (high - 1 + self.size) // 2
        while low:
            for i in range(low, high + 1):
                self._add(i)
            low, high = low // 2, high // 2

    def whole(self) -> str:
        return "".join(self.text)


def cut_leaves(own: Codec, texts: list[str], leaf: int = LEAF) -> list[tuple[list[str], list[int]]]:
    """Leaves of each text and their token counts; distinct stretches are encoded once."""
    spaced = pa.array(texts, pa.string())
    for space in "\n\t\r":
        spaced = pc.replace_substring(spaced, space, " ")
    cut = pc.split_pattern(spaced.cast(pa.large_string()), " ")
    flat, offsets = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    counts = own.counts(flat)
    ends = ragged(np.asarray(pc.utf8_length(flat)).astype(np.int64) + 1)
    out = []
    for k, text in enumerate(texts):
        a, b = int(offsets[k] - offsets[0]), int(offsets[k + 1] - offsets[0])
        if not text:
            out.append(([], []))
            continue
        edges = np.arange(a, b, leaf)
        bounds = [*(ends[edges] - ends[a]).tolist(), len(text)]
        leaves = [text[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        tokens = np.add.reduceat(counts[a:b], edges - a).tolist()
        if not leaves[-1]:  # white space at the end of the text leaves an empty stretch
            leaves, tokens = leaves[:-1], tokens[:-1]
        out.append((leaves, tokens))
    return out


def build_trees(own: Codec, texts: list[str], leaf: int = LEAF) -> list[TokenTree]:
    """Trees of many documents."""
    return [TokenTree(*x) for x in cut_leaves(own, texts, leaf)]


def token_counts(
    docs: DataFrame, path: str, edits: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token count of every whole text, and after its edits.

    ``edits`` names an array of ``struct<start, stop, text>``, applied in
    order, each to the text that the ones before left (code points, half open,
    clipped; a null start or stop is that of the text, a null text inserts
    nothing, a null edit changes nothing). Returns ``doc_id``, ``n_tokens`` and
    with edits ``n_tokens_edited``, ``n_chars_edited`` and
    ``n_chars_reencoded``. Null texts and null edit lists are empty. Narrow:
    one row for each input row, other columns are dropped.
    """
    fields = [docs.schema[key], T.StructField("n_tokens", T.LongType())]
    names = [key, "n_tokens"]
    if edits:
        names += ["n_tokens_edited", "n_chars_edited", "n_chars_reencoded"]
        fields += [T.StructField(n, T.LongType()) for n in names[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for table in gathered(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in table.column("text").to_pylist()]
            columns = [table.column("key").combine_chunks()]
            if not edits:
                columns.append(pa.array(own.count(texts), pa.int64()))
            else:
                trees = build_trees(own, texts)
                columns.append(pa.array([t.n_tokens for t in trees], pa.int64()))
                scripts = [e or [] for e in table.column("edits").to_pylist()]
                # One edit of every document at a time, so that they share a call.
                for step in range(max(map(len, scripts), default=0)):
                    live = [(t, s[step]) for t, s in zip(trees, scripts, strict=True) if step < len(s) and s[step]]
                    new = [t.edit(e["start"], e["stop"], e["text"]) for t, e in live]
                    for (t, _), found in zip(live, cut_leaves(own, new), strict=True):
                        t.settle_leaves(*found)
                columns.append(pa.array([t.n_tokens for t in trees], pa.int64()))
                columns.append(pa.array([t.chars[1] for t in trees], pa.int64()))
                columns.append(pa.array([t.reencoded for t in trees], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = [F.col(key).alias("key"), F.col(text).alias("text")]
    if edits:
        wanted.append(F.col(edits).alias("edits"))
    return docs.select(*wanted).mapInArrow(tidy(run), T.StructType(fields))
