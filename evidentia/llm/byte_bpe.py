"""Byte-level BPE in Spark expressions: ranked merges folded over byte arrays.

A word (one match of the pattern) starts as the array of its bytes' ranks. A
fold merges the adjacent pair of least rank, the leftmost of equals, until no
pair has a rank: ids are ranks, so the merged id is the rank itself. The rank
map is one literal: two hash tables (a cuckoo table) from a pair of ids to the
id of the joined bytes, so that a look-up reads two places and scans nothing.
Decoding concatenates the pieces' bytes.

Words of more than ``LONG`` bytes are encoded window by window. That is exact:
the merges within two neighbouring tokens of a result do not depend on what
stands around them, so a sequence of tokens is the encoding of its bytes if
and only if every two neighbours encode, as a text of their own, to themselves.
Within a window that holds already; where two windows meet it is checked, and
the last token before the seam is given up until it holds.

Distinct words are encoded once: the most frequent ones (at most ``WORDS``, by a
count over all texts) are broadcast with their ids, and Arrow batches of words
look them up; every other word is folded where it stands, to the same ids.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import give_back, list_array, partitions, ragged, stored, take_ragged, tidy

#: Bytes of a word that are folded at once, and of a window of a longer one.
LONG = 60
#: Distinct words that are looked up; the others are encoded where they stand.
WORDS = 1 << 20
#: Bits of an id in the table's entries, and in a token of the fold.
BITS = 21
#: No rank: greater than all.
NONE = 1 << BITS
#: Where a token's rank begins; its place is below, of as many bytes as no fold can reach.
RANK_AT = 41
PLACE = (1 << RANK_AT) - (1 << BITS)

# Letters and numbers that newer versions of Unicode have and
# Java 17 does not know. With them the classes are those of the library.
NEWER_LETTERS = (
    (0x870, 0x887), (0x889, 0x88E), (0x8B5, 0x8B5), (0x8C8, 0x8C9), (0xC5D, 0xC5D), (0xCDD, 0xCDD),
    (0x170D, 0x170D), (0x171F, 0x171F), (0x1B4C, 0x1B4C), (0x1C89, 0x1C8A), (0x2C2F, 0x2C2F),
    (0x2C5F, 0x2C5F), (0x9FFD, 0x9FFF), (0xA7C0, 0xA7C1), (0xA7CB, 0xA7CD), (0xA7D0, 0xA7D1),
    (0xA7D3, 0xA7D3), (0xA7D5, 0xA7DC), (0xA7F2, 0xA7F4), (0x10570, 0x1057A), (0x1057C, 0x1058A),
    (0x1058C, 0x10592), (0x10594, 0x10595), (0x10597, 0x105A1), (0x105A3, 0x105B1), (0x105B3, 0x105B9),
    (0x105BB, 0x105BC), (0x105C0, 0x105F3), (0x10780, 0x10785), (0x10787, 0x107B0), (0x107B2, 0x107BA),
    (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x10F70, 0x10F81), (0x11071, 0x11072),
    (0x11075, 0x11075), (0x1123F, 0x11240), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11740, 0x11746),
    (0x11AB0, 0x11ABF), (0x11BC0, 0x11BE0), (0x11F02, 0x11F02), (0x11F04, 0x11F10), (0x11F12, 0x11F33),
    (0x12F90, 0x12FF0), (0x1342F, 0x1342F), (0x13441, 0x13446), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16A70, 0x16ABE), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB),
    (0x1AFFD, 0x1AFFE), (0x1B11F, 0x1B122), (0x1B132, 0x1B132), (0x1B155, 0x1B155), (0x1DF00, 0x1DF1E),
    (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E290, 0x1E2AD), (0x1E4D0, 0x1E4EB), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0), (0x1E7E0, 0x1E7E6), (0x1E7E8, 0x1E7EB), (0x1E7ED, 0x1E7EE), (0x1E7F0, 0x1E7FE),
    (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D), (0x31350, 0x323AF),
)
NEWER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x11F50, 0x11F59), (0x16130, 0x16139),
    (0x16AC0, 0x16AC9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1D2C0, 0x1D2D3), (0x1E4F0, 0x1E4F9),
    (0x1E5F1, 0x1E5FA),
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 piece and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def flat_ranges(ranges: tuple) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def newer_pattern() -> str:
    """One of the newer letters and numbers; what stands before all of them is tested once."""
    every = sorted(NEWER_LETTERS + NEWER_NUMBERS)
    return f"[\\x{{{every[0][0]:X}}}-\\x{{{every[-1][1]:X}}}&&[{flat_ranges(tuple(every))}]]"


def java_pattern(pattern: str) -> str:
    """The pattern for Java's matcher, with Unicode's white space, letters and numbers."""
    flat = flat_ranges

    def known(kind: str, ranges: tuple, within: bool) -> str:
        if within:
            return f"\\p{{{kind}}}{flat(ranges)}"
        # What stands before all of the newer ranges is tested once.
        return f"[\\p{{{kind}}}[\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}&&[{flat(ranges)}]]]"

    out, depth, k = [], 0, 0
    while k < len(pattern):
        if pattern.startswith("\\p{L}", k) or pattern.startswith("\\p{N}", k):
            kind = pattern[k + 3]
            out.append(known(kind, NEWER_LETTERS if kind == "L" else NEWER_NUMBERS, depth > 0))
            k += 5
        elif pattern[k] == "\\":
            out.append(pattern[k : k + 2])
            k += 2
        else:
            depth += {"[": 1, "]": -1}.get(pattern[k], 0)
            out.append(pattern[k])
            k += 1
    return "(?U)" + "".join(out)


def _prime(least: int) -> int:
    n = least | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def cuckoo(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Two tables that hold every key at its remainder by one table's length.

    An entry is the key, shifted by ``BITS``, with its value below; free places
    are -1. The first table is wide, so that most keys that are not there find
    a free place in it and need no second look: a place once taken stays so.
    The tables grow until every key has a place.
    """
    wide, narrow = 2 * len(pairs) + 5, len(pairs) // 2 + 5
    while True:
        sizes = _prime(wide), _prime(narrow)
        tables = [-1] * sizes[0], [-1] * sizes[1]
        for key, value in pairs.items():
            entry, side = key << BITS | value, 0
            for _ in range(500):
                at = (entry >> BITS) % sizes[side]
                entry, tables[side][at] = tables[side][at], entry
                if entry < 0:
                    break
                side = 1 - side
            if entry >= 0:
                break
        else:
            return tables
        wide, narrow = wide + 2, narrow * 5 // 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the end of an aggregation over nothing.

    The element of a one-element array would do, but evaluating it asks for
    the type of the whole expression beneath each time.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


class Codec:
    """Expressions of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        """Raises ValueError if a byte has no rank or ranks do not fit ``BITS``."""
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        if min(ranks.values()) < 0 or max(ranks.values()) >= 1 << BITS:
            raise ValueError(f"ranks of more than {BITS} bits")
        self.pattern = java_pattern(pattern)
        #: The same but for the newer letters and numbers; three times as fast.
        self.plain = "(?U)" + pattern
        self.newer = newer_pattern()
        self.size = max(ranks.values()) + 1
        self.bytes_of = [ranks[bytes([b])] for b in range(256)]
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << BITS | right] = rank
        self.tables = cuckoo(pairs)
        self.pieces: list[bytes] = [b""] * self.size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    @staticmethod
    def _ints(values: list[int], kind: str) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    @functools.cached_property
    def rank_map(self) -> Column:
        """The literal: ranks of single bytes, the two tables, lengths of pieces."""
        return F.struct(
            self._ints(self.bytes_of, "int").alias("bytes"),
            self._ints(self.tables[0], "bigint").alias("one"),
            self._ints(self.tables[1], "bigint").alias("two"),
            self._ints([len(p) for p in self.pieces], "int").alias("lengths"),
        )

    def words(self, text: Column) -> Column:
        """The matches of the pattern in a text; null has none.

        Only texts with a newer letter or number need the pattern that names them.
        """
        text = F.coalesce(text, F.lit(""))
        plain, whole = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (self.plain, self.pattern))
        return F.when(text.rlike(self.newer), whole).otherwise(plain)

    def _rank(self, known: Column, left: Column, right: Column) -> Column:
        """Rank of two neighbours joined, or NONE."""

        low = F.lit((1 << BITS) - 1)

        def second(key: Column) -> Column:
            entry = known["two"][F.pmod(key, F.lit(len(self.tables[1])))]
            return let(entry, lambda e: F.when(F.shiftright(e, BITS) == key, e.bitwiseAND(low)).otherwise(F.lit(NONE)))

        def first(key: Column) -> Column:
            def found(e: Column) -> Column:
                # Whoever finds its first place free stays there: no key of this place is elsewhere.
                here = F.when(F.shiftright(e, BITS) == key, e.bitwiseAND(low)).otherwise(second(key))
                return F.when(e < 0, F.lit(NONE)).otherwise(here)

            return let(known["one"][F.pmod(key, F.lit(len(self.tables[0])))], found)

        return let(F.shiftleft(left.cast("bigint"), BITS) + right, first).cast("int")

    def _start(self, known: Column, word: Column) -> Column:
        """Ranks of a word's bytes."""
        letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        return F.transform(letters, lambda c: known["bytes"][F.ascii(c)])

    def _fold(self, known: Column, start: Column) -> Column:
        """Ids of a short array of ids, merged as far as ranks go.

        A token is one long: the rank of itself and the next one joined, its
        place at the start, its id. So the least of them is the pair to merge,
        the leftmost of equals, and a merge makes one array.
        """

        def token(rank: Column, rest: Column) -> Column:
            return F.shiftleft(rank.cast("bigint"), RANK_AT).bitwiseOR(rest)

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << BITS) - 1))

        def merge(tokens: Column) -> Column:
            def with_least(least: Column) -> Column:
                rank = F.shiftright(least, RANK_AT)

                def with_place(p: Column) -> Column:  # 1-based place of the left one
                    before, after = F.get(tokens, p - 2), F.get(tokens, p + 1)
                    ahead = F.when(p + 1 < F.size(tokens), self._rank(known, rank, id_of(after))).otherwise(F.lit(NONE))
                    own = token(ahead, least.bitwiseAND(F.lit(PLACE)).bitwiseOR(rank))
                    left = token(self._rank(known, id_of(before), rank), before.bitwiseAND(F.lit((1 << RANK_AT) - 1)))
                    return F.when(p == 1, F.concat(F.array(own), F.slice(tokens, 3, F.size(tokens)))).otherwise(
                        F.concat(F.slice(tokens, 1, p - 2), F.array(left, own), F.slice(tokens, p + 2, F.size(tokens)))
                    )

                return F.when(least >= F.lit(NONE << RANK_AT), tokens).otherwise(let(F.array_position(tokens, least).cast("int"), with_place))

            return let(F.array_min(tokens), with_least)

        def run(first: Column) -> Column:
            def begin(x: Column, k: Column) -> Column:
                ahead = F.when(k + 1 < F.size(first), self._rank(known, x, F.get(first, k + 1))).otherwise(F.lit(NONE))
                return token(ahead, F.shiftleft(k.cast("bigint"), BITS).bitwiseOR(x))

            return F.aggregate(
                F.slice(first, 2, F.size(first)), F.transform(first, begin), lambda s, _: merge(s),
                lambda s: F.transform(s, lambda x: id_of(x).cast("int")),
            )

        return let(start, run)

    def _windows(self, known: Column, start: Column) -> Column:
        """Ids of a long array of bytes' ranks, window by window."""
        lengths = known["lengths"]
        size = F.size(start)

        def count(ids: Column) -> Column:
            return F.aggregate(ids, F.lit(0), lambda n, i: n + lengths[i])

        def kept(ids: Column, most: int) -> Column:
            """The tokens that end within the first ``most`` bytes, at least one."""
            cut = F.aggregate(
                ids,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda s, i: F.struct(
                    (s["n"] + F.when(s["end"] + lengths[i] <= most, 1).otherwise(0)).alias("n"),
                    (s["end"] + lengths[i]).alias("end"),
                ),
                lambda s: F.greatest(s["n"], F.lit(1)),
            )
            return F.slice(ids, 1, cut)

        def step(s: Column) -> Column:
            # tail: the tokens of the last window that still may go; done: those before.
            def with_window(ids: Column) -> Column:
                last = F.element_at(s["tail"], -1)
                first = ids[0]
                seam = F.when(F.size(s["tail"]) == 0, True).otherwise(
                    self._fold(known, F.slice(start, s["at"] - lengths[last] + 1, lengths[last] + lengths[first]))
                    == F.array(last, first)
                )

                def go_on(more: Column) -> Column:
                    return F.struct(
                        (s["at"] + count(more)).alias("at"),
                        F.when(F.size(s["tail"]) == 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["tail"]))).alias("done"),
                        more.alias("tail"),
                        F.lit(LONG).alias("width"),
                    )

                ahead = F.when(s["at"] + s["width"] >= size, ids).otherwise(kept(ids, LONG * 3 // 4))
                back = F.when(
                    F.size(s["tail"]) > 1,
                    F.struct(
                        (s["at"] - lengths[last]).alias("at"), s["done"].alias("done"),
                        F.slice(s["tail"], 1, F.size(s["tail"]) - 1).alias("tail"), s["width"].alias("width"),
                    ),
                ).otherwise(
                    # The whole window goes; the one before it is open again, and the next is twice as wide.
                    F.struct(
                        (s["at"] - lengths[last]).alias("at"),
                        F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))).alias("done"),
                        F.when(F.size(s["done"]) > 0, F.element_at(s["done"], -1)).otherwise(F.slice(start, 1, 0)).alias("tail"),
                        (s["width"] * 2).alias("width"),
                    )
                )
                return F.when(seam, let(ahead, go_on)).otherwise(back)

            return F.when(s["at"] >= size, s).otherwise(
                let(self._fold(known, F.slice(start, s["at"] + 1, s["width"])), with_window)
            )

        none = F.slice(start, 1, 0)
        first = F.struct(
            F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("done"), none.alias("tail"), F.lit(LONG).alias("width")
        )
        steps = F.sequence(F.lit(1), F.greatest(F.ceil(size / 16), F.lit(2)).cast("int"))
        out = F.aggregate(steps, first, lambda s, _: step(s))
        return let(
            out,
            lambda s: F.when(s["at"] >= size, F.concat(F.flatten(s["done"]), s["tail"])).otherwise(self._fold(known, start)),
        )

    def word_ids(self, known: Column, word: Column) -> Column:
        """Ids of one word, given the rank map as ``known``."""
        return let(
            self._start(known, word),
            lambda start: F.when(F.size(start) <= LONG, self._fold(known, start)).otherwise(self._windows(known, start)),
        )

    def with_map(self, body: Callable[[Column], Column]) -> Column:
        """``body`` of the rank map, which stands in the plan once."""
        return let(self.rank_map, body)

    def encoded(self, words: Column) -> Column:
        """Ids of an array of words, each folded where it stands."""
        return self.with_map(lambda known: F.flatten(F.transform(words, lambda w: self.word_ids(known, w))))

def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array and where each row's begin and end; null rows are empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return np.asarray(lists.flatten()), ragged(sizes)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count, of 32 in each power of two, that at most ``most`` words reach."""
    power = F.floor(F.log2("n"))
    step = F.greatest(F.pow(F.lit(2.0), power - 5), F.lit(1.0))
    steps = counts.groupBy((F.floor(F.col("n") / step) * step).cast("long").alias("least")).agg(F.count("*").alias("words"))
    total, least = 0, None
    for row in sorted(steps.collect(), key=lambda r: -r["least"]):
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    return least if least is not None else 1 << 62


def frequent_words(texts: DataFrame, codec: Codec, text: str, most: int = WORDS) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The most frequent words of all texts by their hashes, the ids of all and where each one's begin.

    Words that occur once, and those of more than ``LONG`` bytes, are left to
    the texts, so that ``most`` bounds the bytes that the driver gets.
    """
    words = texts.select(F.explode(codec.words(F.col(text))).alias("word")).where(F.octet_length("word") <= LONG)
    counts = stored(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word-counts")
    chosen = counts.where(F.col("n") >= _least_count(counts, most)).select("word")
    ids = codec.with_map(lambda known: codec.word_ids(known, F.col("word")))
    coded = chosen.repartition(partitions(texts.sparkSession)).withColumn("ids", ids).withColumn("hash", F.xxhash64("word"))
    found = stored(coded, "word-ids").orderBy("hash").select("hash", F.col("word").cast("binary"), "ids").toArrow()
    flat, offsets = flat_lists(found["ids"].combine_chunks())
    out = found["hash"].to_numpy(), found["word"].combine_chunks(), flat, offsets.astype(np.int32)
    del found
    give_back()
    return out


def _places(words: pa.Array, hashes: np.ndarray, names: pa.Array) -> np.ndarray:
    """Where each word stands among names in order of their hashes, or their number."""
    own = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)
    at, out = np.searchsorted(hashes, own), np.full(len(words), len(hashes))
    # Words of one hash are neighbours; more than two are next to impossible, but looked at.
    while (near := np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == own))).size:
        same = pc.equal(names.take(pa.array(at[near])), words.take(pa.array(near))).to_numpy(zero_copy_only=False)
        out[near[same]] = at[near[same]]
        at[near] += 1
    return out


def _look_up(docs: DataFrame, table: tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray], words: str) -> DataFrame:
    """Arrays of words as their ids and the words that the table lacks: columns ids and rest of ``words``.

    The k-th such word of a row stands among its ids as -1 - k.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names, flat, offsets = held.value
        lacks = len(names)
        # A word that is not there is one entry, whose only value is set below.
        known, starts = np.append(flat, np.int32(0)), offsets.astype(np.int64)
        lengths = np.append(np.diff(starts), 1)
        for batch in batches:
            lists = batch.column(words)
            _, ends = flat_lists(lists)
            coded = lists.flatten().dictionary_encode()
            codes = _places(coded.dictionary.cast(pa.binary()), hashes, names)[np.asarray(coded.indices, np.int64)]
            sizes = lengths[codes]
            at = ragged(sizes)
            ids = take_ragged(known, starts[codes], sizes)
            missing = np.flatnonzero(codes == lacks)
            row = np.searchsorted(ends, missing, "right") - 1
            per_row = ragged(np.bincount(row, minlength=len(lists)))
            ids[at[missing]] = per_row[row] - np.arange(len(missing)) - 1
            rest = coded.dictionary.take(coded.indices.take(pa.array(missing)))
            found = pa.StructArray.from_arrays(
                [list_array(ids, at[ends]), pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), rest)], ["ids", "rest"]
            )
            yield batch.set_column(batch.schema.get_field_index(words), words, found)

    kind = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("rest", T.ArrayType(T.StringType()))
    fields = [T.StructField(f.name, kind) if f.name == words else f for f in docs.schema.fields]
    return docs.mapInArrow(tidy(look_up), T.StructType(fields))


def byte_bpe_encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", words: int = WORDS
) -> DataFrame:
    """``docs`` with the token ids of each text, as an array of ints.

    Matches of ``pattern`` are encoded separately and no text is special. A
    null or empty text has no ids, a text is encoded whole whatever its length,
    equal texts and rows are encoded alike, an empty table gives an empty one;
    a column of the result's name is replaced (the text's own too), others stay.
    """
    codec = Codec(read_ranks(path), pattern)
    of_text = codec.words(F.col(text))
    if not words:
        return docs.withColumn(ids, codec.encoded(of_text))
    table = frequent_words(docs, codec, text, words)
    held = f"_words_{uuid.uuid4().hex}"
    found = _look_up(docs.withColumn(held, of_text).drop(ids), table, held)
    known, rest = F.col(held)["ids"], F.col(held)["rest"]
    filled = codec.with_map(
        lambda ranks: let(
            F.transform(rest, lambda w: codec.word_ids(ranks, w)),
            lambda folded: F.flatten(F.transform(known, lambda i: F.when(i < 0, F.get(folded, -1 - i)).otherwise(F.array(i)))),
        )
    )
    return found.withColumn(ids, F.when(F.size(rest) == 0, known).otherwise(filled)).drop(held)


def byte_bpe_decode(
    docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded", packed: str | None = None
) -> DataFrame:
    """``docs`` with the bytes of each row's ids, and with ``packed`` the ids as little-endian 32-bit integers.

    Null ids give empty bytes; what is no id of the vocabulary has no piece.
    Columns of the results' names are replaced.
    """
    pieces = Codec(read_ranks(path), pattern).pieces
    lengths = np.array([*map(len, pieces), 0], np.int64)
    starts, joined = ragged(lengths)[:-1], np.frombuffer(b"".join(pieces), np.uint8)
    added = [name for name in (decoded, packed) if name]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_lists(batch.column(ids))
            code = np.where((flat >= 0) & (flat < len(pieces)), flat, len(pieces)).astype(np.int64)
            out = [binary_array(take_ragged(joined, starts[code], lengths[code]), ragged(lengths[code])[offsets])]
            if packed:
                out.append(binary_array(flat.astype("<u4").view(np.uint8), offsets * 4))
            rows = pa.Table.from_batches([batch]).select([n for n in batch.schema.names if n not in added])
            for name, column in zip(added, out, strict=True):
                rows = rows.append_column(name, column)
            yield from rows.combine_chunks().to_batches()

    schema = T.StructType([f for f in docs.schema.fields if f.name not in added])
    for name in added:
        schema = schema.add(name, "binary")
    return docs.mapInArrow(tidy(decode), schema)
