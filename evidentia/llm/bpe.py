"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled, one merge gadget after another, into a
deterministic automaton over *tokens* (Berglund, Martens & van der Merwe,
"Constructing a BPE Tokenization DFA", 2024). It starts as one state that
every token leads back to. The gadget of merge ``(u, v)``

* splits the state that ``u`` leads to, and takes the arc ``v`` from the copy,
  as ``u v`` is now always merged;
* adds an arc ``uv``, beside every arc ``u``, to the state that ``v`` leads to.

Every token leads to one state, so the state is named by the last token. An
arc ``t`` is missing after token ``x`` exactly if some gadget took it from an
ancestor state of ``x`` (``x``, its right part, the right part of that, ...)
for an ancestor arc of ``t`` (``t``, its left part, ...) before either was
copied. That is how the arcs are stored: one entry for each gadget, plus the
two chains of ancestors; ``allowed`` looks an arc up in these tables.

A trie over the token spellings joins bytes to arcs. As the automaton accepts
exactly one token sequence for each prefix of a word, one left-to-right pass
of table look-ups finds, for every position, the one token that ends there.
All words of a batch advance together in NumPy. Decoding emits arc labels.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidentia.llm.common import Growing, Numbers, Stretches, gathered, list_array, ragged, take_ragged, tidy

BATCH_BYTES = 3 << 20
#: Stretches of text, and words, that a codec remembers.
CACHE_ENTRIES, WORDS = 400_000, 300_000
#: New stretches, or words, that are looked at together.
CHUNK = 1 << 14
NONE, NEVER = 1 << 31, 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class HashTable:
    """Vectorised look-up of int64 keys: open addressing, linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            at, which = np.unique(slot[left[free]], return_index=True)
            won = left[free][which]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], missing)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Automaton:
    """The tokenization automaton of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.size = max(vocab.values()) + 1
        left = np.full(self.size, -1, np.int64)
        right = np.full(self.size, -1, np.int64)
        birth = np.zeros(self.size, np.int64)
        rank_of: dict[int, int] = {}
        for i, (u, v) in enumerate(merges, 1):
            a, b, whole = vocab[u], vocab[v], vocab[u + v]
            rank_of.setdefault(a * self.size + b, i)
            if left[whole] < 0 and birth[whole] == 0:
                left[whole], right[whole], birth[whole] = a, b, i
        self.left, self.right, self.birth = left, right, birth
        self.gadgets = HashTable(
            np.fromiter(rank_of.keys(), np.int64, len(rank_of)),
            np.fromiter(rank_of.values(), np.int64, len(rank_of)),
        )
        self._arc_key = np.full(1 << 20, -1, np.int64)
        self._arc_ok = np.zeros(1 << 20, bool)

        self.suffix = suffix
        code = {c: b for b, c in enumerate(byte_symbols())}
        nodes: dict[int, int] = {}
        token_at = [-1]
        self.length = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            if not body or any(c not in code for c in body):
                continue
            symbols = [code[c] for c in body]
            if len(body) < len(token):
                symbols[-1] += 256
            # A token that no merge makes and that is not one symbol has no arc.
            if len(symbols) > 1 and left[i] < 0:
                continue
            node = 0
            for s in symbols:
                key = node * 512 + s
                if key not in nodes:
                    nodes[key] = len(token_at)
                    token_at.append(-1)
                node = nodes[key]
            token_at[node] = i
            self.length[i] = len(symbols)
        self.trie = HashTable(
            np.fromiter(nodes.keys(), np.int64, len(nodes)),
            np.fromiter(nodes.values(), np.int64, len(nodes)),
        )
        self.first = self.trie.get(np.arange(512), -1)
        self.token_at = np.array(token_at, np.int64)

    def allowed(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether arc ``t`` leaves the state of token ``x`` (-1: the start)."""
        keys = x * self.size + t
        slot = ((keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(
            np.int64
        )
        start = x < 0
        ok = np.where(start, True, self._arc_ok[slot])
        miss = np.flatnonzero(~start & (self._arc_key[slot] != keys))
        if len(miss):
            ok[miss] = self._arcs(x[miss], t[miss])
            # Of two keys of one slot, the last one owns the entry in both arrays.
            self._arc_key[slot[miss]], self._arc_ok[slot[miss]] = keys[miss], ok[miss]
        return ok

    def _arcs(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        taken = np.zeros(len(x), bool)
        which = np.arange(len(x))
        state, before = x, np.full(len(x), NEVER, np.int64)
        while len(which):
            sub, arc, until = np.arange(len(which)), t[which], np.full(len(which), NEVER, np.int64)
            while len(sub):
                when = self.gadgets.get(state[sub] * self.size + arc, NONE)
                taken[which[sub]] |= (when < before[sub]) & (when <= until)
                until, arc = self.birth[arc], self.left[arc]
                keep = arc >= 0
                sub, arc, until = sub[keep], arc[keep], until[keep]
            before, state = self.birth[state], self.right[state]
            keep = (state >= 0) & ~taken[which]
            which, state, before = which[keep], state[keep], before[keep]
        return ~taken

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each non-empty word: flat ids, and offsets by word."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        if not len(n):
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        offsets = ragged(n)
        if self.suffix:
            symbols[offsets[1:] - 1] += 256
        ends = np.repeat(offsets[1:], n)
        place = np.arange(len(symbols)) - np.repeat(offsets[:-1], n)

        at, node, depth = np.arange(len(symbols)), self.first[symbols], 0
        starts, tokens = [], []
        while len(at):
            if depth:
                node = self.trie.get(node * 512 + symbols[at + depth], -1)
            keep = node >= 0
            at, node = at[keep], node[keep]
            token = self.token_at[node]
            real = token >= 0
            starts.append(at[real])
            tokens.append(token[real])
            depth += 1
            keep = at + depth < ends[at]
            at, node = at[keep], node[keep]
        start, token = np.concatenate(starts), np.concatenate(tokens)
        order = place[start]
        # A stable sort of 16-bit keys is a radix sort.
        order = np.argsort(order.astype(np.int16) if n.max() < 1 << 15 else order, kind="stable")
        start, token = start[order], token[order]
        steps = place[start]
        cuts = np.searchsorted(steps, np.arange(int(n.max()) + 1))
        # last[p]: the one token that ends before flat position p of its word.
        word = np.repeat(np.arange(len(n)), n)
        last = np.full(len(symbols) + len(n), -1, np.int64)
        base = start + word[start]  # each word has one more position than symbols
        for a, b in zip(cuts, cuts[1:], strict=False):
            t = token[a:b]
            ok = self.allowed(last[base[a:b]], t)
            t = t[ok]
            last[base[a:b][ok] + self.length[t]] = t

        count = np.zeros(len(n), np.int64)
        live, spot = np.arange(len(n)), offsets[1:] + np.arange(len(n))
        floor = offsets[:-1] + np.arange(len(n))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            t = last[spot]
            if (t < 0).any():
                raise ValueError("a byte has no token in this vocabulary")
            found.append((live, t))
            count[live] += 1
            spot = spot - self.length[t]
            keep = spot > floor[live]
            live, spot = live[keep], spot[keep]
        out = ragged(count)
        ids = np.empty(int(out[-1]), np.int64)
        for k, (w, t) in enumerate(found):
            ids[out[w + 1] - 1 - k] = t
        return ids, out


def _array(texts: pa.Array | pa.ChunkedArray | list[str]) -> pa.Array:
    if isinstance(texts, list):
        return pa.array(texts, pa.string())
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def _plain(text: str) -> str:
    """NFC and lower case, by single character, so that a final sigma stays one."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Codec:
    """Encodes and decodes whole texts as the vocabulary file prescribes.

    Texts are cut at ASCII white space first; no rule of the file looks across
    it, so each distinct stretch is normalised, pre-split and encoded once and
    kept in a bounded table.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = spec.get("normalizer") or {}
        kinds = [x["type"] for x in steps.get("normalizers", [])]
        if not self.suffix or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only vocabularies with word ends and NFC, lower-case rules are supported")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.parted = regex.compile(split["pattern"]["Regex"] + "|\\n").findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pattern = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({pattern})") if pattern else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, self.suffix)
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.labels = [""] * size
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.labels[i] = token
        self._forget_words()
        self.ids, self.bounds = Growing(np.int32), Growing(np.int64, [0])
        self.stretches = Stretches(self._encode_new, self._keep)

    def _keep(self, stay: np.ndarray) -> None:
        """Forget stretches, and all words once there are too many."""
        starts, sizes = self._sizes(stay)
        ids = take_ragged(self.ids.array, starts, sizes)
        self.ids, self.bounds = Growing(np.int32), Growing(np.int64, [0])
        self.ids.extend(ids)
        self.bounds.extend(ragged(sizes)[1:])
        if len(self.words) > WORDS:
            self._forget_words()

    def _forget_words(self) -> None:
        self.words = Numbers(["\n"])
        self.line = 0
        self.word_ids, self.word_bounds = Growing(np.int32), Growing(np.int64, [0, 0])

    def _marked(self, stretch: str) -> list[str | int]:
        """Pieces of a stretch that may hold special tokens."""
        out: list[str | int] = []
        for part in self.specials.split(stretch):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.pieces(_plain(part))
        return out

    def _encode_new(self, new: list[str]) -> None:
        marked = {}
        if self.specials is not None:
            marked = {k: self._marked(s) for k, s in enumerate(new) if "<|" in s}
        # One pass over all stretches; the line feeds stay as pieces that part them.
        found = self.parted(_plain("\n".join("" if k in marked else s for k, s in enumerate(new)) if marked else "\n".join(new)))
        order, fresh = self.words.fresh(found)
        breaks = order == self.line
        per = np.diff(np.concatenate([[-1], np.flatnonzero(breaks), [len(found)]])) - 1
        order = order[~breaks]
        for k, pieces in sorted(marked.items(), reverse=True):
            # A special token is the word that is its number.
            numbers, more = self.words.fresh(pieces)
            fresh += more
            order = np.insert(order, int(per[:k].sum()), numbers)
            per[k] = len(pieces)
        for a in range(0, len(fresh), CHUNK):
            part = fresh[a : a + CHUNK]
            special = [k for k, x in enumerate(part) if isinstance(x, int)] if marked else []
            plain = [x.encode() for x in part if isinstance(x, str)] if special else list(map(str.encode, part))
            flat, bounds = self.automaton.encode_words(plain)
            for k in special:
                flat = np.insert(flat, bounds[k], part[k])
                bounds = np.concatenate([bounds[: k + 1], bounds[k:] + 1])
            self.word_bounds.extend(bounds[1:] + len(self.word_ids))
            self.word_ids.extend(flat)
        bounds = self.word_bounds.array
        starts = bounds[order]
        sizes = bounds[order + 1] - starts
        self.bounds.extend(ragged(sizes)[ragged(per)][1:] + len(self.ids))
        self.ids.extend(take_ragged(self.word_ids.array, starts, sizes))

    def numbered(self, stretches: pa.Array) -> np.ndarray:
        """Number in the table of each stretch; none may hold white space."""
        return self.stretches.numbered(stretches, CACHE_ENTRIES, CHUNK)

    def _sizes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of stretches."""
        starts = self.bounds.array[which]
        return starts, self.bounds.array[which + 1] - starts

    def _cut(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(pc.fill_null(_array(texts), "").cast(pa.large_string()))
        offsets = np.asarray(cut.offsets).astype(np.int64)
        return self.numbered(cut.flatten()), offsets - offsets[0]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts: flat ids, and offsets by text."""
        which, offsets = self._cut(texts)
        starts, sizes = self._sizes(which)
        return take_ragged(self.ids.array, starts, sizes), ragged(sizes)[offsets]

    def count(self, texts: pa.Array | list[str]) -> np.ndarray:
        """Number of ids of each text."""
        which, offsets = self._cut(texts)
        return np.diff(ragged(self._sizes(which)[1])[offsets])

    def counts(self, stretches: pa.Array) -> np.ndarray:
        """Number of ids of each stretch."""
        return self._sizes(self.numbered(stretches))[1]

    def decode(self, ids: Iterable[int]) -> str:
        """Arc labels of the ids; this kind of file has no decoder, so a space parts them."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """Token ids of every whole text, and with ``decoded`` their decoded text.

    Returns ``keys`` and ``ids`` (array of int), one row for each input row.
    A null or empty text has no ids and decodes to the empty string. Repeated
    rows give repeated results; other columns, whatever their names, are
    dropped. Narrow: no shuffle, tables of the codec are bounded.
    """
    fields = [docs.schema[k] for k in keys]
    fields.append(T.StructField(ids, T.ArrayType(T.IntegerType(), False), False))
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for table in gathered(batches, text, BATCH_BYTES):
            flat, bounds = own.encode(table.column(text))
            columns = [table.column(k).combine_chunks() for k in keys]
            columns.append(list_array(flat, bounds))
            if decoded:
                columns.append(
                    pa.array(
                        [own.decode(flat[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)],
                        pa.string(),
                    )
                )
            names = [*keys, ids, *([decoded] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keys, text).mapInArrow(tidy(encode), T.StructType(fields))


def bpe_decode(
    encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the decoded text of an id list; null ids decode to the empty string."""
    schema = T.StructType(
        [*[f for f in encoded.schema.fields if f.name != decoded], T.StructField(decoded, T.StringType(), False)]
    )
    names = [f.name for f in schema.fields[:-1]]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = pa.array([own.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], out], names=[*names, decoded]
            )

    return encoded.select(*names).mapInArrow(tidy(decode), schema)
