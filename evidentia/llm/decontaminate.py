"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, units behind a number, and names (runs of
capitalised words inside a sentence) become typed placeholders. Windows of such templates
are hash-joined between benchmark items and documents, so a question is found
again when only its numbers, units or names have changed. The values in the
slots are then checked: along one alignment of a document and an item, equal
item values must stand against equal document values. What passes is a copy,
or the same question with other parameters. Beside the templates, windows of
the case-folded tokens themselves are joined: they find copies in other case,
and items that are mostly placeholders.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Growing, Numbers, Stretches, gathered, ragged, take_ragged, tidy
from evidentia.llm.repeats import gram_hash

WINDOW = 8
#: Words that a window needs beside its placeholders.
LEAST_WORDS = 4
FILTER_BITS = 22
SLICE_BYTES = 2 << 20
#: Stretches of text, and words, that a lexicon remembers.
STRETCHES, WORDS = 200_000, 300_000
#: New stretches that are looked at together.
CHUNK = 1 << 14
_PIECE = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?:;|\n]")
_STOPS = frozenset(".!?:;|")
UNITS = frozenset(
    "km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg t lb lbs pound pounds oz ounce ounces "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents degree degrees "
    "celsius fahrenheit kmh mph hz khz mhz ghz w kw kwh v volt volts a amp amps j joule joules n newton newtons "
    "b kb mb gb tb byte bytes people persons items times "
    "kilometer kilometers kilometre kilometres meter meters metre metres centimeter centimeters centimetre centimetres "
    "millimeter millimeters millimetre millimetres micrometer micrometers gram grams gramme grammes kilogram kilograms "
    "milligram milligrams ton tons tonne tonnes stone stones milliliter milliliters millilitre millilitres cl dl "
    "quart quarts pint pints cup cups tablespoon tablespoons teaspoon teaspoons tbsp tsp ms msec millisecond milliseconds "
    "secs mins hrs decade decades century centuries pound sterling cny jpy yen yuan rupee rupees peso pesos franc francs "
    "kelvin radian radians rad hertz kilohertz megahertz gigahertz watt watts kilowatt kilowatts megawatt megawatts mw mwh "
    "newtons kj kilojoule kilojoules cal kcal calorie calories pa kpa mpa pascal pascals bar bars psi atm ohm ohms mv kv ma mah "
    "knot knots kph acre acres hectare hectares ha bit bits kbps mbps gbps kilobyte kilobytes megabyte megabytes gigabyte "
    "gigabytes terabyte terabytes mol mole moles lumen lumens lux dozen dozens "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent "
    "grad gramm kilo kilos tonnen meilen fuß zoll pfund unzen kilometern metern "
    "heure heures jour jours semaine semaines mois an ans année années seconde secondes pourcent degré degrés "
    "kilomètre kilomètres mètre mètres centimètre centimètres millimètre millimètres tonne livre livres pouce pouces pied pieds "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados "
    "kilómetro kilómetros metro metros centímetro centímetros milímetro milímetros gramo gramos kilogramo kilogramos "
    "tonelada toneladas litro litros milla millas libra libras pulgada pulgadas pie pies euros dólar dólares".split()
)
#: Number words of the documents' languages; articles are none.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn "
    "neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante "
    "soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta "
    "sesenta setenta ochenta noventa cien ciento mil".split()
)
_WORD, _NUMBER, _CAPITAL, _UNIT, _STOP, _LINE = range(6)
_LITERAL = np.uint64(0x94D049BB133111EB)
_SLOT_HASH = np.array([0, 0xA5B35705F00DCAFE, 0x6C62272E07BB0142, 0x27D4EB2F165667C5], np.uint64)


class Lexicon:
    """Tokens of the distinct stretches between white space, kept in bounded tables."""

    def __init__(self):
        self._forget()
        self.tokens, self.bounds = Growing(np.int32), Growing(np.int64, [0])
        #: Whether a stop stands before the first token, and behind the last.
        self.begins, self.ends = Growing(bool), Growing(bool)
        self.stretches = Stretches(self._learn, self._keep)

    def _forget(self) -> None:
        self.words, self.lower = Numbers(), []
        self.kind, self.hash, self.caseless = Growing(np.int8), Growing(np.uint64), Growing(np.uint64)

    def _keep(self, stay: np.ndarray) -> None:
        sizes = self.bounds.array[stay + 1] - self.bounds.array[stay]
        tokens = take_ragged(self.tokens.array, self.bounds.array[stay], sizes)
        begins, ends = self.begins.array[stay], self.ends.array[stay]
        self.tokens, self.bounds = Growing(np.int32), Growing(np.int64, [0])
        self.begins, self.ends = Growing(bool), Growing(bool)
        self.tokens.extend(tokens)
        self.bounds.extend(ragged(sizes)[1:])
        self.begins.extend(begins)
        self.ends.extend(ends)

    def _learn_words(self, fresh: list[str]) -> None:
        kinds, hashes, caseless = [], [], []
        for word in fresh:
            low = word.lower()
            self.lower.append(word if low == word else low)
            if word in _STOPS or word == "\n":
                kind = _LINE if word == "\n" else _STOP
            elif word[0].isdigit() or low in NUMBER_WORDS:
                kind = _NUMBER
            elif word[0].isupper() and len(word) > 1 and word[1:].islower():
                kind = _CAPITAL
            else:
                kind = _UNIT if low in UNITS else _WORD
            kinds.append(kind)
            hashes.append(xxhash.xxh64_intdigest(low))
            folded = low.casefold()
            caseless.append(hashes[-1] if folded == low else xxhash.xxh64_intdigest(folded))
        self.kind.extend(kinds)
        self.hash.extend(np.array(hashes, np.uint64))
        self.caseless.extend(np.array(caseless, np.uint64))

    def _learn(self, new: list[str]) -> None:
        found = _PIECE.findall("\n".join(new))
        which, fresh = self.words.fresh(found)
        self._learn_words(fresh)
        kind = self.kind.array[which]
        line, real = kind == _LINE, kind < _STOP
        owner = np.cumsum(line) - line
        per = np.bincount(owner[real], minlength=len(new))
        place, stops = np.flatnonzero(real), np.flatnonzero(kind == _STOP)
        edge = ragged(per)
        # Places of the first and the last token of each stretch.
        some = np.flatnonzero(per)
        first, last = np.full(len(new), len(found)), np.full(len(new), -1)
        first[some], last[some] = place[edge[some]], place[edge[some + 1] - 1]
        begins, ends = np.zeros(len(new), bool), np.zeros(len(new), bool)
        of = owner[stops]
        begins[of[(stops < first[of]) & (per[of] > 0)]] = True
        ends[of[stops > last[of]]] = True
        self.bounds.extend(edge[1:] + len(self.tokens))
        self.tokens.extend(which[real])
        self.begins.extend(begins)
        self.ends.extend(ends)

    def numbered(self, stretches: pa.Array) -> np.ndarray:
        """Number in the table of each stretch; none may hold white space."""
        if len(self.words) > WORDS:
            # Stretches name words by their numbers, so they go as well.
            self.stretches.forget()
            self._forget()
        return self.stretches.numbered(stretches, STRETCHES, CHUNK)


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    """The lexicon of this process."""
    return Lexicon()


class Templates:
    """Template and literal tokens of a batch of texts, one text after the other.

    ``token``, ``literal`` and ``offsets`` are of the tokens as they stand;
    ``slot``, ``hash`` and ``bounds`` of those with each run of names as one,
    which begins at token ``span``. Valid until the next batch is made.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        text = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        text = pc.replace_substring(pc.fill_null(text, ""), "\n", " . ")
        cut = pc.ascii_split_whitespace(text.cast(pa.large_string()))
        bounds = np.asarray(cut.offsets).astype(np.int64)
        self.known = lexicon()
        which = self.known.numbered(cut.flatten())
        starts = self.known.bounds.array[which]
        n = self.known.bounds.array[which + 1] - starts
        self.token = take_ragged(self.known.tokens.array, starts, n)
        self.offsets = ragged(n)[bounds - bounds[0]]
        kind = self.known.kind.array[self.token]
        # A sentence begins with the text, behind a stop, or at one inside.
        if len(which):
            stop_before = np.concatenate([[True], self.known.ends.array[which][:-1]])
            first = np.zeros(len(self.token), bool)
            real = np.flatnonzero(n > 0)
            # A stretch without tokens passes the stop before it on.
            stops = np.concatenate([[0], np.cumsum(stop_before | self.known.begins.array[which])])
            upto = stops[real + 1]
            before = np.concatenate([[0], stops[real[:-1] + 1]]) if len(real) else upto
            first[ragged(n)[:-1][real]] = upto > before
            first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        else:
            first = np.zeros(0, bool)
        after_number = np.concatenate([[False], kind[:-1] == _NUMBER]) & ~first if len(kind) else first
        slot = np.zeros(len(kind), np.int8)
        slot[kind == _NUMBER] = _NUMBER
        slot[(kind == _CAPITAL) & ~first] = _CAPITAL
        slot[(kind == _UNIT) & after_number] = _UNIT
        again = np.zeros(len(slot), bool)
        again[1:] = (slot[1:] == _CAPITAL) & (slot[:-1] == _CAPITAL)
        kept = np.flatnonzero(~again)
        self.span = np.append(kept, len(slot))
        self.slot = slot[kept]
        self.bounds = ragged(~again)[self.offsets]
        self.hash = np.where(self.slot > 0, _SLOT_HASH[self.slot], self.known.hash.array[self.token[kept]])
        self.literal = self.known.caseless.array[self.token]

    def windows(self, width: int, literal: bool, short: set[int] | None = None, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Start, text, hash and size of the windows; templates need enough words.

        With ``short``, windows of these sizes are added to those of ``width``
        tokens; without, a text of fewer tokens has one window: all of it.
        With ``bitmap``, only windows in this filter are returned.
        """
        tokens, offsets = (self.literal, self.offsets) if literal else (self.hash, self.bounds)
        n = np.diff(offsets)
        words = None if literal else np.concatenate([[0], np.cumsum(self.slot == 0)])
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        for size in {width, *({int(x) for x in np.unique(n[(n > 0) & (n < width)])} if short is None else short)}:
            if len(tokens) < size:
                continue
            h = gram_hash(tokens, size)
            if literal:
                h ^= _LITERAL
            s = np.arange(len(h)) if bitmap is None else np.flatnonzero(_in_bitmap(bitmap, h))
            owner = np.searchsorted(offsets, s, "right") - 1
            keep = s + size <= offsets[owner + 1]
            if short is None and size < width:
                keep &= n[owner] == size
            if not literal:
                keep &= words[s + size] - words[s] >= min(LEAST_WORDS, size)
            found.append((s[keep], owner[keep], h[s[keep]], np.full(int(keep.sum()), size)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _words(self, tokens: np.ndarray) -> list[str]:
        return [self.known.lower[t] for t in tokens.tolist()]

    def text(self, start: int, size: int, literal: bool) -> str:
        """What a window is, apart from its values."""
        if literal:
            return "= " + " ".join(w.casefold() for w in self._words(self.token[start : start + size]))
        marks = ("", "<number>", "<name>", "<unit>")
        words = self._words(self.token[self.span[start : start + size]])
        return " ".join(marks[k] or w for k, w in zip(self.slot[start : start + size].tolist(), words, strict=True))

    def slots(self, start: int, size: int) -> list[str]:
        at = start + np.flatnonzero(self.slot[start : start + size])
        return [" ".join(self._words(self.token[self.span[k] : self.span[k + 1]])) for k in at]


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


_ROWS = "hash long, id long, pos int, total int, size int, literal boolean, template string, slots array<string>"


def _rows(t: Templates, ids: list, literal: bool, starts, owner, hashes, size) -> pa.RecordBatch:
    offsets = t.offsets if literal else t.bounds
    total = np.bincount(owner, minlength=len(offsets) - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hashes.view(np.int64)),
            pa.array([ids[o] for o in owner], pa.int64()),
            pa.array((starts - offsets[owner]).astype(np.int32)),
            pa.array(total[owner].astype(np.int32)),
            pa.array(size.astype(np.int32)),
            pa.array(np.full(len(starts), literal)),
            pa.array([t.text(s, k, literal) for s, k in zip(starts, size, strict=True)], pa.string()),
            pa.array([[] if literal else t.slots(s, k) for s, k in zip(starts, size, strict=True)], pa.list_(pa.string())),
        ],
        names=["hash", "id", "pos", "total", "size", "literal", "template", "slots"],
    )


def consistency(matches: list[tuple[int, int, list[str], list[str]]]) -> tuple[int, float, bool]:
    """Slots compared, share that agrees, and whether any value was changed.

    ``matches``: document position, item position, document and item slots of
    each window. Windows of one alignment (equal difference of positions) share
    one mapping of item values to document values; a slot agrees if it has the
    value that its item value stands against most often there.
    """
    by_shift: dict[int, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for at, item_at, ours, theirs in matches:
        for a, b in zip(ours, theirs, strict=True):
            by_shift[at - item_at][b][a] += 1
    slots = agree = 0
    changed = False
    for values in by_shift.values():
        for b, seen in values.items():
            slots += seen.total()
            agree += max(seen.values())
            changed |= any(a != b for a in seen)
    return slots, agree / slots if slots else 1.0, changed


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least_coverage: float = 0.3, least_consistency: float = 0.8,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Documents that hold benchmark items, one row for each pair.

    Returns ``doc_id, item_id, matched`` (distinct item windows found),
    ``windows`` (of the item), ``coverage, slots, consistency`` and
    ``reparameterised``: of the templates, or of the literal windows if only
    those pass. Whole texts are looked at. An item of fewer tokens than
    ``width`` is one window, found anywhere in a document; one with no token
    gives none. A template window has ``LEAST_WORDS`` words beside its
    placeholders, or as many as tokens if these are fewer: an item without such
    a window is found in its own words only, not with other values. Nulls are empty texts; rows with a null id are left out.
    Repeated rows count once.
    """

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", SLICE_BYTES):
            t = Templates(table.column("text"))
            for literal in (False, True):
                yield _rows(t, table.column("id").to_pylist(), literal, *t.windows(width, literal))

    def pick(df: DataFrame, id_: str, body: str) -> DataFrame:
        return df.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.coalesce(body, F.lit("")).alias("text"))

    items = pick(benchmark, item_key, item_text).mapInArrow(tidy(item_rows), _ROWS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        sizes = set()
        for batch in batches:
            seen[(np.asarray(batch.column("hash")).view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            sizes |= {int(x) for x in np.unique(np.asarray(batch.column("size")) * 2 + np.asarray(batch.column("literal")))}
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.packbits(seen).tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["bits", "sizes"]
            )

    # A filter of fixed size (half a megabyte) is what tasks are sent, and the sizes below width.
    bitmap = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    short: tuple[set[int], set[int]] = (set(), set())
    for part, sizes in items.select("hash", "size", "literal").mapInArrow(tidy(bits), "bits binary, sizes array<int>").toLocalIterator():
        bitmap |= np.frombuffer(part, np.uint8)
        for x in sizes:
            if x // 2 < width:
                short[x % 2].add(x // 2)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for table in gathered(batches, "text", SLICE_BYTES):
            t = Templates(table.column("text"))
            for literal in (False, True):
                found = t.windows(width, literal, short[literal], known)
                if len(found[0]):
                    yield _rows(t, table.column("id").to_pylist(), literal, *found)

    theirs = items.select(
        "hash", "template", "literal", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("total").alias("windows"), F.col("slots").alias("item_slots")
    ).distinct()
    pairs = (
        pick(docs, key, text).mapInArrow(tidy(doc_rows), _ROWS).select("hash", "template", "id", "pos", "slots")
        .join(theirs, ["hash", "template"])
        .groupBy("id", "item")
        .agg(F.collect_set(F.struct("literal", "windows", "pos", "item_pos", "slots", "item_slots")).alias("found"))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                matches = defaultdict(list)
                for m in r["found"]:
                    matches[m["literal"], m["windows"]].append((m["pos"], m["item_pos"], m["slots"], m["item_slots"]))
                passed = {}
                for (literal, windows), found in matches.items():
                    slots, share, changed = consistency(found)
                    n = len({m[1] for m in found})
                    if n / windows >= least_coverage and share >= least_consistency:
                        passed[literal, windows] = (r["id"], r["item"], n, windows, n / windows, slots, share, changed)
                templates = [x for (literal, _), x in passed.items() if not literal]
                out += templates or passed.values()
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc", "item", "matched", "windows", "coverage", "slots", "consistency", "reparameterised"],
            )

    return (
        pairs.mapInArrow(tidy(judge), "doc long, item long, matched long, windows long, coverage double, slots long, consistency double, reparameterised boolean")
        .withColumnRenamed("doc", key)
        .withColumnRenamed("item", item_key)
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; all columns stay, and so do rows without an id."""
    found = contaminated(docs, benchmark, key=key, **options).select(key).distinct()
    return docs.join(found, key, "left_anti")
