"""Decontamination against a plain version over tuples of words, and planted changed questions."""

import random
import re
from collections import Counter, defaultdict

from evidentia.llm import decontaminate
from evidentia.llm.decontaminate import NUMBER_WORDS, UNITS, contaminated
from evidentia.llm.queries import table

SF = "/root/testdata/sf0.001"


def tokens(text):
    """(raw word, whether a sentence begins with it) of a text, by characters between words."""
    out, end, fresh = [], 0, True
    for m in re.finditer(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", text):
        gap = text[end : m.start()]
        # Only stops beside white space, or at a stretch's edge, part sentences.
        inside = out and not re.search(r"[\s\x1c-\x1f]", gap)
        if ("\n" in gap) or (re.search(r"[.!?:;|]", gap) and not inside):
            fresh = True
        out.append((m.group(), fresh))
        fresh, end = False, m.end()
    return out


def template(text):
    """Template tokens: (mark or word, value of the slot)."""
    out, before = [], None
    for word, first in tokens(text):
        low = word.lower()
        number = word[0].isdigit() or low in NUMBER_WORDS
        if number:
            new = ("<number>", low)
        elif word[0].isupper() and len(word) > 1 and word[1:].islower():
            new = (low, None) if first else ("<name>", low)
        elif low in UNITS and before and not first:
            new = ("<unit>", low)
        else:
            new = (low, None)
        if new[0] == "<name>" and out and out[-1][0] == "<name>":
            out[-1] = ("<name>", f"{out[-1][1]} {low}")
        else:
            out.append(new)
        before = number
    return out


def windows(seq, sizes, literal):
    for size in sizes:
        for k in range(len(seq) - size + 1):
            part = seq[k : k + size]
            if literal or sum(v is None for _, v in part) >= min(4, size):
                yield k, tuple(w for w, _ in part), [v for _, v in part if v is not None]


def plain(docs, items, width=8):
    """(doc, item) pairs that the rules of the operator report."""
    found = set()
    for literal in (False, True):
        read = (lambda t: [(w.lower().casefold(), None) for w, _ in tokens(t)]) if literal else template
        by, total = defaultdict(list), Counter()
        for i, t in items:
            seq = read(t)
            for k, w, slots in windows(seq, [min(width, len(seq))] if seq else [], literal):
                by[w].append((i, k, slots))
                total[i] += 1
        for d, t in docs:
            seq, hits = read(t), defaultdict(list)
            for k, w, slots in windows(seq, sorted({len(w) for w in by}), literal):
                for i, at, theirs in by[w] if w in by else ():
                    hits[i].append((k, at, slots, theirs))
            for i, hit in hits.items():
                seen = defaultdict(Counter)
                for k, at, ours, theirs in {(k, at, tuple(a), tuple(b)) for k, at, a, b in hit}:
                    for a, b in zip(ours, theirs, strict=True):
                        seen[k - at, b][a] += 1
                slots, agree = sum(c.total() for c in seen.values()), sum(max(c.values()) for c in seen.values())
                if len({h[1] for h in hit}) >= 0.3 * total[i] and (not slots or agree >= 0.8 * slots):
                    found.add((d, i))
    return found


def run(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(frame, bench).collect()}


def test_given_tables_equal_the_plain_version(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"] or "") for r in table(spark, SF, "benchmark").collect()]
    assert set(run(spark, docs, items)) == plain(docs, items) != set()


SHAPES = [
    "yesterday {a} walked {n} {u} from the old mill to the green bridge and {b} waited there for {m} hours in the rain",
    "how many of the {n} boxes that {a} brought to the market in {b} were still there after {m} days of snow",
    "im Herbst kaufte der Bauer {a} {n} {u} Holz und brachte es mit dem Wagen nach {b} zu seiner alten Mutter",
    "combien de {u} reste-t-il quand {a} prend {n} pommes du panier et donne {m} poires au voisin de {b} le soir",
    "cuando {a} llega a {b} con {n} {u} de arroz el tendero le vende {m} panes y una botella de vino tinto",
    "what share of {n} {u} would {a} keep",
]
NAMES = ["Anna", "Bob", "Mary Jane", "Karl Otto Thal", "New York", "Paris", "Lima", "Santa Fe", "Ida"]
UNIT = ["km", "meters", "Stunden".lower(), "litros", "pounds", "années", "kg"]
NUMBER = ["7", "12", "300", "4.5", "seven", "zwölf", "trois", "cuarenta", "1,200"]


def planted(seed, count):
    rng = random.Random(seed)
    fill = lambda shape, k: shape.format(
        a=NAMES[k % len(NAMES)], b=NAMES[(k + 3) % len(NAMES)], n=NUMBER[k % len(NUMBER)], m=NUMBER[(k + 2) % len(NUMBER)], u=UNIT[k % len(UNIT)]
    )
    filler = lambda: " ".join(f"wort{rng.randrange(4000)}" for _ in range(rng.randrange(5, 60)))
    items = [(i, fill(shape, rng.randrange(100))) for i, shape in enumerate(SHAPES)]
    docs = []
    for d in range(count):
        body = fill(SHAPES[d % len(SHAPES)], rng.randrange(100))
        docs.append((d, f"{filler()} {[body, body.upper(), body.lower()][d % 7 % 3 if d % 7 < 2 else 0]} {filler()}"))
    return items, docs


def test_planted_changed_questions_are_found(spark):
    items, docs = planted(3, 240)
    clean = [(1000 + k, " ".join(f"wort{random.Random(k).randrange(4000)}" for _ in range(80))) for k in range(40)]
    got = run(spark, docs + clean, items)
    assert set(got) == plain(docs + clean, items)
    plain_case = [d for d, t in docs if t != t.upper() and any(c.isupper() for c in t)]
    caught = [d for d in plain_case if (d, d % len(SHAPES)) in got]
    assert len(caught) >= 0.9 * len(plain_case)
    assert not any(d >= 1000 for d, _ in got)


def test_small_tables_of_the_lexicon(spark, monkeypatch):
    """Forgetting stretches and words between slices changes nothing."""
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect()][:60]
    monkeypatch.setattr(decontaminate, "STRETCHES", 50)
    monkeypatch.setattr(decontaminate, "WORDS", 80)
    lexicon = decontaminate.Lexicon()
    monkeypatch.setattr(decontaminate, "lexicon", lambda: lexicon)
    import pyarrow as pa

    for _, t in docs:
        small = decontaminate.Templates(pa.array([t]))
        got = [(w, small.slots(k, 1)) for k in range(len(small.slot)) for w in [small.text(k, 1, False)]]
        assert got == [(w, [] if v is None else [v]) for w, v in template(t)]
