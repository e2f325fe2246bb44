"""Column builders for answers, ledgers and what sub-tasks return: no UDF among them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.config import GATE_AGGREGATE, GATE_CLAIM
from evidentia.functions import lexicons as lex
from evidentia.functions import text as X

STRINGS = "array<string>"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def not_blank(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def snippet(text: Column, terms: Column, width: int = 400) -> Column:
    """A window around the first term (in their order) that the text holds; its
    beginning if it holds none. A third of the window stands before the term."""
    whole = X.collapse(F.coalesce(text, F.lit("")))
    found = F.filter(F.transform(terms, lambda t: F.when(t != "", F.instr(F.lower(whole), F.lower(t))).otherwise(0)), lambda p: p > 0)
    at = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(1))
    start = F.greatest(F.lit(0), at - 1 - width // 3)
    none = F.lit("")
    before = F.when((F.size(found) > 0) & (start > 0), "...").otherwise(none)
    behind = F.when((F.size(found) > 0) & (start + width < F.length(whole)), "...").otherwise(none)
    return F.concat(before, F.substring(whole, start + 1, F.lit(width)), behind)


def gold_entities(c: Column | str) -> Column:
    """``name, type`` of ``Name:Type; Name:Type``; the last colon parts them, no type is Concept."""
    parts = not_blank(F.split(X.col(c), ";"))
    named = lambda p, k: F.trim(F.regexp_extract(p, r"(?s)^(.*):([^:]*)$", k))
    return F.transform(
        parts,
        lambda p: F.when(
            F.contains(p, F.lit(":")),
            F.struct(named(p, 1).alias("name"), F.when(named(p, 2) == "", "Concept").otherwise(named(p, 2)).alias("type")),
        ).otherwise(F.struct(p.alias("name"), F.lit("Concept").alias("type"))),
    )


def clean_surface(c: Column | str) -> Column:
    """Surface text without the spaces that joining tokens left in numbers and around marks."""
    tight = F.regexp_replace(F.coalesce(X.col(c), F.lit("")), r"(?<=\d)\s*\.\s*(?=\d)", ".")
    tight = F.regexp_replace(tight, r"\s+([,.;:!?%)\]])", "$1")
    return strip(F.regexp_replace(F.regexp_replace(tight, r"([(\[])\s+", "$1"), r"\s{2,}", " "))


def triple_question(head: Column, head_type: Column, relation: Column, tail: Column, tail_type: Column, paper: Column) -> Column:
    """One line that asks an annotator whether a triple holds."""
    return F.format_string("Is it true that %s (%s) %s %s (%s) at arxiv paper %s", head, head_type, relation, tail, tail_type, paper)


def numeric_sentence(text: Column, number: Column) -> Column:
    """The first sentence that states a number (given as it is written), collapsed."""
    return X.collapse(F.try_element_at(F.filter(X.sentences(text), lambda s: F.contains(s, number)), F.lit(1)))


def perturb_number(c: Column | str, step: int = 17) -> Column:
    """``text, before, after``: the first number of a text replaced by another."""
    text = X.col(c)
    raw = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0)
    before = raw.try_cast("double")
    new = F.when(F.contains(raw, F.lit(".")), F.format_string("%.1f", before + step)).otherwise((before + step).cast("long").cast("string"))
    at = F.instr(text, raw)
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(raw), F.length(text)))
    return F.when(raw != "", F.struct(swapped.alias("text"), before.alias("before"), (before + step).alias("after")))


#: A fenced block: its language and its body.
FENCE = r"(?s)```[ \t]*([A-Za-z0-9_+-]*)[^\n]*\n(.*?)```"


def code_block(c: Column | str, languages: Sequence[str] = lex.CODE_LANGUAGES) -> Column:
    """Body of the first fenced block in one of the languages, null of none; indentation stays."""
    kinds, bodies = (F.regexp_extract_all(X.col(c), F.lit(FENCE), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(kinds.alias("kind"), bodies.alias("body"))
    fit = F.filter(pairs, lambda p: F.lower(p["kind"]).isin(*languages))
    return F.regexp_replace(F.try_element_at(fit, F.lit(1))["body"], r"^\n+|\n+$", "")


def final_answer(c: Column | str, marker: str = lex.FINAL_MARKER) -> Column:
    """What follows the last marker outside fenced blocks; null without one, or of nothing."""
    outside = F.regexp_replace(F.coalesce(X.col(c), F.lit("")), FENCE, " ")
    answer = strip(F.substring_index(outside, marker, -1))
    return F.when(F.contains(outside, F.lit(marker)) & (answer != ""), answer)


def prose(c: Column | str) -> Column:
    """A completion without its fenced blocks."""
    outside = F.regexp_replace(F.coalesce(X.col(c), F.lit("")), FENCE, " ")
    return strip(F.regexp_replace(outside, r"\n{3,}", "\n\n"))


def unfenced(c: Column | str) -> Column:
    """The body of a reply that is one fenced block, else the reply."""
    text = strip(X.col(c))
    body = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*?)\n?```$", 1)
    return F.when(body != "", body).otherwise(text)


def json_in_prose(c: Column | str) -> Column:
    """The text from the first opening to the last closing brace; null without them."""
    found = F.regexp_extract(X.col(c), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def truncated(text: Column, most: int) -> Column:
    """A text cut to ``most`` characters, with a mark that says so."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… [truncated]"))).otherwise(text)


def normal_answer(c: Column) -> Column:
    """Lower case, collapsed, no stop at the ends."""
    return F.lower(F.regexp_replace(X.collapse(c), r"^[.!?;:]+|[.!?;:]+$", ""))


def score_answer(answer: Column, gold: Column, kind: Column) -> Column:
    """``correct, predicted`` by format: integer, sorted-id-list, uuid, or free
    (the gold answer stands in the answer)."""

    def number(c: Column) -> Column:
        return F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?\d+", 0).try_cast("double")

    def ids(c: Column) -> Column:
        parts = F.transform(F.split(c, r"[\s,;]+"), lambda x: F.regexp_replace(x, r"""^[\[\]()'"]+|[\[\]()'"]+$""", ""))
        return F.array_sort(F.filter(parts, lambda x: x != ""))

    text, none = strip(F.coalesce(answer, F.lit(""))), F.lit(False)
    uuid = F.lower(F.regexp_extract(text, lex.UUID, 0))
    free = normal_answer(text)
    correct = (
        F.when(kind == "integer", number(text) == number(gold))
        .when(kind == "sorted-id-list", (F.size(ids(text)) > 0) & (ids(text) == ids(gold)))
        .when(kind == "uuid", (uuid != "") & (uuid == F.lower(gold)))
        .otherwise(F.contains(free, normal_answer(gold)))
    )
    predicted = (
        F.when(kind == "integer", number(text).cast("long").cast("string"))
        .when(kind == "sorted-id-list", F.array_join(ids(text), ","))
        .when(kind == "uuid", uuid)
        .otherwise(F.substring(free, 1, 200))
    )
    return F.struct(F.coalesce(correct, none).alias("correct"), predicted.alias("predicted"))


def truth_of(label: Column) -> Column:
    """1 of a supported claim, 0 of one that is partly or not, null of any other label."""
    kind = F.lower(F.trim(label))
    return F.when(kind == "supported", 1).when(kind.isin("partial", "unsupported"), 0)


def format_evidence(items: Column, most: int) -> Column:
    """``[key] text`` of an array of ``struct<key, text>``, parted by bars, up to ``most`` characters of lines."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast(STRINGS).alias("lines"))

    def add(s: Column, x: Column) -> Column:
        body = X.collapse(F.coalesce(x["text"], F.lit("")))
        line = F.substring(F.concat(F.lit("["), x["key"], F.lit("] "), body), F.lit(1), F.lit(most) - s["used"])
        fits = (body != "") & (s["used"] < most)
        return F.when(fits, F.struct((s["used"] + F.length(line)).alias("used"), F.concat(s["lines"], F.array(line)).alias("lines"))).otherwise(s)

    return F.array_join(F.aggregate(items, start, add)["lines"], " | ")


def render_items(items: Column, most: int = 2400) -> Column:
    """``[key]`` and the first characters of each text, one block each."""
    blocks = F.transform(items, lambda x: F.concat(F.lit("["), x["key"], F.lit("]\n"), F.substring(F.coalesce(x["text"], F.lit("")), 1, most)))
    return F.array_join(blocks, "\n\n")


def ledger_status(answer: Column, units: Column, texts: Column) -> Column:
    """missing (``units`` is null), empty, stale (no frame's first 80 characters stand in the answer) or ok."""
    whole = F.lower(X.collapse(F.coalesce(answer, F.lit(""))))
    heads = F.transform(texts, lambda t: F.lower(F.substring(X.collapse(t), 1, 80)))
    held = F.exists(heads, lambda h: (h != "") & F.contains(whole, h)) & (whole != "")
    return F.when(units.isNull(), "missing").when(units < 1, "empty").when(F.coalesce(held, F.lit(False)), "ok").otherwise("stale")


def verify_quotes(quotes: Column, text: Column, least: int = 25, longest: int = 400, most: int = 3) -> Column:
    """``kept`` (verbatim spans of the text, the first ``most``) and how many were ``dropped``."""
    whole = X.collapse(F.coalesce(text, F.lit("")))
    spans = F.transform(quotes, X.collapse)
    kept = F.slice(F.filter(spans, lambda q: F.length(q).between(least, longest) & F.contains(whole, q)), 1, most)
    return F.struct(kept.alias("kept"), (F.size(quotes) - F.size(kept)).alias("dropped"))


def budget_warning(used: Mapping[str, Column], limits: Mapping[str, float], ratio: float = 0.8) -> Column:
    """``cap, share`` of the cap that is used up most, from ``ratio`` on; ties go to
    the first. A limit of zero is none; null where all caps hold."""
    shares = [
        F.struct((F.coalesce(used[name], F.lit(0)) / F.lit(float(limit))).alias("share"), F.lit(-k).alias("order"), F.lit(name).alias("cap"))
        for k, (name, limit) in enumerate(limits.items()) if limit > 0 and name in used
    ]
    best = F.array_max(F.filter(F.array(*shares), lambda s: s["share"] >= ratio))
    return F.when(best.isNotNull(), F.struct(best["cap"].alias("cap"), best["share"].alias("share")))


def normal_buckets(raw: Column, order: Sequence[str] = lex.BUCKETS) -> Column:
    """The fixed buckets (``bucket, clauses``) of an array of the same kind.

    Names fit without case and spaces, the last of a name counts; clauses are
    stripped, blank ones dropped, and one that a bucket before holds as well
    (without case, white space collapsed) is kept there only.
    """
    key = lambda x: F.lower(X.collapse(x))

    def own(name: str) -> Column:
        fit = F.filter(raw, lambda b: F.lower(F.regexp_replace(b["bucket"], r"\s", "")) == name)
        return F.coalesce(not_blank(F.try_element_at(fit, F.lit(-1))["clauses"]), F.array().cast(STRINGS))

    def distinct(clauses: Column, seen: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            known = F.exists(done, lambda y: key(y) == key(x)) | F.exists(seen, lambda y: key(y) == key(x))
            return F.when(known, done).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(clauses, F.array().cast(STRINGS), add)

    found, seen = [], F.array().cast(STRINGS)
    for name in order:
        found.append(F.struct(F.lit(name).alias("bucket"), distinct(own(name), seen).alias("clauses")))
        seen = F.concat(seen, own(name))
    return F.array(*found)


def flat_clauses(buckets: Column) -> Column:
    """All clauses of ordered buckets in one query text."""
    return F.array_join(not_blank(F.flatten(F.transform(buckets, lambda b: b["clauses"]))), " ")


def bucket_scores(gold: Column, produced: Column) -> Column:
    """Clauses on each side that the other side has, with recall and precision."""
    gold, produced = (F.filter(c, lambda x: F.trim(x) != "") for c in (gold, produced))
    g = F.size(F.filter(gold, lambda e: F.exists(produced, lambda p: X.clause_matches(e, p))))
    p = F.size(F.filter(produced, lambda x: F.exists(gold, lambda e: X.clause_matches(e, x))))
    return F.struct(
        F.size(gold).alias("gold"), F.size(produced).alias("produced"), g.alias("matched_gold"), p.alias("matched_produced"),
        X.rate(g, F.size(gold)).alias("recall"), X.rate(p, F.size(produced)).alias("precision"),
    )


def union_recall(gold: Column, produced: Column) -> Column:
    """Gold clauses that stand in any produced bucket (``bucket, clauses``): ``gold, matched, recall``."""
    every, wanted = not_blank(F.flatten(F.transform(produced, lambda b: b["clauses"]))), not_blank(gold)
    n = F.size(F.filter(wanted, lambda e: F.exists(every, lambda p: X.clause_matches(e, p))))
    return F.struct(F.size(wanted).alias("gold"), n.alias("matched"), X.rate(n, F.size(wanted)).alias("recall"))


def excerpts(ids: Column, *texts: Column) -> Column:
    """``id, text`` of a worksheet's ids and excerpts, in order, blank ones left out."""
    both = F.arrays_zip(ids.alias("id"), F.array(*texts).alias("text"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return F.filter(both, lambda x: ~blank(x["id"]) & ~blank(x["text"]))


def final_gate(aggregate: Column, claims: Column, score: Column | None = None, threshold: float = 0.8, fails: tuple[float, float] = (GATE_AGGREGATE, GATE_CLAIM), named: int = 3) -> Column:
    """``verdict, decision, named`` of an answer's last gate.

    ``aggregate``: the probability that it is not supported; ``claims``: those of
    its claims (``name, p``). A score from ``threshold`` on passes by itself. A
    missing aggregate is uncertain. Where the aggregate fails and no claim does,
    the likeliest claims from the aggregate's bound on are named.
    """
    failed = F.filter(claims, lambda c: c["p"] >= fails[1])
    near = F.array_sort(
        F.filter(claims, lambda c: c["p"] >= fails[0]),
        lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0),
    )
    by_all, by_claim = aggregate >= fails[0], F.size(failed) > 0
    decision = F.when(by_all & by_claim, "both").when(by_claim, "claim").when(by_all, "aggregate").otherwise("none")
    names = lambda a: F.transform(a, lambda c: c["name"])
    said = F.when(by_claim, names(failed)).when(by_all, names(F.slice(near, 1, named))).otherwise(F.array().cast(STRINGS))
    whole = F.when(aggregate.isNull(), F.struct(F.lit("uncertain").alias("verdict"), F.lit("none").alias("decision"), F.array().cast(STRINGS).alias("named"))).otherwise(
        F.struct(F.when(by_all | by_claim, "fail").otherwise("pass").alias("verdict"), decision.alias("decision"), said.alias("named"))
    )
    if score is None:
        return whole
    short = F.struct(F.lit("pass").alias("verdict"), F.lit("score").alias("decision"), F.array().cast(STRINGS).alias("named"))
    return F.when(score >= threshold, short).otherwise(whole)


def citation_labels(c: Column | str) -> Column:
    """``id, label`` of an answer's citations, numbered in order of first mention."""
    return F.transform(X.cited_ids(c), lambda x, i: F.struct(x.alias("id"), F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("label")))


def answer_units(c: Column | str) -> Column:
    """Sentences and lines of an answer."""
    return not_blank(F.split(F.coalesce(X.col(c), F.lit("")), rf"{lex.SENTENCE_GAP}|\n+"))


def claim_scores(answer: Column, gold: Column, recorded: Column, texts: Column) -> Column:
    """Gold claims (``values, chunk_uuid``) against an answer, the chunks that a
    run recorded, and chunk texts by id.

    ``matched``: claims that a unit of the answer states. ``judged``: units that
    state one and cite something; ``supported``: those of which a cited chunk
    states one too. ``gold_chunks``, and of them ``in_record`` and ``cited``.
    """
    states = lambda claim, text: F.exists(claim["values"], lambda v: X.value_matches(v, text))
    units = answer_units(answer)
    matched = F.filter(gold, lambda g: F.exists(units, lambda u: states(g, u)))
    judged = F.filter(units, lambda u: (F.size(X.cited_ids(u)) > 0) & F.exists(gold, lambda g: states(g, u)))

    def holds(unit: Column) -> Column:
        cited = F.filter(F.transform(X.cited_ids(unit), lambda i: F.try_element_at(texts, i)), lambda t: t.isNotNull())
        return F.exists(cited, lambda t: F.exists(gold, lambda g: states(g, t)))

    chunks = F.array_distinct(F.filter(F.transform(gold, lambda g: g["chunk_uuid"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    named = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(f"({lex.UUID})"), F.lit(1))
    return F.struct(
        F.size(gold).alias("claims"), F.size(matched).alias("matched"), F.size(judged).alias("judged"), F.size(F.filter(judged, holds)).alias("supported"),
        F.size(chunks).alias("gold_chunks"), F.size(F.array_intersect(chunks, recorded)).alias("in_record"),
        F.size(F.array_intersect(chunks, named)).alias("cited"),
    )


def token_span(tokens: Column, start: Column, stop: Column) -> Column:
    """``first, last`` of the tokens (``start, stop``) that overlap a span of characters; null of none."""
    hits = F.filter(F.transform(tokens, lambda t, i: F.when((t["start"] < stop) & (t["stop"] > start), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.struct(F.array_min(hits).alias("first"), F.array_max(hits).alias("last")))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of parts in order, whatever is in them: each with its length before it."""
    sized = [F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.sha2(reduce(F.concat, [F.coalesce(s, F.lit("-")) for s in sized]), 256)
