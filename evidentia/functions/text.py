"""Column builders for text: no UDF among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.config import UUID_NAMESPACE
from evidentia.functions import lexicons as lex


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize_span(c: Column | str) -> Column:
    """Lower case, everything but ``[a-z0-9]`` to single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def fold(c: Column | str) -> Column:
    """Key of an entity: collapsed white space, lower case."""
    return F.lower(collapse(c))


def compact(c: Column | str) -> Column:
    """Key of an entity's letters and digits alone."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def words(c: Column | str) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def tokens(c: Column | str) -> Column:
    """Distinct lower-case words of ``[a-z0-9]``."""
    return F.array_distinct(F.filter(F.split(normalize_span(c), " "), lambda w: w != ""))


def sentences(c: Column | str) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"(?<=[.!?])\s+"), lambda s: s != "")


def numbers(c: Column | str) -> Column:
    """Every signed number of a text, thousands commas removed."""
    found = F.regexp_extract_all(col(c), F.lit(r"([-+]?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def normalize_head(c: Column | str) -> Column:
    """Section head: lower case, no numbering, no leading chapter or section."""
    x = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"^\d+(?:\.\d+)*\.?\s*", "")
    x = collapse(F.regexp_replace(x, r"^(chapter|section)\s+", ""))
    return F.regexp_replace(x, r"^[\p{Punct} ]+|[\p{Punct} ]+$", "")


def classify_section(c: Column | str) -> Column:
    """Type of a section head: the longest keyword in it, ties in registry order."""
    head = normalize_head(c)
    ranked = sorted(
        ((kind, word, order) for order, (kind, all_) in enumerate(lex.SECTION_KEYWORDS.items()) for word in all_.split("|")),
        key=lambda x: (-len(x[1]), x[2]),
    )
    out = F.when(head == "", F.lit(lex.OTHER_SECTION))
    for kind, word, _ in ranked:
        out = out.when(F.contains(head, F.lit(word)), F.lit(kind))
    return out.otherwise(F.lit(lex.OTHER_SECTION))


def chunk_uuid(paper: Column | str, section: Column | str, order: Column | str) -> Column:
    """UUIDv5 of ``paper:section:order`` in the corpus namespace."""
    name = F.concat_ws(":", col(paper), col(section), col(order).cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), F.lower(F.hex(variant)), F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12),
    )


def cited_ids(c: Column | str) -> Column:
    """Chunk and paper ids of a text in its order, distinct, versions cut off."""
    found = F.regexp_extract_all(col(c), F.lit(rf"\b({lex.UUID}|{lex.PAPER_ID}(?:v\d+)?)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.when(F.contains(x, F.lit("-")), x).otherwise(F.regexp_replace(x, r"v\d+$", ""))))


def quoted_spans(c: Column | str) -> Column:
    """Spans of 25 to 400 characters in straight or curly quotes."""
    straight = r'(?<![0-9A-Za-z])"(?=\S)[^"\n]{25,400}?(?<=\S)"(?![0-9A-Za-z])'
    curly = "\u201c(?=\\S)[^\u201d\\n]{25,400}?(?<=\\S)\u201d"
    return F.transform(
        F.regexp_extract_all(col(c), F.lit(f"({straight}|{curly})"), F.lit(1)),
        lambda x: F.substring(x, F.lit(2), F.length(x) - 2),
    )


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    n = F.length(F.coalesce(col(c), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def rate(part: Column, whole: Column) -> Column:
    """Share rounded to four places, null of nothing."""
    return F.round(F.try_divide(part, whole), 4)


def rounded(c: Column | str, digits: int) -> Column:
    """A double at some digits, by its product with their power of ten.

    ``round`` looks at the shortest decimal of the quotient, which can lie just
    below a half that the quotient stands for: 0.333171 / 0.2.
    """
    scale = F.lit(10.0**digits)
    return F.round(col(c) * scale) / scale


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, (0, 0) of nothing."""
    n = n.cast("double")
    p, zz = F.try_divide(k, n), z * z
    middle = p + F.try_divide(F.lit(zz / 2), n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz / 4), n * n))
    scale = 1 + F.try_divide(F.lit(zz), n)
    zero = F.lit(0.0)
    return (
        F.when(n == 0, zero).otherwise(F.greatest(zero, (middle - spread) / scale)),
        F.when(n == 0, zero).otherwise(F.least(F.lit(1.0), (middle + spread) / scale)),
    )


def value_matches(gold: Column, text: Column) -> Column:
    """A gold number within ``max(0.01, 0.5 %)``, else the gold text, else all its
    words of over two letters."""

    def norm(c: Column) -> Column:
        x = F.regexp_replace(F.lower(collapse(c)), ",", "")
        return F.regexp_replace(x, r"^[\p{Punct} ]+|[\p{Punct} ]+$", "")

    g, t = norm(gold), norm(text)
    first = F.try_element_at(numbers(g), F.lit(1))
    near = F.exists(numbers(t), lambda x: F.abs(x - first) <= F.greatest(F.lit(0.01), F.abs(first) * 0.005))
    long = F.filter(F.split(g, " "), lambda w: F.length(w) > 2)
    present = (F.size(long) > 0) & F.forall(long, lambda w: F.contains(t, w))
    return (g != "") & F.when(first.isNotNull(), near).otherwise(F.contains(t, g) | present)


def clause_matches(gold: Column, produced: Column) -> Column:
    """The gold clause in the produced one, or all its words of over two letters."""
    g, p = normalize_span(gold), normalize_span(produced)
    long = F.filter(F.split(g, " "), lambda w: F.length(w) > 2)
    return (g != "") & (F.contains(p, g) | ((F.size(long) > 0) & F.forall(long, lambda w: F.array_contains(F.split(p, " "), w))))
