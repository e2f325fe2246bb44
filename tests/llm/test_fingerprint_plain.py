"""Fingerprints against a byte-by-byte version, and pairs across ranges and ties."""

import hashlib
import random

from evidentia.llm.fingerprint import ALPHABET, fingerprint, fingerprint_edits, likeness

WORD, ODD = 1 << 64, 0x9E3779B97F4A7C15


def signature(data: bytes, size: int) -> str:
    out, chunk, weight = "", 0, 1

    def letter():
        h = chunk ^ (chunk >> 29)
        return chr(ALPHABET[(h * 0xBF58476D1CE4E5B9 % WORD) >> 58])

    for i, b in enumerate(data):
        chunk, weight = (chunk + (b + 1) * weight) % WORD, weight * ODD % WORD
        recent = [data[i - k] if i >= k else 0 for k in range(7)]
        mixed = 0
        for k, x in enumerate(recent):
            mixed ^= x << 5 * k & 0xFFFFFFFF
        roll = (sum(x * (8 - k) for k, x in enumerate(recent)) + mixed) & 0xFFFFFFFF
        if roll % size == size - 1 and len(out) < 63:
            out, chunk, weight = out + letter(), 0, 1
            ended = i
    return out if out and ended == len(data) - 1 else out + letter()


def plain(text: str) -> str:
    data, size = text.encode(), 3
    if not data:
        return "3::"
    while size * 64 < len(data):
        size *= 2
    while len(one := signature(data, size)) < 32 and size > 3:
        size //= 2
    return f"{size}:{one}:{signature(data, 2 * size)}"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def alike(x: str, y: str) -> float:
    (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
    pairs = [(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if int(p) == 2 * int(q) else [(p2, q1)] if int(q) == 2 * int(p) else []
    near = [1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0 for a, b in pairs]
    return max(near, default=0.0)


def texts(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(["straße", "road", "año", "x", "日本", "1.5"]) + str(rng.randrange(50)) for _ in range(rng.choice([0, 1, 3, 30, 400]))) for _ in range(count)]


def test_fingerprints_equal_the_plain_version():
    for t in texts(1, 40):
        assert fingerprint(t) == plain(t)
    pairs = [(plain(a), plain(a[: len(a) // 2] + b[: len(b) // 3])) for a, b in zip(texts(2, 30), texts(3, 30), strict=True)]
    assert [round(x, 9) for x in likeness(pairs)] == [round(alike(a, b), 9) for a, b in pairs]


def test_rows_that_share_a_key_and_null_keys(spark):
    rng = random.Random(5)
    body = texts(4, 200)
    rows = [(rng.choice([None, 5, 5, k]), body[k], "clash") for k in range(200)] + [(9, None, "clash"), (9, "same", "c"), (9, "same", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(ordered):
        x = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        f = plain(t)
        e = plain(edited)
        near = (1.0 if f == e else alike(f, e)), (1.0 if f == plain(x) else alike(f, plain(x)))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, *(round(v, 9) for v in near)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, fingerprint_edits(docs).collect())]
    assert sorted(map(str, got)) == sorted(map(str, want))
