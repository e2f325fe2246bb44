"""Operators against brute force on small tables, edge rows included."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from tokenizers import Tokenizer

from evidentia.llm.bpe import Codec, bpe_decode, bpe_encode
from evidentia.llm.fingerprint import edit_likeness, fingerprint, fingerprint_edits, likeness
from evidentia.llm.queries import URL_RULES, word_bpe
from evidentia.llm.simhash import simhash, simhash_components, simhash_dedup
from evidentia.llm.token_files import encode_sorted, read_tokens, token_positions, write_tokens
from evidentia.llm.url_filter import build_trie, longest_rule, split_url, url_filter

DOC = "doc_id long, text string, fp string, key long, part int, node string"


def docs_of(spark, rows):
    """Rows of (doc_id, text), with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOC)


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "ζeta", "eta.", "theta", "iota", "kappa"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 90))) for _ in range(n)]
    rows = list(enumerate(base))
    rows += [(n + i, base[i]) for i in range(8)]  # exact copies
    rows += [(n + 10 + i, base[i] + " tail" * (i % 3)) for i in range(20)]  # near copies
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "x" * 30_000), (505, "a b " * 9000)]
    rows += [(None, base[0]), (3, base[3])]  # a null id, a repeated row
    return rows


def brute_simhash(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    k = min(width, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, width, most=4):
    prints = {i: brute_simhash(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (f"{prints[i]:016x}", root(i)) for i in prints}


def test_simhash_components_equal_brute_force(spark):
    rows = corpus()
    got = simhash_components(docs_of(spark, rows), 4, 4).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, 4)
    assert {r[0]: tuple(r[1:]) for r in got if r[0] is not None} == want


@pytest.mark.parametrize("most", [4, 8])
def test_simhash_finds_every_pair_within_the_distance(spark, most):
    """Random fingerprints with planted distances, one dense group, split anchors."""
    import numpy as np

    from evidentia.llm.common import connected_components
    from evidentia.llm.simhash import fingerprint_links

    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for x in list(fps):
        y = x
        for b in rng.sample(range(64), rng.randrange(1, 11)):
            y ^= 1 << b
        fps.append(y)
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(150)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    number = dict(zip(signed, range(len(fps)), strict=True))
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups = {frozenset(j for j in range(len(fps)) if root(j) == root(i)) for i in range(len(fps))}
    want = {g for g in groups if len(g) > 1}
    for split in (20_000, 5):
        links = fingerprint_links(prints, most, split_above=split)
        assert all((fps[number[a]] ^ fps[number[b]]).bit_count() <= most for a, b in links.collect())
        got = {}
        for r in connected_components(links).collect():
            got.setdefault(r["component"], set()).add(number[r["node"]])
        assert set(map(frozenset, got.values())) == want


def test_simhash_dedup_keeps_all_columns_and_one_of_each(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words entirely here now"), (None, "a b c d e f g")]
    kept = simhash_dedup(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "key", "part", "node"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3]


def test_simhash_of_an_empty_table(spark):
    assert simhash_components(docs_of(spark, []), 4, 4).count() == 0


@pytest.mark.parametrize("text", ["", "   ", "a", "A b C", "x y z w v"])
def test_simhash_small(text):
    assert simhash(text) == brute_simhash(text, 4)


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://sub.www.example.com/en/a",
    "http://example.com/en", "http://example.com?x=/en/", "http://x.net/es/1", "http://net/fr/", "http://x.org/", "http://com",
    "http://notexample.com/en/", "ftp://x.net/esx/", "http://ex.com#a/b", "http://a.b://c.com/", "://", "http://É.com/",
]


def test_url_filter_equals_plain_rules(spark):
    def plain(url):
        host, path = split_url(url)
        fits = [(len(h) + len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*URLS, URLS[3]])], "page_id long, url string, rule string")
    want = {i: plain(u) for i, u in enumerate([*URLS, URLS[3]])}
    for rules in (URL_RULES, spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")):
        got = url_filter(pages, rules)
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    joined = url_filter(pages, rules, max_trie_bytes=1)
    assert {r[0]: tuple(r[1:]) for r in joined.collect()} == want
    assert url_filter(pages.limit(0), URL_RULES).count() == 0


def test_url_rule_precedence():
    trie = build_trie([("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("allow", "com", "/xyz"), ("block", "", "/never")])
    assert longest_rule(trie, "b.a.com", "/xy") == ("a.com/x", "block")
    assert longest_rule(trie, "b.com", "/xyz/1") == ("com/xyz", "allow")
    assert longest_rule(trie, "q", "/never/1") == ("/never", "block")
    assert longest_rule(trie, "q", "/") is None


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(word_bpe())
    rng = random.Random(9)
    letters = "aaabbeeiinnotthsrl'  .,!?1é́ßΣσİ\n\t\xa0\x85\x1c　ſ中文😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["<|endoftext|> it's<|startoftext|>'s", "th" * 4000, "a" * 3000, "The THE the " * 500]
    rows = [*corpus(), *[(1000 + i, t) for i, t in enumerate(texts)]]
    got = bpe_encode(docs_of(spark, rows), word_bpe(), decoded="decoded")
    assert got.columns == ["doc_id", "ids", "decoded"]
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, t)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(by_text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = bpe_decode(got.drop("decoded"), word_bpe())
    assert {(r["doc_id"], r["decoded"]) for r in again.collect()} == {(r["doc_id"], r["decoded"]) for r in out}
    assert bpe_encode(docs_of(spark, []), word_bpe()).count() == 0


def test_codec_tables_are_reset(monkeypatch):
    from evidentia.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    library, codec = Tokenizer.from_file(word_bpe()), Codec(word_bpe())
    for text in ("the quick brown fox jumps", "over the lazy dog", "the quick", ""):
        flat, _ = codec.encode([text])
        assert flat.tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.count([text]).tolist() == [len(flat)]


def test_token_files_round_trip(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    library = Tokenizer.from_file(word_bpe())
    path = str(tmp_path / "tokens")
    write_tokens(encode_sorted(docs_of(spark, rows), word_bpe(), 1), path)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    assert sorted(map(tuple, token_positions(spark, path).collect())) == want
    some = read_tokens(spark, path, keys=[3, 503, 99999])
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 3, 503]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert sum(len(r["ids"]) for r in read_tokens(spark, path).collect()) == at


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_tokens(encode_sorted(docs_of(spark, []), word_bpe(), 1), path)
    assert token_positions(spark, path).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_likeness_equals_plain_edit_distance():
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randrange(65))), "".join(rng.choice("abcd") for _ in range(rng.randrange(65)))) for _ in range(60)]
    pairs += [("", ""), ("", "a"), ("a", "")]
    got = edit_likeness([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), x in zip(pairs, got, strict=True):
        assert x == pytest.approx(1 - levenshtein(a, b) / max(len(a), len(b), 1) if a or b else 1.0)


def test_fingerprints_follow_content():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    near = text[:2500] + "INSERTED" + text[2500:]
    a, b, c = likeness([(fingerprint(text), fingerprint(near)), (fingerprint(text), fingerprint(other)), (fingerprint(text), fingerprint(text))])
    assert a > 0.8 > 0.4 > b and c == 1.0
    assert likeness([(fingerprint("a" * 10), fingerprint("b" * 100_000))]) == [0.0]


def test_fingerprint_edits_equal_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 3]
    want = {}
    ordered = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(ordered):
        t, x = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + x[:third]
        f, e, g = fingerprint(t), fingerprint(edited), fingerprint(x)
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, *likeness([(f, e), (f, g)]))
    got = {r[0]: tuple(r[1:]) for r in fingerprint_edits(docs_of(spark, rows)).collect()}
    assert got == want
    one = fingerprint_edits(docs_of(spark, [(7, "abc def")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint_edits(docs_of(spark, [])).count() == 0
    doubled = fingerprint_edits(docs_of(spark, [(1, "b"), (1, "a"), (None, "n"), (0, None)])).collect()
    assert len(doubled) == 4
