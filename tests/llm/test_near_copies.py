"""Near-copy removal against a brute force over exact Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from evidentia.llm import near_copies
from evidentia.llm.queries import table
from evidentia.llm.simhash import simhash

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def kept_by_jaccard(rows, least=0.8):
    """Smallest ids of the components over all pairs."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (len(a & b) >= least * len(a | b) - 1e-9):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [i for i in sorted(sets) if root(i) == i]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect())


def edited(words, rng, edits):
    """Words with some replaced: each takes five shingles with it."""
    out = list(words)
    for p in rng.sample(range(4, len(words) - 4, 5), edits):
        out[p] = f"new{rng.random()}"
    return " ".join(out)


def test_copies_that_differ_in_over_eight_bits(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(204)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, rng, 4))]  # 180 of 220 shingles: 0.82
    far = [k for k in range(40) if (simhash(rows[2 * k][1], 5) ^ simhash(rows[2 * k + 1][1], 5)).bit_count() > corpus_pipeline.NEAR_BITS]
    assert far
    assert kept(spark, rows) == kept_by_jaccard(rows) == list(range(0, 80, 2))


def test_stage_equals_jaccard_on_the_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert kept(spark, rows) == kept_by_jaccard(rows)


@pytest.mark.parametrize("split", [2000, 7])
def test_chains_and_large_groups(spark, monkeypatch, split):
    monkeypatch.setattr(near_copies, "SPLIT_ABOVE", split)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(words))]
    for k in range(1, 40):  # each is close to the one before only
        words[4 + 5 * (k % 38)] = f"x{k}"
        words[4 + 5 * (k * 7 % 38)] = f"y{k}"
        rows.append((k, " ".join(words)))
    base = [f"v{k}" for k in range(200)]
    rows += [(100 + k, edited(base, rng, 3)) for k in range(40)]
    rows += [(200, None), (201, ""), (202, "One two"), (203, "one  TWO"), (204, "one two three")]
    assert kept(spark, rows) == kept_by_jaccard(rows)


def test_texts_within_eight_bits_but_unlike_stay(spark):
    """Documents 155 and 192 differ in four bits, at a similarity of 0.76."""
    text = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").where("doc_id in (155, 192)").collect()}
    a, b = shingles(text[155]), shingles(text[192])
    assert (simhash(text[155], 5) ^ simhash(text[192], 5)).bit_count() <= 8 and len(a & b) < 0.8 * len(a | b)
    assert kept(spark, list(text.items())) == [155, 192]


def test_parts_of_a_bucket_meet_where_needed(spark, monkeypatch):
    """Two unlike families and a bridge between them, dealt to many small parts."""
    monkeypatch.setattr(near_copies, "SPLIT_ABOVE", 5)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, edited(base, rng, 2)) for k in range(30)]
    far = list(base)
    for p in range(4, 196, 15):
        far[p] = f"far{p}"
    rows += [(100 + k, edited(far, rng, 1)) for k in range(12)]
    middle = list(base)
    for p in range(4, 196, 40):
        middle[p] = f"far{p}"
    rows += [(200, " ".join(middle)), (300, " ".join(f"z{k}" for k in range(50)))]
    assert kept(spark, rows) == kept_by_jaccard(rows)
    monkeypatch.setattr(near_copies, "bucket_keys", lambda sets: near_copies.np.zeros((len(sets), 2), "i8"))
    assert kept(spark, rows) == kept_by_jaccard(rows)  # all texts in one bucket


def test_candidates_are_found_by_simhash():
    """Bits are majorities of the shingles' hashes; pairs at 0.8 differ in few and share a band."""
    np = near_copies.np
    rng = np.random.default_rng(7)
    sets = []
    for k in range(60):
        both, own = rng.integers(0, 1 << 63, (160 + 40 * k, ), np.uint64), rng.integers(0, 1 << 63, (2, 20 + 5 * k), np.uint64)
        sets += [np.unique(np.concatenate([both, x])) for x in own]  # 0.8 each
    prints = near_copies.simhashes(sets)
    h = (sets[5] ^ near_copies._MIX[0, 3]) * (near_copies._MIX[1, 3] | np.uint64(1))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    ones = [int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h) for b in range(64)]
    assert int(prints[5, 3]) == sum(1 << b for b, one in enumerate(ones) if one)
    keys = near_copies.bucket_keys(prints)
    assert keys.shape == (120, near_copies.BANDS) and (keys >> near_copies.BAND_BITS == np.arange(near_copies.BANDS)).all()
    assert (keys[::2] == keys[1::2]).any(axis=1).all()
    rows = np.argsort(keys, axis=None, kind="stable")
    x, y = near_copies.close_pairs(keys.ravel()[rows], prints[rows // near_copies.BANDS, : near_copies.PRINT])
    linked = {tuple(sorted((int(a), int(b)))) for a, b in zip(rows[x] // near_copies.BANDS, rows[y] // near_copies.BANDS, strict=True)}
    assert linked == {(k, k + 1) for k in range(0, 120, 2)}
    alike = np.repeat(prints[:1], 200, axis=0)
    x, y = near_copies.close_pairs(np.zeros(200, "i8"), alike[:, : near_copies.PRINT])
    assert len(x) == 199 and set(y.tolist()) == set(range(1, 200))


@pytest.mark.parametrize("pending, most", [(1 << 19, 1 << 21), (50, 20)])
def test_links_of_a_group_are_fewer_than_its_members_in_a_task(spark, monkeypatch, pending, most):
    """Near copies that meet in many small buckets: a task sends a forest, not pairs."""
    monkeypatch.setattr(near_copies, "PENDING", pending, raising=False)
    monkeypatch.setattr(near_copies, "HELD", most, raising=False)
    np = near_copies.np
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (3, 400), np.uint64)
    sets = [np.unique(np.r_[b[40:], rng.integers(0, 1 << 63, 5, np.uint64)]) for b in base for _ in range(60)]
    rows = [(k, p.tobytes()) for k, p in enumerate(near_copies.simhashes(sets))]
    links = near_copies.simhash_links(spark.createDataFrame(rows, "node long, print binary"))
    counts = [r["count"] for r in links.groupBy(near_copies.F.spark_partition_id()).count().collect()]
    if most > 180:
        assert max(counts) < 180
    else:
        assert sum(counts) < 104 * 180 / 4  # before: 30 a member and bucket
    got = {r["node"]: r["component"] for r in near_copies.connected_components(links).collect()}
    assert got == {k: k // 60 * 60 for k in range(180)}


def test_stars_span_the_components_of_their_links():
    np = near_copies.np
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (10, 6), (300, 200), (300, 900), (1000, 999)):
        name = rng.permutation(np.arange(n) * 7 - 500)
        a, b = (np.arange(n)[:-1], np.arange(n)[1:]) if m == n - 1 else rng.integers(0, n, (2, m))
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            parent[root(x)] = root(y)
        groups = {}
        for k in range(n):
            groups.setdefault(root(k), []).append(int(name[k]))
        want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
        assert sorted(zip(*(x.tolist() for x in near_copies.spanning_stars(name[a], name[b])))) == want
