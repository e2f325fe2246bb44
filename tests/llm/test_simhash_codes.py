"""The two covering codes of the fingerprint anchors find the same links."""

import random

import numpy as np
import pytest

from evidentia.llm.simhash import anchors, connected_components, fingerprint_links, wide_anchors


def prints(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(120)]
    out = set(base)
    for x in base:
        for flips in (1, 3, 4, 5):
            out.add(x ^ sum(1 << b for b in rng.sample(range(64), flips)))
    return sorted(out | {0, (1 << 64) - 1})


@pytest.mark.parametrize("near, blocks, radius", [(anchors, 3, 2), (wide_anchors, 2, 3)])
def test_every_fingerprint_has_one_home_a_block_and_meets_its_links(near, blocks, radius):
    fp = np.array(prints(1), np.uint64)
    row, key, home = near(fp, radius)
    assert (np.bincount(row[home], minlength=len(fp)) == blocks).all()
    places, homes = {}, {}
    for r, k, h in zip(row.tolist(), key.tolist(), home.tolist(), strict=True):
        places.setdefault(r, set()).add(k)
        if h:
            homes.setdefault(r, set()).add(k)
    for i, x in enumerate(fp.tolist()):
        for j, y in enumerate(fp.tolist()):
            if i != j and (x ^ y).bit_count() <= 4:
                assert homes[i] & places[j]


@pytest.mark.parametrize("most", [0, 3, 4, 5])
def test_components_of_both_codes_equal_brute_force(spark, most):
    fp = prints(2)
    parent = {x: x for x in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fp):
        for y in fp[:i]:
            if (x ^ y).bit_count() <= most:
                parent[root(x)] = root(y)
    want = {}
    for x in fp:
        want.setdefault(root(x), set()).add(x)
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "fp long")
    for options in ({}, {"wide_above": 0}, {"wide_above": 0, "split_above": 1}):
        found = {}
        for r in connected_components(fingerprint_links(df, most, **options)).collect():
            found.setdefault(r["component"], set()).add(int(np.int64(r["node"]).view(np.uint64)))
        assert sorted(sorted(g) for g in found.values()) == want
