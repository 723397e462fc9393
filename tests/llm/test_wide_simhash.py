"""The pipeline's SimHash against op10's, its keys and groups against brute force."""

import numpy as np
import pytest

from tarnbridge.llm import near_copies, resemblance


def test_first_word_is_the_simhash_of_op10():
    text = " ".join(f"w{i}" for i in range(90)).encode()
    assert int(resemblance.simhash(resemblance.shingles(text, 5))[0].view(np.int64)) == near_copies.simhash(text, 5)


def test_sets_of_the_similarity_share_keys():
    """300 pairs at Jaccard 0.8: SimHashes of all are within the distance, and pigeonhole blocks agree somewhere."""
    rng, keys = np.random.default_rng(7), resemblance.deal(*resemblance.width_and_keys(200_000, 0.8))
    for _ in range(300):
        grams = rng.integers(0, 2**64, 450, np.uint64)
        a, b = resemblance.simhash(np.sort(grams[:405])), resemblance.simhash(np.sort(grams[45:]))
        assert resemblance.apart(a, b) <= 1.65 * resemblance.flips(0.8) * resemblance.BITS
        same = np.unpackbits((a ^ b).view(np.uint8), bitorder="little") == 0
        assert same[keys].all(axis=1).any()


@pytest.mark.parametrize("many", [1024, 8])
def test_groups_are_the_connected_nodes_of_each_key(many):
    rng = np.random.default_rng(1)
    checks = rng.integers(0, 2**64, (40, 2), np.uint64)[rng.integers(0, 40, 300)]
    for row in checks:
        for b in rng.choice(128, rng.integers(0, 28), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    entries = np.empty(600, resemblance.ENTRY)
    entries["key"], entries["node"], entries["check"] = rng.integers(0, 9, 600), np.arange(600) // 2, checks[np.arange(600) // 2]
    got, want = {}, set()
    for group, node in zip(*(x.tolist() for x in resemblance.groups_of_keys(rng.permutation(entries), 38, many)), strict=True):
        got.setdefault(group, set()).add(node)
    for key in range(9):
        left = {int(n) for n in entries["node"][entries["key"] == key]}
        while left:
            todo = [left.pop()]
            group = set(todo)
            while todo:
                x = todo.pop()
                near = {y for y in left if int(resemblance.apart(checks[x], checks[y])) <= 38}
                left, group = left - near, group | near
                todo += near
            want |= {frozenset(group)} if len(group) > 1 else set()
    assert set(map(frozenset, got.values())) == want
