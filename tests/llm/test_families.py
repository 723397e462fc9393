"""Families of near copies: told of in few rows, and the same as if every key told of all its nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbridge.llm import resemblance

from .test_resemblance import slow_firsts, texts_of

WORDS = np.array([f"w{i}" for i in range(500)])


def edited_copies(rng, n):
    """n texts, each the same 200 words with up to 8 changed."""
    base, out = rng.choice(WORDS, 200), []
    for _ in range(n):
        words, k = base.copy(), rng.integers(1, 9)
        words[rng.choice(200, k, replace=False)] = rng.choice(WORDS, k)
        out.append(" ".join(words))
    return out


def test_keys_tell_of_a_large_group_in_few_rows(spark, monkeypatch):
    """A key deals the copies of one text anew, so that rows of all 128 keys do not fall together."""
    texts, counts = edited_copies(np.random.default_rng(2), 600), []
    inner = resemblance.components
    monkeypatch.setattr(resemblance, "components", lambda edges, rows=None: counts.append(edges.count()) or inner(edges, rows))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in resemblance.drop_resembling(docs).collect()) == slow_firsts(texts)
    assert 599 <= counts[0] <= 12 * 600


def closure(pairs, nodes):
    root = {x: x for x in nodes}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = {x: low if r == high else r for x, r in root.items()}
    return root


@pytest.mark.parametrize("many", [1024, 8])
def test_names_of_early_keys_change_no_family(many):
    rng = np.random.default_rng(4)
    checks = rng.integers(0, 2**64, (30, 2), np.uint64)[rng.integers(0, 30, 200)]
    for row in checks:
        for b in rng.choice(128, rng.integers(0, 26), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    keys, nodes = rng.integers(0, 6, (12, 200)), rng.permutation(200) - 100

    def entries(names, numbers):
        out = np.empty(200 * len(numbers), resemblance.ENTRY)
        out["key"], out["node"], out["check"] = (10 * np.array(numbers)[:, None] + keys[numbers]).ravel(), np.tile(names, len(numbers)), np.tile(checks, (len(numbers), 1))
        return rng.permutation(out)

    group, node = resemblance.groups_of_keys(entries(nodes, range(12)), 38, many)
    want = closure([(int(node[np.argmax(group == g)]), int(x)) for g, x in zip(group, node, strict=True)], nodes.tolist())
    a, node, company = resemblance.members_of_keys(entries(nodes, range(2)), 38, many)
    assert (a <= node).all() and (company > 1).all()
    names = np.array([min([x, *a[node == x]]) for x in nodes])
    late = resemblance.edges_of_keys(entries(names, range(2, 12)), 38, many)
    assert (late[0] < late[1]).all() and set(late[0].tolist() + late[1].tolist()) <= set(names.tolist())
    assert closure([*zip(a.tolist(), node.tolist(), strict=True), *zip(*(x.tolist() for x in late), strict=True)], nodes.tolist()) == want
    assert len(set(want.values())) < 200


def test_families_that_fall_apart_into_groups(spark, monkeypatch):
    """As where groups have fewer pairs than the family."""
    texts, inner = texts_of(np.random.default_rng(3)), resemblance._families
    monkeypatch.setattr(resemblance, "_families", lambda *a: (inner(*a)[0], inner(*a)[1].withColumn("company", F.lit(0))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in resemblance.drop_resembling(docs, block=4, family=8).collect()) == slow_firsts(texts)


def test_large_family_with_large_groups_stays_whole(spark, monkeypatch):
    """Sets do not travel once for each of 128 keys."""
    texts, counts = edited_copies(np.random.default_rng(2), 200), []
    inner = resemblance._cells
    monkeypatch.setattr(resemblance, "_cells", lambda *a: counts.append((out := inner(*a)).count()) or out)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in resemblance.drop_resembling(docs, block=64, family=100).collect()) == slow_firsts(texts)
    assert max(counts) <= 10 * 200


def test_meetings_of_strangers_tell_nothing():
    lone = np.zeros(1, resemblance.ENTRY)
    assert [len(x) for told in (resemblance.members_of_keys, resemblance.edges_of_keys, resemblance.groups_of_keys) for x in told(lone, 38)] == [0] * 7
