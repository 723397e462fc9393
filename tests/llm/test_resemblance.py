"""Near copies by resemblance against brute-force Jaccard."""

import corpus_pipeline
import numpy as np
import pytest

from tarnbridge.llm import near_copies, resemblance

WORDS = np.array([f"w{i}" for i in range(500)])


def slow_firsts(texts):
    """The smallest index of each group that pairs of similarity 0.8 connect."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def edited(rng, words, n):
    words = words.copy()
    words[rng.choice(len(words), n, replace=False)] = rng.choice(WORDS, n)
    return words


def texts_of(rng):
    texts = [None, "", " \n", "one two", "One TWO", "one three"]
    for n in (20, 60, 200, 900):
        for _ in range(6):
            base = rng.choice(WORDS, n)
            texts += [" ".join(edited(rng, base, k)) for k in (0, 0, max(1, n // 100), max(1, n // 50), max(1, n // 40), n // 10)] + [" ".join(base[: int(0.85 * n)])]
    base = rng.choice(WORDS, 120)
    for _ in range(60):  # a dense group: some are near each other, some only near others, some near none
        texts.append(" ".join(edited(rng, base, rng.integers(0, 9))))
    return texts


@pytest.mark.parametrize("limits", [{"block": 4, "family": 8}, {"block": 16}, {"block_shingles": 300, "block": 16}, {}])
def test_all_pairs_of_the_similarity_link(spark, limits):
    """Also where families fall apart into keys, and blocks meet."""
    texts = texts_of(np.random.default_rng(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = resemblance.drop_resembling(docs, **limits)
    assert sorted(r["doc_id"] for r in got.collect()) == slow_firsts(texts)


def test_stage_drops_edited_copies(spark):
    """Copies with one word in a hundred changed: SimHash within 2 bits keeps them."""
    rng = np.random.default_rng(5)
    bases = [rng.choice(WORDS, 300) for _ in range(20)]
    texts = [" ".join(b) for b in bases] + [" ".join(edited(rng, b, 3)) for b in bases]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(20))


def test_repeated_rows_and_null_ids(spark):
    data = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A b c d e f"), (None, "x y z")]
    got = resemblance.drop_resembling(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("7", "a b c d e f"), ("None", "x y z")]
    assert resemblance.drop_resembling(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_and_types_of_other_columns_do_not_matter(spark):
    data = [(i, t, {"k": i}, float(i), [i], i, i) for i, t in ((3, "a b c d e f"), (2, "A b c d e f"), (5, None), (4, ""), (9, "z"))]
    docs = spark.createDataFrame(data, "doc_id long, text string, m map<string,int>, `a.b` double, keys array<int>, __row int, id int")
    for drop in (resemblance.drop_resembling, near_copies.drop_near_copies):
        got = drop(docs)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"], r["m"]["k"], r["a.b"], r["__row"], r["id"]) for r in got.collect()) == [(i, i, float(i), i, i) for i in (2, 4, 9)]
