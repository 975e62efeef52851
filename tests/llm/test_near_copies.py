"""Near copies of the pipeline against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from snapgate.llm import near_copies
from snapgate.llm.common import stored


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10 ** 6)}"
    return words


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] == sets[j] or (shared and 5 * shared >= 4 * len(sets[i] | sets[j])):
            root[find(i)] = find(j)
    return [find(k) for k in range(len(texts))]


def make_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "x", "x", "one two three four", "one two three five"]
    for _ in range(12):
        base = prose(rng, rng.choice((40, 120, 400)))
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:len(base) // 2] + prose(rng, 30))]
        # Edits that leave a similarity around 0.8, on either side of it.
        texts += [" ".join(edited(rng, base, max(1, round(len(base) * share)))) for share in (.005, .015, .02, .025, .03, .05)]
    return texts


def brute_kept(texts):
    """Positions of the first text of each group."""
    first = {}
    for k, g in enumerate(brute_groups(texts)):
        first.setdefault(g, k)
    return set(first.values())


@pytest.mark.parametrize("stars", [0, 2])
def test_near_copies_against_all_pairs(spark, monkeypatch, stars):
    monkeypatch.setattr(near_copies, "STARS", stars)
    texts = make_texts(3)
    docs = stored(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3), "test-docs")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_kept(texts) and len(texts) - kept.count() > 40
    nameless = stored(docs.withColumn("doc_id", F.lit(None).cast("long")), "test-docs")
    assert near_copies.keep_one(nameless).count() == kept.count()
    assert near_copies.keep_one(stored(docs.limit(0), "test-docs")).count() == 0
