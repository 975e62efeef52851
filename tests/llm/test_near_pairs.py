import random

import numpy as np

from snapgate.llm import near_copies
from snapgate.llm.common import stored


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 5000):
        one = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        two = np.unique(np.concatenate([one[n // 10:], rng.integers(0, 2 ** 64, n // 5 + 1, dtype=np.uint64)]))
        a, b = (np.array(near_copies.parities(x)) for x in (one, two))
        assert 0 < int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= len(np.setxor1d(one, two))


def test_a_crowd_that_shares_keys_without_being_similar_makes_no_pairs(spark, monkeypatch):
    counts = []

    def counted(df, purpose):
        made = stored(df, purpose)
        if purpose == "near-pairs":
            counts.append(made.count())
        return made

    monkeypatch.setattr(near_copies, "stored", counted)
    rng = random.Random(2)
    common = [f"w{k}" for k in range(140)]
    texts = [" ".join(common + [f"own{rng.randrange(10 ** 9)}" for _ in range(60)]) for _ in range(60)]
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-docs")
    assert near_copies.keep_one(docs).count() == 60
    assert sum(counts) == 0


def test_golay_keys_bring_the_first_candidates_and_later_rounds_the_rest(spark, monkeypatch):
    made = {}

    def kept(df, purpose):
        out = stored(df, purpose)
        made.setdefault(purpose, []).append(out)
        return out

    monkeypatch.setattr(near_copies, "stored", kept)
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        for edits in (0, 1, 2, 10):
            changed = list(words)
            for k in rng.sample(range(600), edits):
                changed[k] = f"new{rng.randrange(10 ** 6)}"
            texts.append(" ".join(changed))
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "test-docs")
    assert near_copies.keep_one(docs).count() == 12
    prints = [near_copies.simhash.fingerprint_bits(near_copies.shingles(t.encode()).tolist()) for t in texts]
    by_place = {r.place: r.doc_id for r in near_copies.groups(docs).collect()}
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}
    golay = {tuple(sorted((by_place[r.a], by_place[r.b]))) for r in made["near-golay"][0].collect()}
    assert len(near) >= 12 and golay <= near
    assert {j for _, j in near} == {j for _, j in golay}
    later = {tuple(sorted((by_place[r.a], by_place[r.b]))) for f in made["near-pairs"] for r in f.collect()}
    assert later and not later & golay
