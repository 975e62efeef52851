"""The whole pipeline against brute-force stages."""

import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from snapgate.llm import mixing, quality
from snapgate.llm.common import stored

DDL = "doc_id long, text string, lang string, source string, n_chars long"


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


def test_pipeline_against_brute_force_stages(spark, tmp_path):
    rng = random.Random(5)
    passage = " ".join(prose(rng, 30))
    texts = make_texts(7)[7:] + [" ".join(prose(rng, 60)) for _ in range(40)]
    leaked = len(texts)
    texts += [" ".join(prose(rng, 40)) + " " + passage + " " + " ".join(prose(rng, 40))]
    junk = len(texts)
    texts += [" ".join(prose(rng, 80)).upper().replace("W", "!!") for _ in range(60)]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], DDL).repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, int(k < junk)) for k in range(len(texts))], "doc_id long, quality int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    network = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = [k for k, t in enumerate(texts) if network.score(t.encode()) >= quality.THRESHOLD]
    assert leaked in good and len(set(good) & set(range(junk))) > 0.9 * junk
    alone = [good[k] for k in brute_kept([texts[k] for k in good])]
    clean = [k for k in alone if passage not in texts[k]]
    assert len(good) - len(alone) > 40 and len(alone) - len(clean) == 1
    frame = stored(docs.where(F.col("doc_id").isin(clean)), "test-docs")
    want = {r.doc_id: r.copies for r in mixing.balance(frame).collect() if r.copies}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {}
    for r in got:
        assert r.text == texts[r.doc_id] and 0 <= r.shard < corpus_pipeline.SHARDS
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == want
