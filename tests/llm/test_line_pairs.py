import random

from snapgate.llm import line_dedup
from snapgate.llm.common import stored


def test_long_lines_that_only_share_words_never_join_their_sets(spark, monkeypatch):
    made = {}

    def kept(df, purpose):
        out = stored(df, purpose)
        made.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", kept)
    rng = random.Random(6)
    lines = [" ".join(rng.sample([f"w{k}" for k in range(700)], 300)) for _ in range(30)]
    lines += [f"{line} more" for line in lines[:5]]
    docs = stored(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1), "test-docs")
    got = line_dedup.without_repeated_lines(docs)
    assert {r.doc_id for r in got.where("n_removed = 1").collect()} == set(range(30, 35))
    assert sum(made["line-pairs"]) > 20
    assert sum(made["line-near"]) == 5


def test_sets_are_made_once_and_blank_lines_stay(spark, monkeypatch):
    plans = {}

    def kept(df, purpose):
        plans.setdefault(purpose, df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, purpose)

    monkeypatch.setattr(line_dedup, "stored", kept)
    docs = stored(spark.createDataFrame([(1, "a b\n\n \na b"), (2, "")], "doc_id long, text string").coalesce(1), "test-docs")
    got = line_dedup.without_repeated_lines(docs).select("doc_id", "text", "n_removed")
    assert {tuple(r) for r in got.collect()} == {(1, "a b\n\n ", 1), (2, "", 0)}
    assert plans["line-sets"].count("array_distinct") == 1
