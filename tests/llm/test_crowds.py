"""Crowds of the suffix deduplication: anchors with very many distinct segments."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from snapgate.llm import suffix_dedup


def test_no_task_gathers_the_pieces_of_a_crowd():
    rng = random.Random(2)
    footer = bytes(rng.choices(range(97, 123), k=300))
    texts = [bytes(rng.choices(range(97, 123), k=90)) + footer + bytes(rng.choices(range(97, 123), k=90)) for _ in range(40)]
    wanted = []
    for text in texts:
        anchor, start, starts, offset = (x.tolist() for x in suffix_dedup.segments(text))
        wanted.append([{"anchor": a, "start": s, "starts": n, "offset": o, "alone": True, "crowd": True}
                       for a, s, n, o in zip(anchor, start, starts, offset, strict=True)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary()), pa.array(wanted)],
                                       names=["place", "text", "wanted"])
    assert sum(b.num_rows for b in suffix_dedup._pieces([batch])) == 0
    rows = [r for b in suffix_dedup._crowd_ranges([batch]) for r in b.to_pylist()]
    assert sum(len(r["digests"]) for r in rows) == sum(len(t) - 199 for t in texts)
    # Strings within the footer have one key and one digest in all texts.
    inside = {}
    for r in rows:
        for k, d in enumerate(r["digests"]):
            if 90 <= r["start"] + k <= 190:
                inside.setdefault(r["start"] + k, set()).add((r["key"], d))
    assert len(inside) == 101 and all(len(v) == 1 for v in inside.values())


def test_footer_of_many_texts_is_removed(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 5)
    rng = random.Random(3)
    footer = "".join(rng.choices("abcdefgh", k=280))
    rows = [(k, "".join(rng.choices("ijklmnop", k=70 + k)) + footer + "".join(rng.choices("qrstuvwx", k=70 + k))) for k in range(30)]
    docs = suffix_dedup.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test-docs")
    # Neighbouring letters may agree by chance, so the expected bytes are counted.
    count = Counter(t[s:s + 200] for _, t in rows for s in range(len(t) - 199))
    want = set()
    for k, t in rows:
        gone = {b for s in range(len(t) - 199) if count[t[s:s + 200]] > 1 for b in range(s, s + 200)}
        assert len(gone) >= 280
        want.add((k, len(gone), 1, "".join(c for b, c in enumerate(t) if b not in gone)))
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed", "n_spans", F.col("text").cast("string").alias("t"))
    assert {tuple(r) for r in got.collect()} == want


def test_whole_texts_are_joined_once_for_pieces_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 5)
    rng = random.Random(4)
    footer = bytes(rng.choices(range(97, 123), k=280))
    rows = [(k, bytes(rng.choices(range(97, 123), k=90)) + footer + bytes(rng.choices(range(97, 123), k=90))) for k in range(30)]
    texts = suffix_dedup.stored(spark.createDataFrame(rows, "place long, text binary"), "test-texts")
    runs = suffix_dedup.repeated_runs(texts)
    assert "wanted" not in runs._jdf.queryExecution().optimizedPlan().toString()
    assert {r.place for r in runs.collect()} == set(range(30))
