"""What the quality network learns from."""

from snapgate.llm import quality


def test_training_reads_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.update(zip(map(bytes, texts), labels, strict=True)))
    keys = [k for k in range(20) if not spark.range(k, k + 1).select(quality.held_out("id")).first()[0]][:6]
    rows = [(k, "filler " * 60_000 + f"telling {k}") for k in keys]
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                spark.createDataFrame([(k, k % 2) for k in keys], "doc_id long, quality int"))
    assert seen == {t.encode(): k % 2 for k, t in rows}


def test_sample_is_bounded_in_rows_whatever_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.extend(zip(map(bytes, texts), labels, strict=True)))
    a, b = [k for k in range(20) if not spark.range(k, k + 1).select(quality.held_out("id")).first()[0]][:2]
    rows = [(a, f"copy {k}") for k in range(500)] + [(b, None), (None, "nameless")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1)] * 300 + [(b, 0), (None, 1), (a, None)], "doc_id long, quality int")
    quality.fit(docs, labels, sample=1)
    assert sorted(seen) == [(b"", 0), (b"copy 0", 1)]
    seen.clear()
    quality.fit(docs, labels)
    assert len(seen) == 2
