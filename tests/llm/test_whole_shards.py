import zlib

from snapgate.llm import sharding
from snapgate.llm.queries import QUERIES


def test_shards_hold_whole_documents(spark, tmp_path, monkeypatch):
    seen, shuffle = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, n: seen.append(shuffle(df, n)) or seen[-1])
    texts = ["a b", "", None, "é"] * 30
    data = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_sharding"](spark, str(tmp_path)).collect()
    assert seen[0].columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {
        k: (len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for k, t in enumerate(texts)}
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(40) for i in range(3)]
