"""Packing into sequences: ids against the tokenizer itself, the rule against a plain one."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapgate.llm import packing
from snapgate.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t \x0b", "Don't stop, don't!", "ΑΣ ΟΔΟΣ σ x y\u0085z", "é ́x İstanbul", "a<|endoftext|> b <|startoftext|>",
    "x" * 5000, "word, WORD; (word) w0rd 12345", "\x1c\x1d sep", "日本語 テスト。", "ok?! no... yes.", "café. CAFÉ,", "<|ENDOFTEXT|> A", "ÀÉ <|EndOfText|> ÉA", "ÿÀß×÷ªºµ_a'b''s '. ÀÖ'. straße&&& (a) a) £ÀÖ µm ĳ ǅ ﬁ",
]


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def plain_rule(sizes, limit):
    """The sum itself for every choice."""
    free, place = [], []
    for size in sizes:
        best = None
        for at in [*range(len(free)), None]:
            if at is not None and free[at] < size:
                continue
            after = [f for k, f in enumerate(free) if k != at] + [(limit if at is None else free[at]) - size]
            score = sum(n * n for g, n in Counter(after).items() if 0 < g < limit)
            gap = limit + 1 if at is None else free[at]
            if best is None or (score, gap) < best[:2]:
                best = (score, gap, at)
        place.append(best[2])
        if best[2] is None:
            free.append(limit - size)
        else:
            free[best[2]] -= size
    return sorted(free), len(free)


@pytest.mark.parametrize("seed", range(8))
def test_rule_is_the_sum_of_squares(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(60)]
    place, free = packing.sum_of_squares(np.array(sizes), 20)
    assert (sorted(free.tolist()), len(free)) == plain_rule(sizes, 20)
    used = np.bincount(place, weights=sizes)
    assert (used == 20 - free).all()


def test_group_beats_no_lower_bound_and_few_more():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 1500, 4000))[::-1]
    place = packing.pack_group(sizes, 4096)
    used = np.bincount(place, weights=sizes)
    assert used.max() <= 4096 and used.min() > 0
    assert len(used) <= 1.003 * sizes.sum() / 4096 + 1


def test_words_give_the_ids_of_the_whole_text():
    encoder = packing.Encoder(PATH)
    assert encoder.by_words
    for text in ODD[1:]:
        got = np.frombuffer(b"".join(encoder.chunks(text)), "<u4").tolist()
        assert got == ids_of(text)[:-1], text


def test_every_word_of_the_documents(spark):
    """The short way for words of composed letters is the tokenizer's own answer."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    words = sorted({w for r in rows for w in (r["text"] or "").replace("\n", " ").split(" ")})
    encoder = packing.Encoder(PATH)
    found = TOKENIZER.encode_batch(words, add_special_tokens=False)
    for word, own in zip(words, found, strict=True):
        assert np.frombuffer(b"".join(encoder.chunks(word)), "<u4").tolist() == own.ids, word


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 30)
    monkeypatch.setattr(packing, "WORDS", 5)
    text = "Some words, more words;\nand aVeryLongWordWithoutAnyBlankInsideOfItAtAll again. " * 20
    got = np.frombuffer(b"".join(packing.Encoder(PATH).chunks(text)), "<u4").tolist()
    assert got == ids_of(text)[:-1]


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(path)
    assert not encoder.by_words
    text = "two  words\nand more"
    got = np.frombuffer(b"".join(encoder.chunks(text)), "<u4").tolist()
    assert got == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check_whole(rows, texts, limit):
    """Every id of every document is in one piece, sequences are gapless and not too long."""
    at = defaultdict(list)
    for r in rows:
        at[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids, mine = ids_of(text), sorted(at[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // limit)))
        for r in mine:
            part = ids[r["start"]:r["start"] + limit]
            assert r["start"] == r["piece"] * limit and r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    return len(used)


def test_pieces_and_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    monkeypatch.setattr(packing, "LOOSE", 3)
    rng = random.Random(5)
    texts = dict(enumerate(ODD + [" ".join(rng.choices(["alpha", "be", "Gamma,", "x1"], k=rng.randint(0, 90))) for _ in range(300)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    docs = packing.stored(docs.withColumn("row", F.lit("clash")).withColumn("piece", F.lit(1)), "test-docs")
    limit = 64
    got = packing.packed(docs, PATH, limit=limit)
    got = packing.stored(got, "test-packed")
    rows = got.collect()
    n = check_whole(rows, texts, limit)
    total = sum(r["length"] for r in rows)
    assert n <= 1.05 * total / limit + 1
    again = packing.packed(docs, PATH, limit=limit, keep_ids=False)
    assert "ids" not in again.columns

    def members(found):
        held = defaultdict(set)
        for r in found:
            held[r["sequence_id"]].add((r["doc_id"], r["piece"], r["offset"], r["ids_crc32"]))
        return {frozenset(v) for v in held.values()}

    assert members(again.collect()) == members(rows)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_repeated_and_null_keys_and_ties(spark):
    docs = packing.stored(spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (None, None)], "doc_id int, text string"), "test-docs")
    rows = packing.packed(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 2), ("1", 2), ("None", 1), ("None", 2)]
    assert len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 4


def test_loose_pieces_that_cannot_be_joined_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    docs = spark.createDataFrame([(k, "a " * 40) for k in range(50)], "doc_id long, text string")
    rows = packing.packed(packing.stored(docs, "test-docs"), PATH, limit=64).collect()
    assert len(rows) == 50 == len({r["sequence_id"] for r in rows})


def test_empty_table(spark):
    docs = packing.stored(spark.createDataFrame([], "doc_id long, text string"), "test-docs")
    assert packing.packed(docs, PATH).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_packing"](spark, folder).collect()
    n = check_whole(rows, texts, 4096)
    assert n <= sum(r["length"] for r in rows) / 4096 * 1.02 + 1
