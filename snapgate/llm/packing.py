"""Packing of documents into training sequences of a fixed number of tokens.

Documents are tokenised in the tasks and cut into pieces of at most one sequence. Pieces that
fill a sequence are one. The others are dealt into groups by a hash; within a group they are
placed, longest first, by the sum-of-squares rule: a piece goes where the sum of the squared
counts of open sequences per residual gap becomes smallest. Sequences that stay loose in their
group give their pieces to the next round, in which they meet those of all other groups.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgate.llm.common import stored

LIMIT = 4096       # tokens of a sequence
END = 1            # the id that ends every document
GROUP = 16_384     # pieces that one task packs at once, on average
LOOSE = 40         # free tokens from which a sequence of a group is packed anew
CHUNK = 1 << 20    # characters of a text that are tokenised at once
WORDS = 400_000    # words whose ids a task remembers
BATCH = 1 << 20    # ids or pieces that a task hands over at once

# The settings of a tokenizer that lower-cases, splits at white space and drops
# it, and parts letters from punctuation. Its ids of a text are those of the text's words.
DROPS_WHITE_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# Letters that are one composed character each, and Ascii marks behind them.
_PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_LATIN = re.compile(r"[\x00-\xff]*")
# The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the
# characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    A tokenizer that drops white space is asked once for each word, and a long text is taken
    in chunks that end at a blank; any other one is asked for each whole text.
    """

    def __init__(self, path: str):
        # Spark runs a task on every core; threads of its own would only wait for them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.by_words = all(settings.get(k) == v for k, v in DROPS_WHITE_SPACE.items()) and not any(
            settings.get(k) for k in ("truncation", "padding", "post_processor"))
        self.known: dict[str, bytes] = {}

    def chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text, part by part."""
        if not self.by_words:
            yield self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= CHUNK else text.find(" ", at + CHUNK)
            end = len(text) if end < 0 else end
            yield self._words(text[at:end])
            at = end

    def _words(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        # Lower case of composed letters is one letter each; a special token's name is not text.
        if text.isascii() or _LATIN.fullmatch(text):
            text = text if "<|" in text else text.lower()
        words = text.split(" ")
        known = self.known
        if len(known) > WORDS:
            known.clear()
        rest = []
        for word in set(words).difference(known):
            plain = _PLAIN_WORD.fullmatch(word)
            if plain is None:
                rest.append(word)
                continue
            # The letters are one pre-token, the marks behind them the next.
            letters, marks = plain.groups()
            letters = letters.lower()
            ids = known.get(letters)
            if ids is None:
                spelt = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = known[letters] = self._packed([t.id for t in self.tokenizer.model.tokenize(spelt)])
            known[word] = ids + self._marks(marks) if marks else ids
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[word] = self._packed(found.ids)
        return b"".join(map(known.__getitem__, words))

    def _marks(self, marks: str) -> bytes:
        if marks not in self.known:
            self.known[marks] = self._packed(self.tokenizer.encode(marks, add_special_tokens=False).ids)
        return self.known[marks]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, which outlives a task and keeps its words."""
    return Encoder(path)


def _cut(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Bytes in pieces of ``size``, the last one shorter."""
    held = b""
    for part in parts:
        held += part
        whole = len(held) - len(held) % size
        yield from (held[k:k + size] for k in range(0, whole, size))
        held = held[whole:]
    if held:
        yield held


def _pieces(path: str, limit: int, end: int, keep_ids: bool, key_type: pa.DataType):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        names = ["row", "key", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
        made: list[tuple] = []
        held: list[bytes] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            row, key, piece, start, length, crc = zip(*made, strict=True)
            columns = [pa.array(row, pa.int64()), pa.array(key, key_type), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(bounds, np.frombuffer(b"".join(held), "<i4")))
            made.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for given in batches:
            for n in range(given.num_rows):
                row, key = given["row"][n].as_py(), given["key"][n].as_py()
                text = given["text"][n].as_py() or ""
                parts = (p for source in (tokens.chunks(text), [struct.pack("<I", end)]) for p in source)
                for k, ids in enumerate(_cut(parts, 4 * limit)):
                    made.append((row, key, k, k * limit, len(ids) // 4, zlib.crc32(ids)))
                    if keep_ids:
                        held.append(ids)
                    weight += 64 + keep_ids * len(ids) // 4
                    if weight >= BATCH:
                        yield batch()
                        weight = 0
        if made:
            yield batch()

    return cut


def pieces(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text",
    limit: int = LIMIT, end: int = END, keep_ids: bool = True,
) -> DataFrame:
    """The pieces of every document: ``row``, ``key``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if kept, ``ids``.

    A document's ids are those that the tokenizer file gives its whole text without special
    tokens, and then ``end``. More than ``limit`` ids are cut into pieces of ``limit``, the last
    of which may be shorter. A NULL or an empty text has the one id ``end``. ``row`` names the
    row, so that repeated or NULL keys stay apart; other columns of ``docs`` are left out, and
    the key keeps its name only in ``packed``. The pieces are stored. An empty table gives none.

    ``tokenizer`` is a file that every executor has at this place. A text of any length is
    tokenised in chunks that end at blanks, where the tokenizer allows it.
    """
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [T.StructField("row", T.LongType()), T.StructField("key", chosen.schema["key"].dataType),
              T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    from pyspark.sql.pandas.types import to_arrow_type

    cut = _pieces(tokenizer, limit, end, keep_ids, to_arrow_type(chosen.schema["key"].dataType))
    return stored(chosen.mapInArrow(cut, T.StructType(fields)), "pieces")


def sum_of_squares(sizes: np.ndarray, limit: int, *, open_freely: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of each size, in the order given, and the free room of each sequence.

    ``count[g]`` open sequences have the gap g. A size goes to the gap, or to a new sequence,
    that makes the sum of squared counts smallest; of equal choices to the smallest gap, and
    to a new sequence last. Without ``open_freely`` a new one is opened only if none has room.
    """
    count = np.zeros(limit + 1, dtype=np.int64)
    waiting: dict[int, list[int]] = {}
    place, free = np.empty(len(sizes), dtype=np.int64), []
    for k, size in enumerate(sizes.tolist()):
        at, gain = -1, 2 * count[limit - size] + 1 if size < limit else 0
        gaps = count[size:limit]
        if gaps.size:
            change = np.where(gaps > 0, 2 * (count[:limit - size] - gaps) + 2, np.iinfo(np.int64).max)
            if gaps[0]:
                change[0] = 1 - 2 * gaps[0]
            best = int(change.argmin())
            if gaps[best] and (change[best] <= gain or not open_freely):
                at = size + best
        if at < 0:
            mine = len(free)
            free.append(limit - size)
        else:
            mine = waiting[at].pop()
            count[at] -= 1
            free[mine] = at - size
        place[k] = mine
        if free[mine]:
            count[free[mine]] += 1
            waiting.setdefault(free[mine], []).append(mine)
    return place, np.array(free, dtype=np.int64)


def pack_group(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Sequence of each size (descending), as few as the rule gives.

    The rule is used in rounds: loose sequences are taken apart and their pieces placed anew,
    while that saves any. The same with new sequences opened only where none has room; the
    better of both is kept.
    """
    best, fewest = None, None
    for freely in (True, False):
        place, used = np.empty(len(sizes), dtype=np.int64), 0
        left, loose_before = np.arange(len(sizes)), None
        while True:
            at, free = sum_of_squares(sizes[left], limit, open_freely=freely)
            place[left] = at + used
            used += len(free)
            loose = int((free > LOOSE).sum())
            if loose < 2 or loose == len(free) or loose_before is not None and loose >= loose_before:
                break
            open_ = free[at] > LOOSE
            left, loose_before = left[open_], loose
        # Numbers of sequences that were taken apart stay unused.
        place = np.unique(place, return_inverse=True)[1].ravel()
        if fewest is None or place.max(initial=-1) + 1 < fewest:
            best, fewest = place, place.max(initial=-1) + 1
    return best


def _pack(limit: int):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        sizes = group["length"].to_numpy()
        place = pack_group(sizes, limit)
        order = np.argsort(place, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(place[order]) > 0])
        offset = np.empty_like(run)
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        used = np.bincount(place, weights=sizes)
        return pd.DataFrame({
            "row": group["row"], "piece": group["piece"], "length": sizes, "part": np.int64(key[0]),
            "sequence": place, "offset": offset, "closed": used[place] >= limit - LOOSE})

    return pack


def place_pieces(cut: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """``row``, ``piece``, ``sequence_id`` and ``offset`` of stored pieces of 1 to ``limit`` ids.

    Offsets within a sequence run gapless from 0. Which pieces meet depends on hashes of
    (row, piece) only, so a rerun over the same pieces gives the same sequences. A group
    holds about ``GROUP`` pieces however many documents or copies there are. A round that
    closes less than half of its pieces' sequences is the last one.
    """
    whole = cut.where(F.col("length") == limit).select(
        "row", "piece", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    left = cut.where(F.col("length") < limit).select("row", "piece", "length")
    n, turn, ended = left.count(), 0, [whole]
    while n:
        parts = -(-n // GROUP)
        part = F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(parts))
        placed = stored(left.groupBy(part.alias("part")).applyInPandas(
            _pack(limit), "row long, piece int, length long, part long, sequence long, offset long, closed boolean"),
            "packed-pieces")
        # Turns below 2^5, parts below 2^36, sequences of a part below 2^21.
        number = ((F.lit(turn << 36) + F.col("part")) * (1 << 21) + F.col("sequence")) * 2
        done = placed.withColumn("sequence_id", number)
        loose = placed.where(~F.col("closed"))
        n_loose = loose.count() if parts > 1 else n
        if n_loose > n // 2:
            ended.append(done.select("row", "piece", "sequence_id", "offset"))
            break
        ended.append(done.where("closed").select("row", "piece", "sequence_id", "offset"))
        left, n, turn = loose.select("row", "piece", "length"), n_loose, turn + 1
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return found


def packed(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text",
           limit: int = LIMIT, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document and its place: ``key``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, if kept, ``ids``. See ``pieces`` and
    ``place_pieces``."""
    cut = pieces(docs, tokenizer, key=key, text=text, limit=limit, end=end, keep_ids=keep_ids)
    placed = cut.join(place_pieces(cut, limit=limit), ["row", "piece"])
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
                         "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of the packed pieces, in the order of their offsets; at most
    one sequence's ids per group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
