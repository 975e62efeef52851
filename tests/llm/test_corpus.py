"""Corpus operators against brute force, on rows with every kind of oddity."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snapgate.llm import (
    decontaminate,
    line_dedup,
    mixing,
    pivots,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    url_templates,
    warc,
)
from snapgate.llm.common import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, a int"
ALPHABET = ["alpha", "beta", "gamma", "delta", "the", "of", "Ünder", "čaj", "x"]


def prose(rng, n):
    return " ".join(rng.choice(ALPHABET) + str(rng.randrange(60)) for _ in range(n))


def make_docs(seed=3):
    """Repeated, near-equal, NULL, empty, blank, short and long texts, NULL ids and sources."""
    rng = random.Random(seed)
    long = prose(rng, 3000)
    base = [prose(rng, 60) for _ in range(8)]
    texts = [None, "", "  \n\t", "x", long, long, *base, base[0], base[0], base[1] + " tail",
             base[2].replace("alpha", "ALPHA", 1), base[3] + "\n" + base[4], base[5][:300] + "\n" + base[6],
             "line one is here\n\nline one is here\nline one is there", "line one is here"]
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, None, "clash", "clash", k) for k, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, base[7], None, "s1", 5, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(make_docs(), DDL).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d")
    spark.createDataFrame([], DDL).write.parquet(path)
    return spark.read.parquet(path)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (None, 4), *((20, k) for k in range(21, 60))]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{k: 20 for k in range(20, 60)}}
    assert sorted((r.node, r.root) for r in got.collect()) == sorted(want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards_hold_every_row_once(docs, none):
    got = sharding.shuffle_into_shards(docs, 4, bucket_rows=5).collect()
    assert bag(r[:5] + (r.size, r.a) for r in got) == bag(r[:5] + (r.size, r.a) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shuffle_into_shards(docs, 4, bucket_rows=5).collect()
    assert bag(got) == bag(again)
    assert sharding.shuffle_into_shards(none, 4).count() == 0


def test_permutations_are_uniform(spark):
    rows = spark.range(12_000).select(sharding._permutation(F.lit(3), F.col("id"), 1).alias("p"))
    counts = {tuple(r[0]): r[1] for r in rows.groupBy("p").count().collect()}
    assert len(counts) == 6 and all(1800 < n < 2200 for n in counts.values())


def test_written_shards_keep_their_order(spark, docs, tmp_path):
    made = sharding.shuffle_into_shards(docs.select("doc_id", "text"), 3)
    sharding.write_shards(made, str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    assert bag(read.select("doc_id", "shard", "slot").collect()) == bag(
        made.select("doc_id", "shard", "slot").collect())


def targets_of(rows):
    size = defaultdict(int)
    for source, n in rows:
        size[source] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left = {}, dict(size)
    total = sum(size.values())
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * size[s]
            total -= 3 * size[s]
            del left[s]
    return target


def test_mix_meets_its_targets(docs, none):
    got = mixing.balance(docs).collect()
    source = {r.place: r.source for r in docs.withColumn("place", F.monotonically_increasing_id()).collect()}
    want = targets_of((source[r.place], r.size) for r in got)
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 3
        assert r.target == pytest.approx(want[source[r.place]])
        taken[source[r.place]] += r.copies * r.size
    assert len(got) == docs.count()
    assert sorted(r.size for r in got) == sorted(
        len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    largest = Counter()
    for r in got:
        largest[source[r.place]] = max(largest[source[r.place]], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    once = Counter(r.doc_id for r in got)
    other = mixing.balance(docs.repartition(2)).collect()
    assert bag((r.doc_id, r.copies) for r in other if once[r.doc_id] == 1) == bag(
        (r.doc_id, r.copies) for r in got if once[r.doc_id] == 1)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.balance(none).count() == 0


def test_mix_of_rows_that_all_repeat(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "p")] * 60 + [(2, "a b c", "q")] * 60,
                          "doc_id int, text string, source string").write.parquet(str(tmp_path / "r"))
    got = mixing.balance(spark.read.parquet(str(tmp_path / "r"))).groupBy("doc_id").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in got)


def test_lines_against_every_earlier_line(docs, none):
    rows = sorted(docs.withColumn("place", F.monotonically_increasing_id()).collect(), key=lambda r: r.place)
    seen, want = [], []
    for r in rows:
        kept, lines = [], [] if r.text is None else r.text.split("\n")
        for line in lines:
            w = {x for x in re.split(r"[\x20\x09-\x0D]+", line.lower()) if x}
            hit = w and any(5 * len(w & v) >= 4 * len(w | v) for v in seen)
            if w:
                seen.append(w)
            if not hit:
                kept.append(line)
        want.append((r.doc_id, None if r.text is None else "\n".join(kept), len(lines), len(lines) - len(kept), r.a))
    got = line_dedup.without_repeated_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    assert bag(got.select("doc_id", "text", "n_lines", "n_removed", "a").collect()) == bag(want)
    assert line_dedup.without_repeated_lines(none).count() == 0


def test_edited_lines_match_whatever_their_words(spark):
    rng = random.Random(12)
    lines = []
    for _ in range(12):
        base = [prose(rng, 1).replace(" ", "") + str(rng.randrange(10 ** 6)) for _ in range(rng.choice((5, 9, 40, 70)))]
        for _ in range(6):
            edited = list(base)
            for _ in range(rng.randrange(1 + len(base) // 6)):
                edited[rng.randrange(len(base))] = f"new{rng.randrange(10 ** 6)}"
            lines.append(" ".join(edited))
    frame = line_dedup.stored(spark.createDataFrame(
        [(k, line) for k, line in enumerate(lines)], "doc_id long, text string").coalesce(1), "test-docs")
    seen, want = [], set()
    for k, line in enumerate(lines):
        w = set(line.split())
        if any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
            want.add(k)
        seen.append(w)
    got = line_dedup.without_repeated_lines(frame).where("n_removed = 1")
    assert {r.doc_id for r in got.collect()} == want and 10 < len(want) < 60


def test_quality_learns_and_scores_every_text(spark, docs, none):
    rng = random.Random(1)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(60)]
    network = quality.train([t.encode() for t in good + bad], [1] * 60 + [0] * 60)
    fresh = [(prose(rng, 70), 1) for _ in range(20)] + [(prose(rng, 70).upper().replace(" ", "!! "), 0) for _ in range(20)]
    right = [(network.score(t.encode()) >= 0.5) == bool(y) for t, y in fresh]
    assert sum(right) >= 38
    got = quality.score(docs, network).select("doc_id", "score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    # A text is scored as a whole: junk far behind the start still counts.
    assert network.score((good[0] * 400 + " " + bad[0] * 400).encode()) < network.score((good[0] * 400).encode())
    assert quality.score(none, network).count() == 0
    assert quality.fit(none, spark.createDataFrame([], "doc_id long, quality int")).score(b"") > 0.99


def test_quality_never_learns_held_out_labels(spark):
    rows = [(k, f"text {k}") for k in range(40)]
    labels = [(k, 1) for k in range(40)] + [(None, 0), (1000, 0)]
    held = {k for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2}
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r[0] for r in frame.where(quality.held_out("doc_id")).collect()} - {1000} == held
    flipped = spark.createDataFrame([(k, 0 if k in held else 1) for k in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.fit(docs, flipped).bias == quality.fit(docs, frame).bias == 30.0


def test_long_texts_are_convolved_in_blocks():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32),
                          np.zeros(quality.FILTERS, dtype=np.float32), rng.normal(size=3 * quality.FILTERS), 0.0)
    text = rng.integers(0, 256, quality.SEGMENT * quality.BLOCK * 2 + 77, dtype=np.uint8)
    out = net.responses(text)
    want = np.stack([out[s:s + quality.SEGMENT].max(axis=0) for s in range(0, len(out), quality.SEGMENT)])
    assert np.allclose(net.segments(text.tobytes())[0], want)
    assert np.allclose(net.segments(text.tobytes(), where=True)[0], want)


def brute_removed(texts):
    count = Counter(t[s:s + 200] for t in texts for s in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - 199):
            if count[t[s:s + 200]] > 1:
                gone[s:s + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(
            np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_repeats_against_every_window(docs, none, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(5)
    shared = prose(rng, 120)
    more = [(100 + k, prose(rng, 20) + shared[k:600 - 3 * k] + prose(rng, 30 + k), "ab" * 300 if k == 3 else None)
            for k in range(12)] + [(200, "ab" * 300, None), (201, "é" * 101, None), (202, shared[5:205], None)]
    spark = docs.sparkSession
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(
        [(a, b) for a, b, _ in more], "doc_id long, text string"))
    path = suffix_dedup.stored(frame.repartition(2), "test-docs")
    rows = path.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_removed([(r.text or "").encode() for r in rows]), strict=True))
    got = suffix_dedup.remove_repeats(path)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans"]
    assert bag(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256)).collect()) == want
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in [*range(30), 250]:
        for letters in (1, 2, 5, 200):
            s = rng.integers(1, letters + 1, n)
            assert suffix_dedup.suffix_order(s, n + 1).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
            cut = [tuple(s[i:i + 12]) for i in suffix_dedup.suffix_order(s, 12)]
            assert cut == sorted(cut)


def test_segments_tile_the_strings_of_a_text(monkeypatch):
    text = prose(random.Random(9), 400).encode() + b"z" * 900
    for part in (1 << 22, 500):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        _, start, starts, offset = suffix_dedup.segments(text)
        assert start[0] == 0 and (start[1:] == start[:-1] + starts[:-1]).all()
        assert start[-1] + starts[-1] == len(text) - 199
        assert (offset >= starts - 1).all() and (offset < suffix_dedup.SPAN).all()


def brute_fingerprint(text):
    w = words_of(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprints_and_components(docs, none):
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints],
               brute_components([r.doc_id for r in rows], prints), strict=True)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")), "component")
    assert bag(got.collect()) == bag(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.root for r in simhash.near_duplicates(docs).collect()})
    nameless = simhash.stored(docs.withColumn("doc_id", F.lit(None).cast("long")), "test-docs")
    assert simhash.keep_one(nameless).count() == kept.count()
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("crowd,block", [(256, 2048), (2, 16)])
def test_every_link_is_found(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(8)
    prints = {0, 2 ** 64 - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(30):
            flips = rng.sample(range(64), rng.randrange(5))
            prints.add(centre ^ sum(1 << b for b in flips))
    ids = sorted(prints)
    signed = np.array(ids, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = brute_components(list(range(len(ids))), ids)
    groups = defaultdict(set)
    for k, f in enumerate(signed):
        groups[want[k]].add(find(f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({find(f) for f in signed}) == len(groups)


def test_codewords_near_are_all_within_four_bits():
    words = np.array([0, 1, 2 ** 23 - 1, 123456, 7654321], dtype=np.int64)
    row, index, nearest = simhash.codewords_near(words)
    assert (np.bincount(row[nearest], minlength=5) == 1).all()
    code = np.arange(4096, dtype=np.int64) << 11
    code ^= simhash._remainders(code)
    for k, w in enumerate(words):
        far = np.bitwise_count(code ^ w)
        assert sorted(index[row == k]) == sorted(np.flatnonzero(far <= 4))
        assert far[index[(row == k) & nearest][0]] <= 3


def edits_within(pattern, text):
    last = [0] * (len(text) + 1)
    for p in pattern:
        row = [last[0] + 1]
        for j, t in enumerate(text):
            row.append(min(last[j] + (p != t), last[j + 1] + 1, row[j] + 1))
        last = row
    return min(last)


def test_occurrences_against_full_alignment(spark, docs, none):
    rng = random.Random(4)
    items = [(k, prose(rng, n)) for k, n in enumerate((5, 14, 25, 40))] + [(9, None), (10, ""), (11, "short one")]
    host = prose(rng, 40)
    texts = [None, "", host]
    for _, t in items[:4]:
        garbled = list(t)
        for _ in range(3):
            garbled[rng.randrange(len(t))] = "#"
        texts += [host + " " + t.upper() + " " + host, host + "".join(garbled), host + t[: len(t) // 3],
                  "\n ".join((host + " " + t).split(" ")), t[1:-1]]
    frame = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").union(
        docs.select("doc_id", "text"))
    frame = decontaminate.stored(frame, "test-docs")
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = set()
    for r in frame.collect():
        flat = decontaminate.normal((r.text or "").encode())
        for k, t in items:
            p = decontaminate.normal((t or "").encode())
            if len(p) < decontaminate.SHORTEST:
                continue
            starts = [*range(0, max(1, len(p) - 80 + 1), 40), max(0, len(p) - 80)]
            if len(flat) < 6000 and any(edits_within(p[s:s + 80], flat) <= int(len(p[s:s + 80]) * 0.08) for s in starts):
                want.add((r.doc_id, k))
    got = decontaminate.occurrences(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 8
    cleaned = decontaminate.clean(frame, benchmark)
    assert {r.doc_id for r in cleaned.collect()} == {r.doc_id for r in frame.collect()} - {d for d, _ in want}
    assert decontaminate.occurrences(none, benchmark).count() == 0
    assert decontaminate.occurrences(frame, benchmark.limit(0)).count() == 0


def test_vectors_against_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + rng.normal(size=16) * 0.08 * (k % 3)).tolist()) for k in range(240)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [0.0] * 16), (305, [float("nan")] * 16),
             (306, [None] * 16), (None, rows[0][1]), (307, [1.0, 2.0]), (308, [2.0, 4.0]), (309, [1e-200] * 16), (309, [1e200] * 16)]
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows],
                                  "vec_id long, embedding array<double>, label int, node string")
    got = pivots.near_vectors(frame).collect()
    assert len(got) == len(rows)
    fit = [(a, np.array(b)) for a, b in rows if b and None not in b
           and np.isfinite(b).all() and np.any(b)]
    unit = [v / np.abs(v).max() for _, v in fit]
    unit = [v / np.linalg.norm(v) for v in unit]
    links = Counter()
    for i, j in combinations(range(len(fit)), 2):
        if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
            links[i] += 1
            links[j] += 1
    want = Counter()
    for k, (a, _) in enumerate(fit):
        want[a] += links[k]
    found = Counter()
    for r in got:
        if r.vec_id is not None:
            found[r.vec_id] += r.n_links
    assert all(found[a] <= want[a] for a in found)
    assert sum(found.values()) >= 0.9 * sum(want.values()) > 100
    assert found[300] >= 2 and found[307] == found[308] == 1 and found[303] == found[304] == found[305] == 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert pivots.near_vectors(frame.limit(0)).count() == 0


def test_hot_lists_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=8)
    rows = [(k, (base + rng.normal(size=8) * 0.01).tolist()) for k in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = bag(pivots.near_vectors(frame).collect())
    monkeypatch.setattr(pivots, "BLOCK", 20)
    assert bag(pivots.near_vectors(frame).collect()) == whole
    assert all(r[2] == 0 for r in whole)


def test_urls(spark, none):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/en/12?x://y", "http://example.org/es/", "http://notexample.org/es/1",
            "http://a.com/fr/1", "http://a.com/fr/2", "http://a.com/de/3", "http://a.com/it/3.html", "http://x.net?/a", "http://x.net#/a",
            "http://org/a", "http://a.com/it/" + "a/" * 6, "first://b.org/x http://c.com/de/"]
    frame = spark.createDataFrame([(k, u, "clash") for k, u in enumerate([*urls, urls[8]])], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_templates.judge(frame).collect()}
    assert len(got) == len(urls) + 1
    assert [(got[k].host, got[k].path) for k in (0, 2, 4, 11, 12)] == [
        ("", ""), ("", ""), ("a.example.org", "/en/12"), ("x.net", ""), ("x.net", "")]
    assert [got[k].rule for k in (4, 5, 6, 7, 9, 10, 13, 15)] == [
        "example.org/en/1", "example.org/es/", "org/", "com/fr/", "com/de/", None, "org/", "org/"]
    assert [got[k].verdict for k in (4, 5, 6, 7, 9)] == ["block", "block", "allow", "allow", "block"]
    assert got[10].template == "/it/*.html" and got[10].verdict == "allow"
    assert got[8].verdict == got[16].verdict
    assert url_templates.judge(frame.limit(0)).count() == 0


def test_impure_templates_are_rejected(spark):
    rules = (url_templates.Rule("block", "h.com", "/bad/1"), url_templates.Rule("allow", "h.com", "/good/1"))
    urls = [f"http://h.com/{kind}/{d}{k}" for kind in ("bad", "good") for d in (1, 2) for k in range(30)]
    got = url_templates.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=rules)
    verdicts = {(r.path[1:-2] if len(r.path) > 6 else r.path, r.verdict) for r in got.where("rule IS NULL").collect()}
    assert {v for p, v in verdicts if "bad" in p} == {"block"} and {v for p, v in verdicts if "good" in p} == {"allow"}


def test_warc_derivatives_and_files(spark, tmp_path):
    html = ('<html lang="de"><head><title> T &amp;\n x</title><style>p{}</style><script>var t="</p>";</script></head><body>'
            '<!-- no --><p>A &lt;b&gt; &#228;&#x1F600;&bogus; &amp;lt; x</p><br>B<a href="/r">link</a> <a href="u?v=1&amp;w">k</a>'
            '<a href="#f">f</a><a href="//o.net/x">o</a><a href="mailto:a@b">m</a></body></html>')
    pages = spark.createDataFrame([(1, "http://h.org/d/e?q", html, "x"), (1, "http://h.org/d/e?q", html, "x"), (2, None, None, "y"),
                                   (3, "nonsense", "", "z"), (4, "http://h.org", "plain", None)],
                                  "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    got = warc.derivatives(source)
    rows = got.collect()
    assert len(rows) == 10
    text = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert text[1] == "A <b> ä😀&bogus; &lt; x\nBlink kfom"
    assert text[2] == text[3] == "" and text[4] == "plain"
    fields = next(r.block for r in rows if r.page_id == 1 and r.record_type == "metadata").split("\r\n")
    assert "title: T & x" in fields and "language: de" in fields and "source-header: HTTP/1.1 200 OK" in fields
    assert [f[9:] for f in fields if f.startswith("outlink: ")] == [
        "http://h.org/r", "http://h.org/d/u?v=1&w", "http://h.org/d/e#f", "http://o.net/x", "mailto:a@b"]
    ids = {r.page_id: r.record_id for r in source.collect()}
    for r in rows:
        assert r.refers_to == ids[r.page_id] and r.record_id != r.refers_to
        assert r.content_length == len(r.block.encode())
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    warc.write_warc(got, str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert all(r.whole for r in read)
    assert bag((r.headers["warc-record-id"], r.headers["warc-refers-to"], r.block) for r in read) == bag(
        (r.record_id, r.refers_to, r.block) for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
