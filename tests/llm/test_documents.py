"""Operators on documents against brute force, on fixtures with the awkward cases."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import components, decontamination, registry, sharding, simhash, substring_dedup, toxicity
from marlstone.llm.words import find_words, sliding_min

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, runs, periods, nulls, blanks and a long one."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), prose(rng, 52)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(40)]
    texts += [texts[3]] * 4 + [texts[5] + " tail"] + ["  " + texts[7].replace(" ", "\n\t ") + " "]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(4)]
    texts += [prose(rng, 5) + " " + line, line, line + " " + prose(rng, 3)]
    texts += ["na " * 120, "na " * 60 + "x", "ab cd " * 70, "cd ab " * 70, "na " * 49]
    texts += [None, "", " \n ", "É é É", "Words WORDS words", prose(rng, 4000), "x" * 5000, None]
    near = prose(rng, 300).split()
    for _ in range(6):
        copy = list(near)
        copy[rng.randrange(300)] = "other"
        texts.append(" ".join(copy))
    return texts


def frame(spark, texts, ids=None, extra=()):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), *(e for _, e in extra)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c, _ in extra))


def saved(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


# words


def test_words_match_the_pattern():
    texts = corpus() + ["a\x0bb\x0cc\u00a0d\u2003e", "\x1cq\x85r"]
    found = find_words(pa.array(texts, pa.string()))
    got = [[found.data[found.start[k] : found.end[k]].decode() for k in range(found.first[i], found.first[i + 1])] for i in range(len(texts))]
    assert got == [words_of(t) for t in texts]
    names = dict()
    for word, h in zip((w for t in got for w in t), found.hashes().tolist()):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    sliced = find_words(pa.array(texts, pa.string()).slice(10, 30))
    assert sliced.hashes().tolist() == found.hashes()[found.first[10] : found.first[40]].tolist()


def test_sliding_min():
    values = np.array([5, 3, 9, 1, 7, 2, 8])
    for width in range(1, 8):
        assert sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(8 - width)]


# op 3


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 60])
def test_sharding(spark, tmp_path, hot):
    texts = corpus() + ["hot text " * 20] * hot
    texts += texts[:3]
    ids = list(range(len(texts) - 3)) + [0, None, None]
    out = registry.op3_minimax_sharding(spark, saved(spark, tmp_path, documents=frame(spark, texts, ids))).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    shards, of = defaultdict(list), defaultdict(set)
    for r in out:
        shards[r["shard"]].append(r)
        of[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(shards) <= set(range(8)) and all(len(s) == 1 for s in of.values())
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    # the capacity is the least for the order of hashes, after groups that fill a share by themselves
    keyed = spark.createDataFrame([(t or "",) for t in texts], "t string").groupBy(F.xxhash64("t").alias("k")).agg(F.sum(F.octet_length("t") + 1).alias("n")).orderBy("k").collect()
    sizes, left = [r["n"] for r in keyed], 8
    while left > 1 and max(sizes) * left >= sum(sizes):
        sizes.remove(max(sizes))
        left -= 1
    used = sorted(sum(r["size"] for r in rows) for rows in shards.values())
    assert max(used[:left]) == best_capacity(sizes, left)


def test_sharding_refines_ranges(spark, monkeypatch):
    rng = random.Random(3)
    sizes = {rng.randrange(-(1 << 63), 1 << 63): rng.randrange(1, 1000) for _ in range(3000)}
    groups = spark.createDataFrame(list(sizes.items()), "_key long, _bytes long").cache()
    monkeypatch.setattr(sharding, "BITS_A_LEVEL", 5)
    cuts = sharding.cut_keys(groups, 8)
    parts = np.add.reduceat([sizes[k] for k in sorted(sizes)], [0] + [bisect_left(sorted(sizes), c) for c in cuts])
    assert parts.max() == best_capacity([sizes[k] for k in sorted(sizes)], 8)


# op 9


def brute_components(ids, prints, radius):
    label = list(range(len(ids)))
    for _ in range(len(ids)):
        before = list(label)
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius:
                    label[i] = min(label[i], label[j])
        if label == before:
            break
    least = defaultdict(list)
    for i, one in enumerate(label):
        if ids[i] is not None:
            least[one].append(ids[i])
    return [min(least[one]) if least[one] else None for one in label]


def brute_print(text, size=4):
    w = words_of(text, lower=True)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, tmp_path):
    texts = corpus() + corpus()[:2]
    ids = [100 - i for i in range(len(texts) - 2)] + [100, None]
    out = registry.op9_simhash_tiles(spark, saved(spark, tmp_path, documents=frame(spark, texts, ids))).collect()
    prints = [brute_print(t) for t in texts]
    want = Counter(zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints, 4)))
    assert Counter(map(tuple, out)) == want


def test_tiles_find_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    prints = np.concatenate([base, base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), base[:50] ^ np.uint64(0b11111)])
    for right in (None, prints[600:]):
        left = prints if right is None else prints[:600]
        got = simhash.linked_rows(left[:, None], None if right is None else right[:, None], 4, 128)
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
        if right is not None:
            near[:600, :600] = near[600:, 600:] = False
        label = np.arange(len(prints))
        while True:
            new = np.array([min(label[i], *(label[near[i]].tolist() or [label[i]])) for i in range(len(prints))])
            if (new == label).all():
                break
            label = new
        assert len({*zip(got.tolist(), label.tolist())}) == len(set(got.tolist())) == len(set(label.tolist()))


def test_blocks_cover_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 10)
    counts = {20: 3, 25: 35, 26: 4, 27: 4, 40: 1}
    blocks, pairs = simhash.plan_blocks(counts, 4, 8)
    for a in counts:
        for b in counts:
            if abs(a - b) <= 4:
                own = [[i for i, (low, high, _, _) in enumerate(blocks) if low <= x <= high] for x in (a, b)]
                assert all(tuple(sorted((i, j))) in pairs for i in own[0] for j in own[1])
    assert simhash.plan_blocks({}, 4, 8) == ([], [])


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)] + [(200, 200 + i) for i in range(1, 20)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(20)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one(spark):
    rng = random.Random(9)
    base = prose(rng, 600, 5000)
    near = base.split()
    near[300] = "changed"
    texts = [prose(rng, 300, 5000), base, " ".join(near), base, base, None, None, ""]
    df = frame(spark, texts, [7, 5, 6, 5, None, None, None, 3], extra=(("_text", "a"), ("component_id", "b"), ("c0", "c")))
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(3, ""), (5, base), (7, texts[0])]


def shingle_set(text, size=5):
    w = words_of(text, lower=True)
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_repeated_line_is_no_near_copy(spark):
    rng = random.Random(10)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [" ".join(f"t{t}x{i}" for i in range(300)) + f" {line}" * 40 for t in range(4)]
    base = [f"b{i}" for i in range(400)]
    texts += [" ".join(base), " ".join(base) + " " + "again and " * 400]  # alike at 0.99; the repeats must not outvote the rest
    kept = simhash.deduplicate(frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("part", [1 << 15, 300])
def test_near_copies_are_exactly_those_alike(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "LEAST_OF_PART", part)
    rng, texts = random.Random(11), []
    for length in (5, 8, 9, 13, 60, 150, 400):
        for _ in range(4):
            base = prose(rng, length, 5000).split()
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.025, 0.03, 0.04):
                base = [w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in base]  # chains
                texts.append(" ".join(base))
            texts.append(" ".join(base[: len(base) * 9 // 10]))
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i in range(len(texts)):
            label[i] = min(label[j] for j in range(len(texts)) if jaccard(sets[i], sets[j]) >= 0.8)
        if label == before:
            break
    assert 0 < len(set(label)) < len(texts)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(frame(spark, texts)).collect()) == sorted(set(label))


# op 10


def brute_repeats(ids, texts, window=50):
    least = {}
    split = [words_of(t) for t in texts]
    for i, w in zip(ids, split):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    rows = []
    for i, w in zip(ids, split):
        out = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                out[p : p + window] = [True] * window
        kept = [x for x, o in zip(w, out) if not o]
        rows.append((i, len(w), sum(out), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_recompression(spark, tmp_path, seed):
    texts = corpus(seed) + corpus(seed)[3:6]
    ids = list(range(len(texts) - 3)) + [3, 3, None]
    random.Random(seed).shuffle(ids)
    out = registry.op10_recompression(spark, saved(spark, tmp_path, documents=frame(spark, texts, ids))).collect()
    assert Counter(map(tuple, out)) == brute_repeats(ids, texts)


def test_small_windows_and_alphabets(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    for window in (1, 3, 12, 25):
        out = substring_dedup.without_repeats(frame(spark, texts), window=window, keep=["doc_id"]).select("doc_id", "_n_words", "_n_removed", "_kept_sha256").collect()
        assert Counter(map(tuple, out)) == brute_repeats(range(60), texts, window), window


def test_shapes_hold():
    for window in range(1, 300):
        shape = substring_dedup.shape_for(window)
        assert shape.starts >= min(shape.longest, 1) and (shape.pair_rounds == 0 or shape.starts >= shape.longest)
    assert substring_dedup.shape_for(50).pair_rounds == 2


def test_cut_texts(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    texts = [passage, "Keep  this,\n" + passage.replace(" ", "  ") + "\n and that ", None, " \n", passage]
    df = frame(spark, texts, extra=(("_id", "x"), ("_cuts", "y")))
    out = substring_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: passage, 1: "Keep  this, and that ", 2: None, 3: " \n", 4: ""}


# op 2


def test_leaks(spark):
    rng = random.Random(8)
    items = [prose(rng, n, 3000) for n in (40, 25, 13, 9, 4)]
    items += [items[0].upper(), None, ""]
    swapped = items[0].split()
    for at in (4, 11, 19, 26, 33):
        swapped[at] = "swapped"
    half = " ".join(items[1].split()[5:20])
    texts = [prose(rng, 200, 3000) for _ in range(5)]
    texts += [prose(rng, 30, 3000) + " " + items[0] + " " + prose(rng, 30, 3000), " ".join(swapped), "«" + half + "»!", items[2].title() + ".", items[3], items[4], None, "", items[0] + " x " + items[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, texts, extra=(("_leaks", "a"),))
    for piece in (1 << 20, 30):
        got = {(r["doc_id"], r["x"]["item_id"]): (r["x"]["doc_start"], r["x"]["length"], r["x"]["matches"]) for r in decontamination.find_leaks(df, bench, keep=["doc_id"], piece_words=piece, least_words=8).select("doc_id", F.explode("_leaks").alias("x")).collect()}
        want = {(5, 0): (30, 40, 40), (6, 0): (0, 40, 35), (7, 1): (0, 15, 15), (8, 2): (0, 13, 13), (9, 3): (0, 9, 9), (13, 0): (0, 40, 40)}
        if piece == 30:
            want |= {(d, 5): v for (d, i), v in want.items() if i == 0}  # the equal item lies in another piece
        assert {k: v for k, v in got.items() if k != (7, 1)} == {k: v for k, v in want.items() if k != (7, 1)}
        assert got[7, 1][1] >= 13
    kept = decontamination.decontaminate(df, bench, least_words=8)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 10, 11, 12]
    assert decontamination.decontaminate(df, bench.limit(0)).count() == len(texts)


def test_longest_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        same = rng.random(rng.integers(1, 25)) < rng.choice([0.5, 0.8, 0.95])
        s, e = decontamination.longest_overlap(same, 0.8)
        best = max([b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a:b].mean() >= 0.8 - 1e-12] or [0])
        if best == 0:
            assert e - s == 0
        else:
            assert same[s] and same[e - 1] and e - s <= best and same[s:e].mean() >= 0.8


def test_every_overlap_is_found():
    rng = random.Random(12)
    for n in [*range(1, 18), 20, 25, 40]:
        for _ in range(60):
            item = [f"i{rng.randrange(10**6)}" for _ in range(n)]
            copy = list(item)
            for at in rng.sample(range(n), rng.randrange(0, n // 5 + 2)):
                copy[at] = "other"
            doc = [f"d{i}" for i in range(5)] + copy + [f"e{i}" for i in range(5)]
            same, least = [a == b for a, b in zip(copy, item)], min(13, n)
            want = any(sum(same[a:b]) >= 0.8 * (b - a) - 1e-12 for a in range(n) for b in range(a + least, n + 1))
            index = decontamination.Index.of([7], [find_words(pa.array([" ".join(item)])).hashes()])
            found = decontamination.leaks_of(find_words(pa.array([" ".join(doc)])), index, 13, 0.8)[0]
            assert bool(found) == want, (n, same)
            assert not found or found[0]["length"] >= least and found[0]["matches"] >= 0.8 * found[0]["length"] - 1e-12


def test_short_items(spark):
    items = ["yes", "so it goes", "a b c d e", "what is it for you now then"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, ["he said yes", "And so it goes.", "a b x d e", "what is it for them now then", "no"])
    found = lambda **o: sorted((r["doc_id"], [x["item_id"] for x in r["_leaks"]]) for r in decontamination.find_leaks(df, bench, keep=["doc_id"], **o).collect())
    assert found() == [(0, [0]), (1, [1]), (2, [2]), (3, [3]), (4, [])]
    assert all(not x for _, x in found(least_words=8))


# op 1


def toxic_corpus(rng, n):
    bad = ["glorb", "snarkle", "vexo"]
    rows = []
    for i in range(n):
        w = prose(rng, rng.randrange(5, 120), 2000).split()
        toxic = i % 4 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ish,", "ed."]))
        rows.append((" ".join(w), int(toxic)))
    return rows


def test_toxicity(spark, tmp_path):
    rows = toxic_corpus(random.Random(2), 400)
    texts = [t for t, _ in rows] + [None, "", "Glorb! yes snarkleish", "prose " * 20000]
    ids = list(range(403)) + [None]
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(0, 1, None), (9999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    folder = saved(spark, tmp_path, documents=frame(spark, texts, ids), labels=labels)
    out = {r["doc_id"]: r for r in registry.op1_crf_toxicity(spark, folder).collect()}
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [i for i in range(400) if out[i]["held_out"]]
    assert held and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(403))
    assert np.mean([out[i]["predicted"] == rows[i][1] for i in held]) > 0.97
    assert out[400]["score"] == out[401]["score"] < 0.5 and out[402]["predicted"] == 1
    assert [texts[402][s["start"] : s["end"]] for s in out[402]["spans"]] == ["Glorb", "snarkleish"]
    # the labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = registry.op1_crf_toxicity(spark, saved(spark, tmp_path / "b", documents=frame(spark, texts, ids), labels=flipped)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {i: r["score"] for i, r in out.items()}


def test_forward_backward():
    from itertools import product

    from marlstone.llm import crf

    rng = np.random.default_rng(1)
    chain = crf.Chain(rng.normal(size=2), rng.normal(size=(2, 2)))
    lengths = [1, 4, 7, 300]
    scores = rng.normal(size=sum(lengths)) * 2
    first = np.zeros(len(scores), dtype=bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got = crf.marginals(scores, first, chain)
    at = 0
    for n in lengths[:3]:
        mass, hot = 0, np.zeros(n)
        for path in product((0, 1), repeat=n):
            p = np.exp(chain.start[path[0]] + sum(chain.step[a, b] for a, b in zip(path, path[1:])) + sum(s * y for s, y in zip(scores[at:], path)))
            mass, hot = mass + p, hot + p * np.array(path)
        assert np.allclose(got[at : at + n], hot / mass)
        at += n
    assert np.allclose(got[at:], crf.marginals(scores[at:], first[at:], chain))


# empty tables


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    folder = saved(spark, tmp_path, documents=none, labels=labels, benchmark=bench)
    for name in ("op1_crf_toxicity", "op2_spaced_seeds", "op3_minimax_sharding", "op5_best_fit_packing", "op7_kneser_ney", "op8_tiered_packing", "op9_simhash_tiles", "op10_recompression"):
        assert registry.QUERIES[name](spark, folder).count() == 0, name
