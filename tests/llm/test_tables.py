"""Url rules, neighbours, the language model, packing and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import ann, hasharrays, language_model, packing, registry, tokenizing, url_filter
from tests.llm.test_documents import corpus, frame, prose, saved, toxic_corpus, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")

# op 4


def brute_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_rules(spark, tmp_path):
    hosts = ["example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "example.net", "net", "com", ".com", "", "example.com:80", "u@example.com", "comx", "É.com", "example.com."]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/EN/", "/es/1", "/fr/", "?q=/en/", "#/en/", "/en/?a#b", "/en\n/", "//en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "no scheme", "example.com/en/", "a://b://example.com/en/", "http://" + "a." * 3000 + "com/" + "en/" * 3000, "http:///en/", "\nhttp://example.com/en/", urls[0]]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    out = registry.op4_url_cascade(spark, saved(spark, tmp_path, pages=df)).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in out} == {i: brute_rule(u, registry.URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.apply_rules(df, []).select("rule", "verdict").distinct().collect() == [(None, "allow")]
    empty = registry.op4_url_cascade(spark, saved(spark, tmp_path / "e", pages=df.limit(0)))
    assert empty.count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.xxhash64("key") % 7 == 0)
    cascade = url_filter.build_cascade(listed, keys, bits_a_key=4, probes=1)
    assert len(cascade.levels) > 2
    got = {r[0] for r in keys.where(cascade.contains(F.col("key"))).collect()}
    assert got == {r[0] for r in listed.collect()}
    assert not url_filter.build_cascade(listed.limit(0), keys).levels
    assert url_filter.build_cascade(listed, keys, most_bytes=8) is None
    asked = keys.selectExpr("key AS c0", "concat(key, '') AS key", "1 AS is_listed").unionByName(spark.sql("SELECT 'x' AS c0, CAST(NULL AS STRING) AS key, 2 AS is_listed"))
    for most in (None, 8):  # beyond the bound the keys are joined, with the same result
        out = url_filter.mark_listed(asked, F.col("key"), listed.union(listed.limit(3)), most_bytes=most)
        assert out.columns == ["c0", "key", "is_listed"]
        assert {r["c0"] for r in out.where("is_listed").collect()} == got and out.count() == 4001


# op 6


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 24)).astype(np.float32) + 0.3
    vectors[200:330] = vectors[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    bad = [(1000, None, 0), (1020, [0.0] * 24, 0), (1040, [float("nan")] + [1.0] * 23, 0), (1060, [float("inf")] * 24, 0), (1080, [1.0], 0), (1100, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0), (1120, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    out = defaultdict(list)
    for r in registry.op6_one_bit_codes(spark, saved(spark, tmp_path, embeddings=df)).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == set(range(0, 500, 20))
    found = 0
    for q, got in out.items():
        score = ann.exact(vectors.astype(np.float64), vectors[q].astype(np.float64))
        want = [i for i in np.lexsort((np.arange(500), -score)) if i != q][:20]
        assert [g[0] for g in got] == list(range(1, 21)) and all(g[2] == score[g[1]] for g in got)
        found += len({g[1] for g in got} & set(want))
        if len(want) == len(got) and {g[1] for g in got} == set(want):
            assert [g[1] for g in got] == want
    assert found >= 0.9 * 20 * len(out)
    few = df.where("vec_id < 5")
    assert [r["vec_id"] for r in ann.nearest(few, F.col("vec_id") == 0).collect()].__len__() == 4
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 1020"), F.lit(True)).count() == 0


def test_neighbours_with_repeated_ids(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 8))
    ids = [i // 2 * 20 if i < 10 else i for i in range(40)]
    vectors[3], vectors[5], vectors[4] = vectors[2], vectors[4], vectors[4] * 2  # rows 2 and 3 are equal in all
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, vectors)]
    got = Counter()
    for name in ("vec_id", "score"):
        df = spark.createDataFrame(rows, f"{name} long, embedding array<double>, query_id string")
        out = ann.nearest(df, F.col(name) % 20 == 0, id_col=name, k=5).collect()
        got = Counter((r["query_id"], r["rank"], r["vec_id" if name == "vec_id" else "id"], r["score"]) for r in out)
        want = Counter()
        for q, i in enumerate(ids):
            if i % 20 == 0:
                score = ann.exact(vectors, vectors[q])
                best = [r for r in np.lexsort((np.array(ids), -score)) if r != q][:5]
                want.update((i, rank, ids[r], score[r]) for rank, r in enumerate(best, 1))
        assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(400, 64)), rng.normal(size=(50, 64))
    mean, turn = vectors.mean(axis=0), ann.rotation(64, 1)
    guess, width = ann.Codes.of(vectors, mean, turn).estimate(queries, mean, turn, 3.0)
    inside = np.abs(guess - queries @ vectors.T) <= width
    assert inside.mean() > 0.99 and abs((guess - queries @ vectors.T).mean()) < 0.2


def test_shipped_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(400, 64)), rng.normal(size=(50, 64))
    mean, turn = vectors.mean(axis=0), ann.rotation(64, 1)
    guess, width = ann.Codes.of(vectors, mean, turn).estimate(queries, mean, turn, ann.EPSILON)
    assert (np.abs(guess - queries @ vectors.T) <= width).mean() > 0.99


# op 7


def brute_model(texts, ids):
    tokens = [words_of(t, lower=True) + [None] for t in texts]
    train = [w for w, i in zip(tokens, ids) if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    count = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip(["<s>"] + ws, ws))
    total, kinds, endings = Counter(), defaultdict(Counter), Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
        endings[b] += 1
    d, e = (language_model.discounts(Counter(c.values())) for c in (pairs, endings))
    size, all_endings = len(count), sum(endings.values())
    spare = sum(e[min(n, 3)] for n in endings.values()) / all_endings / (size + 1)

    def low(w):
        return spare + ((endings[w] - e[min(endings[w], 3)]) / all_endings if w in endings else 0)

    def p(a, b):
        if not total[a]:
            return low(b)
        n = pairs[a, b]
        return (n - d[min(n, 3)]) / total[a] + sum(d[k] * kinds[a][k] for k in (1, 2, 3)) / total[a] * low(b)

    everything = sum(count.values())
    rows = [(len(ws), sum(w in count for w in ws), everything, sum(math.log10((count[w] + 1) / (everything + size + 1)) for w in ws), sum(math.log10(p(a, b)) for a, b in zip(["<s>"] + ws, ws))) for ws in tokens]
    return rows, count, p


def test_language_model(spark, tmp_path):
    texts = corpus() + ["the end " * 400] + corpus()[:2]
    ids = list(range(len(texts) - 2)) + [0, None]
    rows, count, p = brute_model(texts, ids)
    out = registry.op7_kneser_ney(spark, saved(spark, tmp_path, documents=frame(spark, texts, ids).repartition(5))).collect()
    assert len(out) == len(texts)
    got = sorted((tuple(r)[2:] for r in out), key=lambda r: (r[0], r[1], round(r[4], 6)))
    want = sorted(rows, key=lambda r: (r[0], r[1], round(r[4], 6)))
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], abs_tol=1e-8) and math.isclose(g[4], w[4], abs_tol=1e-8)
    assert math.isclose(sum(p("w1", w) for w in count) + p("w1", "never seen"), 1, abs_tol=1e-9)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2) for r in out)


def test_language_model_through_sent_files(spark):
    df = frame(spark, corpus())
    here, sent = (language_model.score(df, language_model.train(df, mounted=m), keep=["doc_id"]).orderBy("doc_id").collect() for m in (True, False))
    assert here == sent and len(here) == len(corpus())
    blank = language_model.score(df, language_model.train(df.limit(0)), keep=["doc_id"]).agg(F.sum("_n_known"), F.max("_score"), F.min("_base_score")).first()
    assert tuple(blank) == (0, 0, 0)


def test_hash_arrays():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(0, 1 << 40, len(keys)).astype(np.uint64)
    back = hasharrays.unpack(hasharrays.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()
    assert hasharrays.unpack(hasharrays.pack(keys[:0]))[0].size == 0
    for bits in (1, 6):
        starts = hasharrays.bucket_starts(keys, bits)
        ask = np.concatenate([keys[::3], keys[::3] + np.uint64(1)])
        assert hasharrays.find(keys, starts, bits, ask, ask).tolist() == list(range(0, len(keys), 3)) + [-1] * len(keys[::3])


# op 5 and op 8


@pytest.fixture(scope="module")
def real():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_added_tokens_are_those_of_the_library(real):
    encode, end = tokenizing.encoder(PATH), "<|endoftext|>"
    for text in (f"the end {end}start", end, f"{end}{end} a", f" x {end} \n y{end}", f"<|endoftext|{end}|>", " " * 3000 + f"x{end}" + " " * 3000 + "x"):
        assert encode(text).tolist() == real(text)[:-1].tolist()
    assert 50256 in encode(f"the end {end}start")


def test_ids_are_those_of_the_library(real):
    rng = random.Random(1)
    texts = [t for t in corpus() if t] + ["don't  stop\n\n\t now!!  ", "日本語 und Ünïcödé 🎉🎉", "\u0000\u200b x", "a" * 3000, " " * 3000 + "x", "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(4000))]
    encode = tokenizing.encoder(PATH)
    for t in texts:
        assert encode(t).tolist() == real(t)[:-1].tolist()
    assert encode(" " * 3_000_000 + "x").size > 0


def test_tiers(spark, tmp_path, real):
    texts = corpus() + ["word " * 9000] + corpus()[:1]
    ids = list(range(len(texts) - 1)) + [None]
    out = registry.op8_tiered_packing(spark, saved(spark, tmp_path, documents=frame(spark, texts, ids).repartition(3))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, t in zip(ids, texts):
        at, own = 0, real(t)
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rows[0]["tier"] <= 2048 and at & (at - 1) == 0


@pytest.mark.parametrize("seed", range(5))
def test_fillings(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 40, 200, 900, 5000]) + rng.randrange(60) for _ in range(rng.randrange(0, 80))]
    carried = [(70, len(lengths), 5)] if seed % 2 else []
    full, left = packing.fill_tiers(lengths, 512, 64, carried)
    assert all(sum(n for n, _, _ in used) == tier for tier, used in full) and sum(n for n, _, _ in left) < 512
    small = packing.powers(left)
    pieces = sorted((doc, at, n) for _, used in full + small for n, doc, at in used)
    covered = defaultdict(int)
    for doc, at, n in pieces:
        assert at == covered[doc] or (doc == len(lengths) and at >= 5)
        covered[doc] = at + n
    assert {d: n for d, n in covered.items() if d < len(lengths)} == dict(enumerate(lengths))
    groups = packing.balanced([t for t, _ in full], 2048)
    held = Counter()
    for g, (tier, _) in zip(groups, full):
        held[g] += tier
    assert not held or max(held.values()) - min(held.values()) <= 512


def test_best_fit_is_best(spark):
    rng = random.Random(7)
    lengths = [rng.randrange(1, 900) for _ in range(300)]
    got = packing.fill_best(lengths, 512)
    free, want = [], 0
    for n in sorted((min(512, n - a) for n in lengths for a in range(0, n, 512)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(512 - n)
    assert sorted(512 - sum(n for n, _, _ in used) for used in got) == sorted(free)
    assert sorted((d, a, n) for used in got for n, d, a in used) == [(d, a, min(512, n - a)) for d, n in enumerate(lengths) for a in range(0, n, 512)]


def test_windows_round_trip(spark, tmp_path, real):
    texts = corpus() + ["word " * 9000]
    packed = packing.pack_best_fit(frame(spark, texts), PATH).cache()
    back, docs = defaultdict(dict), {}
    for r in packed.collect():
        row, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert len(row) == 2048 and r["n_tokens"] == r["cu_seqlens"][-1] and not row[r["n_tokens"] :].any()
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["doc_starts"]):
            back[doc][start] = row[a:b]
            assert positions[a:b].tolist() == list(range(b - a))
    for i, t in enumerate(texts):
        docs[i] = np.concatenate([back[i][k] for k in sorted(back[i])])
        assert docs[i].tolist() == real(t).tolist()
    packing.write_matrices(packed, str(tmp_path / "m"), rows=4)
    matrices = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sum(len(m["sequence_ids"]) for m in matrices) == packed.count()
    assert all(len(m["ids"]) == len(m["position_ids"]) == 4 * 2048 * len(m["sequence_ids"]) for m in matrices)


# the pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = toxic_corpus(rng, 200)
    texts, labels = [t for t, _ in rows], [(i, 1, y) for i, (_, y) in enumerate(rows)]
    copy, passage, item = prose(rng, 400, 9000), prose(rng, 80, 9000), prose(rng, 30, 9000)
    near = copy.split()
    near[200] = "edited"
    texts += [copy, copy, " ".join(near), prose(rng, 90, 9000) + " " + passage, prose(rng, 90, 9000) + " " + passage + " " + prose(rng, 9, 9000), prose(rng, 40, 9000) + " " + item, None, "", ""]
    df = frame(spark, texts, extra=(("_text", "a"), ("component_id", "b"), ("_score", "c")))
    folder = saved(spark, tmp_path, documents=df, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs, kept = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == df.columns and docs.dtypes == df.dtypes
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i, _, y in labels if y}
    assert set(kept["toxicity"]) & set(range(200)) == set(range(200)) - toxic and set(range(200, 209)) <= set(kept["toxicity"])
    assert {200, 201, 202, 206, 207, 208} & set(kept["near_dedup"]) == {200, 206}
    assert set(kept["substring_dedup"]) == set(kept["near_dedup"])
    cut = kept["substring_dedup"][204]
    assert len(cut["text"].split()) == 99 and cut["n_chars"] == len(cut["text"]) and kept["substring_dedup"][203]["text"] == texts[203]
    assert set(kept["substring_dedup"]) - set(kept["decontamination"]) == {205}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept["decontamination"])
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
