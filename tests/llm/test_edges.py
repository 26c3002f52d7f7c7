"""Awkward tables for every operator: clashing names, repeated rows, null ids, empty tables; and what only larger inputs reach."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import ann, decontamination, language_model, packing, registry, sharding, shared, simhash, substring_dedup, toxicity, url_filter
from marlstone.llm.words import find_words, shingle_hashes
from tests.llm.test_documents import SCHEMA, corpus, frame, prose, saved, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ("_text", "_id", "_hash", "_leaks", "_score", "_print", "_ones", "_of", "_one", "c0", "c1", "size", "score", "shard", "component_id", "_start", "_new_text")


@pytest.fixture(scope="module")
def awkward(spark):
    """Columns that operators use themselves, null ids and repeated rows."""
    rng = random.Random(3)
    line = prose(rng, 60)
    texts = [None, "", "one two", line, line + " tail", line, prose(rng, 300), prose(rng, 300)]
    texts += texts[3:7]
    return frame(spark, texts, [0, 1, 2, 3, 4, None, 6, None, 3, 4, None, 6], extra=tuple((c, "x") for c in CLASHES)).cache()


def test_clashing_columns(spark, awkward):
    bench = spark.createDataFrame([(1, prose(random.Random(5), 20))], "item_id long, text string")
    model = language_model.train(awkward)
    toxic = toxicity.fit_toxicity(awkward, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    added = {
        "score": (toxicity.score(awkward, toxic), {"_score", "_spans"}),
        "perplexity": (language_model.score(awkward, model), {"_n_tokens", "_n_known", "_base_score", "_score"}),
        "near": (simhash.near_duplicates(awkward), {"_print", "component_id"}),
        "repeats": (substring_dedup.without_repeats(awkward), {"_new_text", "_n_words", "_n_removed", "_kept_sha256"}),
        "leaks": (decontamination.find_leaks(awkward, bench), {"_leaks"}),
        "many_leaks": (decontamination.find_leaks(awkward, bench.union(bench.selectExpr("2L", "reverse(text)")), piece_words=5), {"_leaks"}),
    }
    for name, (out, new) in added.items():
        assert len(set(out.columns)) == len(out.columns) and set(out.columns) == set(awkward.columns) | new, name
        kept = [c for c in awkward.columns if c not in new]
        assert Counter(map(tuple, out.select(*kept).collect())) == Counter(map(tuple, awkward.select(*kept).collect())), name
    packed = packing.pack_tiers(awkward, PATH, keep=["doc_id", "_id", "c0", "_start"])
    assert packed.columns == ["doc_id", "_id", "c0", "_start", "_length", "_ids", "_doc_tokens", "_sequence_id", "_offset", "_tier", "_step"]
    assert len(packed.collect()) >= 12
    assert packing.pack_best_fit(awkward.withColumnRenamed("doc_id", "ids"), PATH, id_col="ids").count() >= 1
    for out in (simhash.deduplicate(awkward), substring_dedup.deduplicate(awkward), decontamination.decontaminate(awkward, bench), toxicity.without_toxic(awkward, toxic)):
        assert out.columns == awkward.columns and out.count() <= 12
    sized = sharding.shard(awkward.drop("size").withColumnRenamed("doc_id", "size"), 3, id_col="size")
    assert sized.columns == ["id", "size", "text_crc32", "shard", "slot"] and sized.count() == 12
    marked = url_filter.mark_listed(awkward, F.col("text"), spark.createDataFrame([("one two",)], "key string"), flag="c0")
    assert set(marked.columns) == set(awkward.columns) and marked.where("c0").count() == 1
    vectors = awkward.select("*", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    assert ann.nearest(vectors, F.lit(True), id_col="doc_id", k=2).columns == ["query_id", "rank", "doc_id", "score"]


def test_shingles():
    texts = corpus() + ["a b c d", "a b c d e", None]
    hashes, first = shingle_hashes(find_words(pa.array(texts, pa.string()), lower=True), 5)
    seen = {}
    for i, t in enumerate(texts):
        w = words_of(t, lower=True)
        want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(own) == len(want) and all(seen.setdefault(s, h) == h for s, h in zip(want, own))
    assert len(set(seen.values())) == len(seen)


def test_standard_shingles():
    rng = random.Random(1)
    texts = corpus() + [" ".join("w" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    for size in (1, 4):
        for some in (texts, [None, ""], ["a  b"]):
            hashes, first = simhash.standard_shingles(pa.array(some, pa.string()), size)
            for i, t in enumerate(some):
                w = words_of(t, lower=True)
                want = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))] if w else []
                assert hashes[first[i] : first[i + 1]].tolist() == want


def test_votes_of_long_texts():
    rng = np.random.default_rng(2)
    first = np.cumsum([0, 0, 1, 254, 255, 256, 1500])
    hashes = rng.integers(0, 1 << 63, first[-1], dtype=np.uint64) << np.uint64(1)
    got = simhash.votes(hashes, first, 1)[:, 0]
    for a, b, one in zip(first, first[1:], got.tolist()):
        assert one == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in hashes[a:b]) > b - a)


def test_repeated_rows_are_judged_once(spark):
    """Spans of a text do not grow with its copies."""
    rng = random.Random(2)
    line = prose(rng, 70)
    texts = [line + " " + prose(rng, 40), prose(rng, 30) + " " + line + " " + prose(rng, 60)]
    sizes = []
    for copies in (1, 40):
        df = frame(spark, [texts[0]] + [texts[1]] * copies, [1] + [2] * copies)
        cuts = substring_dedup.repeats(df, "doc_id", "text", 50).collect()
        sizes.append((len(cuts), sum(len(r["_cuts"]) for r in cuts)))
        out = substring_dedup.without_repeats(df, keep=["doc_id"]).collect()
        assert Counter((r["doc_id"], r["_n_removed"]) for r in out) == {(1, 0): 1, (2, 70): copies}
    assert sizes[0] == sizes[1]


def brute_leaks(text, item, least=13):
    """Whether some stretch of an alignment of ``least`` words or the whole item has 80 % equal words."""
    strip = lambda t: ["".join(c for c in w) for w in "".join(c if c.isalnum() or ord(c) > 126 else " " for c in (t or "").lower()).split()]
    d, b = strip(text), strip(item)
    n = min(least, len(b))
    for shift in range(-len(b) + 1, len(d)):
        low, high = max(0, -shift), min(len(b), len(d) - shift)
        same = [d[shift + k] == b[k] for k in range(low, high)]
        total = np.concatenate([[0], np.cumsum(same)])
        for size in range(n, len(same) + 1):
            if n and ((total[size:] - total[:-size]) >= 0.8 * size - 1e-9).any():
                return True
    return False


@pytest.mark.parametrize("piece", [1 << 20, 60])
def test_leaks_against_brute_force(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(decontamination.find_leaks.__wrapped__, "__kwdefaults__", decontamination.find_leaks.__wrapped__.__kwdefaults__ | {"piece_words": piece})
    rng = random.Random(piece)
    items = [prose(rng, n, 9000) for n in (1, 2, 3, 5, 7, 8, 9, 11, 13, 15, 16, 20, 33, 40)] + [None, "", "?!"]
    texts = [None, "", prose(rng, 100, 9000)]
    for item in items[:14]:
        for share in (0, 0.1, 0.2, 0.25):
            copy = [w if rng.random() > share else "swapped" for w in item.split()]
            a = rng.randrange(0, max(1, len(copy) - 14)) if share == 0.1 else 0
            texts.append(prose(rng, rng.randrange(20), 9000) + " " + ", ".join(copy[a:]) + " " + prose(rng, rng.randrange(20), 9000))
    texts += texts[5:7]
    ids = list(range(len(texts) - 2)) + [5, None]
    folder = saved(spark, tmp_path, documents=frame(spark, texts, ids), benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = Counter((r["doc_id"], r["item_id"]) for r in registry.op2_spaced_seeds(spark, folder).collect())
    want = Counter((i, k) for i, t in zip(ids, texts) for k, item in enumerate(items) if item and brute_leaks(t, item))
    assert got == want


def test_best_fit_query(spark, tmp_path):
    """The digests of the registered query are those of the library's ids in the places it names."""
    real = Tokenizer.from_file(PATH)
    texts = corpus() + ["word " * 5000, "a <|endoftext|> b"] + corpus()[:2]
    ids = list(range(len(texts)))
    own = {i: [*real.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(ids, texts)}
    seen = defaultdict(list)
    for r in registry.op5_best_fit_packing(spark, saved(spark, tmp_path, documents=frame(spark, texts, ids).repartition(2))).collect():
        row, positions = np.zeros(2048, dtype="<u4"), np.zeros(2048, dtype="<u4")
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 2048
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["doc_starts"]):
            row[a:b], positions[a:b] = own[doc][start : start + b - a], np.arange(b - a)
            seen[doc] += range(start, start + b - a)
        assert r["ids_crc32"] == zlib.crc32(row.tobytes()) and r["position_ids_crc32"] == zlib.crc32(positions.tobytes())
    assert {i: sorted(v) for i, v in seen.items()} == {i: list(range(len(v))) for i, v in own.items()}


def test_sample_is_drawn_from_what_is_there(spark):
    """Labels of documents that are not there, or are null, leave the sample to others."""
    rng = random.Random(4)
    texts = [None] * 40 + [prose(rng, 30, 2000) + (" glorb snarkle" if i % 2 else "") for i in range(260)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5000, 7000)] + [(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(spark, texts), labels, sample_rows=100)
    clean = prose(rng, 30, 2000)
    out = toxicity.score(frame(spark, [clean + " glorb snarkle", clean]), model, keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["_score"] >= 0.5 for r in out} == {0: True, 1: False}


def test_pipeline_of_awkward_tables(spark, tmp_path):
    rng = random.Random(2)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, texts, ids in (("none", [], []), ("nulls", [None, None, "", "a b", prose(rng, 80), prose(rng, 80)], [None] * 4 + [1, 1])):
        folder = saved(spark, tmp_path / name, documents=frame(spark, texts, ids), labels=labels, benchmark=bench)
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() >= min(1, len(texts))


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Fake:
        master = "spark://host:7077"

    class Session:
        sparkContext = Fake()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
    df = shared.settle(spark.range(3), "x")
    assert df.count() == 3 and spark.createDataFrame([], SCHEMA).count() == 0
    shared.discard(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.settled_at).count()
