"""Toxic spans and documents by a linear-chain conditional random field.

Labels are given by document. Tokens of toxic documents get the label 1 if they,
or their first letters, are found in several toxic documents and hardly ever in
others; these labelled tokens train the field. Forward-backward marginals give
each token's probability, spans are runs of likely tokens, and a logistic model
of the marginals of a document gives its score.

Training reads at most ``sample_rows`` labelled rows of either class (those of
least hash of the id) with texts of at most ``sample_bytes``; both bounds are
parameters. The logistic model weighs the classes by their numbers among all
labelled rows. Scoring covers every row and every token.

Edge cases: null and empty texts get the score of a document without tokens.
Without labelled rows of both classes no token is toxic and the score is the
share of toxic rows (0 if none). Labels that are null are ignored;
an id that is labelled more than once is toxic if one of its labels is. Rows are
kept one for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import crf
from marlstone.llm.shared import clash_free, discard, renamed, restored, settle
from marlstone.llm.words import SPACE_OR_MARK, U64, Words, find_words, mix, pair, pieces, prefix_hashes

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 16
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
SEGMENT = 128
LIKELY = 0.5
MARK_ODDS, MARK_DEVIATIONS = 3, 2.0
#: Marginals below this are not added up, so that the length of a text alone makes nothing toxic.
FAINT = 0.2


@dataclass
class Model:
    weights: np.ndarray
    chain: crf.Chain
    document: np.ndarray
    rate: float


def token_features(words: Words, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Weight numbers of the tokens ``at`` (all): the word, its first letters, and the words before and after."""
    names = words.hashes()
    around = np.zeros((2, len(names)), dtype=np.uint64)
    if len(names) > 1:
        around[0, 1:], around[1, :-1] = names[:-1], names[1:]
        inner = words.first[(words.first > 0) & (words.first < len(names))]
        around[0, inner], around[1, inner - 1] = 0, 0
    out = np.empty((len(PREFIXES) + 3, len(names[at])), dtype=np.int32)
    for i, kind in enumerate(chain([mix(names)], (prefix_hashes(words, n) for n in PREFIXES), (mix(around[i] + U64(11 + i)) for i in range(2)))):
        out[i] = (kind[at] >> U64(20)) % U64(BUCKETS)
    return out


def token_marginals(words: Words, weights: np.ndarray, links: crf.Chain) -> np.ndarray:
    scores = np.zeros(len(words.start), dtype=np.float32)
    for kind in token_features(words):
        scores += weights[kind]
    return crf.marginals(scores.astype(np.float64), first_tokens(words), links)


def first_tokens(words: Words) -> np.ndarray:
    out = np.zeros(len(words.start), dtype=bool)
    out[words.first[:-1][np.diff(words.first) > 0]] = True
    return out


def document_features(hot: np.ndarray, words: Words) -> np.ndarray:
    """By document: 1, the log of the expected number of toxic tokens that are not faint, its excess over one, the greatest marginal, the log of the length."""
    texts = len(words.first) - 1
    out = np.zeros((texts, 5))
    out[:, 0] = 1
    held = np.flatnonzero(np.diff(words.first) > 0)
    if len(held):
        total = np.add.reduceat(np.where(hot >= FAINT, hot, 0), words.first[held])
        out[held, 1] = np.log1p(total)
        out[held, 2] = np.clip(total - 1, 0, 2)
        out[held, 3] = np.maximum.reduceat(hot, words.first[held])
        out[held, 4] = np.log1p(np.diff(words.first)[held]) / 10
    return out


def unlike(words: Words) -> np.ndarray:
    """Texts that share no minimal hash of word pairs with an earlier one: one of each group of copies."""
    names = words.hashes()
    seen: set[tuple[int, int]] = set()
    keep = np.ones(len(words.first) - 1, dtype=bool)
    both = pair(names[:-1], names[1:]) if len(names) > 1 else names[:0]
    for i in range(len(keep)):
        own = both[words.first[i] : max(words.first[i], words.first[i + 1] - 1)]
        if len(own):
            marks = {(s, int(mix(own + U64(s)).min())) for s in range(1, 4)}
            keep[i] = not (marks & seen)
            seen |= marks
    return keep


def toxic_tokens(words: Words, toxic: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Token labels: in toxic documents, words or first letters that mark toxic documents.

    A mark is found in toxic documents at odds that are surely above MARK_ODDS: by
    MARK_DEVIATIONS standard deviations of their logarithm.
    """
    text = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(words.first))
    use = np.flatnonzero(counted[text])
    odds_of = lambda p, n: np.log((p + 0.5) / (toxic[counted].sum() + 1)) - np.log((n + 0.5) / ((~toxic[counted]).sum() + 1))
    out = np.zeros(len(text), dtype=np.int8)
    for size in (None, *PREFIXES[1:]):
        kind = words.hashes() if size is None else prefix_hashes(words, size)
        known = np.unique(kind[use])
        once = np.unique(np.searchsorted(known, kind[use]) * len(toxic) + text[use])
        of, where = once // len(toxic), once % len(toxic)
        hits = np.bincount(of, weights=toxic[where], minlength=len(known))
        misses = np.bincount(of, minlength=len(known)) - hits
        spread = np.sqrt(1 / (hits + 0.5) + 1 / (misses + 0.5))
        marks = known[odds_of(hits, misses) - MARK_DEVIATIONS * spread > np.log(MARK_ODDS)]
        out |= toxic[text] & np.isin(kind, marks)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.3 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.3 * w)
    return w


def train(texts: pa.Array, toxic: np.ndarray, rate: float, seed: int = 5) -> Model:
    """``rate``: the share of toxic rows among all labelled ones."""
    blank = Model(np.zeros(BUCKETS, dtype=np.float32), crf.Chain(np.zeros(2), np.zeros((2, 2))), np.zeros(5), rate)
    if not 0 < toxic.sum() < len(toxic):
        return blank
    words = find_words(texts, lower=True, gaps=SPACE_OR_MARK)
    if not len(words.start):
        return blank
    labels = toxic_tokens(words, toxic, unlike(words))
    first = first_tokens(words)
    place = np.arange(len(first)) - np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    begins = np.flatnonzero(place % SEGMENT == 0)
    hits = np.add.reduceat(labels, begins, dtype=np.int64)
    rng = np.random.default_rng(seed)
    marked, rest = np.flatnonzero(hits > 0), np.flatnonzero(hits == 0)
    chosen = np.sort(np.concatenate([marked, rng.permutation(rest)[: max(2000, len(marked))]]))
    ends = np.append(begins[1:], len(first))
    at = np.concatenate([np.arange(begins[i], ends[i]) for i in chosen])
    starts = np.zeros(len(first), dtype=bool)
    starts[begins[chosen]] = True
    weights, links = crf.fit(token_features(words, at), labels[at], starts[at], BUCKETS)
    weights = weights.astype(np.float32)
    found = []
    for part in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
        own = find_words(part.column(0), lower=True, gaps=SPACE_OR_MARK)
        found.append(document_features(token_marginals(own, weights, links), own))
    weight = np.where(toxic, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
    return Model(weights, links, fit_logistic(np.concatenate(found), toxic.astype(float), weight), rate)


def held_out(ident: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_toxicity(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    known = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(F.col(f"`{label_col}`")).alias("_toxic"))
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    known = known.where(~held_out(F.col("_id"))).select(F.col("_id").alias("_of"), (F.col("_toxic") > 0).alias("_toxic"))
    numbers = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    texts = df.where(~held_out(ident) & (F.octet_length(text) <= sample_bytes)).select(ident.alias("_id"), text.alias("_text"))
    # ids of labelled texts that are there are sampled first, so that no text but theirs is moved; their number is bounded
    present = settle(texts.select("_id").distinct().join(known, F.col("_id") == F.col("_of")).select("_of", "_toxic"), "labelled")
    parts = []
    for kind in (False, True):
        chosen = present.where(F.col("_toxic") == kind).orderBy(F.xxhash64("_of", F.lit(3)), "_of").limit(sample_rows)
        some = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_of")).orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(sample_rows)
        parts.append(some.select("_text").toArrow().column(0).cast(pa.large_string()).combine_chunks())
    discard(present)
    toxic = np.repeat([False, True], [len(p) for p in parts])
    return train(pa.concat_arrays(parts), toxic, numbers.get(True, 0) / max(1, sum(numbers.values())))


@clash_free
def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``keep`` columns (default: all) of every row with ``_score`` and, if ``spans``, ``_spans``: start, end (characters), probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in pieces(whole, "_text"):
                words = find_words(batch.column(batch.schema.get_field_index("_text")), lower=True, gaps=SPACE_OR_MARK)
                hot = token_marginals(words, model.weights, model.chain)
                if model.document.any():
                    odds = document_features(hot, words) @ model.document
                    result = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                else:
                    result = np.full(batch.num_rows, model.rate)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(result)]
                names = [*keep, "_score"]
                if spans:
                    columns.append(likely_spans(words, hot))
                    names.append("_spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    more = ", _spans array<struct<start:int,end:int,probability:double>>" if spans else ""
    return rows.mapInArrow(run, (fields + ", " if fields else "") + "_score double" + more)


def without_toxic(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``df`` that score below the threshold."""
    plain, names = renamed(df)
    return restored(score(plain, model, text_col=names[text_col], spans=False).where(F.col("_score") < threshold), names)


def likely_spans(words: Words, hot: np.ndarray) -> pa.Array:
    """Runs of tokens with a marginal of at least LIKELY, by text, in character offsets."""
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    likely = np.flatnonzero(hot >= LIKELY)
    text = np.searchsorted(words.first, likely, side="right") - 1
    last = (-2, -2)
    for token, t in zip(likely.tolist(), text.tolist()):
        low = int(words.text_start[t])
        if last == (t, token - 1):
            span = out[t][-1]
            span["end"] = span["start"] + len(words.data[span["_at"] : words.end[token]].decode(errors="replace"))
            span["probability"] = max(span["probability"], float(hot[token]))
        else:
            a, b = int(words.start[token]), int(words.end[token])
            before = out[t][-1] if out[t] else {"_at": low, "start": 0}
            start = before["start"] + len(words.data[before["_at"] : a].decode(errors="replace"))
            out[t].append({"_at": a, "start": start, "end": start + len(words.data[a:b].decode(errors="replace")), "probability": float(hot[token])})
        last = (t, token)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
    return pa.array([[{k: s[k] for k in ("start", "end", "probability")} for s in spans] for spans in out], kind)
