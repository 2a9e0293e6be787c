"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to three bytes is counted on a bounded sample of labelled documents
(at most ``TRAIN_DOCS`` of each language and, of those in order of their id's hash, as many as hold ``TRAIN_BYTES``;
whole texts, A-Z lower-cased). A byte's probability in its longest known context is its count over count plus distinct
(method C); the escape share of a context is spread over the bytes it hasn't seen in proportion to the next shorter
context, seen bytes excluded, so each context's probabilities add up to 1. Statistics are frozen after fitting: the
code length of a text is a sum of table look-ups, the language is that of the shortest code, and the score is its
posterior under equal priors.

No gram or context of the sample is dropped: a language has a row of 256 code lengths for every context it has seen,
and reads the row of the longest shorter one elsewhere. So the tables grow with the sample, whose size is bounded for
each language, and not with the corpus. Any number of languages is told apart: ``GROUP`` of them make one model, so what
the driver builds and what is broadcast at once has a bound; with more languages the groups score one after the other
and a document's shortest code over all of them wins.

``bits_per_byte`` of the chosen language beside ``limit`` (``SLACK`` times a high quantile of the code lengths of held-back
sample texts of that language, each language by itself) tells text of no learned language from text of one. A language
without held-back texts of some length has no limit.

Defined results: ``und`` with score 0 for a null text, an empty one or one without a letter, or if no labelled row was
there to learn from. Ties go to the language first by name. Repeated rows each give a row; texts are never cut.
Columns that are already called ``lang_pred``, ``score`` or ``bits_per_byte`` are replaced by ``predict``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fold, keep, small_batches
from .text import _LOWER, chunks, column_bytes

TRAIN_DOCS = 1000
TRAIN_BYTES = 8 << 20
#: Languages of one model, some 6 MB of tables each.
GROUP = 40
#: Sampled ids are broadcast to the scan for their texts up to this many, else joined by shuffle.
BROADCAST_IDS = 200_000
#: One sampled text in so many is held back to learn how long codes of the language's own texts get.
HELD_BACK = 8
#: A text may take so many times this quantile of the held-back bits per byte before it counts as of no learned language.
SLACK, QUANTILE = 2.0, 0.95
#: Bytes from which on a text's bits per byte are steady enough to count.
STEADY = 64
#: Bytes of text scored at once.
CHUNK = 1 << 19
_PAD = 32  # stands before a text's first byte


@dataclass
class Model:
    """cost[row * 256 + byte] in bits; row[lang][node] of the node of the longest context, found by two look-ups."""

    langs: list[str]
    cost: np.ndarray
    row: np.ndarray
    pair_node: np.ndarray
    pair_row: np.ndarray
    triple_node: np.ndarray
    limit: np.ndarray  # lang -> most bits per byte of its own texts

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (rows, languages) of the texts."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.langs)))
        if not len(data):
            return out
        b = _LOWER[data].astype(np.int32)
        before = []
        for k in (1, 2, 3):
            p = np.full(len(b), _PAD, dtype=np.int32)
            p[k:] = b[:-k]
            for j in range(k):  # the first k bytes of a text have no byte k places before
                at = offsets[:-1] + j
                p[at[at < offsets[1:]]] = _PAD
            before.append(p)
        b2, b1, b0 = before
        node = self.pair_node[b1 * 256 + b2]
        deep = self.triple_node[self.pair_row[b0 * 256 + b1] * 256 + b2]
        node = np.where(deep >= 0, deep, node)
        full = np.flatnonzero(np.diff(offsets))
        for i, row in enumerate(self.row):
            at = row[node] * 256
            at += b
            out[full, i] = np.add.reduceat(self.cost[at], offsets[full], dtype=np.float64)
        return out


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch: a gram is three bytes of context and the byte that follows."""
    for batch in chunks(batches, "text", CHUNK):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, off = column_bytes(batch.column("text"))
        b = _LOWER[data].astype(np.int64)
        pad = np.full(3, _PAD, dtype=np.int64)
        for lang in sorted(set(langs)):
            parts = []
            for i in np.flatnonzero(langs == lang):
                t = np.concatenate([pad, b[off[i] : off[i + 1]]])
                parts.append(t[:-3] << 24 | t[1:-2] << 16 | t[2:-1] << 8 | t[3:])
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The tables from grams of the languages (lang: index into langs)."""
    count = len(langs)
    contexts = [np.unique((gram >> 8) & ((1 << 8 * order) - 1)) for order in range(4)]
    first = np.cumsum([0, *(len(x) for x in contexts)])
    row = np.zeros((count, first[-1]), np.int32)
    costs, rows = [], 0  # probabilities of all rows so far, order by order and language by language
    for order, nodes in enumerate(contexts):
        context = (gram >> 8) & ((1 << 8 * order) - 1)
        shorter = nodes & ((1 << 8 * max(order - 1, 0)) - 1)
        before = costs[0] if order else np.full((1, 256), 1 / 256, np.float32)
        if order:  # every shorter context of one that was seen was seen as well
            above = first[order - 1] + np.searchsorted(contexts[order - 1], shorter)
        for i in range(count):
            own = lang == i
            seen_at, place = np.unique(np.searchsorted(nodes, context[own]), return_inverse=True)
            c = np.zeros((len(seen_at), 256), dtype=np.float32)
            np.add.at(c, (place, gram[own] & 255), n[own])
            parent_row = row[i, above] if order else np.zeros(len(nodes), np.int32)
            parent = before[parent_row[seen_at]]
            total, seen = c.sum(axis=1, keepdims=True), c > 0
            distinct = seen.sum(axis=1, keepdims=True).astype(np.float32)
            left = np.where(seen, np.float32(0), parent)
            mass = left.sum(axis=1, keepdims=True)
            base = total + np.where(mass > 0, distinct, np.float32(0))
            left *= np.divide(distinct / base, mass, out=np.zeros_like(mass), where=mass > 0)
            c = np.where(seen, c / base, left)
            row[i, first[order] : first[order + 1]] = parent_row
            row[i, first[order] + seen_at] = rows + np.arange(len(seen_at))
            costs.append(c)
            rows += len(seen_at)
        costs = [np.concatenate(costs)]
    pair_node = np.zeros(65536, np.int32)
    one = np.zeros(256, np.int32)
    one[contexts[1]] = first[1] + np.arange(len(contexts[1]))
    pair_node[:] = np.tile(one, 256)
    pair_node[contexts[2]] = first[2] + np.arange(len(contexts[2]))
    heads, at = np.unique(contexts[3] >> 8, return_inverse=True)
    pair_row = np.full(65536, len(heads), np.int32)
    pair_row[heads] = np.arange(len(heads))
    triple_node = np.full((len(heads) + 1) * 256, -1, np.int32)
    triple_node[at * 256 + (contexts[3] & 255)] = first[3] + np.arange(len(contexts[3]))
    cost = costs[0]
    np.log2(cost, out=cost)
    np.negative(cost, out=cost)
    return Model(langs, cost.ravel(), row, pair_node, pair_row, triple_node, np.full(count, np.inf))


def sample_ids(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, doc_id) of the documents to learn from: of each language those of the smallest hash of their id.

    A hash threshold from the languages' counts thins the rows before the ordered window, so that it gets a few
    thousand rows a language from however many documents.
    """
    rows = docs.where("lang is not null and doc_id is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return rows.select("lang", "doc_id").limit(0)
    share = F.from_json(F.lit(json.dumps({r.lang: min(1.0, (3 * train_docs + 100) / r.n) for r in counts})), "map<string,double>")
    h = F.xxhash64("doc_id")
    few = rows.select("lang", "doc_id", h.alias("h"), F.octet_length("text").alias("bytes"))
    few = few.where((F.pmod(F.col("h"), F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h", "doc_id", "bytes")
    ranked = few.select("lang", "doc_id", F.row_number().over(order).alias("n"), F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return ranked.where((F.col("n") <= train_docs) & F.coalesce(F.col("before") < train_bytes, F.lit(True))).select("lang", "doc_id").distinct()


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, group: int = GROUP) -> list[Model]:
    """The models of the languages of docs (doc_id, text, lang), ``group`` languages each; rows with a null in any of them aren't used.

    Seven of eight sampled texts are counted into the trees that set ``limit`` by the eighth's code lengths; the trees
    that are returned count all of them.
    """
    ids = sample_ids(docs, train_docs)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = docs.where("text is not null").select("lang", "doc_id", "text").join(ids, ["lang", "doc_id"], "left_semi")
    back = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD_BACK)) == 0

    def counted(part: DataFrame) -> DataFrame:
        return small_batches(part).mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    both = counted(chosen.where(~back)).withColumn("part", F.lit(0)).unionByName(counted(chosen.where(back)).withColumn("part", F.lit(1)))
    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    if len(langs) > group:
        both = keep(both)
    out = []
    for at in range(0, len(langs), group):
        some = langs[at : at + group]
        own = F.lit(True) if len(langs) <= group else F.col("lang").isin(some)
        if model := _fit_group(both.where(own), chosen.where(back & own)):
            out.append(model)
    return out


def _fit_group(both: DataFrame, held_back: DataFrame) -> Model | None:
    grams = both.toArrow()  # as many as samples of bounded size of a group's languages have
    if not grams.num_rows:
        return None
    codes = grams.column("lang").combine_chunks().dictionary_encode()
    names = codes.dictionary.to_pylist()
    langs = sorted(names)
    rank = np.array([langs.index(x) for x in names])
    lang, gram, n = rank[codes.indices.to_numpy()], grams.column("gram").to_numpy(), grams.column("n").to_numpy()
    main = grams.column("part").to_numpy() == 0
    model = _fit(langs, lang, gram, n)
    learned = np.unique(lang[main])  # a language all of whose texts are held back has no limit, the others have theirs
    if len(learned):
        partial = _fit([langs[i] for i in learned], np.searchsorted(learned, lang[main]), gram[main], n[main])
        shared = both.sparkSession.sparkContext.broadcast(partial)

        def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in chunks(batches, "text", CHUNK):
                data, off = column_bytes(batch.column("text"))
                own = np.array([m.langs.index(x) for x in batch.column("lang").to_pylist()])
                size = np.diff(off)
                rate = m.bits(data, off)[np.arange(len(own)), own] / np.maximum(size, 1)
                use = size >= STEADY
                yield pa.RecordBatch.from_arrays([pa.array(own[use]), pa.array(rate[use])], names=["lang", "rate"])

        rows = held_back.where(F.col("lang").isin(partial.langs))
        held = small_batches(rows).mapInArrow(lengths, "lang long, rate double").groupBy("lang").agg(F.percentile("rate", QUANTILE).alias("rate")).collect()
        for r in held:
            model.limit[learned[r.lang]] = SLACK * r.rate
        shared.unpersist()
    return model


def _lettered(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)


def predict(docs: DataFrame, models: list[Model], text: str = "text") -> DataFrame:
    """docs with lang_pred string, score double and bits_per_byte double added; every whole text is scored.

    bits_per_byte is the code length a byte divided by the language's limit (``Model.limit``), so above 1 the text is
    none of that language; 0 under STEADY bytes or where the limit isn't known.
    """
    new = ["lang_pred", "score", "bits_per_byte"]
    docs = docs.drop(*new)
    if len(models) > 1:
        return _predict_by_group(docs, models, text)
    shared = docs.sparkSession.sparkContext.broadcast(models[0] if models else None)
    names = [*docs.columns, *new]
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, place, CHUNK):
            texts = batch.column(place)
            data, off = column_bytes(texts)
            lettered = _lettered(texts.to_pylist())
            if m is None:
                lettered[:] = False
            pred, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if lettered.any():
                best, _, rest, rate = _best(m, data, off)
                rate[~lettered] = 0
                score[lettered] = 1 / rest[lettered]
                for i in np.flatnonzero(lettered):
                    pred[i] = m.langs[best[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], names=names)

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")).schema
    return small_batches(docs).mapInArrow(run, schema)


def _best(m: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language of the shortest code, its bits, sum over languages of 2 ** (those bits - their bits), bits a byte over the limit)."""
    bits = m.bits(data, off)
    best, least = bits.argmin(axis=1), bits.min(axis=1)
    rest = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    size = np.diff(off)
    return best, least, rest, np.where(size >= STEADY, least / np.maximum(size, 1) / m.limit[best], 0.0)


def _predict_by_group(docs: DataFrame, models: list[Model], text: str) -> DataFrame:
    """``predict`` with several models: each scores all texts by itself, a row a text, and the rows are put together."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), F.struct("*").alias("doc")))
    parts = []
    for model in models:  # a job each, so that no worker holds the tables of two
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in chunks(batches, "text", CHUNK):
                data, off = column_bytes(batch.column("text"))
                best, least, rest, rate = _best(m, data, off)
                lettered = _lettered(batch.column("text").to_pylist())
                lang = pa.array([m.langs[i] if own else None for i, own in zip(best, lettered)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row"), lang, pa.array(least), pa.array(rest), pa.array(rate)], names=["row", "lang", "least", "rest", "rate"])

        parts.append(cut(small_batches(rows.select("row", "text")).mapInArrow(run, "row long, lang string, least double, rest double, rate double")))
        shared.unpersist()
    found = reduce(DataFrame.unionByName, parts).where("lang is not null")
    each = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("least", "lang", "rest", "rate"))).alias("m"))  # a row for each model
    first = F.col("m")[0]
    total = F.aggregate("m", F.lit(0.0), lambda s, x: s + x["rest"] * F.pow(F.lit(2.0), F.greatest(first["least"] - x["least"], F.lit(-1000.0))))
    chosen = each.select("row", first["lang"].alias("lang_pred"), (1 / total).alias("score"), first["rate"].alias("bits_per_byte"))
    joined = rows.select("row", "doc").join(chosen, "row", "left")
    return joined.select("doc.*", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("bits_per_byte", F.lit(0.0)).alias("bits_per_byte"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns where crc32(doc_id) mod 4 is not 2 and predicts every document."""
    held_out = fold("doc_id", 4) == 2
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    models = fit(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "lang_pred", "score")
