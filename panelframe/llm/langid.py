"""Language mixtures: expectation-maximisation over n-gram likelihoods.

Each word of a text is one draw from a mixture of languages; a language gives a word the product of
its byte-trigram probabilities. EM estimates the language proportions of each text; of the nested
sets of the most likely languages the one with the best penalised likelihood is taken.

Null text, or one without a letter: `und`, score 0. Null or unknown labels are not learned from. With no labelled row every
text is `und`. Ties go to the language that sorts first. Repeated rows are judged independently. Very long texts are judged whole.
An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import word_spans
from .common import blocks, byte_texts, discard, laid, staged
from .recur import pack, unpack

#: Hashed trigram space; labelled rows learned from (the least by hash of their id and text).
BUCKET_BITS, TRAIN_ROWS = 15, 8000
#: What one more language must gain in log-likelihood, times log of the words.
PENALTY, EM_STEPS = 1.5, 7
#: Least proportion in the full mixture with which a language may join a set.
MIN_SHARE = 0.02
#: Bytes that part words here: all but ASCII letters, the apostrophe and non-ASCII.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
ASCII_LETTER = re.compile(rb"[A-Za-z]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string, proportions array<double>"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: log-probability of each trigram bucket, by language.
    logs: np.ndarray


def _trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets, the word of each, and where each text's words start (with the end last)."""
    buf, at = laid(texts)
    buf = LOWER[buf]
    starts, ends = word_spans(buf, NOT_LETTER)
    # Words are laid anew with one blank before and after, so a trigram sees a word's borders.
    inside = ~NOT_LETTER[buf]
    inside[1:] |= inside[:-1]
    kept = buf[inside]
    kept = np.where(NOT_LETTER[kept], np.uint8(32), kept)
    padded = np.concatenate((np.full(1, 32, np.uint8), kept)).astype(np.uint32)
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    grams = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    lengths = ends - starts
    # A word of n bytes has n trigrams: they are those that start at its blank and at its bytes but the last.
    first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    word_at = np.searchsorted(starts, at)
    return grams, first, lengths, word_at


def _word_grams(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(first, lengths) + offset


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for a, b in blocks(texts):
        grams, first, lengths, _ = _trigrams(texts[a:b])
        if len(lengths):
            counts += np.bincount(grams[_word_grams(first, lengths)], minlength=1 << BUCKET_BITS)
    return counts


def model_of(counts: dict[str, np.ndarray]) -> LanguageModel:
    languages = tuple(sorted(counts))
    smooth = np.array([counts[x] + 0.5 for x in languages]).reshape(len(languages), 1 << BUCKET_BITS)
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))


def train(texts: list[bytes], labels: list[str]) -> LanguageModel:
    return model_of({x: trigram_counts([t for t, y in zip(texts, labels, strict=True) if y == x]) for x in set(labels)})


def _em(like: np.ndarray, doc: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of each text; like: (words, languages); allowed: (texts, languages)."""
    n_words = np.maximum(np.diff(at), 1)[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    full = np.flatnonzero(np.diff(at))
    for step in range(EM_STEPS + 1):
        joint = like * share[doc]
        total = joint.sum(axis=1)
        if step == EM_STEPS:
            break
        joint /= total[:, None]
        new = np.zeros_like(share)
        new[full] = np.add.reduceat(joint, at[full], axis=0)
        share = new / n_words
    logs = np.zeros(len(share))
    logs[full] = np.add.reduceat(np.log(total), at[full])
    return share, logs


def predict(model: LanguageModel, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Predicted language, its proportion, the chosen set and all proportions, for each text."""
    n, k = len(texts), len(model.languages)
    grams, first, lengths, at = _trigrams(texts)
    if k == 0 or not len(lengths):
        return ["und"] * n, np.zeros(n), [""] * n, np.zeros((n, k))
    sums = np.zeros((len(grams) + 1, k))
    np.cumsum(model.logs.T[grams], axis=0, dtype=np.float64, out=sums[1:])
    word = sums[first + lengths] - sums[first]
    best = word.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(word - best, -50))
    doc = np.repeat(np.arange(n), np.diff(at))
    share, _ = _em(like, doc, at, np.ones((n, k)))
    order = np.argsort(-share, axis=1, kind="stable")
    ranked = np.take_along_axis(share, order, axis=1)
    chosen = np.zeros((n, k))
    np.put_along_axis(chosen, order[:, :1], 1.0, axis=1)
    full = np.flatnonzero(np.diff(at))
    value = np.zeros(n)
    value[full] = np.add.reduceat(np.log(like[np.arange(len(doc)), order[doc, 0]]), at[full])
    for m in range(2, k + 1):
        some = np.flatnonzero(ranked[:, m - 1] >= MIN_SHARE)  # only these can use so many languages
        if not len(some):
            break
        sizes = np.diff(at)[some]
        own = np.concatenate(([0], np.cumsum(sizes)))
        rows = np.repeat(at[:-1][some] - own[:-1], sizes) + np.arange(own[-1])
        allowed = np.zeros((len(some), k))
        np.put_along_axis(allowed, order[some, :m], 1.0, axis=1)
        part, logs = _em(like[rows], np.repeat(np.arange(len(some)), sizes), own, allowed)
        logs = logs - PENALTY * (m - 1) * np.log(np.maximum(sizes, 2))
        better = logs > value[some]
        chosen[some[better]], value[some[better]] = part[better], logs[better]
    top = chosen.argmax(axis=1)
    has = np.diff(at) > 0
    for i in np.flatnonzero(has):  # a text of non-ASCII signs alone may have no letter, however long it is
        if not ASCII_LETTER.search(texts[i]) and not any(c.isalpha() for c in texts[i].decode("utf-8", "replace")):
            has[i] = False
    langs = [model.languages[j] if ok else "und" for j, ok in zip(top, has, strict=True)]
    sets = ["+".join(model.languages[j] for j in order[i] if chosen[i, j] > 0) if has[i] else "" for i in range(n)]
    return langs, np.where(has, np.clip(chosen.max(axis=1), 0, 1), 0.0), sets, np.where(has[:, None], chosen, 0.0)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learns from text and lang of the train_rows labelled rows with the least hash of doc_id and text.

    Rows are counted first, so that only those below a bound on the hash, about twice as many as wanted, are sorted;
    should many rows be alike and the bound leave too few, it is raised. Trigrams are counted by the executors; the driver gets
    the counts of each language that are not zero.
    """
    labelled = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    share = 2 * train_rows / max(labelled.count(), 1)
    while True:
        low = labelled if share >= 1 else labelled.where(F.col("h") < int(-(2.0**63) + share * 2.0**64))
        sample = staged(low.orderBy("h", "lang").limit(train_rows), "labelled")
        if share >= 1 or sample.count() == train_rows:
            break
        discard(sample)
        share *= 4

    def count(table: pa.Table) -> pa.Table:
        counts = trigram_counts(byte_texts(table.column("text").combine_chunks()))
        at = np.flatnonzero(counts)
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([pack(at.astype(np.int32), counts[at])], pa.binary())})

    counts = {}
    for r in sample.select("lang", "text").groupBy("lang").applyInArrow(count, "lang string, counts binary").collect():
        at, found = unpack(bytes(r["counts"]))
        counts[r["lang"]] = np.bincount(at, found, 1 << BUCKET_BITS)
    discard(sample)
    return model_of(counts)


def language_mixture(docs: DataFrame, model: LanguageModel, also: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred, score, languages and proportions to each row of docs (doc_id, text, held_out); columns in `also` go along unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(StructType.fromDDL(SCHEMA).fields + docs.select(*also).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for a, b in blocks(texts):
                langs, score, sets, shares = predict(shared.value, texts[a:b])
                columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")]
                columns += [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string()), pa.array(shares.tolist(), pa.list_(pa.float64()))]
                columns += [batch.column(c).slice(a, b - a) for c in also]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions", *also])

    others = [c for c in also if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", *others).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    return language_mixture(docs, fit(docs.where("not held_out")))
