"""Repetition coverage: how much of a text lies inside repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths are taken over the words of many texts at once; a hash is
salted with its text, so one sort finds the repeats of every text of a block.

Null or empty text: no words, all measures 0, base_failed true, kept false. Null doc_id stays null.
Repeated rows are measured independently. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import SPACE_BYTES, U64, gram_hashes, mix, span_hashes, word_spans
from .common import blocks, byte_texts, covered, laid, per_doc

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
#: Largest share of a text's word characters inside n-grams that occur twice or more, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines equal to an earlier line, and of such lines.
LINE_CHAR_LIMIT, LINE_LIMIT = 0.20, 0.30
MIN_WORDS, BASE_REPEAT_PERCENT = 50, 50
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
)


def _repeats(h: np.ndarray) -> np.ndarray:
    """Which elements have an equal elsewhere."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(h) else False
    return out


def _later(h: np.ndarray) -> np.ndarray:
    """Which elements have an equal before them."""
    _, first = np.unique(h, return_index=True)
    out = np.ones(len(h), bool)
    out[first] = False
    return out


def measure(texts: list[bytes | None], lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """All measures of a block of texts, an array element for each text."""
    buf, at = laid(texts)
    n = len(texts)
    begins = (buf & 0xC0) != 0x80
    starts, ends = word_spans(buf)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(begins & ~SPACE_BYTES[buf], out=chars[1:])
    word_at = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(n), np.diff(word_at))
    salt = mix(np.arange(1, n + 1).astype(U64))
    words = span_hashes(buf, starts, ends)
    word_len = chars[ends] - chars[starts]
    out = {
        "n_words": np.diff(word_at),
        "word_chars": np.diff(chars[at]),
        "n_symbols": per_doc(SYMBOLS[buf], at),
    }

    def inside(k: int) -> np.ndarray:
        grams = gram_hashes(words, k)
        own = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
        where = np.flatnonzero(own)
        where = where[_repeats(grams[where] ^ salt[doc[where]])]
        return covered(where, where + k, len(words))

    out["n_repeat_words"] = per_doc(inside(3), word_at)
    for k in lengths:
        out[f"dup_{k}gram_chars"] = per_doc(np.where(inside(k), word_len, 0), word_at)
    line_end = np.flatnonzero(buf == 0x0A)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    line_doc = np.searchsorted(at, line_start, "right") - 1
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    later = _later(span_hashes(buf, line_start, line_end) ^ salt[line_doc])
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc, np.where(later, chars[line_end] - chars[line_start], 0), n).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["word_chars"]) & (m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"])
    for k, limit in NGRAM_LIMITS.items():
        kept &= m[f"dup_{k}gram_chars"] <= limit * m["word_chars"]
    return failed, kept


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        for a, b in blocks(texts):
            m = measure(texts[a:b])
            m["base_failed"], m["kept"] = verdicts(m)
            columns = [batch.column("doc_id").slice(a, b - a)]
            columns += [pa.array(m[x] if m[x].dtype == bool else m[x].astype(np.int64)) for x in names[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def repetition_coverage(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, characters inside repeats, and the verdict.

    A map over partitions: no shuffle, memory bounded by a block of texts (or one long text).
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_batches, SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(spark.read.parquet(f"{sf_dir}/documents.parquet"))
