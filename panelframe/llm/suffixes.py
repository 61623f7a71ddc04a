"""Exact substring deduplication with two-stage suffix sorting.

Strings of 200 bytes that start more than once in the corpus (in one document or in several) mark
the bytes they cover. Candidate segments meet in shards (see recur.py); a shard sorts the suffixes of
its segments: the ones smaller than their successor directly, the others by induction in bucket
scans; neighbours with a common prefix of 200 bytes or more are repeats.

Null text counts as empty: zero bytes, the hash of nothing. Texts under 200 bytes lose nothing. Rows
with equal text are copies of each other, with the same doc_id too. Null doc_id is kept. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import covered
from .recur import Kind, Recurrence, equal_runs

LENGTH = 200
BYTES = Kind(words=False, window=LENGTH, anchor=64, own=True)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BLOCK = 400_000


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (and what their induction needs) in the order of their suffixes.

    text: uint16, 0 ends a segment and sorts first. Order is by at least the first `depth` units.
    """
    n = len(text)
    # Type B: smaller than the successor. Equal neighbours take the type of the first that differs.
    rising, falling = np.zeros(n, bool), np.zeros(n, bool)
    rising[:-1], falling[:-1] = text[:-1] < text[1:], text[:-1] > text[1:]
    rising |= text == 0
    falling &= ~rising
    decided = np.where(rising | falling, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = rising[decided]
    smaller[-1] = True
    next_b = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    need = np.zeros(n + 1, np.int64)
    np.add.at(need, wanted, 1)
    np.add.at(need, next_b[wanted] + 1, -1)
    need = np.cumsum(need[:-1]) > 0
    # Stage one: type B suffixes by direct comparison of bytes, up to the end of their segment.
    direct = np.flatnonzero(need & smaller)
    ends = np.flatnonzero(text == 0)
    stop = np.minimum(direct + depth, ends[np.searchsorted(ends, direct)])
    data = np.maximum(text, 1).astype(np.uint16) - 1
    data = data.astype(np.uint8).tobytes()
    keys = [data[a:b] for a, b in zip(direct.tolist(), stop.tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    firsts = text[direct]
    bounds = np.searchsorted(firsts, np.arange(258)) if (np.diff(firsts.astype(np.int64)) >= 0).all() else None
    if bounds is None:  # pragma: no cover
        raise AssertionError("direct order is broken")
    # Stage two: scan the buckets in order; what stands before a suffix and is larger goes next into its own bucket.
    larger = need & ~smaller
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    order: list[np.ndarray] = []

    def push(done: np.ndarray) -> None:
        before = done[done > 0] - 1
        before = before[larger[before]]
        first = text[before]
        at = np.argsort(first, kind="stable")
        before, first = before[at], first[at]
        for a, b in equal_runs(first):
            pending[first[a]].append(before[a:b])

    for c in range(257):
        while pending[c]:  # runs of c go on within the bucket
            layer, pending[c] = np.concatenate(pending[c]), []
            order.append(layer)
            push(layer)
        layer = direct[bounds[c] : bounds[c + 1]]
        if len(layer):
            order.append(layer)
            push(layer)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefix_reaches(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b share their first `length` bytes; eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 8,), (1,))
    left = np.arange(len(a))
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for k in steps:
        left = left[eight[a[left] + k] == eight[b[left] + k]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def repeated_windows(segments: list[tuple], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (content, windows, ..., count) which of its windows start elsewhere too."""
    sizes = np.array([len(x[0]) for x in segments])
    at = np.append(0, np.cumsum(sizes + 1))
    raw = np.frombuffer(b"\0".join(x[0] for x in segments) + b"\0", np.uint8)
    text = raw.astype(np.uint16) + 1
    text[at[1:] - 1] = 0
    n = np.array([x[1] for x in segments])
    first = np.append(0, np.cumsum(n))
    wanted = np.repeat(at[:-1] - first[:-1], n) + np.arange(first[-1])
    order = two_stage_order(text, wanted, length)
    rank = np.full(len(text), -1, np.int64)
    rank[wanted] = np.arange(len(wanted))
    order = order[rank[order] >= 0]
    same = common_prefix_reaches(raw, order[:-1], order[1:], length)
    twice = np.repeat(np.array([x[4] > 1 for x in segments]), n)
    twice[rank[order[:-1][same]]] = True
    twice[rank[order[1:][same]]] = True
    return np.split(twice, first[1:-1])


def _row(_: int | None, text: bytes, found: list[tuple]) -> tuple:
    gone = np.zeros(len(text), bool)
    starts = [s + np.flatnonzero(v) for s, v in found]
    if starts and len(at := np.concatenate(starts)):
        gone = covered(at, at + LENGTH, len(text))
    edges = np.diff(np.concatenate(([0], gone.astype(np.int8))))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs (doc_id, text)."""
    return Recurrence(docs, BYTES).run(repeated_windows, _row, SCHEMA, BLOCK)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
