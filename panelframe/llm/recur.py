"""Finds strings of a fixed number of units (words or bytes) that recur anywhere in a corpus.

Texts are dealt once into groups by a hash of the row and kept as a table bucketed by group; every later pass reads
that table and joins small packed messages to it, so a text is shuffled once.

1. Anchors. Each window of W units chooses the least k-unit hash inside it. Equal windows choose equal
   anchors, so an anchor hash that a corpus holds once rules its windows out. Groups send their distinct anchor
   hashes to buckets; buckets tell which occur again.
2. Common anchors (in more than COMMON groups) stand in many different contexts. Their windows are
   looked up one by one, by a hash of the whole window, in the same way. Only windows that recur
   are left, and these are alike wherever they occur, so no bucket gathers all the contexts.
3. Segments: runs of windows that share an anchor and may recur. Each distinct segment of a group
   goes to the shard of its anchor, with its counts; equal windows always meet in one shard.
4. A shard decides by exact comparison and answers each group (the operators differ here).
5. Groups apply the answers to their texts.

A text is held whole by the task of its group, however long; numpy work on it goes in rounds of CUT windows. An empty table
gives empty tables in every pass.

Every group, bucket and shard has a size set by spark.sql.shuffle.partitions; a lost executor costs the
recomputation of its groups, as every pass is deterministic in the rows of a group.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_HASH, U64, gram_hashes, span_hashes, window_anchors, word_spans
from .common import blocks, bucketed, byte_texts, discard, laid, shuffle_partitions, staged

COMMON = 24
#: Windows looked at in one round of numpy calls; a longer text is cut, with overlap.
CUT = 1 << 19
#: Bytes of short texts handled in one round: arrays of eight bytes for each stay in the cache.
ROUND = 1 << 17
ONE = U64(1)
#: What keys are sent as. Hashes of whole windows go with their low half only: buckets are chosen by the high half, and a clash
#: merely adds a candidate, which the exact comparison drops.
ANCHOR_KEY, WINDOW_KEY = np.dtype("<u8"), np.dtype("<u4")
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Kind:
    """What a unit is (bytes or words), units in a window, units in an anchor."""

    words: bool
    window: int
    anchor: int
    #: Whether recurrence inside one document counts.
    own: bool


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed cell: a JSON head with kinds and sizes, then the raw bytes."""
    head = json.dumps([["", len(x)] if isinstance(x, bytes) else [x.dtype.str, *x.shape] for x in parts]).encode()
    body = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return zlib.compress(len(head).to_bytes(4, "little") + head + body, 1)


def unpack(data: bytes) -> tuple:
    data = zlib.decompress(data)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for kind, *shape in json.loads(data[4:at]):
        if kind:
            x = np.frombuffer(data, np.dtype(kind), int(np.prod(shape)), at).reshape(shape)
            at += x.nbytes
        else:
            x = data[at : at + shape[0]]
            at += shape[0]
        out.append(x)
    return tuple(out)


@dataclass
class Rows:
    """A group's rows in a fixed order. ids: null as the largest."""

    ids: list
    order_ids: np.ndarray
    texts: list


def rows_of(table: pa.Table) -> Rows:
    ids = table.column("doc_id").to_pylist()
    texts = [t or b"" for t in byte_texts(table.column("text").combine_chunks())] if table.num_rows else []
    order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    return Rows(ids, np.array([NO_ID if x is None else x for x in ids], np.int64), texts)


def units_of(kind: Kind, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit hashes of the texts end to end, and where each text's units begin and end."""
    buf, at = laid(texts)
    if not kind.words:
        return BYTE_HASH[buf], at[:-1], at[1:] - 1
    starts, ends = word_spans(buf)
    word_at = np.searchsorted(starts, at)
    return span_hashes(buf, starts, ends), word_at[:-1], word_at[1:]


def anchor_runs(kind: Kind, units: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: text, first window (in units), windows, anchor hash."""
    w, out = kind.window, []
    for cut in range(0, max(0, len(units) - w + 1), CUT):
        part = units[cut : cut + CUT + w - 1]
        grams = gram_hashes(part, kind.anchor)
        least = window_anchors(grams, w - kind.anchor + 1)
        at = np.arange(cut, cut + len(least))
        text = np.searchsorted(begin, at, "right") - 1
        # Of empty texts at one position the last has what follows, as searchsorted gives it.
        valid = at + w <= end[text]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        if len(first):
            stop = np.minimum(np.append(first[1:], len(least)) + cut, end[text[first]] - w + 1)
            out.append((text[first], first + cut, stop - first - cut, grams[least[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distinct(kind: Kind, keys: np.ndarray, texts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distinct keys with the lowest bit telling whether the group itself holds them twice."""
    keys = keys & ~ONE
    if not kind.own:  # once for each document id
        order = np.lexsort((ids[texts], keys))
        k, d = keys[order], ids[texts][order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        keys = k[new]
    found, count = np.unique(keys, return_counts=True)
    return found | (count > 1).astype(U64)


def equal_runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(values):
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    which = ((keys >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    keys, which = keys[order], which[order]
    for a, b in equal_runs(which):
        yield int(which[a]), keys[a:b]


def _answer(table: pa.Table, kind_of_answer: int, sent_as: np.dtype) -> pa.Table:
    """A bucket: for each group its keys that occur again; the lowest bit says that a key is common."""
    groups, packs = table.column("g").to_pylist(), [np.frombuffer(x, sent_as).astype(U64) for x in table.column("payload").to_pylist()]
    every = np.sort(np.concatenate(packs) if packs else np.zeros(0, U64))
    bare = every & ~ONE
    first = np.flatnonzero(np.append(True, bare[1:] != bare[:-1])) if len(bare) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(bare)))
    last = first + count - 1
    again = (count > 1) | ((every[last] & ONE) == ONE)
    known, common = bare[first][again], (count[again] > COMMON).astype(U64)
    out_g, out_p = [], []
    for g, keys in zip(groups, packs, strict=True):
        keys = keys & ~ONE
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        if hit.any():
            out_g.append(g)
            out_p.append((keys[hit] | common[at[hit]]).astype(sent_as).tobytes())
    return pa.table({"g": pa.array(out_g, pa.int32()), "kind": pa.array([kind_of_answer] * len(out_g), pa.int32()), "payload": pa.array(out_p, pa.binary())})


def _known(messages: pa.Table, which: int, sent_as: np.dtype) -> np.ndarray:
    packs = [np.frombuffer(p, sent_as).astype(U64) for k, p in zip(messages.column("kind").to_pylist(), messages.column("payload").to_pylist(), strict=True) if k == which]
    return np.sort(np.concatenate(packs)) if packs else np.zeros(0, U64)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is known, and whether as common."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    bare, keys = known & ~ONE, keys & ~ONE
    at = np.minimum(np.searchsorted(bare, keys), len(bare) - 1)
    hit = bare[at] == keys
    return hit, hit & ((known[at] & ONE) == ONE)


def _messages(buckets: list, groups: list, payloads: list) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "g": pa.array(groups, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _windows_of(runs: tuple, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the chosen runs, and the run of each."""
    n = runs[2][which]
    run = np.repeat(which, n)
    return runs[1][run] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), run


def _segments(kind: Kind, units: np.ndarray, runs: tuple, anchors: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, first window, windows, anchor hash of each run of windows that may recur."""
    hit, common = _find(anchors, runs[3])
    plain = np.flatnonzero(hit & ~common)
    parts = [tuple(x[plain] for x in runs)]
    hot = np.flatnonzero(common)
    if len(hot):
        at, run = _windows_of(runs, hot)
        ok, _ = _find(windows, gram_hashes(units, kind.window)[at].astype(WINDOW_KEY).astype(U64))
        at, run = at[ok], run[ok]
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            parts.append((runs[0][run[first]], at[first], np.diff(np.append(first, len(at))), runs[3][run[first]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Recurrence:
    """The passes over docs (doc_id, text) for one kind of unit."""

    def __init__(self, docs: DataFrame, kind: Kind):
        self.kind = kind
        self.parts = shuffle_partitions(docs.sparkSession)
        self.groups, self.buckets = 2 * self.parts, self.parts
        keyed = docs.selectExpr("cast(doc_id as long) doc_id", "text", f"cast(pmod(xxhash64(doc_id, text), {self.groups}) as int) g")
        self.docs = bucketed(keyed, "g", self.parts, "texts")

    def _lookup(self, sent: DataFrame, answer: int, sent_as: np.dtype) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda t: _answer(t, answer, sent_as), "g int, kind int, payload binary")

    def anchors(self) -> DataFrame:
        kind, buckets = self.kind, self.buckets

        def send(table: pa.Table) -> pa.Table:
            rows, found, where = rows_of(table), [], []
            for a, b in blocks(rows.texts, ROUND):
                runs = anchor_runs(kind, *units_of(kind, rows.texts[a:b]))
                found.append(runs[3])
                where.append(runs[0] + a)
            keys = _distinct(kind, np.concatenate(found), np.concatenate(where), rows.order_ids) if found else np.zeros(0, U64)
            out = [(b, k.tobytes()) for b, k in _dealt(keys, buckets)]
            return _messages([b for b, _ in out], [table.column("g")[0].as_py()] * len(out), [p for _, p in out])

        return self._lookup(self.docs.groupBy("g").applyInArrow(send, "bucket int, g int, payload binary"), 0, ANCHOR_KEY)

    def common_windows(self, anchors: DataFrame) -> DataFrame:
        kind, buckets = self.kind, self.buckets

        def send(key: tuple, table: pa.Table, messages: pa.Table) -> pa.Table:
            known = _known(messages, 0, ANCHOR_KEY)
            known = known[(known & ONE) == ONE]
            rows, found, where = rows_of(table), [], []
            for a, b in blocks(rows.texts, ROUND) if len(known) else ():
                units, begin, end = units_of(kind, rows.texts[a:b])
                runs = anchor_runs(kind, units, begin, end)
                hot = np.flatnonzero(_find(known, runs[3])[1])
                if len(hot):
                    at, run = _windows_of(runs, hot)
                    found.append(gram_hashes(units, kind.window)[at])
                    where.append(runs[0][run] + a)
            keys = _distinct(kind, np.concatenate(found), np.concatenate(where), rows.order_ids) if found else np.zeros(0, U64)
            out = [(b, k.astype(WINDOW_KEY).tobytes()) for b, k in _dealt(keys, buckets)]
            return _messages([b for b, _ in out], [key[0].as_py()] * len(out), [p for _, p in out])

        sent = self.docs.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(send, "bucket int, g int, payload binary")
        return self._lookup(sent, 1, WINDOW_KEY)

    def segments(self, answers: DataFrame, places: bool) -> DataFrame:
        """Rows with bucket >= 0 carry distinct segments to a shard; with bucket -1 - g (if places) where group g has them."""
        kind, shards = self.kind, self.buckets

        def send(key: tuple, table: pa.Table, messages: pa.Table) -> pa.Table:
            anchors, windows = _known(messages, 0, ANCHOR_KEY), _known(messages, 1, WINDOW_KEY)
            g, rows = key[0].as_py(), rows_of(table)
            index: dict[tuple, int] = {}
            hashes, sizes, contents, least, most, counts = [], [], [], [], [], []
            occ: list[tuple] = []
            for a, b in blocks(rows.texts, ROUND) if len(anchors) else ():
                texts = rows.texts[a:b]
                units, begin, end = units_of(kind, texts)
                seg = _segments(kind, units, anchor_runs(kind, units, begin, end), anchors, windows)
                split: dict[int, list] = {}
                for t, s, n, h in zip(*(x.tolist() for x in seg), strict=True):
                    s -= int(begin[t])
                    if kind.words:
                        if t not in split:
                            split = {t: texts[t].split()}
                        content = b" ".join(split[t][s : s + n + kind.window - 1])
                    else:
                        content = texts[t][s : s + n + kind.window - 1]
                    doc = int(rows.order_ids[a + t])
                    i = index.setdefault((h, content), len(contents))
                    if i == len(contents):
                        for x, y in ((hashes, h), (sizes, n), (contents, content), (least, doc), (most, doc), (counts, 0)):
                            x.append(y)
                    least[i], most[i], counts[i] = min(least[i], doc), max(most[i], doc), counts[i] + 1
                    if places:
                        occ.append((i, a + t, s))
            index.clear()
            out_b, out_p = [], []
            if contents:
                hash_array = np.array(hashes, U64)
                which = ((hash_array >> U64(32)) % U64(shards)).astype(np.int64)
                order = np.argsort(which, kind="stable")
                for x, y in equal_runs(which[order]):
                    own = order[x:y]
                    take = lambda values, kind_=np.int64: np.array([values[i] for i in own], kind_)  # noqa: E731,B023
                    out_b.append(int(which[own[0]]))
                    out_p.append(pack(own.astype(np.int32), hash_array[own], take(sizes), take(least), take(most), np.minimum(take(counts), 2), take([len(c) for c in contents]), b"".join([contents[i] for i in own])))
                if places:
                    out_b.append(-1 - g)
                    out_p.append(pack(np.array(occ, np.int64), np.array(sizes, np.int64)))
            return _messages(out_b, [g] * len(out_b), out_p)

        return self.docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(send, "bucket int, g int, payload binary")

    def candidates(self, places: bool, then: Callable[[DataFrame], DataFrame] = lambda sent: sent, name: str = "segments") -> DataFrame:
        """The first three passes; what `then` makes of the segments is staged."""
        anchors = staged(self.anchors(), "anchors")
        windows = staged(self.common_windows(anchors), "windows")
        out = staged(then(self.segments(anchors.unionByName(windows), places)), name)
        discard(anchors, windows)
        return out

    def with_messages(self, messages: DataFrame, rows_for: Callable, schema: str) -> DataFrame:
        """rows_for(rows of a group, its message payloads by kind) gives tuples of the schema's columns."""
        names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
        types = {"long": pa.int64(), "string": pa.string()}

        def finish(key: tuple, table: pa.Table, sent: pa.Table) -> pa.Table:
            by_kind: dict[int, list] = {}
            for k, p in zip(sent.column("kind").to_pylist(), sent.column("payload").to_pylist(), strict=True):
                by_kind.setdefault(k, []).append(p)
            out = rows_for(rows_of(table), by_kind)
            return pa.table({n: pa.array([r[j] for r in out], types[k]) for j, (n, k) in enumerate(zip(names, kinds, strict=True))})

        return self.docs.groupBy("g").cogroup(messages.groupBy("g")).applyInArrow(finish, schema)

    def run(self, solve: Callable, apply: Callable, schema: str, block: int) -> DataFrame:
        """solve(segments of some anchors) gives an array for each segment; apply(id, text, [(first window, array)]) a row's result."""

        def decide(key: tuple, table: pa.Table) -> pa.Table:
            if key[0].as_py() < 0:  # a group's places go on as they are
                return pa.table({"g": table.column("g"), "kind": pa.array([1] * table.num_rows, pa.int32()), "payload": table.column("payload")})
            answers: dict[int, list] = {}
            for part in merged(table, block):
                for (where, _), verdict in zip(part, solve([x[1] for x in part]), strict=True):
                    for g, i in where:
                        answers.setdefault(g, []).append((i, verdict))
            out = {g: pack(np.array([i for i, _ in x], np.int32), np.concatenate([v for _, v in x])) for g, x in answers.items()}
            return pa.table({"g": pa.array(list(out), pa.int32()), "kind": pa.array([0] * len(out), pa.int32()), "payload": pa.array(list(out.values()), pa.binary())})

        # The segments go from their groups to the shards in the query that decides them: they are on disk once, as its shuffle.
        decided = self.candidates(places=True, then=lambda sent: sent.groupBy("bucket").applyInArrow(decide, "g int, kind int, payload binary"), name="decided")

        def rows_for(rows: Rows, sent: dict[int, list]) -> list[tuple]:
            verdict, occ, sizes = {}, np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
            for p in sent.get(1, []):
                occ, sizes = unpack(p)
            for p in sent.get(0, []):
                own, flat = unpack(p)
                at = np.append(0, np.cumsum(sizes[own]))
                for j, i in enumerate(own.tolist()):
                    verdict[i] = flat[at[j] : at[j + 1]]
            by_row: dict[int, list] = {}
            for i, t, s in occ.tolist():
                by_row.setdefault(t, []).append((s, verdict[i]))
            return [(rows.ids[t], *apply(rows.ids[t], rows.texts[t], by_row.get(t, []))) for t in range(len(rows.ids))]

        return self.with_messages(decided, rows_for, schema)


def merged(table: pa.Table, block: int) -> Iterator[list]:
    """A shard's distinct segments in blocks of whole anchors: ([(group, index)], (content, windows, least id, most id, count))."""
    by_anchor: dict[int, dict] = {}
    for g, p in zip(table.column("g").to_pylist(), table.column("payload").to_pylist(), strict=True):
        own, hashes, sizes, least, most, counts, lengths, data = unpack(p)
        at = 0
        for i, h, n, lo, hi, c, size in zip(own.tolist(), hashes.tolist(), sizes.tolist(), least.tolist(), most.tolist(), counts.tolist(), lengths.tolist(), strict=True):
            content = data[at : at + size]
            at += size
            seg = by_anchor.setdefault(h, {})
            if content in seg:
                where, (_, _, lo2, hi2, c2) = seg[content]
                where.append((g, i))
                seg[content] = (where, (content, n, min(lo, lo2), max(hi, hi2), c + c2))
            else:
                seg[content] = ([(g, i)], (content, n, lo, hi, c))
    part, total = [], 0
    for seg in by_anchor.values():
        part += seg.values()
        total += sum(x[1][1] for x in seg.values())
        if total >= block:
            yield part
            part, total = [], 0
    if part:
        yield part
