"""N-gram Jaccard join with connected components: set-relation skipping.

A document is its set of 4-word shingles (64-bit hashes). Sets with similarity 0.85 or more must share one of
their first few shingles in a common order (rare first), so those go to inverted lists.

* Equal sets are one set. A list entry has the set's size and the shingle's position. Long lists are kept in blocks by position,
  sorted by size inside: a block whose entries have too little left after their positions is skipped whole, and within a block
  so are the sizes out of range.
* A pair that passes these bounds is compared only if its sketches allow it: a sketch counts a set's elements in hash cells, and
  sets share at most the sum of the lesser counts, so no linked pair is lost.
* A long list is first compared with one set, its centre. What a set has in common with the centre answers for
  sets like the centre: |x & y| <= min(|x & c|, |y & c|) + min(|x - c|, |y - c|), so most pairs of
  the list are decided without a comparison, and pairs already connected need none. The rest is compared exactly.

Links are merged into components by alternating star contractions. Null text, or one without words:
no shingles, a component of its own. Null doc_id: linked like any other, but it names no component (null if all ids
are null). Rows with equal doc_id and different text are separate; repeated rows share their component. Very long texts are handled
whole. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from .arrays import U64, gram_hashes, mix, span_hashes, word_spans
from .common import blocks, bucketed, byte_texts, discard, laid, shuffle_partitions, staged
from .recur import equal_runs, pack, unpack

SHINGLE, PERCENT = 4, 85
#: Rarity classes come from counts in this many hash cells (a byte each is broadcast). Counts in one task stop at 255: they only order shingles.
CELL_BITS, CELL_CHUNKS = 22, 64
#: Bits of the filter that tells which sets are compared (broadcast, a set in it by chance is sent in vain), and shingles counted in one round.
FILTER_BITS, ROUND = 25, 1 << 21
#: Up to this many sets a list is compared pair by pair; longer ones have a centre.
SMALL = 8
#: Members of a centre that are compared with as many others in one task.
MEMBERS = 100
#: Positions in one block of a long list.
POSITIONS = 8
#: Entries of a list that one task decides on; longer lists are dealt by size class and block.
LIST = 1000
#: The span of a list that is not dealt by size class.
WHOLE = -2


def _sets(texts: list) -> Iterator[np.ndarray]:
    buf, at = laid([(t or b"").lower() for t in texts])
    starts, ends = word_spans(buf)
    words = span_hashes(buf, starts, ends)
    word_at = np.searchsorted(starts, at)
    grams = gram_hashes(words, SHINGLE)
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield mix(gram_hashes(words[a:b], b - a) + U64(b - a))
        else:
            yield np.zeros(0, U64)


def _sid(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(s: np.ndarray) -> bytes | None:
    """Counts of the elements in 2 ** k hash cells, about half as many as elements; None if a count exceeds a byte."""
    bits = max(0, (len(s) - 1).bit_length() - 1)
    counts = np.bincount(((s >> U64(1)) >> U64(63 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if len(s) and counts.max() < 256 else None


def _at_most(x: bytes, y: bytes) -> int:
    """A bound on what the sets of two sketches have in common."""
    x, y = sorted((np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y)), key=len)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - CELL_BITS)).astype(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, text_key, n, sid and sketch for each row; kind 1: counts of a chunk of cells in one task."""
    names = ["kind", "doc_id", "text_key", "n", "sid", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, n = np.zeros(1 << CELL_BITS, np.uint8), [], 0

        def count() -> None:
            found = np.bincount(_cells(np.concatenate(waiting)), minlength=len(cells)) + cells
            np.minimum(found, 255, out=cells, casting="unsafe")
            waiting.clear()

        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for a, b in blocks(texts):
                own = list(_sets(texts[a:b]))
                waiting += own
                n += sum(map(len, own))
                if n >= ROUND:
                    count()
                    n = 0
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * m, pa.int32()), *[batch.column(c).slice(a, m) for c in ("doc_id", "text_key")], pa.array([len(s) for s in own], pa.int64()), pa.array([_sid(s) if len(s) else None for s in own], pa.int64()), pa.array([_sketch(s) for s in own], pa.binary())], names=names
                )
        if waiting:
            count()
        for i, part in enumerate(np.split(cells, CELL_CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int64()), pa.nulls(1, pa.int64()), pa.array([pack(part)], pa.binary())], names=names)

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "kind int, doc_id long, text_key long, n long, sid long, payload binary")


def rarity(found: DataFrame) -> np.ndarray:
    """The class (about log2 of the count) of each cell, summed over all documents."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(p)[0].astype(np.int64) for p in table.column("payload").to_pylist())
        kind = np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()
        return pa.table({"n": table.column("n").slice(0, 1), "classes": pa.array([kind], pa.binary())})

    rows = found.where("kind = 1").select("n", "payload").groupBy("n").applyInArrow(add, "n long, classes binary").collect()
    out = b"".join(bytes(r["classes"]) for r in sorted(rows, key=lambda r: r["n"]))
    return np.frombuffer(out, np.uint8) if out else np.zeros(1 << CELL_BITS, np.uint8)


def needed_overlap(a, b):
    """The least intersection of sets of sizes a and b with 100 * common >= PERCENT * union."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def postings(docs: DataFrame, classes: np.ndarray, buckets: int) -> DataFrame:
    """Packed (shingle, sid, size, position) of each distinct set's prefix, by bucket of the shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            token, sid, size, pos = [], [], [], []
            for a, b in blocks(texts):
                for s in _sets(texts[a:b]):
                    if not len(s) or (i := _sid(s)) in seen:
                        continue
                    seen.add(i)
                    # Elements beyond the prefix cannot be the first common one of a linked pair.
                    prefix = len(s) - -(-PERCENT * len(s) // 100) + 1
                    order = np.lexsort((s, rank[_cells(s)]))[:prefix]
                    token.append(s[order])
                    sid.append(np.full(len(order), i, np.int64))
                    size.append(np.full(len(order), len(s), np.int32))
                    pos.append(np.arange(len(order), dtype=np.int32))
            if token:
                token, sid, size, pos = (np.concatenate(x) for x in (token, sid, size, pos))
                which = ((token >> U64(20)) % U64(buckets)).astype(np.int64)
                order = np.argsort(which, kind="stable")
                cuts = list(equal_runs(which[order]))
                payload = [b"".join(x[order[a:b]].tobytes() for x in (token, sid, size, pos)) for a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([int(which[order[a]]) for a, _ in cuts], pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "payload"])

    return docs.mapInArrow(run, "bucket int, payload binary")


def _unpacked(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    out = []
    for p in payloads:
        n = len(p) // 24
        out.append((np.frombuffer(p, U64, n), np.frombuffer(p, np.int64, n, 8 * n), np.frombuffer(p, np.int32, n, 16 * n), np.frombuffer(p, np.int32, n, 20 * n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def possible(size_a, pos_a, size_b, pos_b):
    """Length and position bounds for two entries of a list, taken as the first element both sets have: all
    they share stands at or after it. Linked sets pass in the list of their first common element at least."""
    need = needed_overlap(size_a, size_b)
    return (np.minimum(size_a, size_b) >= need) & (np.minimum(size_a - pos_a, size_b - pos_b) >= need)


def list_pairs(bucketed: DataFrame) -> DataFrame:
    """kind 0: pairs a < b to compare; kind 1: long lists, packed, with their shingle in b."""

    def run(table: pa.Table) -> pa.Table:
        token, sid, size, pos = _unpacked(table.column("payload").to_pylist())
        order = np.lexsort((sid, size, token))
        token, sid, size, pos = (x[order] for x in (token, sid, size, pos))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        token, sid, size, pos = (x[new] for x in (token, sid, size, pos))
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(first, len(token)))
        kinds, left, right, packs = [], [], [], []
        pairs: list[np.ndarray] = []
        for n in range(2, SMALL + 1):  # all lists of one length at once
            at = first[count == n]
            for i in range(n):
                for j in range(i + 1, n):
                    pairs.append(np.stack((at + i, at + j)))
        for a, n in zip(first[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
            kinds.append(1)
            left.append(None)
            right.append(int(token[a].astype(np.int64)))
            packs.append(pack(sid[a : a + n], size[a : a + n], pos[a : a + n]))
        if pairs:
            i, j = np.concatenate(pairs, axis=1)
            ok = possible(size[i], pos[i], size[j], pos[j])
            i, j = i[ok], j[ok]
            both = np.unique(np.stack((np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])), axis=1), axis=0)
            kinds += [0] * len(both)
            left += both[:, 0].tolist()
            right += both[:, 1].tolist()
            packs += [None] * len(both)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "payload": pa.array(packs, pa.binary())})

    return bucketed.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, payload binary")


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each hash cell that holds a wanted sid; its size is fixed."""
    cell = F.shiftrightunsigned(F.col("sid"), 64 - FILTER_BITS)
    size = (1 << FILTER_BITS) // CELL_CHUNKS

    def mark(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        bits[table.column("cell").to_numpy() % size] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([pack(np.packbits(bits))], pa.binary())})

    cells = wanted.select(cell.alias("cell")).distinct().withColumn("chunk", F.floor(F.col("cell") / size).cast("int"))
    out = np.zeros((CELL_CHUNKS, size // 8), np.uint8)
    for r in cells.groupBy("chunk").applyInArrow(mark, "chunk int, bits binary").collect():
        out[r["chunk"]] = unpack(bytes(r["bits"]))[0]
    return out.ravel()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, elements) of the wanted sets, in buckets by sid. Texts stay where they are: each task sends a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = shared.value, set()
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for a, b in blocks(texts):
                own = []
                for s in _sets(texts[a:b]):
                    if len(s) and (i := _sid(s)) not in sent:
                        cell = (i & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)
                        if bits[cell >> 3] >> (7 - (cell & 7)) & 1:
                            sent.add(i)
                            own.append((i, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], names=["sid", "elements"])

    every = docs.select("text").mapInArrow(build, "sid long, elements binary")
    return bucketed(every, "sid", shuffle_partitions(docs.sparkSession), "sets").dropDuplicates(["sid"])


def sketched(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a link."""
    own = found.where("kind = 0 and sid is not null").select("sid", "n", "payload").dropDuplicates(["sid"])
    both = pairs.join(own.toDF("a", "size_a", "sketch_a"), "a").join(own.toDF("b", "size_b", "sketch_b"), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = needed_overlap(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy())
            sketches = zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), need.tolist(), strict=True)
            ok = pa.array([x is None or y is None or _at_most(x, y) >= least for x, y, least in sketches], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    return both.mapInArrow(keep, "a long, b long")


def overlaps(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) plus the sets' sizes and what they have in common, compared exactly; for sets that share half or more also the elements only one has.

    The sets' table is bucketed by sid, so of the joins only pairs, and the first set of each, are shuffled."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("sid")))
    both = pairs.join(sets.toDF("a", "elements_a"), "a").join(sets.toDF("b", "elements_b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, common, only_a, only_b = [], [], [], [], []
            for x, y in zip(batch.column("elements_a").to_pylist(), batch.column("elements_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                in_y = np.isin(x, y, assume_unique=True)
                c = int(in_y.sum())
                near = 2 * c >= max(len(x), len(y))
                na.append(len(x))
                nb.append(len(y))
                common.append(c)
                only_a.append(x[~in_y].tobytes() if near else None)
                only_b.append(y[~np.isin(y, x, assume_unique=True)].tobytes() if near else None)
            columns = [batch.column("a"), batch.column("b"), *[pa.array(x, pa.int64()) for x in (na, nb, common)], *[pa.array(x, pa.binary()) for x in (only_a, only_b)]]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "size_a", "size_b", "common", "only_a", "only_b"])

    return both.mapInArrow(compare, "a long, b long, size_a long, size_b long, common long, only_a binary, only_b binary")


def linked(compared: DataFrame) -> DataFrame:
    return compared.where(100 * F.col("common") >= PERCENT * (F.col("size_a") + F.col("size_b") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without edges are left out.

    Alternating large and small stars (Kiveris et al. 2014); every round is written to the shared folder.
    """
    edges, mark = staged(edges.where("a <> b").distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


def long_entries(lists: DataFrame) -> DataFrame:
    """token, sid, size, pos, centre, centre_size, centre_pos of each entry of a long list.

    The centre of a list is the member that stands in most long lists: the text that others were
    made from keeps all its shingles, so one centre serves nearly all lists of a group of copies.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, p in zip(batch.column("b").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                sid, size, pos = unpack(p)
                yield pa.RecordBatch.from_arrays([pa.array([token] * len(sid), pa.int64()), pa.array(sid), pa.array(size), pa.array(pos)], names=["token", "sid", "size", "pos"])

    entries = staged(lists.select("b", "payload").mapInArrow(spread, "token long, sid long, size int, pos int"), "entries")
    votes = entries.groupBy("sid").agg(F.count(F.lit(1)).alias("votes"))
    best = entries.join(votes, "sid").groupBy("token").agg(F.max_by(F.struct("sid", "size", "pos"), F.struct("votes", F.col("sid"))).alias("c"))
    centres = best.select("token", F.col("c.sid").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.pos").alias("centre_pos"))
    return staged(entries.join(centres, "token"), "centred")


def centre_pairs(entries: DataFrame) -> DataFrame:
    """Pairs a < b of entries with their list's centre that pass the length and position bounds."""
    need = F.ceil(PERCENT * (F.col("size") + F.col("centre_size")) / (100 + PERCENT))
    left = F.least(F.col("size") - F.col("pos"), F.col("centre_size") - F.col("centre_pos"))
    ok = (F.col("sid") != F.col("centre")) & (left >= need)
    return entries.where(ok).select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b")).distinct()


def _apart(df: DataFrame, *keys: str) -> GroupedData:
    """df grouped by keys and dealt by all of them: rows that a join dealt by some of the keys would else stay together in one task."""
    return df.repartition(*keys).groupBy(*keys)


def derived_links(entries: DataFrame, compared: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between sets near the same centre, from what each differs in from the centre:
    |x & y| = |c| - |c - x| - |c - y| + |(c - x) & (c - y)| + |(x - c) & (y - c)|, which is exact.

    Members of a centre are dealt into blocks of about MEMBERS and every two blocks meet in a task of
    their own; a task skips connected pairs and emits a forest of links, never all pairs.
    """
    same = compared.where("only_a is not null")
    turned = same.select(F.col("b").alias("sid"), F.col("a").alias("centre"), F.col("size_a").alias("whole"), F.col("only_a").alias("missing"), F.col("only_b").alias("added"))
    both = same.select(F.col("a").alias("sid"), F.col("b").alias("centre"), F.col("size_b").alias("whole"), F.col("only_b").alias("missing"), F.col("only_a").alias("added")).unionByName(turned)
    members = both.join(entries.select("sid", "centre").distinct(), ["sid", "centre"]).join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    members = staged(members, "members")
    groups = members.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").selectExpr("centre", f"cast(ceil(n / {MEMBERS}) as int) blocks")
    dealt = members.join(groups, "centre").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def solve(table: pa.Table) -> pa.Table:
        sid, root, block, whole = (table.column(c).to_numpy() for c in ("sid", "root", "block", "whole"))
        missing = [np.frombuffer(x, np.int64) for x in table.column("missing").to_pylist()]
        added = [np.frombuffer(x, np.int64) for x in table.column("added").to_pylist()]
        crossing = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        less, more = np.array([len(x) for x in missing]), np.array([len(x) for x in added])
        size = whole - less + more
        holders: dict[tuple, list] = {}
        parent = {int(r): int(r) for r in root}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        found = []
        for i in range(len(sid)):
            shared = np.zeros(i, np.int64)
            for kind, values in ((0, missing[i]), (1, added[i])):
                for e in values.tolist():
                    own = holders.setdefault((kind, e), [])
                    shared[own] += 1
                    own.append(i)
            if i == 0:
                continue
            overlap = whole[i] - less[i] - less[:i] + shared
            ok = 100 * overlap >= PERCENT * (size[i] + size[:i] - overlap)
            if crossing:
                ok &= block[:i] != block[i]
            for j in np.flatnonzero(ok).tolist():
                x, y = find(int(root[i])), find(int(root[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((int(sid[i]), int(sid[j])))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return _apart(dealt, "centre", "low", "high").applyInArrow(solve, "a long, b long")


def undecided(entries: DataFrame, compared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of long lists that neither connection nor the centre's answers decide, and that are not both near the centre.

    Linked sets' sizes differ by a factor of 100 / PERCENT at most. So a list of more than LIST entries is dealt into spans: an entry is at
    home in the span of its size class and visits the one below. A span that is still too long is dealt into blocks, of which
    every two meet in a task of their own, so a hot shingle's list is shared by many tasks and no pair is left out.
    """
    entries = staged(entries.select("token", "centre", "sid", "size", "pos").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    counted = entries.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    open_lists = staged(counted.select("token", (F.col("n") > LIST).alias("long")), "open-lists")
    size_class = F.floor(F.log("size") / math.log(100 / (PERCENT - 1))).cast("int")  # a little wider than need be, for rounding
    spans = F.when(F.col("long"), F.array(size_class, size_class - 1)).otherwise(F.array(F.lit(WHOLE)))
    visits = F.col("long") & (F.col("span") != size_class)
    near = F.col("only_a").isNotNull().alias("near")
    answers = compared.select("a", "b", "common", near).unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", near)).toDF("sid", "centre", "common", "near")
    known = entries.join(open_lists, "token").join(answers, ["sid", "centre"], "left").withColumn("span", F.explode(spans)).withColumn("visitor", visits)
    tall = entries.join(open_lists.where("long"), "token").withColumn("span", F.explode(spans)).groupBy("token", "span")
    homes = tall.agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks"), F.bool_or(~visits).alias("home"))
    known = known.join(homes, ["token", "span"], "left").where(F.coalesce("home", F.lit(True))).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    known = known.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def decide(table: pa.Table) -> pa.Table:
        sid, size, pos, root, block = (table.column(c).to_numpy() for c in ("sid", "size", "pos", "root", "block"))
        visitor = table.column("visitor").to_numpy(zero_copy_only=False)
        crossing = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        centre = table.column("centre")[0].as_py()
        common = table.column("common").to_numpy(zero_copy_only=False).astype(np.float64)
        common = np.where(sid == centre, size, common)
        near = np.array([bool(x) for x in table.column("near").to_pylist()])
        order = np.lexsort((size, pos // POSITIONS))
        sid, size, pos, root, block, visitor, common, near = (x[order] for x in (sid, size, pos, root, block, visitor, common, near))
        cuts = list(equal_runs(pos // POSITIONS))
        most_left = [int((size - pos)[a:b].max()) for a, b in cuts]
        out = []
        for i in range(len(sid)):
            if sid[i] == centre:
                continue
            for (a, b), left in zip(cuts, most_left, strict=True):
                if b <= i + 1 or min(left, size[i] - pos[i]) < needed_overlap(size[i], size[a]):
                    continue  # the whole block is skipped: its least size needs more than any of its entries has left
                low, stop = np.searchsorted(size[a:b], (-(-size[i] * PERCENT // 100), size[i] * 100 // PERCENT + 1))
                j = np.arange(max(a + low, i + 1), a + stop)
                j = j[(root[j] != root[i]) & (sid[j] != centre) & ~(near[j] & near[i]) & ~(visitor[j] & visitor[i])]
                if crossing:
                    j = j[block[j] != block[i]]
                if not len(j):
                    continue
                need = needed_overlap(size[i], size[j])
                bound = np.minimum(common[i], common[j]) + np.minimum(size[i] - common[i], size[j] - common[j])
                ok = possible(size[i], pos[i], size[j], pos[j]) & ~(bound < need)  # an unknown answer (nan) decides nothing
                out.append(np.stack((np.minimum(sid[i], sid[j[ok]]), np.maximum(sid[i], sid[j[ok]]))))
        found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return _apart(known, "token", "span", "low", "high").applyInArrow(decide, "a long, b long").distinct()


def has_words(text: str = "text") -> F.Column:
    """Whether a text has a word, as _sets parts them."""
    return F.coalesce(F.rlike(F.col(text), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); also sid, the set's hash, text_key, the text's,
    and root, which tells components apart even where they share a doc_id or have none (null for texts without words)."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    found = staged(shingle_sets(docs), "shingle-sets")
    rows = found.where("kind = 0").select("doc_id", "text_key", "n", "sid")
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    sent = staged(list_pairs(postings(docs, rarity(found), buckets)), "pairs")
    entries = long_entries(sent.where("kind = 1"))
    short = sketched(sent.where("kind = 0").select("a", "b").distinct(), found)
    pairs = staged(short.unionByName(centre_pairs(entries)).distinct(), "all-pairs")
    compared = staged(overlaps(docs, pairs), "compared")
    discard(sent, pairs)
    roots = components(linked(compared))
    roots = components(roots.toDF("a", "b").unionByName(derived_links(entries, compared, roots)))
    more = staged(sketched(undecided(entries, compared, roots).join(compared.select("a", "b"), ["a", "b"], "leftanti"), found), "undecided")
    discard(entries, compared)
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").unionByName(linked(overlaps(docs, more))))
    discard(more)
    own = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    placed = own.join(roots, own["sid"] == roots["node"], "left").select("sid", F.coalesce("root", "sid").alias("root"), "least")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id", "root")
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sid", "text_key", "root")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
