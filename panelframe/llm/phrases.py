"""Repeated phrases: windows of 13 words that an earlier document holds are removed.

Candidate segments meet in shards (see recur.py). A shard confirms the word sequences that at least two documents hold and
sends them, as passages with the least doc_id that holds each of their windows, to the groups of documents they came from.
Each group compiles the passages of all shards into Aho-Corasick automata over word codes and streams every word of all its
documents through them; the automata alone locate the occurrences.

Null text: no words. Under 13 words nothing goes. Very long texts are handled whole. A null doc_id counts as larger than any
other. Repeats inside one document, and rows that share a doc_id, do not count against each other, so of rows with equal
doc_id and text each is kept or cut alike. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import covered
from .recur import NO_ID, Kind, Recurrence, Rows, merged, pack, unpack

WORDS = 13
PHRASES = Kind(words=True, window=WORDS, anchor=4, own=False)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Windows confirmed in one round.
BLOCK = 200_000
#: Windows of a passage at most: as many as one anchor serves, so that few passages end at one word.
PIECE = WORDS - PHRASES.anchor + 1
#: Different words in one automaton at most (one passage more fits); a group with more streams its documents through several.
AUTOMATON_WORDS = 250_000
#: Confirming codes words as single characters; the surrogates are left out, as they are no characters.
SKIP = 0xD800
#: In automata a word is SYMBOLS_EACH symbols out of a few, so that no state has many successors to search: the first is out of one
#: alphabet, the others out of a second one, so words cannot match out of step. OTHER stands for any word outside the passages.
SYMBOLS_EACH, FIRST, REST, OTHER = 3, 0x100, 0x200, "\1\1\1"
RADIX = 64


class _Codes(dict):
    """A character for each word, given out as words come."""

    def __missing__(self, word: bytes) -> str:
        i = len(self) + 1
        self[word] = x = chr(i if i < SKIP else i + 0x800)
        return x


class _Symbols(dict):
    """The symbols of each word, given out as words come: RADIX ** SYMBOLS_EACH words at most."""

    def __missing__(self, word: bytes) -> str:
        i, low = divmod(len(self), RADIX)
        high, middle = divmod(i, RADIX)
        self[word] = x = chr(FIRST + low) + chr(REST + middle) + chr(REST + high)
        return x


def _passages(spelled: str, n: int, again: set[str]) -> Iterator[tuple[int, int]]:
    """First window and windows of each run of confirmed windows, in pieces of at most PIECE."""
    run = 0
    for i in range(n + 1):
        inside = i < n and spelled[i : i + WORDS] in again
        if run and (not inside or run == PIECE):
            yield i - run, run
            run = 0
        run += inside


def confirmed(segments: list[tuple]) -> list[list[tuple[bytes, list[int]]]]:
    """For each segment (content, windows, least id, most id, ...) its passages that recur: their words, and the least id that holds each window.

    Each run of confirmed windows of each segment is a passage, so every occurrence of a window lies in the occurrence of a passage.
    """
    code = _Codes().__getitem__
    split = [x[0].split(b" ") for x in segments]
    spelled = ["".join(map(code, words)) for words in split]
    lowest: dict[str, int] = {}
    again: set[str] = set()
    for s, (_, n, low, high, _) in zip(spelled, segments, strict=True):
        for i in range(n):
            phrase = s[i : i + WORDS]
            had = lowest.setdefault(phrase, low)
            if had != low or low != high:
                again.add(phrase)
                if low < had:
                    lowest[phrase] = low
    out = []
    for s, words, x in zip(spelled, split, segments, strict=True):
        found = _passages(s, x[1], again) if again else ()
        out.append([(b" ".join(words[at : at + n + WORDS - 1]), [lowest[s[i : i + WORDS]] for i in range(at, at + n)]) for at, n in found])
    return out


def _confirm(table: pa.Table) -> pa.Table:
    """A shard's answer to each group: the passages among the group's segments."""
    by_group: dict[int, dict[bytes, list[int]]] = {}
    for part in merged(table, BLOCK):
        for (where, _), passages in zip(part, confirmed([x[1] for x in part]), strict=True):
            for g, _ in where:
                by_group.setdefault(g, {}).update(passages)
    groups = [g for g, x in by_group.items() if x]
    packs = [pack(np.array([len(v) for v in x.values()], np.int32), np.concatenate([np.array(v, np.int64) for v in x.values()]), b"\n".join(x)) for x in map(by_group.get, groups)]
    return pa.table({"g": pa.array(groups, pa.int32()), "kind": pa.array([0] * len(groups), pa.int32()), "payload": pa.array(packs, pa.binary())})


def _automata(packs: list[bytes]) -> Iterator[tuple[ahocorasick.Automaton, _Symbols]]:
    """Automata of the passages, each with its words' symbols. A match yields (windows, least and largest of their ids, ids)."""
    automaton, symbols = ahocorasick.Automaton(), _Symbols()
    for p in packs:
        sizes, lows, contents = unpack(p)
        at = 0
        for content, n in zip(contents.split(b"\n"), sizes.tolist(), strict=True):
            if len(symbols) > AUTOMATON_WORDS:
                automaton.make_automaton()
                yield automaton, symbols
                automaton, symbols = ahocorasick.Automaton(), _Symbols()
            own = lows[at : at + n].tolist()
            at += n
            automaton.add_word("".join(map(symbols.__getitem__, content.split(b" "))), (n, min(own), max(own), own))
    if symbols:
        automaton.make_automaton()
        yield automaton, symbols


def _stream(rows: Rows, sent: dict[int, list]) -> list[tuple]:
    """Every document of a group goes through the group's automata."""
    spans: list[list[tuple[int, int]]] = [[] for _ in rows.ids]
    for automaton, symbols in _automata(sent.get(0, [])):
        spell = symbols.get
        for own, text, found in zip(rows.order_ids.tolist(), rows.texts, spans, strict=True):
            for last, (n, least, most, lows) in automaton.iter("".join([spell(w, OTHER) for w in text.split()])):
                end = last // SYMBOLS_EACH + 1
                start = end - n - WORDS + 1
                if most < own:
                    found.append((start, end))
                elif least < own:
                    found += [(start + i, start + i + WORDS) for i, low in enumerate(lows) if low < own]
    return [_row(doc_id, text, found) for doc_id, text, found in zip(rows.ids, rows.texts, spans, strict=True)]


def _row(doc_id: int | None, text: bytes, found: list[tuple[int, int]]) -> tuple:
    words = text.split()
    removed = 0
    if found:
        starts, ends = np.array(found).T
        gone = covered(starts, ends, len(words))
        removed = int(gone.sum())
        kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    else:
        kept = words
    return doc_id, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()


def repeated_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs (doc_id, text)."""
    passes = Recurrence(docs, PHRASES)
    passages = passes.candidates(places=False).groupBy("bucket").applyInArrow(_confirm, "g int, kind int, payload binary")
    return passes.with_messages(passages, _stream, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
