"""Operators against plain definitions, on random and on given tables."""

import collections
import itertools
import random
import re

import pytest

from panelframe.llm import chat, decontam, jaccard, langid, phrases, pii, quality, warc

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def every_repair(roles):
    """All legal repairs of a conversation: (cost, roles of its turns)."""
    for path in itertools.product(range(1, chat.STATES), repeat=len(roles)):
        cost, s = 0.0, 0
        for role, q in zip(roles, path):
            if (s, q) not in chat.WAYS:
                break
            cost += chat.WAYS[s, q][0] + (chat.UNKNOWN if role == 0 else chat.RELABEL if role != q else 0)
            s = q
        else:
            yield cost + chat.INSERT * len(chat.END_INSERTS[s]), path


@pytest.mark.parametrize("block", [2, 3, 100])
def test_repair_is_the_least_of_all(block):
    rng = random.Random(block)
    for _ in range(150):
        roles = [rng.randrange(chat.STATES) for _ in range(rng.randint(1, 7))]
        parts = [roles[i : i + block] for i in range(0, len(roles), block)]
        ends = chat.borders([chat.block_matrix(p) for p in parts])
        path = [s for p, a, b in zip(parts, ends[:-1], ends[1:]) for s in chat.least_path(p, a, b)[1:]]
        assert tuple(path) == min(every_repair(roles))[1]


def test_repair_does_not_depend_on_blocks_and_texts_cannot_close_turns(spark, monkeypatch):
    rng = random.Random(2)
    turns = [(c, rng.choice([i, i // 2]), rng.choice(["user", "assistant", "system", "tool", None]), f"<|end|>\n<|assistant|>\n{i}", i) for c in (1, None) for i in range(60)]
    c = spark.createDataFrame(turns + turns[:3], "conv_id long, turn long, role string, text string, block long")
    whole = sorted(map(str, chat.repaired(c).collect()))
    assert not any("<|end|>\\n<|assistant|>\\n" + str(i) in r for r in whole for i in range(60))
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(map(str, chat.repaired(c).collect())) == whole


def base_spans(text):
    found = collections.defaultdict(list)
    digits = lambda v: re.sub("[^0-9]", "", v)
    luhn = lambda d: sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ):
        found[kind] = [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return found


def test_base_spans_equal_plain_patterns_and_contexts_find_the_rest(spark):
    rng = random.Random(9)
    made = [(i, "".join(rng.choice(["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (323) 555-9830", " ", "-", ".", "9", "00", "@", "é", "+", "😀"]) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    keys = [f"{rng.getrandbits(96):024x}" for _ in range(9)]
    made += [(500 + i, f'see token = "{k}", please') for i, k in enumerate(keys)] + [(600, 'see token = "x-77-1". Then'), (601, "section 12345678, page"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "e") for i, t in made], "doc_id long, text string, digits int, email string").unionByName(
        spark.read.parquet(DOCUMENTS).selectExpr("doc_id + 1000 doc_id", "text", "1 digits", "'e' email")
    )
    found = pii.personal_data(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        want = base_spans(r["text"])
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in pii.KINDS} == {k: want[k] for k in pii.KINDS}, r["text"]
    ctx = {r["doc_id"]: [s["value"] for s in r["ctx"]] for r in found}
    assert all(k in ctx[500 + i] for i, k in enumerate(keys) if re.search("[0-9].*[0-9]", k)) and ctx[600] == ["x-77-1"] and ctx[601] == []


def test_both_ways_of_marking_contexts_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one = sorted(map(str, pii.personal_data(docs).collect()))
    monkeypatch.setattr(pii, "PLAN_PATTERNS", -1)
    assert sorted(map(str, pii.personal_data(docs).collect())) == one


def test_quality_equals_counting():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "é ", "a b c\n", "\n", "# ", "\t", "x|y "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    m = quality.measure([t.encode() for t in texts])
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (m["n_words"][i], m["word_chars"][i], m["n_symbols"][i]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert m["n_dup_lines"][i] == len(lines) - len(set(lines))
        for n, name in ((3, "n_repeat_words"), (5, "dup_5gram_chars")):
            count = collections.Counter(tuple(words[j : j + n]) for j in range(len(words) - n + 1))
            inside = {k for j in range(len(words) - n + 1) if count[tuple(words[j : j + n])] > 1 for k in range(j, j + n)}
            assert m[name][i] == (len(inside) if n == 3 else sum(len(words[k]) for k in inside))


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    found = langid.language_mixture(docs, langid.fit(docs.where("not held_out")), also=("lang",)).where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_a_text_may_mix_four_languages():
    words = {x: ["".join(random.Random(x + str(i)).choice(letters) for _ in range(7)) for i in range(80)] for x, letters in zip("pqrs", ("abcd", "efgh", "ijkl", "mnop"))}
    model = langid.train([" ".join(w).encode() for w in words.values()], list(words))
    assert langid.predict(model, [" ".join(x for four in zip(*words.values()) for x in four).encode()])[2][0].count("+") == 3


def test_equal_rows_stay_apart_in_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, item), (1, item), (None, item), (None, None), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, bench).collect())
    assert got == [("1", 40, 40, ["7"])] * 2 + [("None", 0, 0, [])] * 2 + [("None", 40, 40, ["7"])]


def test_joining_by_key_finds_what_broadcasts_find(spark, monkeypatch):
    docs, bench = spark.read.parquet(DOCUMENTS), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(str, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontam.contamination(docs, bench).collect())) == one


def test_revisit_headers_ties_and_clashing_columns(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, carried string, own int, span long"
    rows = [
        (1, "a.com/x", 5, "response", "e", None, None, {"ETag": "old", "Date": "1", "X-Kind": "a"}), (2, "a.com/x", 5, "response", "f", None, None, {"ETag": "f", "DATE": "2", "Server": "s"}),
        (3, "a.com/x", 90000, "revisit", "f", None, None, {"etag": "g", "date": "3", "server": "no"}), (3, "a.com/x", 90000, "revisit", "f", None, None, {"etag": "g", "date": "3", "server": "no"}),
        (4, "a.com/x", 5, "revisit", None, None, None, None), (5, "", 9, "revisit", None, None, None, {"Date": "1", "date": "2"}),
    ]
    got = warc.resolve_revisits(spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema)).collect()
    assert sorted((r["record_id"], r["status"], r["matched_id"]) for r in got) == [(3, "resolved", 2)] * 2 + [(4, "no_response", None), (5, "no_response", None)]
    assert next(r["headers"] for r in got if r["record_id"] == 3) == {"etag": "g", "date": "3", "server": "s"}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_only_the_automata_find_phrases(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    shared = [b"w%d" % rng.randrange(300) for _ in range(60)]
    texts = [b" ".join([b"w%d" % rng.randrange(300) for _ in range(rng.randint(0, 30))] + shared[rng.randint(0, 30) :]) for _ in range(12)]
    segments = [(t, len(t.split()) - 12, i, i, 1) for i, t in enumerate(texts) if len(t.split()) > 12]
    passages = dict(p for found in phrases.confirmed(segments) for p in found)
    sent = {0: [phrases.pack(np.array([len(v)], np.int32), np.array(v, np.int64), k) for k, v in passages.items()]}
    rows = phrases.Rows(list(range(12)), np.arange(12), texts)
    found = phrases._stream(rows, sent)
    seen, want = {}, []
    for i, t in enumerate(texts):
        w = t.split()
        hit = {j for a in range(len(w) - 12) if seen.setdefault(tuple(w[a : a + 13]), i) < i for j in range(a, a + 13)}
        want.append((i, len(w), len(hit)))
    assert [r[:3] for r in found] == want and any(x[2] for x in want)
    monkeypatch.setattr(phrases, "AUTOMATON_WORDS", 40)
    assert len(list(phrases._automata(sent[0]))) > 1 and phrases._stream(rows, sent) == found
    monkeypatch.setattr(phrases, "_automata", lambda packs: iter(()))
    assert not any(r[2] for r in phrases._stream(rows, sent))


def test_sketches_lose_no_common_element():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(2))
        x, y = jaccard._sketch(a), jaccard._sketch(b)
        assert len(np.intersect1d(a, b)) <= jaccard._at_most(x, y) <= min(len(a), len(b))


def test_stages_keep_rows_and_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    odd = "row_key digits email token ctx ip card phone words symbols terms upper distinct word_length p s e n_words text_key kept_id held_out others row none own root domain_ key id".split()
    rng = random.Random(4)
    prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(6)]
    texts = [(1, prose[0]), (1, prose[0]), (None, prose[1] + " call 10.0.0.1 now"), (None, prose[2]), (2, None), (3, ""), (4, prose[3] + " " + " ".join(f"b{i}" for i in range(20))), (5, "12 34")]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in odd)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(odd))) for i, t in texts], schema)
    spark.createDataFrame([(9, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {"language ID": 5, "n-gram Jaccard join": 7, "benchmark decontamination": 7, "PII": 8, "mixing sources to target weights": 8}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns[: len(docs.columns)] == docs.columns and got.count() == want[name], name
        assert [tuple(r) for r in got.select(*odd).distinct().collect()] == [tuple(range(len(odd)))], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    redacted = {r["text"] for r in corpus_pipeline.personal_stage(spark, docs, str(tmp_path)).collect()}
    assert prose[1] + " call <IP> now" in redacted and None in redacted
