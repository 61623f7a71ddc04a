"""Edge cases and brute force on a small corpus with planted copies."""

import collections
import hashlib
import random
import re

import pytest

from panelframe.llm import chat, decontam, jaccard, langid, mixing, phrases, pii, quality, recur, suffixes, warc

SCHEMA = "doc_id long, text string, lang string, words int, key string, extra string"


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, rows = prose(60), []
    for i in range(24):
        words = prose(rng.randint(20, 150)).split()
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = shared.split()
        rows.append((i, " ".join(words), "en"))
    long = prose(150).split()
    for i in range(24, 40):  # a group of near copies
        copy = list(long)
        copy[rng.randrange(150)] = "changed"
        rows.append((i, " ".join(copy), "en"))
    rows += [(40, None, None), (41, "", "en"), (42, "   \n\t ", "en"), (43, "one two three", "en"), (44, "One two\nthree", "en"), (45, rows[3][1], None), (46, "é" * 300, "fr"), (47, "12345 67 +++", "en")]
    rows += [(None, rows[6][1], "en"), rows[2], (48, "mail a@b.co, call +1 (323) 555-9830 or 10.0.0.255; 4111 1111 1111 1111 4111111111111112 a@b_c 999.1.1.1 @x.y", "en"), (49, prose(20000), "en")]
    return [(*r, 1, "k", "e") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def ordered(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def test_phrases(docs, empty):
    first = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in corpus()]
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, 2**63), ordered(d))
    want = collections.Counter()
    for d, t in texts:
        w = t.split()
        gone = [any(first[tuple(w[i : i + 13])] < ordered(d) for i in range(max(0, j - 12), min(j, len(w) - 13) + 1)) for j in range(len(w))]
        want[(d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    assert rows(phrases.repeated_phrases(docs)) == want
    assert phrases.repeated_phrases(empty).count() == 0


def test_suffixes(docs, empty):
    texts = [(d, (t or "").encode()) for d, t, *_ in corpus()]
    count = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        want[(d, len(t), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())] += 1
    assert rows(suffixes.repeated_substrings(docs)) == want
    assert suffixes.repeated_substrings(empty).count() == 0


def test_suffixes_keep_segments_once_and_send_half_hashes(spark, monkeypatch):
    """With a passage in more groups than COMMON: right rows, four bytes for a window, and no table of segments beside their shuffle."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, staged, names = text(400), recur.staged, []
    texts = [(i, text(150) + passage + text(150)) for i in range(160)]
    count = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    monkeypatch.setattr(recur, "staged", lambda df, name: names.append(name) or staged(df, name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = {r["doc_id"]: r["n_removed"] for r in suffixes.repeated_substrings(docs).collect()}
        passes = recur.Recurrence(docs, suffixes.BYTES)
        group = {r["doc_id"]: r["g"] for r in passes.docs.select("doc_id", "g").collect()}
        sent = sum(len(r["payload"]) for r in passes.common_windows(passes.anchors()).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for d, t in texts:
        want[d] = len({j for i in range(len(t) - 199) if count[t[i : i + 200]] > 1 for j in range(i, i + 200)})
    assert got == want
    again = {(group[d], t[i : i + 200]) for d, t in texts for i in range(len(t) - 199) if count[t[i : i + 200]] > 1}
    assert len({g for g, _ in again}) > recur.COMMON
    assert 0 < sent <= 4 * len(again)
    assert sorted(names) == ["anchors", "decided", "windows"]


def test_jaccard_pairs_of_a_dealt_list(spark, monkeypatch):
    """A dealt list gives the pairs that the whole list gives, whatever the sizes."""
    rng = random.Random(8)
    entries = [(7, 10**9, i, rng.randint(1, 60), 0) for i in range(90)]
    table = spark.createDataFrame(entries, "token long, centre long, sid long, size int, pos int")
    compared = spark.createDataFrame([], "a long, b long, common long, only_a binary")
    roots = spark.createDataFrame([], "node long, root long")
    want = {(a[2], b[2]) for a in entries for b in entries if a[2] < b[2] and 100 * min(a[3], b[3]) >= 85 * max(a[3], b[3])}
    for most in (1000, 40, 4):
        monkeypatch.setattr(jaccard, "LIST", most)
        assert {tuple(r) for r in jaccard.undecided(table, compared, roots).collect()} == want


@pytest.mark.parametrize(("small", "most"), [(8, 1000), (1, 1000), (1, 3)])
def test_jaccard(docs, empty, small, most, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)  # 1: every list has a centre
    monkeypatch.setattr(jaccard, "LIST", most)  # 3: lists are dealt by size class and block
    nodes = []
    for d, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        nodes.append((d, frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    group = list(range(len(nodes)))
    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            b = nodes[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(nodes, group):
        least[g] = min(x for x in (least.get(g), d) if x is not None) if d is not None or g in least else None
    want = collections.Counter((d, len(s), least[g]) for (d, s), g in zip(nodes, group))
    assert rows(jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")) == want
    assert jaccard.jaccard_components(empty).count() == 0


def test_decontamination(spark, docs, empty):
    text = next(t for d, t, *_ in corpus() if d == 0)
    items = [(1, " ".join(text.split()[5:25]).upper()), (2, "one two three"), (3, ""), (4, None), (2, "TWO three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = set()
    for d, t, *_ in corpus():
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(13, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        want.add((d, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontam.contamination(docs, bench)
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()} == want
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_personal_data(docs, empty):
    found = {r["doc_id"]: r for r in pii.personal_data(docs.select("doc_id", "text")).collect()}
    spans = lambda k: [s["value"] for s in found[48][k]]
    assert (spans("email"), spans("ip"), spans("phone")) == (["a@b.co"], ["10.0.0.255"], ["+1 (323) 555-9830"])
    assert spans("card") == [] or all(len(re.sub(r"\D", "", s)) in range(16, 20) for s in spans("card"))
    assert all(not found[d][k] for d in (40, 41, 43) for k in pii.KINDS)
    assert pii.personal_data(empty.select("doc_id", "text")).count() == 0


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.repetition_coverage(docs).collect()}
    assert got[40]["n_words"] == got[41]["n_words"] == 0 and got[40]["base_failed"] and not got[40]["kept"]
    assert got[49]["n_words"] == 20000 and got[46]["word_chars"] == 300
    m = quality.measure([b"a b c\na b c\nx # y", None])
    assert [int(m[k][0]) for k in ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words")] == [9, 1, 1, 6]
    assert quality.repetition_coverage(empty).count() == 0


def test_language(docs, empty):
    texts = [b"the cat and the dog went to the house", b"der hund und die katze gehen in das haus"] * 30
    model = langid.train(texts, ["en", "de"] * 30)
    assert langid.predict(model, [b"the house and the cat", b"das haus und der hund", None, b"123"])[0] == ["en", "de", "und", "und"]
    got = {r["doc_id"]: r for r in langid.language_mixture(docs.withColumn("held_out", langid.held_out()), langid.fit(docs)).collect()}
    assert got[40]["lang_pred"] == got[47]["lang_pred"] == "und" and got[46]["lang_pred"] == "fr" and 0 <= got[0]["score"] <= 1
    assert langid.language_mixture(docs.withColumn("held_out", langid.held_out()), langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(24)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).collect()
    assert len(got) == len(corpus()) and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    assert mixing.mixed(empty, labels).count() == 0


def test_role_repair(spark):
    c = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "assistant", "more"), (2, 0, "user", "q"), (2, 1, "user", None), (3, 0, None, "x"), (None, None, "system", "s")], "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in chat.repaired(c).orderBy("conv_id", "turn", "seq").collect():
        got[r["conv_id"]].append(r["role"])
    for roles in got.values():
        merged = [r for i, r in enumerate(roles) if i == 0 or r != roles[i - 1]]
        assert re.fullmatch("(s)?(ua)+", "".join(r[0] for r in merged))
    assert chat.repaired(c.limit(0)).count() == 0


def test_long_conversation_equals_one_block(spark, monkeypatch):
    rng = random.Random(2)
    turns = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), str(i)) for i in range(90)]
    c = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    unknown = sum(t[2] == "tool" for t in turns)

    def cost():
        n = collections.Counter(r["action"] for r in chat.repaired(c).collect())
        merged, changed = n["merge"] + n["relabel_merge"], n["relabel"] + n["relabel_merge"] - unknown
        return chat.INSERT * n["insert"] + chat.MERGE * merged + chat.RELABEL * changed + chat.UNKNOWN * unknown

    whole = cost()
    monkeypatch.setattr(chat, "BLOCK", 7)  # the cheapest repairs may differ, their cost may not
    assert cost() == whole


def test_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    records = [
        (1, "http://A.com/x#f", 10, "response", "e", None, "d", {"etag": "e", "content-length": "5"}), (2, "https://www.a.com/x", 9000, "revisit", "W/e", None, None, {"date": "now", "content-length": "0"}),
        (3, "a.com/x", 10, "revisit", None, None, None, None), (4, "a.com/x", 20, "revisit", "other", None, None, {}), (5, None, 20, "revisit", None, None, None, None), (6, "a.com/x", None, "revisit", None, None, None, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(records, schema)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {2: "resolved", 3: "no_response", 4: "conflict", 5: "no_response"}
    assert got[2]["headers"] == {"etag": "e", "content-length": "5", "date": "now"}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert corpus_pipeline.language_stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


def test_two_stage_order_sorts_suffixes():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 300), 0).astype(np.uint16)
    order = suffixes.two_stage_order(text, np.arange(300), 300)
    data = [text[i:].tolist() for i in order]
    assert data == sorted(data)


def test_spans_are_code_points(spark):
    d = spark.createDataFrame([(1, "éé😀 a@b.co")], "doc_id long, text string")
    r = pii.personal_data(d).select("email", pii.redact(None).alias("t")).first()
    assert (r["email"][0]["start"], r["email"][0]["end"], r["t"]) == (4, 10, "éé😀 <EMAIL>")


def test_long_texts_without_a_letter_have_no_language():
    model = langid.train([b"the cat and the dog"] * 9 + ["é".encode() * 40] * 9, ["en"] * 9 + ["fr"] * 9)
    signs = ["😀" * n for n in (5, 15, 16, 500)] + ["— " * 60, "٣٤٥" * 40, "😀" * 50 + "é", "é" * 60, "1 " * 90 + "the"]
    found = langid.predict(model, [t.encode() for t in signs])[0]
    assert found[:6] == ["und"] * 6 and found[6] != "und" and found[7:] == ["fr", "en"]


def test_stages_decide_by_row_where_ids_are_null_or_shared(spark):
    import corpus_pipeline

    rng = random.Random(7)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(5))
    rows_in = [(None, a, "en"), (None, b, "en"), (None, b, "en"), (7, c, "en"), (7, d, "en"), (8, d.upper(), "en"), (9, a, "en"), (None, e, "en"), (None, e.upper(), "en"), (None, "12 345", "en"), (5, "", "en"), (5, " ", "en"), (5, " ", "en"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows_in], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    kept = collections.Counter((r["doc_id"], r["text"].lower() if r["text"] else r["text"]) for r in got.collect())
    assert got.columns == docs.columns
    assert kept == collections.Counter([(9, a), (None, b), (7, c), (7, d), (None, e), (None, "12 345"), (5, ""), (5, " "), (5, " "), (None, None)])
    lingual = corpus_pipeline.language_stage(spark, docs, "")
    want = collections.Counter((i, t) for i, t, _ in rows_in if t and any(x.isalpha() for x in t))
    assert lingual.columns == docs.columns and rows(lingual.select("doc_id", "text")) == want


def test_overlapping_spans_leave_nothing_in_clear(spark):
    texts = ["at 10.0.0.0 4111 1111 1111 1111 x", "pay 4111 1111 1111 1111 01.2.3.4 now", "a 1.2.3.4 b", "+4111 1111 1111 111 1@b.co"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.personal_data(d)
    for r in found.select("text", *pii.KINDS, "ctx", pii.redact(found).alias("t")).collect():
        spans = [(s["start"], s["end"], k) for k in (*pii.KINDS, "ctx") for s in r[k]]
        covered = {i for a, b, _ in spans for i in range(a, b)}
        assert re.sub("<[A-Z]+>", "", r["t"]) == "".join(x for i, x in enumerate(r["text"]) if i not in covered), (r["text"], spans)
    got = [r["t"] for r in found.orderBy("doc_id").select(pii.redact(found).alias("t")).collect()]
    assert got[0] == "at <IP><CARD> x" and got[2] == "a <IP> b"


@pytest.mark.parametrize("copies", [1, 20])
def test_telling_words_are_found_in_small_and_large_tables(spark, copies):
    rng = random.Random(3)
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    base = [(" ".join(rng.choices(common, k=20)) + (" clown" if i < 8 else "") + (" scum" if 5 <= i < 12 else ""), int(i < 12)) for i in range(80)]
    made = [(k * 80 + i, t, toxic) for k in range(copies) for i, (t, toxic) in enumerate(base)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, toxic) for i, _, toxic in made], "doc_id long, quality int, toxic int")
    assert {"clown", "scum"} <= set(mixing.fit(docs, labels)["words"])
