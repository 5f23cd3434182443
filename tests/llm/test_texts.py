"""Look-alikes, copies, personal data, tokens, leaks and reading level against plain versions and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import copies, leaks, lookalike, pii, reading, tokens

RECORDS = "src string, id bigint, text string, g string"


def test_look_alike_classes_are_transitive():
    n = lookalike.default_normalizer().rewrite
    same = ["paypal café", "pаypal café", "ｐａｙｐａｌ　ｃａｆé", "pay​pal café"]
    assert len({n(t) for t in same}) == 1
    for a, b in [("Paypal", "paypal"), ("cafe", "café"), ("m2", "m²"), ("a b", "a  b"), ("a b", "a\tb"), ("'a'", "’a’"), ("a-b", "a–b")]:
        assert n(a) != n(b)
    assert n("oﬃce") == "office" and n("a‑b") == "a-b" and n("") == ""


def test_representatives_follow_frequency():
    assert lookalike.rewrite_table({"о": 5, "o": 1})["o"] == "о"
    assert lookalike.rewrite_table({"о": 1, "o": 5})["о"] == "o"


def test_same_look_pairs(spark):
    rows = [("a", 1, "cat", "x"), ("a", 2, "cаt", "x"), ("a", 3, "cat", "x"), ("b", 4, "cаt", "x"), ("a", 5, None, "x"), ("a", 6, " ", None), ("a", 7, "​", None), ("a", 2, "cаt", "x"), (None, 8, "cat", "x")]
    df = spark.createDataFrame(rows, RECORDS)
    got = sorted(map(tuple, lookalike.same_look_pairs(df, "src", "id", "text").collect()))
    assert got == [("a", 1, 2), ("a", 2, 3)]
    assert lookalike.same_look_pairs(df.limit(0), "src", "id", "text").count() == 0


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [("s", i, "".join(rng.choice(["a", "а", "b", " ", " "]) for _ in range(4)), "") for i in range(150)]
    n = lookalike.default_normalizer().rewrite
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] != b[2] and n(a[2]) == n(b[2]) and n(a[2]).strip()}
    got = {(r["id_a"], r["id_b"]) for r in lookalike.same_look_pairs(spark.createDataFrame(rows, RECORDS), "src", "id", "text").collect()}
    assert got == want


def test_a_frequent_spelling_is_dealt_out_and_classes_tell_the_pairs(spark):
    rows = [("s", i, "cat", "") for i in range(40)] + [("s", 100 + i, "cаt", "") for i in range(3)] + [("s", 200, "сat", ""), ("s", 300, "dog", ""), ("s", 301, "dog", "")]
    df = spark.createDataFrame(rows, RECORDS)
    text = {r[1]: r[2] for r in rows}
    want = {(a, b) for a in text for b in text if a < b and a < 300 and b < 300 and text[a] != text[b]}
    assert {(r["id_a"], r["id_b"]) for r in lookalike.same_look_pairs(df, "src", "id", "text", share=7).collect()} == want
    classes = {r["id"]: (r["class_id"], r["spelling_id"], r["n_spellings"]) for r in lookalike.look_classes(df, "src", "id", "text").collect()}
    assert classes == {i: (0, 0 if i < 100 else 100 if i < 200 else 200, 3) for i in text if i < 300}
    assert lookalike.look_classes(df.limit(0), "src", "id", "text").count() == 0


def test_more_scripts_and_numerals_look_alike():
    n = lookalike.default_normalizer().rewrite
    assert n("ꓐ") == n("B") and n("Ꮯ") == n("C") and n("Ⅻ") == "XII" and n("ⅿ") == "m" and n("Ⅰ") == n("I") and n("Ⲟ") == "O"


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Hello, World!", "hello world", True),
        ("Room 3.5 m", "room 35 m", False),
        ("1 2", "1  2", True),
        ("1 2", "1-2", False),
        ("1 - 2", "1-2", True),
        ("résumé", "resume", False),
        ("Переведите ЭТО", "переведите это", True),
        ("Γιατί αργεί", "ΓΙΑΤΊ ΑΡΓΕΊ", True),
        ("Straße", "STRASSE", True),
        ("task: x\ntone: y\naudience: z\nref: 1", '{"ref": "1", "TONE": "Y", "task": "x", "audience": "z"}', True),
        ("task=x | tone=y | audience=z | ref=1", "- tone: y\n- task: x\n- ref: 1\n- audience: z", True),
        ("task: x; tone: y; audience: z; ref: 1", "task: y; tone: x; audience: z; ref: 1", False),
        ("task: x; note: y", "note: y; task: x", True),
        ("aу", "ay", True),
    ],
)
def test_copy_keys(a, b, same):
    assert (copies.copy_key(a) == copies.copy_key(b)) is same


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("かき", "がき", False),
        ("はは", "ぱぱ", False),
        ("か\u3099き。", "が き", True),
        ("दिन", "दीन", False),
        ("มี", "มู", False),
        ("كَتَبَ", "كُتِبَ", False),
        ("காலை!", "காலை", True),
        ("hi \u2764\ufe0f", "hi \u2764", True),
    ],
)
def test_marks_of_all_scripts_count(a, b, same):
    assert (copies.copy_key(a) == copies.copy_key(b)) is same


def test_fields_of_any_name():
    a, b = '{"x": 1, "long name of a field that goes on and on and on and on": "Y"}', "long name of a field that goes on and on and on and on: y\nX: 1"
    assert copies.copy_key(a) == copies.copy_key(b)
    assert copies.copy_key("b: 2; a: 1") == copies.copy_key("a=1 | b=2")
    assert copies.copy_key("b: 2; a: 1", {"task"}) != copies.copy_key("a=1 | b=2", {"task"})
    assert copies.copy_key("Note: b a") != copies.copy_key("Note: a b")


def test_keys_of_plain_text_are_made_without_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(" aZ9 0.-_,:\n\t+'(") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([("a", i, t, "") for i, t in enumerate(texts)], RECORDS)
    for required in ((), ("a", "z")):
        got = {r["id"]: bytes(r["key"]) for r in copies.keyed_records(df, "src", "id", "text", required).collect()}
        import hashlib

        want = {i: hashlib.md5(k.encode()).digest() for i, t in enumerate(texts) if (k := copies.copy_key(t, required)) != "\x1d"}
        assert got == want


def test_buckets_follow_the_first_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", i, f"text {i}", "") for i in range(40)], RECORDS)
    ledger = copies.CopyLedger(spark, str(tmp_path / "l"), keys_per_bucket=2)
    ledger.add(copies.keyed_records(df, "src", "id", "text"))
    assert ledger.buckets == 20 and ledger.table().count() == 40


def test_ledger_adds_up_over_batches(spark, tmp_path):
    first = spark.createDataFrame([("a", 5, "Hi!", ""), ("a", 3, "hi", ""), ("a", 3, "hi", ""), ("a", 9, "other", "")], RECORDS)
    second = spark.createDataFrame([("a", 1, "HI", ""), ("b", 7, "hi", ""), ("a", 8, None, ""), ("a", 4, "", "")], RECORDS)
    keyed = [copies.keyed_records(x, "src", "id", "text") for x in (first, second)]
    ledger = copies.CopyLedger(spark, str(tmp_path / "l"), buckets=4)
    for k in (*keyed, keyed[0].limit(0)):
        ledger.add(k)
    assert sorted((r["grp"], r["first_id"], r["n"]) for r in ledger.table().collect()) == [("a", 1, 3), ("a", 9, 1), ("b", 7, 1)]
    found = copies.copies_of(keyed[0].unionByName(keyed[1]), ledger.table()).collect()
    assert sorted((r["first_id"], r["copy_id"]) for r in found) == [(1, 3), (1, 5)]


def test_a_reopened_ledger_goes_on(spark, tmp_path):
    first = spark.createDataFrame([("a", 5, "Hi!", ""), ("a", 3, "hi", ""), ("a", 9, "other", ""), ("a", 2, "left alone", "")], RECORDS)
    second = spark.createDataFrame([("a", 7, "HI", ""), ("a", 1, "Other", ""), ("b", 8, "hi", "")], RECORDS)
    keyed = [copies.keyed_records(x, "src", "id", "text") for x in (first, second)]
    copies.CopyLedger(spark, str(tmp_path / "l"), buckets=4).add(keyed[0])
    stale = copies.CopyLedger(spark, str(tmp_path / "l"))
    reopened = copies.CopyLedger(spark, str(tmp_path / "l"))
    assert reopened.buckets == 4 and reopened.table().count() == 3
    reopened.add(keyed[1])
    want = [("a", 1, 2), ("a", 2, 1), ("a", 3, 3), ("b", 8, 1)]
    for ledger in (reopened, copies.CopyLedger(spark, str(tmp_path / "l"))):
        assert sorted((r["grp"], r["first_id"], r["n"]) for r in ledger.table().collect()) == want
    with pytest.raises(Exception, match="exists"):
        stale.add(keyed[1])
    assert copies.CopyLedger(spark, str(tmp_path / "l")).table().count() == 4


PII = {
    1: ("My name is Ann Lee, mail ann@example.com", {"PERSON", "EMAIL"}),
    2: ("Call me at 555-123-4567 after six", {"PHONE"}),
    3: ("My SSN is 905-17-4877.", {"ID_NUMBER"}),
    4: ("I live at 12 Quarry Road, Port Ellory 11329.", {"ADDRESS"}),
    5: ("write to ann at example dot org", {"EMAIL"}),
    6: ("Order no. 77-4410-XK, version 10.0.19045, 2026-03-04", set()),
    7: ("", set()),
    8: ("Compare Spring Release with Autumn Release", set()),
    9: ("Contact person: Dr. Belberg", {"PERSON"}),
}


def test_personal_data(spark):
    filler = [(100 + i, f"My name is {n} {f}. Call me at +44 7700 9001{i:02d}. Email {n.lower()}@example.com. Version 1.{i}.20301 of case #2214{i:04d}7.") for i, (n, f) in enumerate((n, f) for n in ("Theo", "Greta", "Abel") for f in ("Norberg", "Varley", "Ostwick"))]
    df = spark.createDataFrame([*((k, v[0]) for k, v in PII.items()), (50, None), *filler], "id bigint, text string").withColumn("spans", F.lit(1))
    rows = pii.found_types(df, ["id"], "text").collect()
    for i, (_, want) in PII.items():
        assert {r["pii_type"] for r in rows if r["id"] == i} == want, i
    texts = {r["id"]: r["redacted"] for r in pii.redacted(df, ["id"], "text").collect()}
    assert texts[1] == "My name is [PERSON], mail [EMAIL]" and texts[50] is None and texts[7] == ""
    assert pii.found_types(df.limit(0), ["id"], "text").count() == 0


WIDE = {
    1: ("My driving licence is MORGA657054SM9IJ.", {"ID_NUMBER"}),
    2: ("Passport no. 12AB34567", {"ID_NUMBER"}),
    3: ("Pasaporte: AAA123456, gracias", {"ID_NUMBER"}),
    4: ("My national ID is 123456789012, thanks", {"ID_NUMBER"}),
    5: ("My passport expires 2031-03-04.", set()),
    6: ("Order MORGA657054SM9IJ is late.", set()),
    7: ("My name is Anna.", {"PERSON"}),
    8: ("Ich heiße Wexley und brauche Hilfe", {"PERSON"}),
    9: ("My name is not important", set()),
}


def test_any_shape_behind_a_cue_is_proposed(spark):
    filler = [(100 + i, f"My name is {n} {f}. My passport number is X{1234567 + i}. Order no. {w[0]}{7654321 + i} of {w} Release.") for i, (n, f, w) in enumerate((n, f, w) for n in ("Theo", "Greta", "Abel") for f in ("Norberg", "Varley", "Ostwick") for w in ("Python", "Linux", "Baking"))]
    df = spark.createDataFrame([*((k, v[0]) for k, v in WIDE.items()), *filler], "id bigint, text string")
    rows = pii.found_types(df, ["id"], "text").collect()
    assert {i: {r["pii_type"] for r in rows if r["id"] == i} for i in WIDE} == {i: want for i, (_, want) in WIDE.items()}


def probe_scores(model, lines):
    """(type -> precision, type -> recall) of the classifier on probe sentences, by types found."""
    from collections import Counter

    rewrite, lexicon = lookalike.default_normalizer().rewrite, pii.default_lexicon()
    hit, found, wanted = Counter(), Counter(), Counter()
    for line in lines:
        types, text = line.rstrip("\n").split("\t")
        want = set(types.split(",")) - {""}
        got = {c[0] for c in pii.candidates(rewrite(text), lexicon) if model.score(pii.pattern(c[0], c[3], c[4])) >= 0.5}
        hit.update(got & want)
        found.update(got)
        wanted.update(want)
    return {k: hit[k] / found[k] for k in pii.TYPES}, {k: hit[k] / wanted[k] for k in pii.TYPES}


def test_probe_sentences(spark, tmp_path):
    """A model learned from the tables, saved and loaded, finds at least nine in ten on sentences of another origin."""
    import os
    from pathlib import Path

    if not (os.path.exists("/root/testdata/sf0.01") and os.path.exists(pii.VOCABULARIES[0])):
        pytest.skip("no tables or vocabulary here")
    texts = lookalike.session_texts(spark, "/root/testdata/sf0.01").where("text is not null")
    pii.learn(pii.proposed(texts, "text")).save(spark, str(tmp_path / "m"))
    model = pii.SpanModel.load(spark, str(tmp_path / "m"))
    with open(Path(__file__).with_name("probe.tsv"), encoding="utf8") as f:
        precision, recall = probe_scores(model, list(f))
    assert min(precision.values()) >= 0.9 and min(recall.values()) >= 0.9, (precision, recall)


def test_a_model_scores_patterns_it_has_not_seen():
    model = pii.fit([("EMAIL|++++|10", 50), ("EMAIL|-0--|00", 50), ("EMAIL|+00+|10", 10)])
    assert model.score("EMAIL|++0+|10") > 0.5 > model.score("EMAIL|-0-0|00") and model.score("PHONE|+++++|111") == 0


def test_redaction_leaves_the_rest_as_it_was(spark):
    model = pii.fit([("EMAIL|++++|10", 50), ("EMAIL|+0++|10", 50), ("EMAIL|-0--|00", 50)])
    texts = {
        "Пожалуйста, напишите на anna@example.com — спасибо, Ελλάδα": "Пожалуйста, напишите на [EMAIL] — спасибо, Ελλάδα",
        "e\u0301te\u0301 et аnnа＠exаmple.com\u200b, cafe\u0301": "e\u0301te\u0301 et [EMAIL], cafe\u0301",
        "oﬃce ﬁle bob@example.com ﬁn": "oﬃce ﬁle [EMAIL] ﬁn",
        "Привет, мир": "Привет, мир",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert [r["redacted"] for r in pii.redacted(df, ["id"], "text", model).orderBy("id").collect()] == list(texts.values())


def test_check_digits():
    good = ("046 454 286", "111222333", "529.982.247-25", "44051401359", "86 095 742 719", "12345678Z", "X1234567L", "2 69 05 49 588 157 80", "234567890124")
    assert [pii.checked(x) for x in good] == [True] * len(good)
    assert not any(map(pii.checked, ("111222335", "12345678A", "44051401358", "", "abc")))


def test_reliability_estimates_recover_good_labelers():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    good = np.where(rng.random(4000) < 0.95, truth, ~truth)
    fair = np.where(rng.random(4000) < 0.8, truth, ~truth)
    other = np.where(rng.random(4000) < 0.85, truth, ~truth)
    votes = np.stack([good, fair, other], 1) * 2 - 1
    p, table, prior = pii.estimate_reliability(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.93 and abs(prior - 0.4) < 0.05
    assert table[0, 2, 1] > table[1, 2, 1]


TEXTS = ["Hello  world\n\n  it's 42", "", None, "naïve café 日本語   end ", "a" * 5000, "<|endoftext|> plain", "Hello  world\n\n  it's 42", "\t\r\n"]


def test_token_ids_equal_the_library(spark):
    import os

    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)] + [(None, "x y", 1)], "doc_id bigint, text string, block int")
    out = tokens.encode(df).cache()
    ids = {r["doc_id"]: r["ids"] for r in out.collect()}
    for i, x in enumerate(TEXTS):
        assert ids[i] == t.encode(x or "", add_special_tokens=False).ids
    assert len(ids) == len(TEXTS) + 1
    assert {r["doc_id"]: r["text"] for r in tokens.decode(out).collect() if r["doc_id"] is not None} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab + ["zzz", "q1"]) for _ in range(rng.randint(0, 30))]
        source = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(source) - 13))
        words[5:5] = source[a : a + rng.choice([8, 11, 12, 20])]
        docs.append((d, "\n+ // ".join(w.upper() if rng.random() < 0.3 else w for w in words)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items for w in [t.split()]}
    want = set()
    for d, t in docs:
        w = leaks.words_of(t or "")
        want |= {(d, i) for i, g in grams.items() if any(tuple(w[k : k + 12]) in g for k in range(len(w) - 11))}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (900, None)], "item_id bigint, text string")
    for shard in (2_000_000, 100):
        assert {tuple(r) for r in leaks.leaks(df, bench, shard_words=shard).collect()} == want
    assert want and leaks.leaks(df, bench.limit(0)).count() == 0


def test_wand_is_complete_and_skips_postings():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(30))) for i in range(400)]
    index = leaks.ItemIndex(items, block=8)
    read = 0
    for _ in range(150):
        query = [rng.randrange(len(index.vocabulary)) for _ in range(rng.randint(12, 30))]
        source = leaks.words_of(rng.choice(items)[1])
        query += [index.vocabulary[w] for w in source[3:17]]
        score = {}
        for t in set(query):
            read += len(index.docs[t])
            for d, x in zip(index.docs[t], index.impacts[t]):
                score[d] = score.get(d, 0) + x
        assert index.retrieve(query) == sorted(d for d, x in score.items() if x >= 1)
    assert 0 < index.scored < 0.5 * read


EASY = "The dog ran to the big red box. It sat down by the box. We saw the dog eat. "
HARD = "Notwithstanding considerable architectural heterogeneity, contemporary implementations necessarily accommodate transactional synchronization. "
MIDDLE = "This change updates the parser so that the old session is closed before the next request begins, which keeps the report small. "


def message(body):
    return f"commit abcdef0123\nAuthor: A <a@b.c>\nDate: now\n\n    subject\n\n    {body}\n\n    Signed-off-by: A <a@b.c>\n\ndiff --git a/x b/x\n+ much more text here"


def test_reading_levels(spark):
    import random as r

    rng = r.Random(2)
    docs, labels = [], []
    for i in range(90):
        level = i % 3
        docs.append((i, message(" ".join([(EASY, MIDDLE, HARD)[level]] * rng.randint(7, 10)))))
        if i % 2:
            labels.append((i, level + 1))
    docs += [(900, None), (901, ""), (902, message(EASY)), (903, message("> " + HARD * 9)), (904, message("Der Hund ist nicht im Haus und die Katze ist auf dem Dach. " * 12))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x["doc_id"]: x["reading_level"] for x in reading.reading_levels(df, spark.createDataFrame(labels, "doc_id bigint, reading_level int")).collect()}
    assert got == {i: i % 3 + 1 for i in range(90)}
    rated = spark.createDataFrame(labels, "doc_id bigint, reading_level int")
    import tempfile

    folder = tempfile.mkdtemp()
    reading.fit_levels(reading.document_features(df, "doc_id", "text"), rated, "doc_id", "reading_level", sample=30, pairs=500).save(spark, folder)
    again = reading.reading_levels(df, None, model=reading.LevelModel.load(spark, folder))
    assert {x["doc_id"]: x["reading_level"] for x in again.collect()} == got
    empty = spark.createDataFrame([], "doc_id bigint, reading_level int")
    assert {x["reading_level"] for x in reading.reading_levels(df, empty).collect()} == {2}
    assert reading.reading_levels(df.limit(0), empty).count() == 0


def test_isotonic_is_monotone():
    import numpy as np

    ends, fitted = reading.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 5]))
    assert list(fitted) == sorted(fitted) and list(ends) == sorted(ends)
