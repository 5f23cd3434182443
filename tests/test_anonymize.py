"""Golden values of detection, overlap resolution, rewriting, restoring and reports."""

import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions import detectors, report, rewrite
from veilspark.functions.policy import Policy, load_policy, validate_policy
from veilspark.functions.resolve import resolve

GOLDENS = [
    ("Hi, I'm John Smith and my email is john.smith@example.com", "Hi, I'm [NAME_1] and my email is [EMAIL_1]", {"[NAME_1]": "John Smith", "[EMAIL_1]": "john.smith@example.com"}),
    ("Please call me at 555-123-4567 or email jane.doe@company.org", "Please call me at [PHONE_1] or email [EMAIL_1]", {"[PHONE_1]": "555-123-4567", "[EMAIL_1]": "jane.doe@company.org"}),
    ("My SSN is 123-45-6789 and my credit card is 4532 1234 5678 9010", "My SSN is [PHONE_1] and my credit card is [PHONE_2]", {"[PHONE_1]": "123-45-6789", "[PHONE_2]": "4532 1234 5678 9010"}),
    ("The server is accessible at 192.168.1.100", "The server is accessible at [IP_1]", {"[IP_1]": "192.168.1.100"}),
    ("Hello, this is a message without any PII", "Hello, this is a message without any PII", {}),
    ("", "", {}),
    ("Email test@example.com twice: test@example.com", "Email [EMAIL_1] twice: [EMAIL_2]", {"[EMAIL_1]": "test@example.com", "[EMAIL_2]": "test@example.com"}),
    ("12345678 4532-1234-5678-9010 1.2.3.4", "[PHONE_1].2.3.4", {"[PHONE_1]": "12345678 4532-1234-5678-9010 1"}),
    ("a@b.com_x@y.com", "[EMAIL_1][EMAIL_2]", {"[EMAIL_1]": "a@b.com", "[EMAIL_2]": "_x@y.com"}),
    ("\U0001f4a9 john@x.io \U0001f4a9 555-123-4567", "\U0001f4a9 [EMAIL_1] \U0001f4a9 [PHONE_1]", {"[EMAIL_1]": "john@x.io", "[PHONE_1]": "555-123-4567"}),
    ("Bar Foo", "[NAME_1]", {"[NAME_1]": "Bar Foo"}),
    ("éBar Foo x", "éBar Foo x", {}),
    ("éBar Foo Baré Qux", "é[NAME_1]́ Qux", {"[NAME_1]": "Bar Foo Bare"}),
    ("John  Smith\nJane\tDoe", "[NAME_1]", {"[NAME_1]": "John  Smith\nJane\tDoe"}),
]


def test_goldens_and_restore(frame):
    df = frame([(i, g[0]) for i, g in enumerate(GOLDENS)], "i int, t string").withColumn("a", rewrite.anonymize(F.col("t")))
    rows = df.select("i", "a.text", "a.entries", rewrite.deanonymize_entries(F.col("a.text"), F.col("a.entries")).alias("back")).collect()
    for r in rows:
        text, want, mapping = GOLDENS[r["i"]]
        assert r["text"] == want
        assert {e["placeholder"]: e["original"] for e in r["entries"]} == mapping
        assert r["back"] == text


def test_null_text_gives_nulls(frame):
    r = frame([(None,)], "t string").select(rewrite.anonymize(F.col("t")).alias("a"), detectors.detect(F.col("t")).alias("s")).first()
    assert r["a"]["text"] is None and r["s"] is None


def test_policy_filter_comes_after_overlap(frame):
    policy = Policy("partial", {k: v for k, v in load_policy("default_pii").placeholders.items() if k != "PHONE"})
    df = frame([("SSN: 123-45-6789",)], "t string")
    assert df.select(rewrite.anonymize(F.col("t"), policy)["text"]).first()[0] == "SSN: 123-45-6789"
    assert df.select(rewrite.anonymize(F.col("t"), policy, policy_first=True)["text"]).first()[0] == "SSN: [SSN_1]"
    assert df.select(rewrite.anonymize(F.col("t"), overlap="none")["text"]).first()[0] == "SSN: [PHONE_1][SSN_1]"


def test_values_can_share_numbers(frame):
    df = frame([("a@b.com c@d.com a@b.com",)], "t string")
    assert df.select(rewrite.anonymize(F.col("t"), dedupe_values=True)["text"]).first()[0] == "[EMAIL_1] [EMAIL_2] [EMAIL_1]"


ENHANCED = {
    "+1-555-123-4567": [("PHONE", 0, 15, 0.85)],
    "+44 20 7123 4567": [("PHONE", 0, 3, 0.90)],
    "Contact: john.smith@example.com": [("EMAIL", 9, 31, 1.0)],
    "IBAN GB29NWBK60161331926819, MAC 00:1A:2B:3C:4D:5E": [("MAC_ADDRESS", 33, 50, 1.0), ("IBAN", 5, 27, 0.95)],
    "Dr. John Smith, MRN-123456, DOB 1985-03-15, NI AB 12 34 56 C": [("NIN_UK", 47, 60, 1.0), ("PERSON", 0, 14, 0.95), ("MRN", 16, 26, 0.95), ("PHONE", 32, 42, 0.70)],
    "Card 4532-1234-5678-9010 amex 3782 822463 10005 pass C12345678": [("CREDIT_CARD", 5, 24, 0.95), ("CREDIT_CARD", 30, 47, 0.95), ("PASSPORT", 53, 62, 0.90)],
    "SSN 123-45-6789 EIN 12-3456789": [("SSN", 4, 15, 1.0), ("EIN", 20, 30, 0.90)],
    "Send to: 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa": [("CRYPTO_ADDRESS", 9, 43, 0.95)],
}


def test_enhanced_detector(frame):
    rows = frame([(t,) for t in ENHANCED], "t string").select("t", detectors.detect(F.col("t"), ("enhanced_regex",)).alias("s")).collect()
    for r in rows:
        assert [(x["entity_type"], x["start"], x["end"], x["confidence"]) for x in r["s"]] == ENHANCED[r["t"]]


def test_unknown_detector_is_refused():
    with pytest.raises(ValueError):
        detectors.detector("no such")


def _merge_fold(spans):
    out = []
    for s in sorted(spans, key=lambda x: (x[1], x[2], x[3])):
        for i, a in enumerate(out):
            if a[0] == s[0] and not (a[2] <= s[1] or s[2] <= a[1]):
                c = (a[4] + s[4]) / 2 if a[4] and s[4] else a[4] or s[4]
                out[i] = (a[0], min(a[1], s[1]), max(a[2], s[2]), a[3], c)
                break
        else:
            out.append(s)
    return sorted(out, key=lambda x: (x[1], x[2], x[3]))


def _scan_fold(spans, better):
    out = []
    for s in sorted(spans, key=lambda x: (x[1], x[2], x[3])):
        hit = next((a for a in out if not (a[2] <= s[1] or s[2] <= a[1])), None)
        if hit is None:
            out.append(s)
        elif better(s, hit):
            out.remove(hit)
            out.append(s)
    return sorted(out, key=lambda x: (x[1], x[2], x[3]))


def test_resolution_equals_plain_folds(spark):
    import random

    rng = random.Random(3)
    lists = []
    for i in range(300):
        spans = []
        for o in range(rng.randint(0, 9)):
            a = rng.randint(0, 30)
            spans.append((rng.choice("AB"), a, a + rng.randint(1, 9), o, rng.choice([None, 0.0, 0.5, 0.9])))
        lists.append((i, spans))
    schema = "i int, s array<struct<entity_type:string,start:int,end:int,ord:int,confidence:double>>"
    df = spark.createDataFrame(lists, schema).withColumn("t", F.repeat(F.lit("x"), 60))
    full = F.transform("s", lambda x: F.struct(x["start"], x["end"], x["ord"], x["entity_type"], F.lit("").alias("text"), x["confidence"]))
    want = {
        "longest_match": lambda s: _scan_fold(s, lambda a, b: a[2] - a[1] > b[2] - b[1]),
        "highest_confidence": lambda s: _scan_fold(s, lambda a, b: (1 if a[4] is None else a[4]) > (1 if b[4] is None else b[4])),
        "first_detector": lambda s: _scan_fold(s, lambda a, b: False),
        "merge": _merge_fold,
    }
    for name, fold in want.items():
        got = {r["i"]: [(x["entity_type"], x["start"], x["end"]) for x in r["r"]] for r in df.select("i", resolve(full, F.col("t"), name).alias("r")).collect()}
        for i, spans in lists:
            assert got[i] == [x[:3] for x in fold(spans)], (name, spans)


REPORTS = [
    (GOLDENS[0][0], {"EMAIL": 1, "PERSON": 1}, 57, 32, 0.561404, "high"),
    (GOLDENS[2][0], {"PHONE": 2, "CREDIT_CARD": 1, "SSN": 1}, 63, 60, 0.952381, "critical"),
    (GOLDENS[3][0], {"IP_ADDRESS": 1}, 41, 13, 0.317073, "high"),
    (GOLDENS[4][0], {}, 40, 0, 0.0, "low"),
]


def test_reports(frame):
    df = frame([(r[0],) for r in REPORTS], "t string").withColumn("r", report.report(F.col("t"), detectors.detect(F.col("t")), True))
    rows = {r["t"]: r for r in df.select("t", "r", report.report_text(F.col("r")).alias("p"), report.report_html(F.col("r")).alias("h")).collect()}
    for text, summary, total, pii, coverage, risk in REPORTS:
        r = rows[text]["r"]
        assert (r["summary"], r["total_chars"], r["pii_chars"], round(r["coverage"], 6), r["risk"]) == (summary, total, pii, coverage, risk)
        assert f"Risk Level: {risk.upper()}" in rows[text]["p"] and risk.upper() in rows[text]["h"]


def test_policies(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text(json.dumps({"name": "mine", "entities": {"EMAIL": {"placeholder": "<{i}>"}, "PHONE": {}}}))
    policy = load_policy(str(path))
    assert policy.placeholders == {"EMAIL": "<{i}>"} and validate_policy(policy) == []
    with pytest.raises(FileNotFoundError):
        load_policy("missing")


def test_long_runs_are_linear(frame):
    text = "a" * 200_000
    assert frame([(text,)], "t string").select(rewrite.anonymize(F.col("t"))["text"]).first()[0] == text


def test_same_placeholder_last_original_wins(frame):
    entries = "array(named_struct('placeholder','[REDACTED]','original','1'),named_struct('placeholder','[REDACTED]','original','2'))"
    m = frame([(1,)], "i int").select(F.map_from_entries(F.expr(f"transform({entries}, e -> named_struct('key', e.placeholder, 'value', e.original))"))).first()[0]
    assert m == {"[REDACTED]": "2"}
