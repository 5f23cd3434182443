"""Strategies, store, limits, conversation, evaluation, sources, hooks and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import report, strategies
from veilspark.operators import conversation, evaluate, hooks, limits, scan, store
from veilspark.sources import readers, sinks
from veilspark.streaming import text as streams


@pytest.mark.parametrize(
    "kind,first,last,value,want",
    [
        ("structured", 0, 0, "john@example.com", "****@*******.***"),
        ("structured", 1, 0, "john@example.com", "j***@*******.***"),
        ("structured", 0, 4, "555-123-4567", "***-***-4567"),
        ("structured", 2, 2, "abc", "abc"),
        ("structured", 0, 0, "", ""),
        ("simple", 1, 3, "john@example.com", "j************com"),
        ("simple", 2, 2, "abc", "***"),
    ],
)
def test_masks(frame, kind, first, last, value, want):
    mask = strategies.mask_structured if kind == "structured" else strategies.mask_simple
    assert frame([(value,)], "v string").select(mask(F.col("v"), first, last)).first()[0] == want


def test_hash_encrypt_synthetic(frame):
    df = frame([("john@example.com",)], "v string")
    assert df.select(strategies.hash_value(F.col("v"), salt="s", truncate=16)).first()[0] == "65f104221c05d82a"
    assert df.select(strategies.hash_value(F.col("v"), "md5")).first()[0] == "d4c74594d841139328695756648b6bd6"
    key = F.lit("0123456789abcdef")
    assert df.select(strategies.decrypt_value(strategies.encrypt_value(F.col("v"), key), key)).first()[0] == "john@example.com"
    made = df.select(strategies.synthetic_value(F.lit("EMAIL"), F.col("v")).alias("a"), strategies.synthetic_value(F.lit("EMAIL"), F.col("v")).alias("b")).first()
    assert made["a"] == made["b"] and "@example." in made["a"]


def test_upsert_changes_only_the_expiry(frame):
    schema = "session_id string, user_id string, created_at int, expires_at int"
    old = frame([("a", "u", 1, 10), ("b", "v", 1, 11)], schema)
    new = frame([("a", "other", 5, 20), ("a", "other", 4, 30), ("c", "w", 2, 12)], schema)
    assert sorted(map(tuple, store.upsert_sessions(old, new).collect())) == [("a", "u", 1, 20), ("b", "v", 1, 11), ("c", "w", 2, 12)]
    assert sorted(map(tuple, store.upsert_sessions(old, new.limit(0)).collect())) == [("a", "u", 1, 10), ("b", "v", 1, 11)]


def test_session_mapping_and_cascade(frame):
    sessions = frame([("a",), ("b",)], "session_id string")
    mappings = frame([("a", 0, "[X]", "1"), ("a", 1, "[X]", "2"), ("z", 0, "[Y]", "3")], "session_id string, position int, placeholder string, original string")
    assert [(r[0], r[1]) for r in store.session_mappings(sessions, mappings).collect()] == [("a", {"[X]": "2"})]
    assert [r[0] for r in store.orphan_sessions(sessions, mappings).collect()] == ["b"]
    assert store.without_sessions(mappings, sessions).count() == 1


def test_fixed_window_and_quota(frame):
    rows = [(i, "u", f"2026-01-01 00:00:{10 + i}") for i in range(5)] + [(9, None, "2026-01-01 00:00:00"), (10, "t", "2026-01-01 00:00:00")]
    df = frame(rows, "id int, who string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    out = {r["id"]: (r["allowed"], r["remaining"]) for r in limits.fixed_window(df, "who", "at", "id", 2, 1, "minute", ("t",)).collect()}
    assert out == {0: (True, 1), 1: (True, 0), 2: (True, 0), 3: (False, 0), 4: (False, 0), 9: (True, None), 10: (True, None)}


def test_conversation_numbering_restores(frame):
    turns = frame([("c", 1, "I am Ann Lee, a@b.com"), ("c", 2, "Bob Ray and c@d.com, e@f.com"), ("d", 1, None)], "conv string, turn int, text string")
    done = conversation.restore_turns(conversation.anonymize_conversation(turns, "conv", "turn", "text"), "anonymized", "entries").collect()
    by = {(r["conv"], r["turn"]): r for r in done}
    assert by[("c", 2)]["anonymized"] == "[NAME_2] and [EMAIL_2], [EMAIL_3]"
    assert by[("c", 2)]["restored"] == "Bob Ray and c@d.com, e@f.com" and by[("d", 1)]["restored"] is None


def test_cumulative_mapping(frame):
    rows = [("c", 1, [("[A_1]", "x"), ("[B_1]", "y")]), ("c", 2, []), ("c", 3, [("[A_1]", "z"), ("[A_1]", "w"), ("[C_1]", "v")]), ("d", 1, None)]
    df = frame(rows, "conv string, turn int, entries array<struct<placeholder:string,original:string>>")
    got = {(r["conv"], r["turn"]): list(r["known"].items()) for r in conversation.cumulative_entries(df, "conv", "turn", "entries").collect()}
    first = [("[A_1]", "x"), ("[B_1]", "y")]
    assert got == {("c", 1): first, ("c", 2): first, ("c", 3): [("[A_1]", "w"), ("[B_1]", "y"), ("[C_1]", "v")], ("d", 1): []}


def test_bodies(frame):
    body = '{"messages": [{"role": "user", "content": "mail a@b.com"}, {"role": "system", "content": null}]}'
    r = frame([(body,)], "b string").select(conversation.anonymize_body(F.col("b")).alias("x")).first()["x"]
    assert r["messages"][0]["content"] == "mail [EMAIL_1]" and r["entries"][0]["original"] == "a@b.com"
    response = '{"choices": [{"message": {"content": "to [EMAIL_1]"}}]}'
    out = frame([(response,)], "b string").select(conversation.restore_response(F.col("b"), F.create_map(F.lit("[EMAIL_1]"), F.lit("a@b.com")))).first()[0]
    assert out == "to a@b.com"


def test_scores(frame):
    df = frame([(["A", "B"], ["A", "C"]), (None, []), ([], ["A"])], "e array<string>, d array<string>").withColumn("c", evaluate.confusion(F.col("e"), F.col("d")))
    r = evaluate.scores(df, "c", []).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"]) == (1, 2, 1, 1 / 3)
    empty = evaluate.scores(df.limit(0), "c", []).first()
    assert (empty["tp"], empty["f1"]) == (0, 0.0)


def test_scan_files_and_sinks(spark, tmp_path, frame):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("mail a@b.com")
    (tmp_path / "sub" / "b.txt").write_text("nothing")
    (tmp_path / "c.log").write_text("c@d.com")
    files = readers.read_text_files(spark, str(tmp_path), recursive=True)
    t = scan.scan_totals(scan.scan(files, "path", "text")).first()
    assert (t["files"], t["files_with_pii"], t["entities"]) == (2, 1, 1)
    sinks.write_text(files, "text", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="blank input"):
        readers.require_text(frame([(" ",)], "t string"), "t").collect()


def test_sensitive_fields(frame):
    m = frame([({"user_Email": "x", "note": "y"},)], "m map<string,string>").select(report.without_sensitive_fields(F.col("m"))).first()[0]
    assert m == {"note": "y"}


def test_hooks_are_isolated(frame):
    seen, h = [], hooks.Hooks()
    h.register(hooks.Event.AFTER_DETECT, lambda df: 1 / 0)
    h.register(hooks.Event.AFTER_DETECT, lambda df: df.where("i > 1"))
    h.register(hooks.Event.ERROR, lambda df: seen.append(1))
    assert h.trigger(hooks.Event.AFTER_DETECT, frame([(1,), (2,)], "i int")).count() == 1 and seen == [1]


def test_streams(spark, tmp_path):
    chunks = [("k", 1, " reach me at", False), ("k", 0, "x" * 90, False), ("k", 2, " a@b.com", True)]
    spark.createDataFrame(chunks, "key string, seq int, text string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, seq int, text string, last boolean").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    parts = streams.anonymize_stream(streams.buffered_chunks(source, "key", "seq", "text", "last", timeout_ms=None), "text")
    assert [r["anonymized"] for r in sorted(run(parts, "parts"), key=lambda r: r["part"])] == ["x" * 90 + " reach me at", " [EMAIL_1]"]
    split = [("k", 0, "to [EMA", False), ("k", 1, "IL_1] now", True)]
    spark.createDataFrame(split, "key string, seq int, text string, last boolean").coalesce(1).write.parquet(str(tmp_path / "cut"))
    source = spark.readStream.schema("key string, seq int, text string, last boolean").parquet(str(tmp_path / "cut"))
    rows = run(streams.joined_placeholders(source, "key", "seq", "text", "last", timeout_ms=None), "whole")
    assert [r["text"] for r in sorted(rows, key=lambda r: r["seq"])] == ["to ", "[EMAIL_1] now"]


def test_command_line(spark, tmp_path, capsys):
    from veilspark import cli

    (tmp_path / "a.txt").write_text("mail a@b.com")
    (tmp_path / "m.json").write_text('{"[EMAIL_1]": "a@b.com"}')
    (tmp_path / "b.md").write_text("mail [EMAIL_1]")
    assert cli.main(["scan", str(tmp_path)]) == 0 and cli.main(["anonymize", str(tmp_path)]) == 0
    assert cli.main(["detect", str(tmp_path)]) == 0 and cli.main(["list-policies"]) == 0 and cli.main(["validate-policy", "pci_dss"]) == 0
    assert cli.main(["deanonymize", str(tmp_path), "--pattern", "*.md", "--mapping", str(tmp_path / "m.json")]) == 0
    out = capsys.readouterr().out
    assert '"entities": 1' in out and "mail [EMAIL_1]" in out and "Total Entities: 1" in out and "hipaa_phi" in out and "mail a@b.com" in out


def test_idle_gaps_and_percentiles_equal_plain_ones(spark):
    import datetime
    import random

    import numpy as np

    from veilspark.operators import audit, limits

    rng = random.Random(6)
    start = datetime.datetime(2026, 1, 1, 22)
    rows = [(rng.choice("abc"), start + datetime.timedelta(minutes=rng.randint(0, 6000)), rng.choice([1.0, 2.0, -3.5, 0.0, 1e6, rng.random()])) for _ in range(600)]
    df = spark.createDataFrame(rows, "who string, at timestamp_ntz, v double")
    want = set()
    for who in "abc":
        times = sorted(t for w, t, _ in rows if w == who)
        run = [times[0]]
        for t in times[1:] + [None]:
            if t is not None and t - run[-1] < datetime.timedelta(hours=1):
                run.append(t)
                continue
            want.add((who, run[0], run[-1], len(run)))
            run = [t]
    assert {(r["who"], r["started"], r["ended"], r["hits"]) for r in limits.idle_gap_sessions(df, "who", "at", "3600 seconds").collect()} == want
    for r in audit.latency_percentiles(df, "v", ["who"]).collect():
        own = [v for w, _, v in rows if w == r["who"]]
        for p in (50, 95, 99):
            assert abs(r[f"p{p}"] - np.percentile(own, p)) < 1e-9


def test_fields_of_nodes_are_restored(frame):
    df = frame([("[A_1] and [A_2]", [("see [A_2]", 1), (None, 2)], [("[A_1]", "x"), ("[A_2]", "y")])], "t string, n array<struct<text:string,k:int>>, e array<struct<placeholder:string,original:string>>")
    from veilspark.functions.rewrite import deanonymize_fields

    r = df.select(deanonymize_fields(F.struct("t", "n"), ("t", "n.[].text"), F.col("e")).alias("r")).first()["r"]
    assert r["t"] == "x and y" and [tuple(x) for x in r["n"]] == [("see y", 1), (None, 2)]


def test_scanned_files_keep_their_errors(spark, tmp_path):
    from veilspark.sources import readers

    (tmp_path / "a.txt").write_text("mail a@b.com")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00bad")
    rows = {r["path"][-5:]: (r["text"], r["error"]) for r in readers.scan_directory(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("mail a@b.com", None), "b.txt": (None, "not valid UTF-8")}


def test_long_rows_take_linear_time(spark):
    import time

    from veilspark.functions.rewrite import anonymize

    df = spark.range(1).select(F.repeat(F.lit("call 123-456-7890 é "), 20_000).alias("t")).select(anonymize(F.col("t")).alias("a"))
    began = time.time()
    r = df.select(F.size("a.entries").alias("n"), F.right("a.text", F.lit(16)).alias("end")).first()
    assert r["n"] == 20_000 and r["end"] == " [PHONE_20000] é " [-16:] and time.time() - began < 60


def test_standard_input_is_one_text(spark):
    import io

    from veilspark.sources import readers

    assert readers.read_stdin(spark, io.StringIO("a@b.com\n")).first()["text"] == "a@b.com\n"
    with pytest.raises(ValueError, match="blank"):
        readers.read_stdin(spark, io.StringIO("  \n"))


def test_event_queries(spark):
    from veilspark.operators import events

    rows = spark.createDataFrame([(1, "s", "u", "SSN", 2, "2026-01-01"), (2, "s", "v", "EMAIL", 9, "2026-01-02"), (3, None, "u", "EMAIL", 1, "2026-01-03")], "id long, session_id string, user_id string, t string, n int, at string")
    severity = F.when(F.col("t") == "SSN", "CRITICAL").when(F.col("n") > 5, "high").otherwise("low")
    log = events.event_rows(rows, F.lit("pii_detected"), severity, F.struct("t", "n"), "id", "at")
    assert [r["id"] for r in events.query_events(log, limit=2).collect()] == [3, 2]
    assert [r["id"] for r in events.query_events(log, least_severity="high", user_id="u").collect()] == [1]
    assert events.query_events(log, F.lit("2026-01-02"), session_id="s").first()["details"] == '{"t":"EMAIL","n":9}'


def test_release_deletes_what_was_written(spark):
    import os

    from veilspark.sources import storage

    df = storage.written(spark.range(3), "probe")
    path = df.inputFiles()[0].replace("file://", "")
    assert df.count() == 3 and os.path.exists(path) and storage.release(spark) >= 1 and not os.path.exists(path)
