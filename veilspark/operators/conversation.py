"""Chat bodies, responses and mappings that build up over a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions.spans import let
from veilspark.functions.rewrite import ENTRIES, anonymize, deanonymize, deanonymize_entries

MESSAGES = "array<struct<role:string,content:string>>"
#: The places of a response body that hold generated text.
RESPONSE_PATHS = ("$.choices[0].message.content", "$.choices[0].text", "$.content[0].text", "$.completion")


def anonymize_messages(messages: Column, **options) -> Column:
    """Struct (messages, entries): every content rewritten; numbering restarts per message, entries are joined in order."""
    rewritten = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), anonymize(m["content"], **options).alias("a")))
    return let(
        rewritten,
        lambda done: F.struct(
            F.transform(done, lambda m: F.struct(m["role"].alias("role"), m["a"]["text"].alias("content"))).alias("messages"),
            F.flatten(F.transform(done, lambda m: F.coalesce(m["a"]["entries"], F.array().cast(ENTRIES)))).alias("entries"),
        ),
    )


def anonymize_body(body: Column, **options) -> Column:
    """Struct (messages, prompt, entries) of a JSON request body with ``messages`` or ``prompt``."""
    def done(parsed: Column) -> Column:
        chat = anonymize_messages(F.coalesce(parsed["messages"], F.array().cast(MESSAGES)), **options)
        return let(F.struct(chat.alias("chat"), anonymize(parsed["prompt"], **options).alias("single")), joined)

    def joined(both: Column) -> Column:
        entries = F.concat(both["chat"]["entries"], F.coalesce(both["single"]["entries"], F.array().cast(ENTRIES)))
        return F.struct(both["chat"]["messages"].alias("messages"), both["single"]["text"].alias("prompt"), entries.alias("entries"))

    return let(F.from_json(body, f"messages {MESSAGES}, prompt string"), done)


def restore_response(body: Column, mapping: Column) -> Column:
    """Generated text of a JSON response (first choice), restored; null where the body has none."""
    text = F.coalesce(*[F.get_json_object(body, p) for p in RESPONSE_PATHS])
    return deanonymize(text, mapping)


def anonymize_arguments(arguments: Column, schema: str, **options) -> Column:
    """Function-call arguments: serialised, anonymized and parsed again."""
    return F.from_json(anonymize(F.to_json(arguments), **options)["text"], schema)


def mapping_changes(turns: DataFrame, conversation: str, turn: str, entries: str) -> DataFrame:
    """(conversation, placeholder, original, from_turn, to_turn, born): what each placeholder stands for, and in which turns.

    A value holds from its turn up to the placeholder's next one (null: to the end); ``born`` is where the placeholder
    first appeared, as (turn, place). Its size is that of the entries, whatever the length of a conversation.
    """
    long = turns.select(conversation, turn, F.posexplode(entries).alias("_p", "_e"))
    values = long.groupBy(conversation, turn, F.col("_e.placeholder").alias("placeholder")).agg(F.max_by("_e.original", "_p").alias("original"), F.min("_p").alias("_first"))
    of_label = Window.partitionBy(conversation, "placeholder")
    return values.select(
        conversation, "placeholder", "original", F.col(turn).alias("from_turn"), F.lead(turn).over(of_label.orderBy(turn)).alias("to_turn"),
        F.min(F.struct(F.col(turn).alias("turn"), F.col("_first").alias("place"))).over(of_label).alias("born"),
    )


def known_placeholders(turns: DataFrame, conversation: str, turn: str, entries: str, out: str = "known") -> DataFrame:
    """(conversation, turn, known): how many placeholders the mapping holds after each turn, by a running sum of first appearances."""
    births = mapping_changes(turns, conversation, turn, entries).where(F.col("from_turn") == F.col("born.turn"))
    per_turn = births.groupBy(conversation, F.col("from_turn").alias(turn)).agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select(conversation, turn).distinct().join(per_turn, [conversation, turn], "left")
    return rows.select(conversation, turn, F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias(out))


def cumulative_entries(turns: DataFrame, conversation: str, turn: str, entries: str, out: str = "known") -> DataFrame:
    """(conversation, turn, known): the whole mapping after each turn, in order of first appearance; the last of equal placeholders counts.

    The result itself grows with turns times placeholders; ask for it for the turns that are needed, and
    keep ``mapping_changes`` for all others.
    """
    changes = mapping_changes(turns, conversation, turn, entries).withColumnRenamed(conversation, "_c")
    holds = (F.col(conversation) == F.col("_c")) & (F.col("from_turn") <= F.col(turn)) & (F.col("to_turn").isNull() | (F.col(turn) < F.col("to_turn")))
    held = F.when(F.col("placeholder").isNotNull(), F.struct("born", "placeholder", "original"))
    gathered = turns.select(conversation, turn).distinct().join(changes, holds, "left").groupBy(conversation, turn).agg(F.array_sort(F.collect_list(held)).alias("_k"))
    return gathered.select(conversation, turn, F.map_from_entries(F.transform("_k", lambda x: F.struct(x["placeholder"].alias("key"), x["original"].alias("value")))).alias(out))


def anonymize_conversation(turns: DataFrame, conversation: str, turn: str, text: str, **options) -> DataFrame:
    """Placeholders numbered through a whole conversation, so that they never collide between turns.

    Each turn's number of spans per type is summed over the turns before it, and the turn's own numbers are shifted by that.
    """
    numbered = turns.withColumn("_a", anonymize(F.col(text), **options))
    long = numbered.select(conversation, turn, F.posexplode("_a.entries").alias("_p", "_e")).withColumn("_stem", F.regexp_extract("_e.placeholder", r"^(.*?)(\d+)(\D*)$", 1))
    per_turn = long.groupBy(conversation, turn, "_stem").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(conversation, "_stem").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_turn.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).groupBy(conversation, turn).agg(F.map_from_entries(F.collect_list(F.struct("_stem", "_shift"))).alias("_s"))
    parts = lambda e, k: F.regexp_extract(e["placeholder"], r"^(.*?)(\d+)(\D*)$", k)

    def moved(e: Column) -> Column:
        number = parts(e, 2).cast("int") + F.coalesce(F.try_element_at("_s", parts(e, 1)), F.lit(0))
        label = F.when(parts(e, 2) == "", e["placeholder"]).otherwise(F.concat(parts(e, 1), number.cast("string"), parts(e, 3)))
        return F.struct(label.alias("placeholder"), e["original"].alias("original"), e["placeholder"].alias("old"))

    joined = numbered.join(shifts, [conversation, turn], "left").withColumn("_m", F.transform("_a.entries", moved))
    # Highest numbers first, so that a new label is never taken for an old one.
    swap = F.aggregate(F.reverse("_m"), F.col("_a.text"), lambda acc, e: F.replace(acc, e["old"], e["placeholder"]))
    entries = F.transform("_m", lambda e: F.struct(e["placeholder"].alias("placeholder"), e["original"].alias("original")))
    return joined.select(*turns.columns, swap.alias("anonymized"), entries.alias("entries"))


def restore_turns(turns: DataFrame, text: str, entries: str, out: str = "restored") -> DataFrame:
    return turns.withColumn(out, deanonymize_entries(F.col(text), F.col(entries)))
