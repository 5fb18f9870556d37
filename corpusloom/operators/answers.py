"""Answers of a generator: parsing, gauges, chat history, model lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "answer string, citations array<struct<id:string,source_id:string>>, warnings array<string>"
NOT_JSON = "Model output was not valid JSON."
#: Parts of names that are not chat models.
NOT_CHAT = ["embedding", "whisper", "tts", "dall-e", "moderation", "davinci-002", "babbage", "audio", "realtime", "transcribe", "image"]


def parsed_answer(raw: Column) -> Column:
    """answer, citations, warnings of a JSON object; any other text is the answer itself, with a warning. An object
    without an answer is its own answer, without one."""
    fine = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{")
    read = F.from_json(raw, ANSWER)
    none = F.expr("cast(array() as array<struct<id:string,source_id:string>>)")
    return F.struct(
        F.when(fine, F.coalesce(read["answer"], raw)).otherwise(raw).alias("answer"),
        F.when(fine, F.coalesce(read["citations"], none)).otherwise(none).alias("citations"),
        F.when(fine, F.coalesce(read["warnings"], F.expr("cast(array() as array<string>)"))).otherwise(F.array(F.lit(NOT_JSON))).alias("warnings"),
    )


def ui_answer(raw: Column) -> Column:
    fine = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{")
    return F.when(fine, F.get_json_object(raw, "$.answer")).when(F.trim(raw) == "", "No answer available").otherwise(raw)


def coverage(hits: Column) -> Column:
    return F.least(F.lit(100), F.bround(hits / 5 * 100)).cast("int")


def latency_gauge(ms: Column) -> Column:
    return F.when(F.coalesce(ms, F.lit(0.0)) == 0, 0).otherwise(F.greatest(F.lit(5), F.least(F.lit(100), F.bround(100 - ms / 1500 * 100)))).cast("int")


def chat_history(turns: DataFrame, conversation: str = "conv_id", last: int | None = None) -> DataFrame:
    """conversation, n_turns, history: ``role: text`` lines in turn order, of the last turns if a number is given."""
    rows = turns
    if last:
        rows = turns.withColumn("_n", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc("turn")))).filter(F.col("_n") <= last)
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy(conversation).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(listed, lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("history"))


def chat_models(models: DataFrame, name: str = "id", needs: str | None = None, capabilities: str = "capabilities") -> DataFrame:
    """Models whose name has no excluded part and, if asked, that list a capability; sorted by name."""
    out = models.filter(~F.col(name).rlike("|".join(NOT_CHAT)))
    return (out.filter(F.array_contains(capabilities, needs)) if needs else out).orderBy(name)


def remaining_models(live: DataFrame, shown: DataFrame, name: str = "id", matched: str = "matched") -> DataFrame:
    """The live models that no preferred one was matched with, sorted by name."""
    return live.select(name).distinct().join(shown.select(F.col(matched).alias(name)), name, "left_anti").orderBy(name)


def preferred_models(preferred: DataFrame, live: DataFrame, name: str = "id") -> DataFrame:
    """preferred id -> matched: the live model of that name, else the first one that begins with it. Both lists are short."""
    pairs = preferred.select(F.col(name).alias("wanted")).join(live.select(F.col(name).alias("found")), F.col("found").startswith(F.col("wanted")), "left")
    return pairs.groupBy("wanted").agg(F.coalesce(F.max(F.when(F.col("found") == F.col("wanted"), F.col("found"))), F.min("found")).alias("matched"))
