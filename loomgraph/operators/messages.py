"""Messages in code: extraction of calls that send something, senders by line, lookups between endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of calls that send messages
KEYWORDS = ["emit", "publish", "send", "post", "notify", "dispatch", "broadcast", "sendmessage", "postmessage"]
CALL = r"[A-Za-z_][A-Za-z0-9_.:>-]*\s*\([^()]*\)"


def fill_sender(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines (file, line, text) with the sender named last at or above each: last value over the file's lines."""
    named = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("sender", F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit("")))


def arguments(text: Column) -> Column:
    """Comma-separated arguments outside quotes, trimmed; an empty one is dropped."""
    parts = F.regexp_extract_all(text, F.lit(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,"'])+)"""), F.lit(1))
    return F.filter(F.transform(parts, lambda a: F.trim(a)), lambda a: a != "")


def unquoted(arg: Column) -> Column:
    """What stands in the first quotes of an argument, or null."""
    group = lambda i: F.regexp_extract(arg, "\"([^\"]*)\"|'([^']*)'", i)
    return F.when(arg.rlike("\"[^\"]*\"|'[^']*'"), F.trim(F.concat(group(1), group(2))))


def extract_messages(lines: DataFrame, project: str) -> DataFrame:
    """(id, name, sender, receiver, payload, file, line, confidence) of sending calls in lines (file, line, text, sender).

    The first argument names the message, a second or third that looks like an endpoint receives it; confidence is 0.55,
    0.2 more for a quoted name and 0.1 each for sender and receiver. Of equal ids the surest row stays.
    """
    calls = lines.select("file", "line", "sender", F.explode(F.regexp_extract_all(F.trim("text"), F.lit(f"({CALL})"), F.lit(1))).alias("call"))
    callee = F.trim(F.regexp_extract("call", r"^([^(]*)\(", 1))
    calls = calls.withColumn("callee", callee).withColumn("short", F.lower(F.element_at(F.split("callee", r"[.:>]+"), -1))).where(F.col("short").isin(KEYWORDS))
    calls = calls.withColumn("args", arguments(F.regexp_extract("call", r"^[^(]*\((.*)\)$", 1)))
    arg = lambda i: F.coalesce(F.get("args", F.lit(i)), F.lit(""))
    endpoint = lambda a: (a != "") & (unquoted(a).isNotNull() | ((F.length(a) <= 120) & ~F.lower(a).isin("null", "true", "false", "this", "self") & a.rlike("^[A-Za-z_][A-Za-z0-9_:.]*$")))
    two = F.col("short").isin("sendmessage", "postmessage")
    name = F.coalesce(F.nullif(unquoted(arg(0)), F.lit("")), F.nullif(arg(0), F.lit("")), F.col("callee"))
    name = F.when(two & unquoted(arg(0)).isNull() & (arg(1) != ""), F.coalesce(F.nullif(unquoted(arg(1)), F.lit("")), name)).otherwise(name)
    receiver = F.when(two, arg(0)).when(endpoint(arg(1)), arg(1)).when(endpoint(arg(2)), arg(2)).otherwise("")
    payload = F.when(two, F.coalesce(F.nullif(arg(1), F.lit("")), arg(2))).otherwise(F.coalesce(F.nullif(arg(1), F.lit("")), arg(0)))
    sender = F.coalesce(F.nullif(F.trim("sender"), F.lit("")), F.element_at(F.split("file", "/"), -1))
    rows = calls.select("file", "line", F.substring(F.regexp_replace(name, r"\s+", " "), 1, 220).alias("name"), sender.alias("sender"), F.substring(receiver, 1, 220).alias("receiver"), F.substring(payload, 1, 400).alias("payload"), unquoted(arg(0)).isNotNull().alias("quoted"))
    confidence = F.round(F.least(F.lit(0.99), 0.55 + F.when(F.col("quoted"), 0.2).otherwise(0.0) + F.when(F.col("sender") != "", 0.1).otherwise(0.0) + F.when(F.col("receiver") != "", 0.1).otherwise(0.0)), 2)
    key = F.concat_ws("||", F.lit(project), "file", F.col("line").cast("string"), "sender", "receiver", "name", "payload")
    rows = rows.withColumn("confidence", confidence).withColumn("id", F.concat(F.lit("msg::"), F.substring(F.sha1(key), 1, 24)))
    best = rows.groupBy("id").agg(F.max(F.struct("confidence", "name", "sender", "receiver", "payload", "file", "line")).alias("m"))
    return best.select("id", "m.*")


def between(messages: DataFrame, sender: str | None = None, receiver: str | None = None) -> DataFrame:
    """Messages from a sender to a receiver; with one side only, the distinct other sides in the order first seen."""
    if sender is not None and receiver is not None:
        return messages.where((F.col("sender") == sender) & (F.col("receiver") == receiver)).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "file", "line")
    given, other = ("sender", "receiver") if sender is not None else ("receiver", "sender")
    rows = messages.where((F.col(given) == (sender if sender is not None else receiver)) & (F.col(other) != ""))
    return rows.groupBy(F.col(other).alias("endpoint")).agg(F.min(F.struct("file", "line")).alias("first"), F.count("*").alias("n")).orderBy("first").select("endpoint", "n")
