"""Message detectors by language: which calls send something, how a sender is declared, which argument is what."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .messages import CALL, arguments, unquoted

_JVM_SENDER = r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|override|internal|open|sealed)\s+)*(?:[\w<>\[\],?.]+\s+)+([A-Za-z_][\w]*)\s*\("
_KOTLIN_SENDERS = (
    r"^\s*(?:suspend\s+)?fun\s+([A-Za-z_][\w.]*)\s*\(",
    r"^\s*(?:(?:public|private|protected|internal|open|override|abstract|final|suspend|inline)\s+)*(?:[\w<>\[\],?.]+\s+)+([A-Za-z_][\w]*)\s*\(",
)
_VB_SENDER = r"(?i)^\s*(?:Public\s+|Private\s+|Friend\s+|Static\s+|Global\s+)?(?:Sub|Function|Property\s+Get|Property\s+Set|Property\s+Let)\s+([A-Za-z_][A-Za-z0-9_]*)"


@dataclass(frozen=True)
class Detector:
    """keywords: short names of sending calls; senders: patterns of declarations; window: calls whose first argument is the
    receiver and whose second names the message; third: calls (None: all) whose third argument may be the receiver;
    first: calls whose first argument receives, with whether the payload is then the second or third."""

    keywords: tuple[str, ...]
    senders: tuple[str, ...] = ()
    window: bool = False
    third: tuple[str, ...] | None = None
    first: dict[str, bool] = field(default_factory=dict)


_BUS = ("sendbroadcast", "publish", "emit", "post", "notify")
#: The detectors
DETECTORS = {
    "generic": Detector(("emit", "publish", "send", "post", "notify", "dispatch", "broadcast", "sendmessage", "postmessage"), window=True),
    "cplus": Detector(("emit", "publish", "send", "postmessage", "sendmessage", "dispatch", "notify", "broadcast"), (r"^\s*(?:template\s*<[^>]+>\s*)?(?:[\w:\[\]<>*&~]+\s+){0,8}([A-Za-z_~][\w:]*)\s*\([^;{}]*\)\s*(?:const\b)?\s*(?:\{|$)",), window=True),
    "delphi": Detector(("sendmessage", "postmessage", "publish", "dispatch", "notify", "broadcast"), (r"^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+([A-Za-z_][A-Za-z0-9_.]*)",), window=True, third=()),
    "java": Detector(("publish", "post", "send", "emit", "sendbroadcast", "registerreceiver", "sendmessage", "notify"), (_JVM_SENDER,), third=_BUS, first={"registerreceiver": True}),
    "csharp": Detector(("publish", "send", "sendasync", "emit", "post", "notify", "dispatch", "broadcast"), (r"^\s*(?:(?:public|private|protected|internal|static|sealed|virtual|override|async|partial)\s+)*(?:[\w<>\[\],?.]+\s+)+([A-Za-z_][\w]*)\s*\(",)),
    "kotlin": Detector(("emit", "publish", "post", "send", "sendbroadcast", "registerreceiver", "sendmessage", "notify"), _KOTLIN_SENDERS, first={"registerreceiver": False}),
    "android": Detector(("emit", "publish", "post", "send", "sendbroadcast", "registerreceiver", "startactivity", "startservice", "sendmessage", "notify"), _KOTLIN_SENDERS, third=_BUS, first={"startactivity": True, "startservice": True, "registerreceiver": False}),
    "python": Detector(("publish", "send", "emit", "post", "notify", "dispatch", "enqueue", "produce", "push"), (r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",)),
    "js": Detector(("publish", "send", "emit", "post", "notify", "dispatch", "enqueue", "produce", "broadcast"), (r"^\s*function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", r"^\s*(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", r"^\s*(?:async\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{")),
    "ts": Detector(("publish", "send", "emit", "post", "notify", "dispatch", "enqueue", "produce", "broadcast"), (r"^\s*function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", r"^\s*(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>", r"^\s*(?:(?:public|private|protected|static|readonly|async)\s+)*([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*(?::\s*[^ {]+)?\s*\{")),
    "php": Detector(("publish", "send", "emit", "post", "notify", "dispatch", "enqueue", "produce", "broadcast"), (r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",)),
    "sql": Detector(("publish", "send", "notify", "post", "emit", "enqueue", "produce"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:procedure|function)\s+([A-Za-z_][A-Za-z0-9_.$]*)",)),
    "plsql": Detector(("publish", "send", "notify", "post", "emit", "enqueue", "produce"), (r"(?i)^\s*(?:create\s+(?:or\s+replace\s+)?(?:procedure|function)\s+|(?:procedure|function)\s+)([A-Za-z_][A-Za-z0-9_.$]*)",)),
    "vbnet": Detector(("publish", "send", "emit", "notify", "dispatch", "post", "raiseevent"), (r"(?i)^\s*(?:Public\s+|Private\s+|Friend\s+|Protected\s+|Static\s+|Shared\s+|Overloads\s+|Overrides\s+|Partial\s+|Async\s+)*(?:Sub|Function|Property\s+Get|Property\s+Set|Property\s+Let)\s+([A-Za-z_][A-Za-z0-9_]*)",)),
    "vb6": Detector(("sendmessage", "postmessage", "publish", "send", "notify", "dispatch"), (_VB_SENDER,), window=True, third=()),
    "vba": Detector(("publish", "send", "notify", "dispatch", "raiseevent"), (_VB_SENDER,)),
    "vbscript": Detector(("publish", "send", "notify", "dispatch", "raiseevent"), (r"(?i)^\s*(?:Sub|Function)\s+([A-Za-z_][A-Za-z0-9_]*)",)),
}


def detector(language: str | None) -> Detector:
    """That of a language; of an unknown one the generic detector."""
    return DETECTORS.get((language or "").strip().lower(), DETECTORS["generic"])


def declared_sender(text: Column, d: Detector) -> Column:
    """The name that a line declares, by the first pattern that fits, or null."""
    found = [F.nullif(F.regexp_extract(F.trim(text), p, 1), F.lit("")) for p in d.senders]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _endpoint(a: Column) -> Column:
    plain = (F.length(a) <= 120) & ~F.lower(a).isin("null", "true", "false", "this", "self") & a.rlike("^[A-Za-z_][A-Za-z0-9_:.]*$")
    return (a != "") & (F.coalesce(unquoted(a) != "", F.lit(False)) | plain)


def fields(short: Column, callee: Column, args: Column, d: Detector) -> Column:
    """struct(name, receiver, payload) of a sending call."""
    arg = lambda i: F.trim(F.coalesce(F.get(args, F.lit(i)), F.lit("")))
    full = lambda c: F.nullif(c, F.lit(""))
    quoted = lambda i: full(F.coalesce(unquoted(arg(i)), F.lit("")))
    name = F.coalesce(quoted(0), full(arg(0)), callee)
    may_third = F.lit(True) if d.third is None else short.isin(list(d.third)) if d.third else F.lit(False)
    receiver = F.when(_endpoint(arg(1)), arg(1)).when(may_third & _endpoint(arg(2)), arg(2)).otherwise("")
    payload = F.coalesce(full(arg(1)), arg(0))
    if d.first:
        takes = short.isin(list(d.first))
        receiver = F.when(takes, F.coalesce(full(arg(0)), arg(1))).otherwise(receiver)
        payload = F.when(short.isin([x for x, rest in d.first.items() if rest]), F.coalesce(full(arg(1)), arg(2))).otherwise(payload)
    if d.window:
        sends = short.isin("sendmessage", "postmessage")
        name = F.when(sends & quoted(0).isNull() & (arg(1) != ""), F.coalesce(quoted(1), name)).otherwise(name)
        receiver = F.when(sends, arg(0)).otherwise(receiver)
        payload = F.when(sends, F.coalesce(full(arg(1)), arg(2))).otherwise(payload)
    return F.struct(F.substring(name, 1, 220).alias("name"), F.substring(receiver, 1, 220).alias("receiver"), F.substring(payload, 1, 400).alias("payload"))


def detect_messages(lines: DataFrame, project: str, languages: list[str] | None = None) -> DataFrame:
    """(id, name, sender, receiver, payload, confidence, file, line) of sending calls in lines (file, line, text, language).

    Each language's lines go through its own detector, lines of other languages through the generic one. The sender is the
    declaration at or above a line, else the file's name; confidence and ids are those of extract_messages().
    """
    known = languages or [x for x in DETECTORS if x != "generic"]
    lang = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def part(name: str) -> DataFrame:
        d = detector(name)
        rows = lines.where(~lang.isin(known) if name == "generic" else lang == name)
        rows = rows.withColumn("declared", F.last(declared_sender(F.col("text"), d), ignorenulls=True).over(w))
        calls = rows.select("file", "line", "declared", F.explode(F.regexp_extract_all(F.trim("text"), F.lit(f"({CALL})"), F.lit(1))).alias("call"))
        calls = calls.withColumn("callee", F.trim(F.regexp_extract("call", r"^([^(]*)\(", 1)))
        calls = calls.withColumn("short", F.lower(F.element_at(F.split("callee", r"[.:>]+"), -1))).where(F.col("short").isin(list(d.keywords)))
        calls = calls.withColumn("args", arguments(F.regexp_extract("call", r"^[^(]*\((.*)\)$", 1)))
        found = calls.withColumn("m", fields(F.col("short"), F.col("callee"), F.col("args"), d)).withColumn("quoted", F.coalesce(unquoted(F.coalesce(F.get("args", F.lit(0)), F.lit(""))).isNotNull(), F.lit(False)))
        sender = F.coalesce("declared", F.element_at(F.split("file", "/"), -1))
        return found.select("file", "line", "m.name", sender.alias("sender"), "m.receiver", "m.payload", "quoted")

    rows = reduce(DataFrame.unionByName, [part(x) for x in [*known, "generic"]])
    confidence = F.round(F.least(F.lit(0.99), 0.55 + F.when(F.col("quoted"), 0.2).otherwise(0.0) + F.when(F.col("sender") != "", 0.1).otherwise(0.0) + F.when(F.col("receiver") != "", 0.1).otherwise(0.0)), 2)
    key = F.concat_ws("||", F.lit(project), "file", F.col("line").cast("string"), "sender", "receiver", "name", "payload")
    rows = rows.withColumn("confidence", confidence).withColumn("id", F.concat(F.lit("msg::"), F.substring(F.sha1(key), 1, 24)))
    best = rows.groupBy("id").agg(F.max(F.struct("confidence", "name", "sender", "receiver", "payload", "file", "line")).alias("m"))
    return best.select("id", "m.*")
