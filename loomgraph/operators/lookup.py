"""Small lookups over nodes: labels, prefixes, kinds, code or document, stubs, pending work, fixed entity lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import at_most

#: Labels of code and of document nodes, and kinds of types that no file declares
CODE_LABELS = ["Project", "Repository", "Directory", "File", "Class", "Function", "Method", "Namespace", "Interface", "Enum", "Type", "Package", "Alias", "Template"]
DOC_LABELS = ["Document", "Paragraph", "Chunk", "PdfDocument", "WordDocument", "WorksheetDocument", "Slide"]
BUILTIN_KINDS = ["primitive", "builtin"]


def string_list(value: object) -> list[str]:
    """A list argument: text is cut at commas and semicolons, items are trimmed, empty ones go."""
    if value is None:
        return []
    items = value.replace(";", ",").split(",") if isinstance(value, str) else value if isinstance(value, list | tuple | set) else [value]
    return [t for t in (str(x).strip() for x in items) if t]


def with_labels(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes (label) of one of the labels; all without labels."""
    return nodes.where(F.col("label").isin(labels)) if labels else nodes


def by_prefix(nodes: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """The first nodes (id, name) by name that begins with a prefix."""
    return nodes.where(F.startswith("name", F.lit(prefix))).orderBy("name", "id").limit(limit)


def of_kinds(nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Nodes (name, kind) of some kinds, by default those of built-in types, ordered by name."""
    return nodes.where(F.col("kind").isin(kinds or BUILTIN_KINDS)).orderBy("name")


def node_class(label: Column, paragraph_id: Column, doc_id: Column, source_id: Column, text: Column) -> Column:
    """`doc` or `code`: by label, else by the properties that only document nodes have."""
    is_doc = label.isin(DOC_LABELS)
    by_property = paragraph_id.isNotNull() | doc_id.isNotNull() | (source_id.isNotNull() & text.isNotNull())
    return F.when(F.coalesce(is_doc, F.lit(False)), "doc").when(F.coalesce(label.isin(CODE_LABELS), F.lit(False)), "code").when(by_property, "doc").otherwise("code")


def typed(nodes: DataFrame, node_type: str, expand: bool = False) -> DataFrame:
    """Nodes (id, label, name, node_type, ...) of a type; with expand the others stay as stubs of these four columns."""
    own = F.col("node_type") == node_type
    if not expand:
        return nodes.where(own)
    kept = {"id", "label", "name", "node_type"}
    return nodes.select(*[F.col(c) if c in kept else F.when(own, F.col(c)).alias(c) for c in nodes.columns])


def pending(nodes: DataFrame, members: DataFrame, status: str = "pending_summary", limit: int | None = None) -> DataFrame:
    """Nodes (id, status, ...) of a status with their members (id, member, name) as a sorted array; empty without any."""
    lists = members.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("member", "name"))).alias("members"))
    found = nodes.where(F.col("status") == status).join(lists, "id", "left")
    found = found.withColumn("members", F.coalesce("members", F.array().cast(lists.schema["members"].dataType)))
    return found.orderBy("id").limit(limit) if limit else found


def dictionary_entities(texts: DataFrame, patterns: DataFrame, most_sent: int = 50_000) -> DataFrame:
    """(id, name, type, pos): phrases (pattern, label) found in texts (id, text) as whole words in any case, with the place
    of their first word. Both sides become word sequences, joined on them: as many joins as phrases have lengths. Up to
    `most_sent` phrases are sent to the texts, which then stay where they are; more are joined by shuffles."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    known = patterns.select(F.col("label").alias("type"), split(F.col("pattern")).alias("w")).where(F.size("w") > 0).select("type", F.size("w").alias("n"), F.array_join("w", " ").alias("name")).distinct()
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # a few numbers
    sent = F.broadcast if at_most(known, most_sent) else lambda df: df
    words = texts.select("id", split(F.col("text")).alias("w"))
    out = None
    for n in lengths:
        grams = words.where(F.size("w") >= n).select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("pos", "name"))  # noqa: B023
        found = grams.join(sent(known.where(F.col("n") == n).select("name", "type")), "name").select("id", "name", "type", "pos")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.select("id", F.lit("").alias("name"), F.lit("").alias("type"), F.lit(0).alias("pos")).limit(0)
