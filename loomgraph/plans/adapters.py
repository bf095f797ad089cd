"""Views of the driver's tables as graph, text and vector tables; each with the same view as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """The tables of a folder, and the views that queries are written against."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def links(self) -> DataFrame:
        """(src, dst, rel_type): orders call parts, parts call suppliers; repeated edges stay."""
        rel = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "POSSIBLE_CALLS").otherwise("CALLS_FUNCTION_POINTER").alias("rel_type")
        ident = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
        lines = self.lineitem
        a = lines.select(ident("o:", "l_orderkey").alias("src"), ident("p:", "l_partkey").alias("dst"), rel)
        b = lines.select(ident("p:", "l_partkey").alias("src"), ident("s:", "l_suppkey").alias("dst"), rel)
        return a.unionByName(b)

    def trade(self) -> DataFrame:
        """(src, dst, rel_type, calls): links(), each once with its number."""
        return self.links().groupBy("src", "dst", "rel_type").agg(F.count("*").alias("calls"))

    def geo(self) -> DataFrame:
        """(src, dst, rel_type): regions contain nations, nations contain customers and suppliers."""
        ident = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
        a = self.nation.select(ident("r:", "n_regionkey").alias("src"), ident("n:", "n_nationkey").alias("dst"))
        b = self.customer.select(ident("n:", "c_nationkey").alias("src"), ident("c:", "c_custkey").alias("dst"))
        c = self.supplier.select(ident("n:", "s_nationkey").alias("src"), ident("s:", "s_suppkey").alias("dst"))
        return a.unionByName(b).unionByName(c).withColumn("rel_type", F.lit("CONTAINS"))

    def module_calls(self) -> DataFrame:
        """(src, dst, calls): brands of parts that follow each other in an order."""
        lines = self.lineitem.join(self.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        pairs = lines.select(F.col("p_brand").alias("src"), F.lead("p_brand").over(w).alias("dst")).where("dst is not null")
        return pairs.groupBy("src", "dst").agg(F.count("*").alias("calls"))

    def calls(self) -> DataFrame:
        """(src, dst): functions that follow each other in a workflow, as calls; repeated calls stay."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        part = F.concat(F.lit("p:"), F.col("l_partkey").cast("string"))
        return self.lineitem.select(part.alias("src"), F.lead(part).over(w).alias("dst")).where("dst is not null")

    def needs(self) -> DataFrame:
        """(src, dst): orders need their parts, a part needs the first order that had it. Grows with the orders; a part
        and its first order are a cycle, and later orders hang on earlier ones."""
        ident = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
        lines = self.lineitem
        first = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("o")).select(ident("p:", F.col("l_partkey")).alias("src"), ident("o:", F.col("o")).alias("dst"))
        return lines.select(ident("o:", F.col("l_orderkey")).alias("src"), ident("p:", F.col("l_partkey")).alias("dst")).distinct().unionByName(first)

    def nav(self) -> DataFrame:
        """(src, dst, n, confidence): event types that follow each other for a user."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        pairs = self.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null and src != dst")
        counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
        total = counts.groupBy("src").agg(F.sum("n").alias("total"))
        return counts.join(total, "src").select("src", "dst", "n", F.round(F.col("n") / F.col("total"), 4).alias("confidence"))

    def steps(self) -> DataFrame:
        """(workflow, step, function): the parts of an order by line; the workflow's domain is the order's priority."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return self.lineitem.select(F.concat(F.lit("w:"), F.col("l_orderkey").cast("string")).alias("workflow"), (F.row_number().over(w) - 1).alias("step"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("function"))

    def workflows(self) -> DataFrame:
        domain = F.when(F.col("o_orderpriority").startswith("1"), "payment").when(F.col("o_orderpriority").startswith("2"), "auth").when(F.col("o_orderpriority").startswith("3"), "order").otherwise("other")
        return self.orders.select(F.concat(F.lit("w:"), F.col("o_orderkey").cast("string")).alias("workflow"), domain.alias("domain"))

    def functions(self) -> DataFrame:
        """(id, name, qualified_name, kind, file, module, comment, summary): parts as functions of brand/type files."""
        name = F.concat(F.lit("get"), F.initcap(F.element_at(F.split("p_name", " "), 1)), F.initcap(F.element_at(F.split("p_name", " "), -1)))
        file = F.concat_ws("/", F.lit("src"), "p_brand", F.concat(F.lower("p_type"), F.lit(".py")))
        return self.part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), name.alias("name"), F.concat_ws(".", "p_brand", name).alias("qualified_name"), F.when(F.col("p_size") % 10 == 0, "lambda").when(F.col("p_size") % 10 == 1, None).otherwise("method").alias("kind"), file.alias("file"), F.col("p_brand").alias("module"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("comment"), F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 4 == 1, F.col("p_type")).alias("summary"), F.col("p_size").alias("size"))

    def points(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"))

    def urls(self) -> DataFrame:
        """(id, url): page paths with numbers as :id."""
        path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+|[?#].*$", ""), "/+$", "")
        return self.pages.select(F.col("page_id").alias("id"), F.regexp_replace(path, r"/[0-9]+", "/:id").alias("url"))

    def messages(self) -> DataFrame:
        """(conv_id, turn, sender, receiver, text): a turn and the role that follows."""
        w = Window.partitionBy("conv_id").orderBy("turn")
        return self.conversations.select("conv_id", "turn", F.col("role").alias("sender"), F.coalesce(F.lead("role").over(w), F.lit("")).alias("receiver"), "text")

    def passages(self) -> DataFrame:
        """(id, text, score, mentions): documents with their capitalised words as mentions."""
        words = F.filter(F.split("text", "[ ,.\n]+"), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))
        kind = lambda w: F.when(F.length(w) % 2 == 0, "PERSON").otherwise("PLACE")
        mentions = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("id"), w.alias("name"), kind(w).alias("type"), F.round(1.0 / (i + 2), 4).alias("confidence"), i.alias("pos")))
        return self.documents.select(F.col("doc_id").alias("id"), "text", ((F.col("doc_id") % 97) / 97.0).alias("score"), mentions.alias("mentions"), "source")


#: The same views for DuckDB
SQL = {
    "trade": """trade AS (SELECT src, dst, rel_type, count(*) AS calls FROM (
  SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'POSSIBLE_CALLS' ELSE 'CALLS_FUNCTION_POINTER' END AS rel_type FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'POSSIBLE_CALLS' ELSE 'CALLS_FUNCTION_POINTER' END FROM lineitem) GROUP BY 1, 2, 3)""",
    "geo": """geo AS (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'CONTAINS' AS rel_type FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'CONTAINS' FROM customer UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'CONTAINS' FROM supplier)""",
    "module_calls": """module_calls AS (SELECT src, dst, count(*) AS calls FROM (SELECT p_brand AS src, lead(p_brand) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE dst IS NOT NULL GROUP BY 1, 2)""",
    "calls": """calls AS (SELECT src, dst FROM (SELECT 'p:' || l_partkey AS src, 'p:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)""",
    "needs": """needs AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p:' || l_partkey, 'o:' || min(l_orderkey) FROM lineitem GROUP BY l_partkey)""",
    "nav": """nav AS (SELECT src, dst, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY src), 4) AS confidence FROM (SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2))""",
    "steps": """steps AS (SELECT 'w:' || l_orderkey AS workflow, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS step, 'p:' || l_partkey AS function FROM lineitem)""",
    "workflows": """workflows AS (SELECT 'w:' || o_orderkey AS workflow, CASE left(o_orderpriority, 1) WHEN '1' THEN 'payment' WHEN '2' THEN 'auth' WHEN '3' THEN 'order' ELSE 'other' END AS domain FROM orders)""",
    "functions": """functions AS (SELECT 'p:' || p_partkey AS id, fname AS name, p_brand || '.' || fname AS qualified_name, CASE p_size % 10 WHEN 0 THEN 'lambda' WHEN 1 THEN NULL ELSE 'method' END AS kind, 'src/' || p_brand || '/' || lower(p_type) || '.py' AS file, p_brand AS module, CASE WHEN p_size % 3 = 0 THEN p_name END AS comment, CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_type END AS summary, p_size AS size
  FROM (SELECT *, 'get' || upper(left(w[1], 1)) || lower(w[1][2:]) || upper(left(w[-1], 1)) || lower(w[-1][2:]) AS fname FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)))""",
    "points": """points AS (SELECT vec_id AS id, embedding AS vector, 'c' || label AS collection FROM embeddings)""",
    "urls": """urls AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+|[?#].*$', '', 'g'), '/+$', ''), '/[0-9]+', '/:id', 'g') AS url FROM pages)""",
    "messages": """messages AS (SELECT conv_id, turn, role AS sender, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS receiver, text FROM conversations)""",
    "passages": r"""passages AS (SELECT doc_id AS id, text, (doc_id % 97)::DOUBLE / 97 AS score, source, list_filter(string_split_regex(text, '[ ,.\n]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')) AS words FROM documents)""",
}


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """SQL that begins with the named views; body may go on with more of them."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[v] for v in views) + ("" if body.lstrip().startswith(",") else "\n") + body
