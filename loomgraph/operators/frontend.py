"""Relationships in front-end code: what a function renders, calls, navigates to, and whose state it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components and words that are no targets, and the confidence of each kind of edge
NO_COMPONENTS = ["Fragment", "StrictMode", "Suspense", "ErrorBoundary"]
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "typeof", "instanceof", "new", "await", "yield", "console", "require", "import"]
RULES = [
    ("RENDER", r"<([A-Z][A-Za-z0-9]*)[\s/>]", 0.90),
    ("NAVIGATE", r"(?:navigation\.(?:navigate|push|replace|reset)|\bnavigate|router\.(?:push|navigate|replace)|history\.(?:push|replace))\s*\(\s*[\"'`]([^\"'`\s,)]+)", 0.88),
    ("STATE_UPDATE", r"\b(set[A-Z]\w*|setState|dispatch)\s*\(", 0.80),
    ("SIDE_EFFECT", r"\b(useEffect|addEventListener|setTimeout|setInterval|useFocusEffect)\s*\(", 0.75),
    ("CALLS", r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", 0.55),
]


def found_edges(functions: DataFrame, rules: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """(src, target, rel_type, confidence) of functions (id, code) by rules of pattern and confidence; more rules may be
    given. Each target counts once a function and kind."""
    def edges(kind: str, pattern: str, confidence: float) -> Column:
        targets = F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)))
        return F.transform(targets, lambda t: F.struct(t.alias("target"), F.lit(kind).alias("rel_type"), F.lit(confidence).alias("confidence")))

    parts = [edges(*rule) for rule in (rules or RULES)]
    rows = functions.where("code is not null").select(F.col("id").alias("src"), F.explode(F.concat(*parts)).alias("e")).select("src", "e.*")
    skip = ((F.col("rel_type") == "RENDER") & F.col("target").isin(NO_COMPONENTS)) | ((F.col("rel_type") == "CALLS") & (F.col("target").isin(NO_CALLS) | (F.length("target") <= 1)))
    return rows.where(~skip)


def relationships(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, target, rel_type, confidence) of functions (id, name, code, role): found edges with targets resolved by
    name, known calls (src, dst) in the place of textual ones, no RENDER from screen to screen."""
    edges = found_edges(functions)
    known = calls.select("src").distinct()
    edges = edges.join(known.withColumn("known", F.lit(True)), "src", "left").where((F.col("rel_type") != "CALLS") | F.col("known").isNull()).drop("known")
    names = functions.groupBy(F.col("name").alias("target")).agg(F.min("id").alias("dst"), F.max((F.col("role") == "screen").cast("int")).alias("screen"))
    roles = functions.select(F.col("id").alias("src"), (F.col("role") == "screen").alias("from_screen"))
    out = edges.join(names, "target", "left").join(roles, "src", "left")
    out = out.where(~((F.col("rel_type") == "RENDER") & F.coalesce("from_screen", F.lit(False)) & (F.coalesce("screen", F.lit(0)) == 1)))
    exact = calls.select("src", "dst", F.lit(None).cast("string").alias("target"), F.lit("CALLS").alias("rel_type"), F.lit(0.95).alias("confidence")).distinct()
    return out.select("src", "dst", "target", "rel_type", "confidence").unionByName(exact)


def navigation_method(text: Column) -> Column:
    return F.when(text.contains("push"), "push").when(text.contains("replace"), "replace").when(text.contains("reset"), "reset").otherwise("navigate")


#: What in a body speaks for an intent, by framework: framework, intent, pattern, confidence
SIGNALS = [
    ("react", "ui_composition", r"<[A-Z][A-Za-z0-9]*[\s/>]", 0.95),
    ("react", "ui_composition", r"\bReact\.(?:createElement|cloneElement)\s*\(", 0.90),
    ("react", "ui_composition", r"\{\.\.\.children\}", 0.70),
    ("react", "state_mutation", r"\bsetState\s*\(", 0.90),
    ("react", "state_mutation", r"\buse(?:State|Reducer)\s*\(", 0.85),
    ("react", "state_mutation", r"\bset[A-Z]\w*\s*\(", 0.80),
    ("react", "state_mutation", r"\bset\b.*\bState\b", 0.65),
    ("react", "state_mutation", r"\buseAtom\b|\buseStore\b", 0.70),
    ("react", "state_mutation", r"\bdispatch\s*\(", 0.75),
    ("react", "screen_navigate", r"\bnavigation\.(?:navigate|push|replace|reset)\b", 0.95),
    ("react", "screen_navigate", r"\buseNavigation\s*\(", 0.85),
    ("react", "screen_navigate", r"\bnavigate\s*\(['\"`/]", 0.90),
    ("react", "screen_navigate", r"\buseNavigate\s*\(", 0.85),
    ("react", "screen_navigate", r"\bhistory\.(?:push|replace)\s*\(", 0.88),
    ("react", "screen_navigate", r"\buseHistory\s*\(", 0.80),
    ("react", "screen_navigate", r"\brouter\.(?:push|navigate|replace)\s*\(", 0.90),
    ("react", "screen_navigate", r"\buseRouter\s*\(", 0.80),
    ("react", "screen_navigate", r"<(?:Link|Navigate)\s", 0.75),
    ("react", "side_effect", r"\buseEffect\s*\(", 0.90),
    ("react", "side_effect", r"\buseCallback\s*\(", 0.50),
    ("react", "side_effect", r"\.addEventListener\s*\(", 0.80),
    ("react", "side_effect", r"\.removeEventListener\s*\(", 0.80),
    ("react", "side_effect", r"\bsetTimeout\s*\(|\bsetInterval\s*\(", 0.75),
    ("react", "side_effect", r"\buseFocusEffect\s*\(", 0.85),
    ("react", "lifecycle", r"\bcomponentDidMount\b|\bcomponentWillUnmount\b", 0.95),
    ("react", "lifecycle", r"\bcomponentDidUpdate\b", 0.90),
    ("react", "lifecycle", r"\bshouldComponentUpdate\b", 0.88),
    ("react", "event_trigger", r"\bon[A-Z]\w+\s*=\s*\{", 0.80),
    ("react", "event_trigger", r"\bonPress\b|\bonClick\b|\bonChange\b", 0.85),
    ("react", "event_trigger", r"\bonSubmit\b|\bonFocus\b|\bonBlur\b", 0.82),
    ("vue", "ui_composition", r"<[A-Z][A-Za-z0-9]*(?:\s|/)", 0.92),
    ("vue", "ui_composition", r"\bcomponent\s+:is=", 0.85),
    ("vue", "ui_composition", r"\bh\s*\(\s*[\w'\"]", 0.80),
    ("vue", "state_mutation", r"\bref\s*\(|\breactive\s*\(", 0.85),
    ("vue", "state_mutation", r"\.value\s*=", 0.75),
    ("vue", "state_mutation", r"\buseStore\b|\bdefineStore\b", 0.80),
    ("vue", "state_mutation", r"\b\$store\.commit\s*\(", 0.88),
    ("vue", "state_mutation", r"\b\$store\.dispatch\s*\(", 0.85),
    ("vue", "state_mutation", r"\buseStore\(\)\.commit\b", 0.85),
    ("vue", "screen_navigate", r"\bthis\.\$router\.(?:push|replace|go)\s*\(", 0.95),
    ("vue", "screen_navigate", r"\buseRouter\s*\(", 0.85),
    ("vue", "screen_navigate", r"\brouter\.(?:push|replace|go)\s*\(", 0.90),
    ("vue", "screen_navigate", r"<router-link\b|<RouterLink\b", 0.80),
    ("vue", "side_effect", r"\bonMounted\s*\(|\bonUnmounted\s*\(", 0.90),
    ("vue", "side_effect", r"\bonBeforeMount\b|\bonBeforeUnmount\b", 0.88),
    ("vue", "side_effect", r"\bwatchEffect\s*\(", 0.85),
    ("vue", "side_effect", r"\bwatch\s*\(", 0.80),
    ("vue", "lifecycle", r"\bcreated\s*\(\)|\bmounted\s*\(\)", 0.95),
    ("vue", "lifecycle", r"\bbeforeDestroy\b|\bdestroyed\b", 0.90),
    ("vue", "lifecycle", r"\bupdated\s*\(\)", 0.85),
    ("vue", "event_trigger", r"\b\$emit\s*\(", 0.90),
    ("vue", "event_trigger", r"\bv-on:|@[a-z]", 0.85),
    ("vue", "event_trigger", r"\bemit\s*\(", 0.75),
    ("react-native", "screen_navigate", r"\bnavigation\.goBack\s*\(", 0.88),
    ("react-native", "screen_navigate", r"\bnavigation\.popToTop\s*\(", 0.85),
    ("react-native", "screen_navigate", r"\bhref\s*=\s*[\w'\"]/", 0.70),
]
#: Frameworks that have the signals of another one as well
INHERITS = {"react-native": "react"}


def framework_signals(functions: DataFrame, signals: list[tuple[str, str, str, float]] | None = None) -> DataFrame:
    """(function, intent, confidence): a row for each signal that a body (id, code, framework) shows; signals of further
    frameworks may be given. gathered_intents() sums them up."""
    rules = signals or SIGNALS
    found = []
    for framework in sorted({f for f, *_ in rules} | set(INHERITS)):
        own = [r for r in rules if r[0] in (framework, INHERITS.get(framework))]
        hits = F.array(*[F.when(F.col("code").rlike(p), F.struct(F.lit(i).alias("intent"), F.lit(c).alias("confidence"))) for _, i, p, c in own])
        found.append(F.when(F.col("framework") == framework, F.filter(hits, lambda h: h.isNotNull())))
    rows = functions.where("code is not null").select(F.col("id").alias("function"), F.explode(F.coalesce(*found)).alias("s"))
    return rows.select("function", "s.intent", "s.confidence")
