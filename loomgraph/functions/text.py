"""Text scalars as Column expressions: tokenizers, URL patterns, query intent, naming rules. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values of the query intent rules -----------------------------------------------------------------------------
STRUCTURAL_WORDS = ["who calls", "callers of", "callers", "call graph", "call site", "call sites", "called by", "calls", "where is", "where are", "dependencies of", "dependency", "dependents", "who uses", "used by", "uses of", "references to", "reference graph", "imports", "importers", "inherits from", "extends", "implements", "overrides", "subclasses", "subclass", "parent class", "superclass", "interface", "related to", "connected to", "neighbors of", "path from", "path to", "trace from", "trace to", "flow from", "graph neighbors", "graph proximity", "entry points", "entry point"]
TEMPORAL_WORDS = ["recent changes", "recently changed", "recently modified", "recently updated", "last modified", "last updated", "last changed", "just updated", "just changed", "dirty", "outdated", "stale", "fresh", "freshness", "what changed", "what has changed", "new changes", "latest changes", "latest version", "this week", "today", "yesterday", "since yesterday", "since last", "update history", "modified files", "changed files", "uncommitted", "incremental"]
SEMANTIC_WORDS = ["similar to", "similar logic", "like", "related logic", "semantically", "what does", "what do", "explain", "describe", "how does", "how do", "purpose of", "meaning of", "intent of", "equivalent to", "analogous", "find similar", "looks like", "same as", "concept", "conceptually"]
INTENT_PATTERNS = [
    (r"\bwho\s+(calls|uses|imports|references)\b", "structural"), (r"\bcall(er|ers|ed|ing)?\s+(of|graph)\b", "structural"), (r"\bdepend(s|enc(y|ies))?\s+of\b", "structural"), (r"\bwhere\s+is\s+.+\s+used\b", "structural"), (r"\b(trace|path|flow)\s+(from|to|between)\b", "structural"),
    (r"\b(recent(ly)?|last|latest)\s+(change|update|modif)", "temporal"), (r"\b(dirty|stale|fresh|outdated|uncommitted)\b", "temporal"), (r"\b(this|last)\s+(week|month|day|commit)\b", "temporal"),
    (r"\b(similar|like|analogous|equivalent)\s+(to|logic|code)\b", "semantic"), (r"\b(explain|describe|what\s+(does|is|do))\b", "semantic"),
]
# -- fixed values of the API matching rules -----------------------------------------------------------------------------
VERB_GROUPS = {
    "get": ["get", "fetch", "load", "retrieve", "read", "find", "query", "list", "search", "show", "display", "obtain", "lookup"],
    "create": ["create", "add", "insert", "save", "post", "register", "submit", "new", "make", "build", "generate", "produce"],
    "update": ["update", "put", "patch", "modify", "edit", "change", "set", "replace", "alter", "amend"],
    "delete": ["delete", "remove", "destroy", "drop", "clear", "cancel", "deactivate", "disable", "purge"],
    "auth": ["login", "logout", "authenticate", "authorize", "refresh", "token", "signin", "signout", "signup", "register"],
}
STOP_TOKENS = ["by", "of", "the", "a", "an", "in", "for", "to", "and", "or", "with", "id", "ids", "all", "data", "info", "item", "items", "request", "response", "dto", "model", "entity", "object", "result", "payload", "body", "params", "param", "type", "types", "base", "default", "current"]
PATH_TOKENS = ["src", "app", "module", "modules", "api", "apis", "service", "services", "controller", "controllers", "handler", "handlers", "route", "routes", "middleware", "index", "common", "shared", "utils", "util", "helpers", "helper", "lib", "libs", "v1", "v2", "v3", "v4", "core", "main", "internal", "external", "public", "private"]
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ALL"]
# -- fixed values of workflow naming: pattern, domain, name --------------------------------------------------------------
WORKFLOW_RULES = [
    ("login|logout|signin|sign_in|sign_out|authenticate|auth", "auth", "Login Flow"), ("register|signup|sign_up|create_account|onboard", "auth", "Registration Flow"), ("password|reset_pass|forgot_pass|change_pass", "auth", "Password Reset Flow"), ("token|refresh_token|revoke_token|access_token", "auth", "Token Flow"),
    ("payment|pay|checkout|purchase|buy|charge|billing|invoice", "payment", "Payment Flow"), ("refund|reimburse|chargeback|reverse_payment", "payment", "Refund Flow"), ("subscription|subscribe|unsubscribe|recurring", "payment", "Subscription Flow"),
    ("reward|loyalty|point|redeem|earn_point|spend_point", "loyalty", "Reward Flow"), ("tier|rank|badge|level_up|vip", "loyalty", "Loyalty Tier Flow"),
    ("order|place_order|checkout_order|fulfill|fulfillment", "order", "Order Flow"), ("ship|deliver|dispatch|track_order|delivery", "order", "Delivery Flow"), ("cart|basket|add_to_cart|update_cart|remove_from_cart", "order", "Cart Flow"),
    ("notify|notification|send_email|send_sms|push_notification|alert", "notification", "Notification Flow"), ("profile|update_profile|edit_profile|user_setting", "profile", "Profile Update Flow"), ("delete_account|deactivate|suspend_account", "profile", "Account Deletion Flow"),
    ("search|find|lookup|discover|browse|list_item", "search", "Search Flow"), ("upload|import_file|ingest|import_data|parse_file", "data", "Data Import Flow"), ("export|download|generate_report|report", "data", "Export Flow"),
    ("onboard|wizard|setup|configure|setup_account", "onboarding", "Onboarding Flow"), ("admin|moderate|review|approve|reject|verify", "admin", "Admin Review Flow"), ("sync|reconcile|batch_process|cron|scheduled|job", "background", "Background Job Flow"), ("webhook|callback|event_handler|handle_event", "integration", "Event Handler Flow"),
]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether text has one of the words as a substring: one alternation, compiled once."""
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def query_intent(query: Column) -> Column:
    """structural, temporal, semantic or default: word lists in that order (substrings count), then patterns."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    out = F.when(q == "", "default").when(contains_any(q, STRUCTURAL_WORDS), "structural").when(contains_any(q, TEMPORAL_WORDS), "temporal").when(contains_any(q, SEMANTIC_WORDS), "semantic")
    for pattern, intent in INTENT_PATTERNS:
        out = out.when(q.rlike(pattern), intent)
    return out.otherwise("default")


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of more than one character of a camelCase, PascalCase, snake_case or kebab-case name."""
    s = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.trim(F.regexp_replace(s, "[^a-zA-Z0-9]+", " "))
    return F.filter(F.transform(F.split(s, " +"), lambda t: F.lower(t)), lambda t: F.length(t) > 1)


def verb_class(token: Column) -> Column:
    """The verb group of a token, or the token; of two groups the later one counts."""
    table = {synonym: group for group, synonyms in VERB_GROUPS.items() for synonym in synonyms}
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, token), token)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of token arrays after verb grouping; stop tokens don't count."""
    x, y = (F.array_distinct(F.transform(t, verb_class)) for t in (a, b))
    stop = strings(STOP_TOKENS)
    union = F.size(F.array_except(F.array_union(x, y), stop))
    both = F.size(F.array_except(F.array_intersect(x, y), stop))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (union == 0), 0.0).otherwise(both / union)


def domain_tokens(path: Column, extra: Column | None = None) -> Column:
    """Distinct tokens of a path and a name that say something of the domain: over two characters, not generic."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), r"[/\-_.]")
    tokens = F.flatten(F.transform(parts, name_tokens))
    if extra is not None:
        tokens = F.concat(tokens, name_tokens(extra))
    tokens = F.filter(tokens, lambda t: F.length(t) > 2)
    return F.array_except(F.array_distinct(tokens), strings(STOP_TOKENS + PATH_TOKENS))


def url_pattern(raw: Column) -> Column:
    """The canonical path of a URL expression: quotes off, variables as :name, no query string; null if external or empty."""
    s = F.trim(raw)
    external = s.rlike("(?i)^https?://")
    s = F.regexp_replace(s, "^[\"'`]+|[\"'`]+$", "")
    s = F.regexp_replace(s, r"\$\{[^}]*?([A-Za-z][A-Za-z0-9_$]*)[^A-Za-z}]*\}", ":$1")
    s = F.regexp_replace(s, r"\$\{[^}]*\}", ":id")
    s = F.regexp_replace(s, r'"\s*\+\s*([A-Za-z_$][A-Za-z0-9_$.]*)', ":$1")
    s = F.regexp_replace(s, r'([A-Za-z_$][A-Za-z0-9_$.]*)\s*\+\s*"', "")
    s = F.regexp_replace(s, r"\?.*$", "")
    s = F.regexp_replace(s, r"\{([^{}]+)\}", ":$1")
    s = F.regexp_replace(s, "/{2,}", "/")
    s = F.when((s != "") & ~s.startswith("/"), F.concat(F.lit("/"), s)).otherwise(s)
    s = F.when(F.length(s) > 1, F.regexp_replace(s, "/+$", "")).otherwise(s)
    return F.when(external | s.isin("", "/"), None).otherwise(s)


def merged_url(base: Column, path: Column) -> Column:
    """Base URL (scheme and host are dropped) and path as one canonical pattern."""
    b, p = url_pattern(F.regexp_replace(base, "^https?://[^/]+", "")), url_pattern(path)
    both = F.regexp_replace(F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"), F.regexp_replace(p, "^/+", "")), "/{2,}", "/")
    return F.when(F.coalesce(path, F.lit("")) == "", None).when(b.isNull(), p).when(p.isNull(), b).otherwise(both)


def http_method(method: Column) -> Column:
    m = F.upper(F.trim(method))
    return F.when(m.isin(HTTP_METHODS), m).otherwise("GET")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_match(call: Column, endpoint: Column) -> Column:
    """1 equal, 0.85 equal but for variables, 0.6 one is the beginning of the other, 0.7 x share of equal segments, or 0."""
    a, b = (F.regexp_replace(F.lower(x), "/+$", "") for x in (call, endpoint))
    x, y = segments(a), segments(b)
    n, m = F.size(x), F.size(y)
    least = F.least(n, m)
    prefix = F.when(least == 0, F.lit(True)).otherwise(F.slice(x, 1, F.greatest(least, F.lit(1))) == F.slice(y, 1, F.greatest(least, F.lit(1))))
    dynamic = lambda s: s.startswith(":") | (s == "*")
    hits = F.aggregate(F.zip_with(x, y, lambda p, q: ((p == q) | dynamic(p) | dynamic(q)).cast("int")), F.lit(0), lambda s, v: s + v)
    empty = (F.coalesce(call, F.lit("")) == "") | (F.coalesce(endpoint, F.lit("")) == "")
    return F.when(empty, 0.0).when(a == b, 1.0).when(n != m, F.when(prefix, 0.6).otherwise(0.0)).when(hits == n, 0.85).otherwise(F.round(hits / n * 0.7, 2))


def path_variables(call: Column, endpoint: Column) -> Column:
    """How well the variables of two paths agree: 1, 0.95, 0.8, 0.4 each, 0 against a fixed segment; 0.5 if none."""
    x, y = segments(call), segments(endpoint)
    bare = lambda s: F.trim(F.lower(F.regexp_replace(s, r"^[:${]+|[}]+$", "")))
    stem = lambda s: F.when(F.regexp_replace(s, "ids?$", "") == "", s).otherwise(F.regexp_replace(s, "ids?$", ""))

    def one(p: Column, q: Column) -> Column:
        dp, dq = p.startswith(":") | (p.contains("{") & p.contains("}")), q.startswith(":") | (q == "*")
        v, w = bare(p), bare(q)
        both = F.when(v == w, 1.0).when(stem(v) == stem(w), 0.95).when(F.contains(stem(w), stem(v)) | F.contains(stem(v), stem(w)), 0.8).otherwise(0.4)
        return F.when(dp & dq, both).when(dp != dq, 0.0)

    scores = F.filter(F.zip_with(x, y, one), lambda v: v.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(x) != F.size(y)) | (F.size(scores) == 0), 0.5).otherwise(total / F.size(scores))


def workflow_rule(signal: Column) -> Column:
    """struct(name, domain, confidence) of the first rule with a whole word in the signal; else the first word, 0.3."""
    make = lambda name, domain, conf: F.struct(name.alias("name"), F.lit(domain).alias("domain"), F.lit(conf).alias("confidence"))
    out = None
    for words, domain, name in WORKFLOW_RULES:
        hit = signal.rlike(rf"(?i)\b({words})\b")
        out = F.when(hit, make(F.lit(name), domain, 0.75)) if out is None else out.when(hit, make(F.lit(name), domain, 0.75))
    first = F.initcap(F.regexp_replace(F.split(F.trim(signal), r"\s+")[0], "[_-]+", " "))
    return out.otherwise(make(F.concat(first, F.lit(" Flow")), "unknown", 0.3))


def entity_name(name: Column, aggressive: bool = True) -> Column:
    """A comparable form of an entity's name."""
    marks = "\"`“”‘’'()\\[\\]{}<>"
    s = F.regexp_replace(F.lower(F.trim(name)), f"^[{marks}]+|[{marks}]+$", "")
    s = F.trim(F.regexp_replace(F.translate(s, "_/-", "   "), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^0-9a-zA-Z+#. ]+", " "), r"\s+", " ")) if aggressive else s


def source_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def content(mode: str, summary: Column, comment: Column, code: Column, *names: Column) -> Column:
    """What to show of a node: one field by mode, or for `auto` the first that isn't blank."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(*[full(n) for n in names])
    return {"summary": full(summary), "comment": full(comment), "code": full(code), "name": name, "auto": F.coalesce(full(summary), full(comment), name)}[mode]


def wildcard_pattern(pattern: str) -> str:
    """A full-match regex of a pattern in which * stands for any text."""
    return "^(?:" + ".*".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in part) for part in pattern.split("*")) + ")$"


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def find_span(text: Column, name: Column) -> Column:
    """struct(start, end): the first place of a name in a text in any case, from 0; null if there is none."""
    at = F.position(F.lower(name), F.lower(text))
    return F.when((F.length(name) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(name)).alias("end")))


def text_chunks(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters, in order; an empty text is one empty piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / most).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.substring(text, i * most + 1, F.lit(most)))


def truncated(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


#: Fixed value: the name space of URLs
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """The version 5 UUID of a name in a name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def entity_id(kind: Column, name: Column) -> Column:
    """The identifier of an entity: by type and normalised name."""
    return uuid5(F.concat(kind, F.lit("::"), entity_name(name)))


def workflow_id(steps: Column) -> Column:
    """A digest of a workflow's steps, whatever their order."""
    return F.concat(F.lit("wf::"), F.substring(F.sha2(F.array_join(F.array_sort(steps), "|"), 256), 1, 16))
