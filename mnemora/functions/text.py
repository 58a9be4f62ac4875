"""Text functions: word sets, entities, segments, hashes, signatures, units and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that",
    "the", "this", "to", "was", "were", "will", "with", "we", "you", "your", "i", "our", "so", "if", "when", "not", "no", "do", "does",
    "did", "been", "being", "which", "what", "where", "why", "how", "can", "could", "should", "would", "may", "might", "must", "any", "all",
    "some", "than", "then", "there", "these", "those", "they", "them", "their",
)
ALLCAPS_STOP = (
    "NOT", "AND", "OR", "BUT", "FOR", "THE", "ALL", "NEW", "API", "WHY", "HOW", "WHAT", "WHEN", "TODO", "FIXME", "BUG", "NB", "WAS", "ARE",
    "AKA", "TBD", "ETA", "FYI", "URL", "HTTP", "HTTPS", "JSON", "HTML", "CSS", "XML", "YAML", "UTF",
)
IDENTIFIER_STOP = (
    "as-is", "at-least", "make-or", "one-off", "up-to", "drop-in", "off-the", "out-of", "as-of", "in-flight", "in-progress", "at-spi",
    "one-shot", "high-level", "low-level", "cross-platform", "run-time", "real-time", "re-read", "re-run", "re-do", "re-try", "re-use",
    "re-load", "re-init", "lock-in", "check-in", "follow-up", "sign-in", "sign-out", "log-in", "log-out", "set-up", "clean-up", "stand-up",
    "write-up", "fall-back", "work-around", "pre-auth", "pre-built", "post-hoc", "case-by", "day-to", "face-to", "self-aware", "self-host",
    "self-care", "both", "first", "never", "always", "before", "after", "then", "valid_from", "valid_to", "last_access", "access_count",
    "review_count", "next_review", "review_interval_days", "easiness_factor", "relevance",
)
INJECTION = (
    r"(?i)ignore\s+previous\s+instructions",
    r"(?i)you\s+are\s+now\b",
    r"(?im)^system\s*:",
    r"(?i)disregard\s+(all\s+)?prior\s+(instructions|context)",
    r"(?i)new\s+instructions?\s*:",
)
JUNK_LEADS = ("**", "- ", "* ", "#", "```", "|", ">")
FEEDBACK_WORDS = ("don't", "do not", "stop ", "always ", "never ", "prefer ", "avoid ")
SELF_WORDS = ("i ", "my ", "we ", "i'm", "i am ")
ROLE_WORDS = ("role", "background", "year", "experience", "engineer", "scientist")
REFERENCE_WORDS = ("see ", "tracked in ", "lives at ", "url", "https://", "linear", "grafana")
ERODED = "·"
FILE_ENDINGS = "py|md|json|sh|cu|c|h|txt|toml|gguf|enc|loer"
CODE_SPAN = r"`([^`\n]{2,40})`"
IDENTIFIER = r"\b[a-zA-Z][a-zA-Z0-9]+(?:[_\-][a-zA-Z0-9]+){1,}\b"
FILE_NAME = rf"[A-Za-z0-9_\-./]+\.(?:{FILE_ENDINGS})\b"
ACRONYM = r"\b[A-Z]{3,}[0-9]*\b"
ISSUE, VERSION = r"#\d{3,}", r"\bv\d+(?:\.\d+){1,3}\b"
PHRASE = r"\b(?:[A-Z][a-z]{2,})(?:\s+[A-Z][a-z]{2,}){1,2}\b"
DATE = r"\b20\d\d-[01]\d-[0-3]\d\b"
FIRST_SENTENCE = r"(.{10,}?[.!?])(\s|$)"
# ---- end of fixed values ----


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(names) -> Column:
    return F.array(*(F.lit(n) for n in names))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def word_set(text: str | Column) -> Column:
    """Distinct lower-case words of three letters, digits or underscores and more, without stopwords; empty for null."""
    found = _all(F.lower(F.coalesce(_c(text), F.lit(""))), "[a-z0-9_]+")
    return F.array_except(F.filter(F.array_distinct(found), lambda w: F.length(w) >= 3), _words(STOPWORDS))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared share of two sets; 0 for two empty ones."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def entities(text: str | Column) -> Column:
    """Code spans, identifiers, file names, acronyms, numbers of issues, versions and capitalised phrases, in lower case."""
    t = F.coalesce(_c(text), F.lit(""))
    code = F.filter(F.transform(F.regexp_extract_all(t, F.lit(CODE_SPAN), 1), lambda x: F.trim(x)), lambda s: (s != "") & ~s.rlike(r"^\d+$"))
    ids = F.filter(F.transform(_all(t, IDENTIFIER), F.lower), lambda s: (F.length(s) >= 5) & ~F.array_contains(_words(IDENTIFIER_STOP), s))
    files = _all(t, FILE_NAME)
    caps = F.filter(_all(t, ACRONYM), lambda s: (F.length(s) <= 12) & ~F.array_contains(_words(ALLCAPS_STOP), s))
    issues, versions = _all(t, ISSUE), _all(t, VERSION)
    phrases = F.filter(F.transform(_all(t, PHRASE), F.lower), lambda s: ~F.array_contains(_words(IDENTIFIER_STOP), s))
    return F.array_distinct(F.concat(F.transform(F.concat(code, files, caps, versions), F.lower), ids, issues, phrases))


def segments(body: str | Column) -> Column:
    """Paragraphs between blank lines, trimmed, in order."""
    parts = F.split(F.coalesce(_c(body), F.lit("")), r"\n\s*\n")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def segment_hash(content: str | Column) -> Column:
    """Sixteen hex digits of the text in lower case with runs of white space as one blank."""
    normal = F.regexp_replace(F.regexp_replace(F.lower(_c(content)), r"^\s+|\s+$", ""), r"\s+", " ")
    return F.substring(F.sha2(normal, 256), 1, 16)


def short_hash(text: str | Column, digits: int = 16) -> Column:
    """First hex digits of SHA-256."""
    return F.substring(F.sha2(_c(text), 256), 1, digits)


def token_estimate(text: str | Column) -> Column:
    """Characters / 3.6, cut to a whole number."""
    return F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / 3.6).cast("bigint")


def token_estimate_up(text: str | Column) -> Column:
    """Characters / 4, rounded up."""
    return F.ceil(F.length(F.coalesce(_c(text), F.lit(""))) / 4).cast("bigint")


def slug(text: str | Column, n: int = 40) -> Column:
    """Lower case, other characters as one underscore, cut; `atom` when nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, n)
    return F.when(s == "", "atom").otherwise(s)


def first_sentence(text: str | Column, limit: int = 110) -> Column:
    """Up to the first end of a sentence behind ten characters, cut with an ellipsis beyond the limit."""
    s = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    hit = F.regexp_extract(s, FIRST_SENTENCE, 1)
    out = F.when(hit != "", F.trim(hit)).otherwise(s)
    return F.when(F.length(out) > limit, F.concat(F.rtrim(F.substring(out, 1, limit - 1)), F.lit("…"))).otherwise(out)


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def kind_of(text: str | Column) -> Column:
    """feedback, user, reference or project, by key words."""
    t = F.lower(_c(text))
    return F.when(_any(t, FEEDBACK_WORDS), "feedback").when(_any(t, SELF_WORDS) & _any(t, ROLE_WORDS), "user").when(_any(t, REFERENCE_WORDS), "reference").otherwise("project")


def named_days(text: str | Column) -> Column:
    """Distinct ISO days in a text, sorted."""
    return F.array_sort(F.array_distinct(_all(F.coalesce(_c(text), F.lit("")), DATE)))


def injection_markers(text: str | Column) -> Column:
    """Numbers (from 1) of the injection patterns that occur."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(i)) for i, p in enumerate(INJECTION, 1))))


def is_junk(title: str | Column, body: str | Column) -> Column:
    """Leftovers of mark-up, cut-off texts and texts too short for a fact."""
    t, b = _c(title), _c(body)
    lead = F.lit(False)
    for j in JUNK_LEADS:
        lead = lead | F.startswith(F.ltrim(b), F.lit(j)) | F.startswith(F.ltrim(t), F.lit(j))
    return lead | F.rtrim(b).rlike(r"(\.\.\.|…)$") | (F.length(b) < 25) | F.contains(t, F.lit("**")) | F.contains(t, F.lit("…"))


def pair_key(a: str | Column, b: str | Column) -> Column:
    """The two ids in order, joined by two colons."""
    return F.concat(F.least(_c(a), _c(b)), F.lit("::"), F.greatest(_c(a), _c(b)))


def pair_id(a: str | Column, b: str | Column) -> Column:
    """Twelve hex digits for an unordered pair."""
    return F.substring(F.sha1(F.concat_ws("|", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))), 1, 12)


def has_terms(text: str | Column, terms: Column) -> Column:
    """Whether every term is a whole word of the text."""
    words = F.array_distinct(_all(F.lower(F.coalesce(_c(text), F.lit(""))), "[a-z0-9_]+"))
    return F.size(F.array_except(F.transform(terms, F.lower), words)) == 0


def has_any_term(text: str | Column, terms: Column) -> Column:
    """Whether any term is a whole word of the text."""
    words = F.array_distinct(_all(F.lower(F.coalesce(_c(text), F.lit(""))), "[a-z0-9_]+"))
    return F.coalesce(F.arrays_overlap(F.transform(terms, F.lower), words), F.lit(False))


def erode(body: str | Column, key: str | Column, n: str | Column, seed: int = 0) -> Column:
    """n visible characters masked, chosen by a hash of (seed, key, position); masked ones are not chosen again."""
    b, k, n = _c(body), _c(key), _c(n)
    chars = F.filter(F.split(b, ""), lambda c: c != "")
    hashes = F.transform(chars, lambda c, i: F.when(~c.rlike(rf"[\s{ERODED}]"), F.xxhash64(F.lit(seed), k, i)))
    found = F.array_sort(F.array_compact(hashes))
    last = F.get(found, F.least(n.cast("int"), F.size(found)) - 1)
    # the bound is a lambda variable, so that it is worked out once and not for every character
    masked = F.transform(F.array(last), lambda m: F.array_join(F.zip_with(chars, hashes, lambda c, h: F.when(h <= m, F.lit(ERODED)).otherwise(c)), ""))
    return F.when((n <= 0) | (b == "") | last.isNull(), b).otherwise(F.get(masked, F.lit(0)))


def intact_share(body: str | Column) -> Column:
    """Share of visible characters that are not masked; 1 without visible ones."""
    visible = F.length(F.regexp_replace(_c(body), r"\s", ""))
    masked = visible - F.length(F.regexp_replace(_c(body), rf"[\s{ERODED}]", ""))
    return F.when(visible > 0, 1 - masked / visible).otherwise(F.lit(1.0))


def typed_scalar(raw: str | Column) -> Column:
    """Struct of `kind` (bool, list, float, int, string) and the value in the field of that kind.

    A comma-separated text in brackets is a list; a text with a dot is tried as a float, any other as an integer.
    Digits grouped by underscores are not numbers here.
    """
    s = F.trim(_c(raw))
    low = F.lower(s)
    is_list = F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]"))
    items = F.filter(F.transform(F.split(F.regexp_replace(s, r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    number = F.when(F.contains(s, F.lit(".")), s.try_cast("double"))
    whole = F.when(~F.contains(s, F.lit(".")), s.try_cast("bigint"))
    is_bool = low.isin("true", "false")
    kind = F.when(is_bool, "bool").when(is_list, "list").when(number.isNotNull(), "float").when(whole.isNotNull(), "int").otherwise("string")
    return F.struct(
        kind.alias("kind"), F.when(is_bool, low == "true").alias("bool"), F.when(is_list, items).alias("list"),
        F.when(~is_list, number).alias("float"), F.when(~is_list, whole).alias("int"), F.when(kind == "string", s).alias("string"),
    )
