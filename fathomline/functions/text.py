"""Column functions on text: identifiers, tokens, clipping, redaction."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the five tokenizers, and the patterns of secrets and of research turns.
RANKING_STOP = ["about", "after", "also", "among", "based", "from", "into", "paper", "papers", "research", "that", "their", "these", "this", "using", "which", "with", "work"]
PROFILE_STOP = ["across", "active", "all", "and", "are", "about", "after", "again", "against", "also", "been", "being", "build", "both", "can", "could", "from", "for", "have", "how", "into", "introduce", "its", "more", "paper", "papers", "research", "should", "some", "that", "their", "there", "these", "this", "those", "using", "use", "want", "what", "when", "where", "which", "with", "would"]
CLUSTER_STOP = ["about", "after", "also", "among", "based", "been", "before", "being", "between", "both", "can", "could", "from", "have", "into", "more", "most", "other", "over", "approach", "approaches", "data", "method", "methods", "model", "models", "paper", "performance", "propose", "proposed", "result", "results", "show", "shows", "study", "such", "task", "tasks", "than", "that", "their", "these", "they", "this", "through", "toward", "using", "which", "while", "with", "without", "work", "we", "our", "the", "and", "for", "are", "was", "were"]
RELATED_STOP = ["this", "that", "with", "from", "using", "paper", "based", "their"]
DIGEST_STOP = ["about", "after", "also", "among", "based", "been", "being", "between", "from", "have", "into", "more", "most", "other", "paper", "papers", "propose", "result", "results", "show", "shows", "such", "than", "that", "their", "these", "they", "this", "through", "using", "which", "while", "with", "without", "work", "the", "and", "for", "are", "was", "were", "our", "we"]
SECRETS = [
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\bsk-[A-Za-z0-9_-]{12,}",
    r"(?i)\b(api[_ -]?key|access[_ -]?token|secret|password)\b\s*[:=]\s*[^\s,;]+",
    r"\b[A-Za-z0-9+/]{40,}={0,2}\b",
]
RESEARCH_HINT = r"(?i)\b(paper|research|arxiv|study|hypothesis|experiment|evaluation|benchmark|dataset|model|agent|algorithm|method|architecture|training|inference|embedding|retrieval|reasoning|scientific|literature|theorem|proof|simulation|biology|protein|medicine|physics|chemistry|economics|robot|vision|language|learning)\b"
NEGATIVE_CUE = r"(?i)\b(avoid|de-emphasize|deemphasize|less of|not interested|exclude)\b"
LEAD_IN = r"(?i)^(?:i\s+(?:care about|am interested in|want|prefer)|please|focus on)\s+"
WORD = r"[\p{L}\p{N}]+"
PLAIN_TOKEN = r"[a-z][a-z0-9-]{2,}"


def words(text: Column) -> Column:
    """Analyzer of the lexical index: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def token_set(text: Column, stop: list[str]) -> Column:
    """Distinct ASCII tokens of three characters or more without stop words, in order of first occurrence."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_TOKEN), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """Collapsed white space; longer texts are cut to ``limit`` - 1 characters and an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def slug(title: Column, date: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", date, F.substring(body, 1, 60))


def stable_id(prefix: str, *parts: Column, size: int = 20) -> Column:
    """Prefix and the first hexadecimal digits of the SHA-256 of all parts; a null part counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, size))


def stable_key(prefix: str, *parts: object, size: int = 20) -> str:
    """The identifier that :func:`stable_id` gives for the same parts."""
    joined = "\x1f".join("" if p is None else str(p) for p in parts)
    return f"{prefix}_{hashlib.sha256(joined.encode()).hexdigest()[:size]}"


def query_items(query: Column) -> Column:
    """The first 20 items of a query, as words with inner hyphens and underscores."""
    return F.slice(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), 1, 20)


def related_terms(text: Column) -> Column:
    """Up to 12 distinct words of four characters or more that describe a paper."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9-]{3,}"), F.lit(0)), F.lower)
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(RELATED_STOP))), 1, 12)


def scholarly_id(url: Column) -> Column:
    """arXiv identifier without version, else DOI, else null."""
    arxiv = F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([^?#]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(arxiv, r"\.pdf$", ""), r"v[0-9]+$", "")
    doi = F.regexp_extract(url, r"doi\.org/([^?#]+)", 1)
    return F.when(bare != "", F.concat(F.lit("ARXIV:"), bare)).when(doi != "", F.concat(F.lit("DOI:"), F.url_decode(doi)))


def jitter(id: Column) -> Column:
    """A number in 0..1 from the identifier's hash."""
    return F.conv(F.substring(F.sha2(id.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def clean_label(text: Column) -> Column:
    return F.regexp_replace(F.substring(squeeze(text), 1, 120), "^[ .,:;-]+|[ .,:;-]+$", "")


def clean_context(text: Column) -> Column:
    return F.substring(redact(squeeze(text)), 1, 240)
