"""Text functions over columns. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a task.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "into", "is", "it", "its", "my", "of", "on", "or", "our", "the", "this", "to", "use", "we", "what", "when",
    "where", "which", "with", "would", "you", "your", "add", "change", "create", "implement", "logic", "make", "please", "update",
)

# File suffix to language.
LANGUAGES = {
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".c": "c", ".h": "c-header", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp-header", ".swift": "swift",
    ".dart": "dart", ".yaml": "yaml", ".yml": "yaml", ".properties": "properties", ".sql": "sql", ".md": "markdown",
}

# Letters whose marks the index drops, and what is left of them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def casefold(x: Column) -> Column:
    """Lower case with the one letter of the supported languages that folds to two."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def fold(x: Column) -> Column:
    """Lower case without diacritics, as the full-text index stores words; ß stays."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def index_tokens(x: Column) -> Column:
    """Runs of letters and digits, folded: what the full-text index holds. Only words beyond ASCII are looked up letter by letter."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.length(w), w).otherwise(F.translate(w, MARKED, PLAIN)))


def query_tokens(x: Column, most: int = 20) -> Column:
    """Runs of letters, digits and _ . - with over one character, the first `most`; one that the index splits is a phrase there."""
    found = F.regexp_extract_all(casefold(x), F.lit(r"([\p{L}\p{N}_.\-]+)"), F.lit(1))
    return F.slice(F.filter(found, lambda w: F.length(w) > 1), 1, most)


def normalize_search(x: Column) -> Column:
    return F.trim(F.replace(casefold(x), F.lit("\\"), F.lit("/")))


def _words(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(?U)([\w.$/\-]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, r"^[.$/\-]+|[.$/\-]+$", "")), lambda w: w != "")


def _firsts(words: Column, least: int) -> Column:
    """Those with `least` letters that aren't stopwords, each casefolded form once, in order."""
    kept = F.filter(words, lambda w: (F.length(casefold(w)) >= least) & ~casefold(w).isin(*STOPWORDS))
    return F.transform(F.array(kept), lambda k: F.filter(k, lambda w, i: F.array_position(F.transform(k, casefold), casefold(w)) == i + 1))[0]


def search_terms(x: Column) -> Column:
    """Words, then their camel-case and dotted parts, in order. Meant for tasks, which are short."""
    return _firsts(F.flatten(F.transform(_words(x), lambda w: F.concat(F.array(w), camel_parts(w), F.when(F.contains(w, F.lit(".")), F.filter(F.split(w, r"\."), lambda p: p != "")).otherwise(F.array().cast("array<string>"))))), 2)


def camel_parts(w: Column) -> Column:
    return F.split(F.regexp_replace(w, r"(?<=[a-z0-9])(?=[A-Z])", " "), " ")


def exact_terms(x: Column) -> Column:
    """Words of three letters or more as they are, for looking names up."""
    return _firsts(_words(x), 3)


def package_name(qualified: Column, kind: Column) -> Column:
    """What stands before the last dot of the part before #; a package is its own."""
    owner = casefold(F.substring_index(qualified, "#", 1))
    return F.when(kind == "package", owner).when(F.contains(owner, F.lit(".")), F.regexp_replace(owner, r"\.[^.]*$", "")).otherwise(F.lit(""))


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("text"))


def estimate_tokens(x: Column) -> Column:
    """A token for 3.6 bytes, at least one for a text that isn't empty."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.octet_length(x) / F.lit(3.6)))).cast("long")


def heading_tags(heading: Column) -> Column:
    """section:<word> for up to eight ASCII words of two letters or more."""
    words = F.regexp_extract_all(F.lower(heading), F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    return F.transform(F.slice(words, 1, 8), lambda w: F.concat(F.lit("section:"), w))


def truncate(content: Column, tokens: Column, marker: str = "\n... [truncated]") -> Column:
    """At most as many characters as so many tokens stand for, 80 at least, then the marker."""
    most = F.greatest(F.lit(80), F.floor(tokens * F.lit(3.6))).cast("int")
    return F.when(F.length(content) <= most, content).otherwise(F.concat(F.substring(content, F.lit(1), most), F.lit(marker)))


def compact(content: Column, lines: int = 14, marker: str = "\n... [compressed]") -> Column:
    """The first lines, then the marker where there are more."""
    split = F.split(content, "\n")
    return F.when(F.size(split) <= lines, content).otherwise(F.concat(F.array_join(F.slice(split, 1, lines), "\n"), F.lit(marker)))


# Patterns for secrets are this library's own; only the shape of the marker is given.
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "<REDACTED:private_key>"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "<REDACTED:aws_access_key>"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "<REDACTED:github_token>"),
    ("generic_secret", r"(?i)\b(api[_-]?key|secret|token|password|passwd)(\s*[:=]\s*)([\"'])([^\"'\s]{8,})([\"'])", "$1$2$3<REDACTED:generic_secret>$5"),
)


def redact_secrets(x: Column) -> Column:
    for _, pattern, marker in SECRETS:
        x = F.regexp_replace(x, pattern, marker)
    return x


def secret_kinds(x: Column) -> Column:
    found = F.array(*[F.when(F.rlike(x, F.lit(p)), F.lit(k)) for k, p, _ in SECRETS])
    return F.filter(found, lambda k: k.isNotNull())
