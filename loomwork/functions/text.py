"""Text projections: tokens, titles, transcripts' block text, timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.ids import WHITESPACE, strip

# Terms that never become topics. The name of one's own product belongs here
# too; pass it through ``extra_stopwords``.
STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "have", "has", "are", "was",
    "were", "will", "would", "should", "could", "can", "not", "but", "you", "your",
    "all", "any", "out", "use", "used", "using", "add", "added", "adds", "fix", "fixed",
    "fixes", "update", "updated", "updates", "remove", "removed", "change", "changed",
    "changes", "new", "old", "now", "get", "set", "let", "via", "into", "onto", "than",
    "then", "when", "what", "which", "who", "how", "why", "where", "code", "file", "files",
    "function", "return", "import", "self", "none", "true", "false", "null", "value",
    "values", "test", "tests", "make", "made", "also", "more", "less", "some", "one", "two",
    "first", "last", "next", "main", "src", "app", "run", "running", "need", "needs", "like",
    "just", "only", "here", "there", "they", "them", "their", "its", "his", "her", "our",
    "able", "based", "type", "types", "data", "name", "names", "line", "lines", "page",
    "user", "users", "call", "calls", "called", "work", "works", "working", "around",
    "claude", "session",
    "interface", "export", "const", "var", "string", "number", "boolean", "void",
    "enum", "async", "await", "class", "public", "private", "static", "promise", "proto",
    "generated", "title", "label", "props", "component", "default", "module", "package",
    "json", "html", "css", "div", "span", "href", "http", "https", "www", "com", "org",
    "def", "elif", "args", "kwargs", "param", "params", "result", "results", "response",
    "request", "error", "errors", "exception", "throw", "catch", "try", "else", "while",
)
TOKEN_PATTERN = "[a-zA-Z][a-zA-Z0-9_+#-]{2,}"

# Starts of user turns that are tool noise, not prompts.
NOISE_PREFIXES = (
    "<task-notification>",
    "<system-reminder>",
    "<command-",
    "<local-command-",
    "Caveat:",
    "[Request interrupted",
)

# Lengths of titles, in characters. Texts are kept whole; a length is an argument where a
# page or a prompt has to bound one.
COMMIT_TITLE, MESSAGE_TITLE, SESSION_TITLE = 200, 120, 200
VECTOR_TITLE = 300

# The characters that end a line, beyond the line feed itself.
_LINE_ENDS = "\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"


def clip(col: Column, n: int | None) -> Column:
    """First ``n`` code points; all of them for None."""
    return col if n is None else F.substring(col, 1, n)


def blank_to_null(col: Column) -> Column:
    """Empty string counts as absent."""
    return F.nullif(col, F.lit(""))


def tokens(text: Column, extra_stopwords: Sequence[str] = ()) -> Column:
    """Distinct lower-case words of a text, without stop words."""
    stop = F.array(*[F.lit(w) for w in (*STOPWORDS, *extra_stopwords)])
    words = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.array_except(F.transform(words, F.lower), stop)


def corpus_text(title: Column, text: Column) -> Column:
    """What an artifact says: title and text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def first_line(col: Column) -> Column:
    return F.regexp_extract(col, f"^[^{_LINE_ENDS}]*", 0)


def commit_title(message: Column, sha: Column) -> Column:
    """First line of the (trimmed) message, or the short sha of a commit without one."""
    return F.when(F.coalesce(message, F.lit("")) != "", clip(first_line(message), COMMIT_TITLE)).otherwise(
        clip(sha, 12)
    )


def is_noise(text: Column) -> Column:
    lead = F.ltrim(text, F.lit(WHITESPACE))
    found = F.lit(False)
    for prefix in NOISE_PREFIXES:
        found = found | lead.startswith(prefix)
    return found


def parse_iso(value: Column) -> Column:
    """ISO timestamp with 'Z' or an offset; naive means UTC; anything else is NULL."""
    return F.try_to_timestamp(value)


def to_utc(ts: Column) -> Column:
    """Naive timestamps are UTC (the session zone is pinned to UTC)."""
    return ts.cast("timestamp")


def iso_utc(ts: Column) -> Column:
    """ISO text of a timestamp, microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", F.lit("")).otherwise(micros), F.lit("+00:00"))


# --- transcript content: a VARIANT that is a string or an array of blocks ---


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def content_blocks(content: Column) -> Column:
    """The blocks of array content; NULL for any other content."""
    return F.try_variant_get(content, "$", "array<variant>")


def block_text(content: Column) -> Column:
    """Readable text of a message: the string itself, or its text blocks joined by newlines."""
    texts = F.transform(
        F.filter(
            content_blocks(content),
            lambda b: (F.try_variant_get(b, "$.type", "string") == "text")
            & _is_string(F.try_variant_get(b, "$.text", "variant")),
        ),
        lambda b: F.try_variant_get(b, "$.text", "string"),
    )
    joined = F.array_join(texts, "\n")
    return strip(
        F.when(_is_string(content), F.try_variant_get(content, "$", "string"))
        .otherwise(F.coalesce(joined, F.lit("")))
    )


# Inputs of a tool call that name a file.
PATH_KEYS = ("file_path", "notebook_path", "path")


def tool_paths(content: Column) -> Column:
    """File paths named by the tool calls of a message, one entry per reference."""

    def named(block: Column) -> Column:
        found = [
            F.when(
                _is_string(F.try_variant_get(block, f"$.input.{key}", "variant")),
                F.try_variant_get(block, f"$.input.{key}", "string"),
            )
            for key in PATH_KEYS
        ]
        return F.filter(F.array(*found), lambda p: p.isNotNull() & (p != ""))

    calls = F.filter(
        content_blocks(content), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"
    )
    return F.coalesce(F.flatten(F.transform(calls, named)), F.array().cast("array<string>"))


def absolute_path(path: Column, cwd: Column) -> Column:
    """Absolute, with '.', '..' and doubled slashes collapsed; NULL if it cannot be anchored."""
    full = F.when(path.startswith("/"), path).when(
        cwd.startswith("/"), F.concat(cwd, F.lit("/"), path)
    )
    parts = F.aggregate(
        F.filter(F.split(full, "/"), lambda p: (p != "") & (p != ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def compose(*parts: Column) -> Column:
    """Non-blank parts separated by an empty line."""
    return F.array_join(
        F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n"
    )
