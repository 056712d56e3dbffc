"""File rules: what is ignored, how a path or its bytes are classified, what a file says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.ids import strip
from loomwork.functions.text import clip

# Directories and extensions that are never ingested (nor any dot directory).
IGNORE_DIRS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build", ".next", ".nuxt",
    "target", "vendor", ".idea", ".vscode", "coverage", ".cache", "out", ".turbo",
    "bin", "obj", ".gradle", ".terraform", "site-packages", ".tox",
)
IGNORE_EXTS = (
    ".zip", ".tar", ".gz", ".tgz", ".7z", ".rar", ".jar", ".war",
    ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".class", ".pyc", ".pyd",
    ".lock", ".map", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp4", ".mov", ".webm", ".mkv", ".avi", ".mp3", ".wav", ".flac", ".ogg",
    ".iso", ".dmg", ".db", ".sqlite", ".parquet",
)

# Extensions by modality.
IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".tif")
CODE_EXTS = (
    ".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".kt", ".c", ".h", ".cpp",
    ".cc", ".cs", ".rb", ".php", ".swift", ".scala", ".sh", ".sql", ".css", ".scss",
)
DOCUMENT_EXTS = (".pdf", ".docx", ".pptx")
NOTEBOOK_EXT = ".ipynb"

# A binary value holds less than 2 GiB; the bytes of larger files stay where they are.
MAX_VALUE_BYTES = 2**31 - 2**20


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' for none. Leading dots of a name are no extension."""
    return F.lower(F.regexp_extract(path, "[^./][^/]*(\\.[^./]*)$", 1))


def in_ignored_dir(path: Column) -> Column:
    """True if any directory of a relative path is ignored or starts with a dot."""
    dirs = F.split(path, "/")
    dirs = F.slice(dirs, F.lit(1), F.size(dirs) - 1)
    return F.exists(dirs, lambda d: d.isin(*IGNORE_DIRS) | d.startswith("."))


def is_ignored(path: Column) -> Column:
    return in_ignored_dir(path) | extension(path).isin(*IGNORE_EXTS)


def size_in_bounds(size: Column, most: int | None = None) -> Column:
    """Not empty, and at most ``most`` bytes if a bound is given."""
    return size > 0 if most is None else (size > 0) & (size <= most)


def looks_textual(content: Column) -> Column:
    """No NUL anywhere, and valid UTF-8."""
    has_nul = F.contains(content, F.lit(b"\x00"))
    return ~has_nul & F.is_valid_utf8(content.cast("string"))


def modality(path: Column, textual: Column) -> Column:
    """Class of a file from its extension; ``textual`` decides the rest."""
    ext = extension(path)
    return (
        F.when(ext.isin(*IMAGE_EXTS), "image")
        .when(ext.isin(*DOCUMENT_EXTS), F.substring(ext, 2, 8))
        .when(ext == NOTEBOOK_EXT, "notebook")
        .when(~textual, "binary")
        .when(ext.isin(*CODE_EXTS), "code")
        .otherwise("text")
    )


def is_binary(modality_col: Column) -> Column:
    return ~modality_col.isin("text", "code", "notebook")


def _bare(ext: Column) -> Column:
    return F.regexp_replace(ext, "^\\.+", "")


def binary_stub(path: Column, size: Column) -> Column:
    ext = F.coalesce(F.nullif(_bare(extension(path)), F.lit("")), F.lit("no-ext"))
    return F.format_string("[binary file %s, %d bytes]", ext, size)


def image_stub(path: Column) -> Column:
    return F.format_string("[image file %s]", _bare(extension(path)))


def document_stub(path: Column, size: Column) -> Column:
    return F.format_string("[%s document, %d bytes]", _bare(extension(path)), size)


def snippet(content: Column, chars: int | None = None) -> Column:
    """A text file, or its first ``chars`` characters; NULL if the bytes are not UTF-8."""
    return clip(F.try_validate_utf8(content.cast("string")), chars)


def notebook_text(content: Column, chars: int | None = None) -> Column:
    """Cell sources joined by newlines; a source is a string or a list of strings.

    NULL if the bytes are not a notebook.
    """
    doc = F.try_parse_json(F.make_valid_utf8(content.cast("string")))
    cells = F.try_variant_get(doc, "$.cells", "array<variant>")

    def source(cell: Column) -> Column:
        listed = F.try_variant_get(cell, "$.source", "array<string>")
        return F.coalesce(F.array_join(listed, ""), F.try_variant_get(cell, "$.source", "string"), F.lit(""))

    joined = F.array_join(F.transform(F.coalesce(cells, F.array().cast("array<variant>")), source), "\n")
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), clip(joined, chars))


def stub_text(path: Column, size: Column) -> Column:
    """What a file says when its bytes are not read as text."""
    ext = extension(path)
    return (
        F.when(ext.isin(*IMAGE_EXTS), image_stub(path))
        .when(ext.isin(*DOCUMENT_EXTS, NOTEBOOK_EXT), document_stub(path, size))
        .otherwise(binary_stub(path, size))
    )


def classify(path: Column, content: Column) -> Column:
    """Modality from path and bytes; a notebook that cannot be read counts as binary."""
    by_ext = modality(path, looks_textual(content))
    broken = (by_ext == "notebook") & notebook_text(content).isNull()
    return F.when(broken, "binary").otherwise(by_ext)


def file_text(path: Column, content: Column, size: Column, modality_col: Column) -> Column:
    """What a file says: its text, its notebook cells, or a typed stub."""
    said = F.when(modality_col.isin("text", "code"), snippet(content)).when(
        modality_col == "notebook", notebook_text(content)
    )
    return strip(F.coalesce(said, stub_text(path, size)))


def file_extra(path: Column, size: Column, modality_col: Column, **more: Column) -> Column:
    """The ``extra`` JSON of a file artifact."""
    return F.to_json(
        F.struct(
            path.alias("path"),
            size.alias("size"),
            modality_col.alias("modality"),
            is_binary(modality_col).alias("binary"),
            *[c.alias(n) for n, c in more.items()],
        ),
        {"ignoreNullFields": "false"},
    )
