"""What a path says about a file: language, category, MIME type, whether it is binary, whether it is ignored."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by ending or name, categories, MIME types, binary endings, ignored paths.
LANGUAGE_OF = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".mts": "typescript", ".cts": "typescript", ".py": "python", ".pyw": "python", ".pyi": "python", ".cs": "csharp", ".csx": "csharp",
    ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".rb": "ruby", ".rake": "ruby", ".sh": "bash", ".bash": "bash",
    ".zsh": "bash", ".fish": "bash", ".sql": "sql", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".csv": "csv",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".sass": "css", ".less": "css", ".md": "markdown", ".mdx": "markdown",
    ".rst": "rst", ".txt": "text", ".adoc": "asciidoc", ".env": "env", ".ini": "ini", ".cfg": "ini", ".conf": "ini", ".tf": "terraform",
    ".hcl": "hcl", "Dockerfile": "dockerfile", ".dockerfile": "dockerfile", ".pdf": "pdf", ".docx": "docx", ".odt": "odt", ".pptx": "pptx",
    ".xlsx": "xlsx", ".log": "log",
}
CATEGORY_OF = {
    "javascript": "code", "typescript": "code", "python": "code", "csharp": "code", "java": "code", "go": "code", "rust": "code", "c": "code",
    "cpp": "code", "php": "code", "kotlin": "code", "swift": "code", "ruby": "code", "bash": "code", "sql": "code", "markdown": "documentation",
    "rst": "documentation", "text": "documentation", "asciidoc": "documentation", "html": "documentation", "pdf": "data", "docx": "data",
    "odt": "data", "pptx": "data", "xlsx": "data", "csv": "data", "json": "config", "yaml": "config", "toml": "config", "xml": "config",
    "env": "config", "ini": "config", "terraform": "config", "hcl": "config", "dockerfile": "config",
}
MIME = {
    "javascript": "application/javascript", "typescript": "application/typescript", "python": "text/x-python", "json": "application/json",
    "yaml": "application/yaml", "html": "text/html", "css": "text/css", "markdown": "text/markdown", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "csv": "text/csv",
}
BINARY = (
    ".png .jpg .jpeg .gif .bmp .ico .svg .mp3 .mp4 .wav .avi .mov .zip .tar .gz .bz2 .xz .7z .rar .exe .dll .so .dylib .a .lib "
    ".wasm .pyc .pyo .class .ttf .otf .woff .woff2 .eot .db .sqlite .sqlite3"
).split()
IGNORED = (
    "node_modules/** .git/** dist/** build/** bin/** obj/** coverage/** .cache/** venv/** __pycache__/** *.pyc *.pyo *.class *.o *.a *.so "
    "*.dll *.exe *.bin *.lock package-lock.json yarn.lock pnpm-lock.yaml *.min.js *.min.css *.map"
).split()


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language_of(path: Column) -> Column:
    """By the whole name first, then by what follows the last dot; null if neither is known."""
    name = F.substring_index(path, "/", -1)
    return F.coalesce(lookup(LANGUAGE_OF, name), lookup(LANGUAGE_OF, F.concat(F.lit("."), F.substring_index(name, ".", -1))))


def category_of(language: Column) -> Column:
    return F.when(language.isNull(), "unknown").otherwise(F.coalesce(lookup(CATEGORY_OF, language), F.lit("unknown")))


def mime_of(language: Column, binary: Column) -> Column:
    return F.when(binary, "application/octet-stream").when(language.isNull(), "text/plain").otherwise(F.coalesce(lookup(MIME, language), F.lit("text/plain")))


def is_binary_path(path: Column) -> Column:
    return F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1))).isin(BINARY)


def has_binary_bytes(content: Column) -> Column:
    """Whether the first 8192 bytes hold a control character that text has not."""
    return F.decode(F.substring(content, 1, 8192), "ISO-8859-1").rlike(r"[\x00-\x07\x0E-\x1A\x1C-\x1F]")


def encoding_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8-bom").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be").otherwise("utf-8")


def glob_regex(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over paths relative to the root."""
    anchored = "/" in pattern.rstrip("/").removesuffix("/**")
    body = pattern.strip("/")
    if body.endswith("/**"):
        body = body[:-3]
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|[^*?]+", body))
    return ("^" if anchored else "(^|/)") + out + "(/|$)"


def ignored(path: Column, patterns: list[str] = IGNORED) -> Column:
    """Later patterns win; those with ``!`` take a path back in."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            out = F.when(path.rlike(glob_regex(p.removeprefix("!"))), not p.startswith("!")).otherwise(out)
    return out


def module_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, 0))
