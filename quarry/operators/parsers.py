"""Parsers: files (id, path, language, content) to sections, symbols and facts, chosen by language."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .chunking import fallback_segments

IMPORT = r"(?m)^\s*((?:import|from|use|package|require|#include)\b[^\n]*)"


def csv_facts(files: DataFrame) -> DataFrame:
    """id, headers, row_count, column_count, schema and sample text. Commas part cells; there is no quoting but around cells."""
    cells = lambda x: F.transform(F.split(x, ","), lambda v: F.regexp_replace(strip(v), r'^"|"$', ""))
    df = files.select("id", F.filter(F.split("content", "\n"), lambda x: strip(x) != "").alias("lines"))
    df = df.select("id", F.coalesce(cells(F.get("lines", 0)), F.array().cast("array<string>")).alias("headers"), F.greatest(F.size("lines") - 1, F.lit(0)).alias("row_count"), F.transform(F.slice("lines", 2, 5), cells).alias("rows"))
    names = F.array_join("headers", ", ")
    sample = F.array_join(F.transform(F.concat(F.array("headers"), "rows"), lambda r: F.array_join(r, " | ")), "\n")
    return df.select("id", "headers", "row_count", F.size("headers").alias("column_count"), F.concat(F.lit("Headers: "), names, F.lit("\nRow count: "), "row_count").alias("schema"), sample.alias("sample"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("id", F.posexplode(F.split("content", "\n")).alias("i", "line"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """id, pos, title, level, content, start_line, end_line of each heading outside fences. Text before the first heading has no section."""
    by = Window.partitionBy("id").orderBy("i")
    fence = F.startswith("line", F.lit("```")) | F.startswith("line", F.lit("~~~"))
    df = _lines(files).withColumn("fence", fence).withColumn("inside", F.sum(F.col("fence").cast("int")).over(by) % 2 == 1)
    head = ~F.col("fence") & ~F.col("inside") & F.col("line").rlike(r"^#{1,6}\s+.+$")
    df = df.withColumn("head", head).withColumn("pos", F.sum(F.col("head").cast("int")).over(by) - 1).where("pos >= 0")
    last = F.max("i").over(Window.partitionBy("id"))
    df = df.withColumn("last", last)
    out = df.groupBy("id", "pos").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("content"),
        F.min("i").alias("a"), F.max("i").alias("b"), F.min_by("line", "i").alias("first"),
    )
    return out.select("id", F.col("pos").cast("int").alias("pos"), strip(F.regexp_extract("first", r"^#{1,6}\s+(.+)$", 1)).alias("title"), F.length(F.regexp_extract("first", r"^(#{1,6})", 1)).alias("level"), "content", (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"))


def markdown_facts(files: DataFrame) -> DataFrame:
    """id, tags (``#word``, twenty at most) and the number of closed code blocks."""
    tags = F.slice(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<!\w)#([a-zA-Z][a-zA-Z0-9_-]*)"), 1)), 1, 20)
    fences = F.size(F.filter(F.split("content", "\n"), lambda x: F.startswith(x, F.lit("```")) | F.startswith(x, F.lit("~~~"))))
    return files.select("id", tags.alias("tags"), F.floor(fences / 2).cast("int").alias("code_blocks"))


def _blocks(files: DataFrame, opens) -> DataFrame:
    df = _lines(files).withColumn("opens", opens)
    return df.withColumn("pos", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("id").orderBy("i")))


def _texts(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    out = df.groupBy("id", "pos").agg(text.alias("content"), (F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.min_by("line", "i").alias("first"))
    rank = (F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1).alias("n")
    return out.select("id", rank, "content", "start_line", "end_line", "first")


def dockerfile_blocks(files: DataFrame) -> DataFrame:
    """id, pos, title, content, start_line, end_line: a block begins with each FROM, RUN, COPY, CMD and ENTRYPOINT."""
    opens = F.col("line").rlike("^(FROM|RUN|COPY|CMD|ENTRYPOINT)")
    return _texts(_blocks(files, opens)).select("id", F.col("n").alias("pos"), F.get(F.split("first", " "), 0).alias("title"), "content", "start_line", "end_line")


def blank_line_blocks(files: DataFrame) -> DataFrame:
    """Blocks between blank lines. A blank line right behind another opens the next block; a file without any block is one."""
    by = Window.partitionBy("id").orderBy("i")
    df = _lines(files).withColumn("blank", strip(F.col("line")) == "")
    # A blank line closes a block only if one is open; a run of blanks closes, opens, closes ... in turn.
    run = df.withColumn("island", F.sum((~F.col("blank")).cast("int")).over(by))
    k = F.row_number().over(Window.partitionBy("id", "island", "blank").orderBy("i"))
    run = run.withColumn("k", k)
    ends = F.col("blank") & F.when(F.col("island") > 0, F.col("k") % 2 == 1).otherwise(F.col("k") % 2 == 0)
    run = run.withColumn("closes", ends).withColumn("pos", F.coalesce(F.sum(F.col("closes").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = _texts(run.where("NOT closes")).drop("first")
    bare = files.join(found.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("n"), "content", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"))
    return found.unionByName(bare).withColumnRenamed("n", "pos")


def json_sections(files: DataFrame) -> DataFrame:
    """id, pos, title and parsed: a section for each top-level key; a scalar is one section ``root``, a broken file one with its path."""
    keys = F.json_object_keys("content")
    df = files.select("id", "path", F.expr("try_variant_get(try_parse_json(content), '$', 'variant')").isNotNull().alias("parsed"), keys.alias("keys"))
    one = F.when(~F.col("parsed"), F.array("path")).when(F.col("keys").isNull(), F.array(F.lit("root"))).otherwise(F.col("keys"))
    return df.select("id", "parsed", F.posexplode(one).alias("pos", "title"))


def tree_sections(files: DataFrame) -> DataFrame:
    """Sections of YAML and TOML files (id, path, language, content): id, pos, title, content, parsed. Files that do not parse are one section."""

    def parse(language: str, text: str):
        if language == "toml":
            import tomllib

            return tomllib.loads(text)
        import yaml

        return yaml.safe_load(text)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    tree = parse(r.language, r.content)
                except Exception:  # noqa: BLE001  whatever a file holds, it stays one section of text
                    rows.append((r.id, 0, r.path, r.content, False))
                    continue
                if isinstance(tree, dict):
                    rows += [(r.id, i, str(k), json.dumps({str(k): v}, indent=2, default=str), True) for i, (k, v) in enumerate(tree.items())]
                else:
                    rows.append((r.id, 0, "root", r.content, tree is not None))
            yield pd.DataFrame(rows, columns=["id", "pos", "title", "content", "parsed"])

    return files.select("id", "path", "language", "content").mapInPandas(run, "id long, pos int, title string, content string, parsed boolean")


def imports(files: DataFrame, cap: int = 50) -> DataFrame:
    """id and the first ``cap`` import lines."""
    found = F.transform(F.slice(F.regexp_extract_all("content", F.lit(IMPORT), 1), 1, cap), strip)
    return files.select("id", found.alias("imports"))


_CLASSES = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:public\s+)?(class|interface|struct|trait|enum)\s+(\w+)"
_FUNCTIONS = r"^\s*(?:export\s+)?(?:default\s+)?(?:pub\s+)?(?:public\s+|private\s+|static\s+)*(?:async\s+)?(?:function|func|fn)\s+(?:\([^)]*\)\s*)?(\w+)|^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"
_METHODS = r"^\s+(?:public\s+|private\s+|static\s+|async\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{"


#: What may hold braces that open and close nothing: block comments, then strings and line comments of one line.
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_BARE = re.compile(r"""//.*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`""")


def symbols_of(language: str | None, text: str) -> list[tuple]:
    """(name, kind, start_line, end_line, doc) of a file's symbols: by Python's own parser, else by the patterns of declarations and by braces.

    Braces in comments and in strings of one line do not count. Outside Python a declaration that is spread over
    several lines before its name is not found, and a string over several lines may hide the end of a symbol.
    """
    lines = text.split("\n")

    def doc(at: int):
        above = lines[at - 2].strip() if at > 1 else ""
        return re.sub(r"^(//|\*|/\*+)\s*|\s*\*/$", "", above).strip() if above.startswith(("//", "*", "/*")) else None

    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        found = [(n.name, kinds[type(n)], n.lineno, n.end_lineno, doc(n.lineno)) for n in ast.walk(tree) if type(n) in kinds]
        return sorted(found, key=lambda s: s[2])

    bare = [_BARE.sub(lambda m: " " * len(m[0]), x) for x in _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")]

    def end(at: int) -> int:
        depth, seen = 0, False
        for i in range(at, len(lines)):
            for c in bare[i]:
                depth += (c == "{") - (c == "}")
                seen = seen or c == "{"
            if seen and depth <= 0 or not seen and lines[i].rstrip().endswith(";"):
                return i + 1
        return len(lines)

    found = []
    for i, line in enumerate(lines):
        if m := re.match(_CLASSES, line):
            found.append((m[2], "interface" if m[1] in ("interface", "trait") else "class", i + 1, end(i), doc(i + 1)))
        elif m := re.match(_FUNCTIONS, line):
            found.append((m[1] or m[2], "function", i + 1, end(i), doc(i + 1)))
        elif (m := re.match(_METHODS, line)) and m[1] not in ("if", "for", "while", "switch", "catch", "function", "return"):
            found.append((m[1], "method", i + 1, end(i), doc(i + 1)))
    return found


def symbols(files: DataFrame) -> DataFrame:
    """id, pos, name, kind, start_line, end_line, doc of every symbol of code files (id, language, content)."""

    def run(batches):
        for pdf in batches:
            rows = [(r.id, i, *s) for r in pdf.itertuples(index=False) for i, s in enumerate(symbols_of(r.language, r.content or ""))]
            yield pd.DataFrame(rows, columns=["id", "pos", "name", "kind", "start_line", "end_line", "doc"])

    return files.select("id", "language", "content").mapInPandas(run, "id long, pos int, name string, kind string, start_line int, end_line int, doc string")


def _sections(found: DataFrame, type_: str) -> DataFrame:
    has = lambda c, d: (F.col(c) if c in found.columns else d).alias(c)
    null = F.lit(None).cast("int")
    return found.select("id", F.lit(type_).alias("type"), F.col("pos").cast("int").alias("pos"), has("title", F.concat(F.lit("block_"), "pos")), has("level", F.lit(1)), has("content", F.lit(None).cast("string")), has("start_line", null), has("end_line", null))


def csv_sections(files: DataFrame) -> DataFrame:
    """Two sections of a CSV file: its schema and a sample."""
    facts = csv_facts(files).select("id", F.posexplode(F.array(F.struct(F.lit("Schema").alias("title"), F.col("schema").alias("content")), F.struct(F.lit("Sample Data").alias("title"), F.col("sample").alias("content")))).alias("pos", "s"))
    return facts.select("id", "pos", "s.*")


def code_sections(files: DataFrame) -> DataFrame:
    """A section for each symbol."""
    s = symbols(files)
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return s.join(files.select("id", "content"), "id").select("id", "pos", F.concat("kind", F.lit(": "), "name").alias("title"), text.alias("content"), "start_line", "end_line")


def plain_sections(files: DataFrame) -> DataFrame:
    found = fallback_segments(files.select(F.col("id").alias("document_id"), "content"))
    return found.select(F.col("document_id").alias("id"), F.col("idx").alias("pos"), F.concat(F.lit("segment_"), "idx").alias("title"), "content", "start_line", "end_line")


CODE = tuple("javascript typescript python csharp java go rust c cpp php kotlin swift ruby bash sql".split())
#: (languages, type of the document, parser of its sections): the first entry with a file's language takes it.
PARSERS: list[tuple[tuple[str, ...], str, object]] = [
    (CODE, "code", code_sections),
    (("markdown",), "documentation", markdown_sections),
    (("json",), "config", json_sections),
    (("yaml", "toml"), "config", tree_sections),
    (("dockerfile",), "config", dockerfile_blocks),
    (("ini", "env", "xml", "hcl", "terraform"), "config", blank_line_blocks),
    (("csv",), "data", csv_sections),
]


def register(languages: tuple[str, ...], type_: str, parser) -> None:
    """``parser`` (files to sections) goes before those that are there."""
    PARSERS.insert(0, (languages, type_, parser))


def parse(files: DataFrame) -> DataFrame:
    """Sections of ``files`` (id, path, language, is_binary, content) by the first parser that takes their language: id, language, type, pos, title, level, content, start_line, end_line.

    Binary files have none. A language that no parser takes, and a null one, is cut as plain text of type ``unknown``.
    """
    files = files.where("NOT coalesce(is_binary, false)").withColumn("language", F.coalesce("language", F.lit("")))
    left, out = F.lit(True), None
    for languages, type_, parser in [*PARSERS, (None, "unknown", plain_sections)]:
        own = files.where(left & F.col("language").isin(*languages) if languages else left)
        part = _sections(parser(own), type_)
        out = part if out is None else out.unionByName(part)
        left = left & ~F.col("language").isin(*languages) if languages else left
    return out.join(files.select("id", "language"), "id")
