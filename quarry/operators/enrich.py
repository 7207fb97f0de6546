"""Rule-based metadata of chunks, and summaries of files, modules and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.text import estimate_tokens, strip, truncate_tokens

# What counts as a branch, and the names of entry points.
BRANCHES = r"\bif\b|\belse\b|\bswitch\b|\bcase\b|\bwhile\b|\bfor\b|\bcatch\b|\?\s"
ENTRY = r"^(index|main|app|server)\.(ts|js|py|go|rs)$"
PROJECT_ENTRY = r"^(index|main|app|server|cmd)\.(ts|js|py|go|rs|java)$"


def complexity(content: Column) -> Column:
    """low, medium, high or very-high by depth of indentation, number of branches and size."""
    depth = F.array_max(F.transform(F.split(content, "\n"), lambda x: F.floor(F.length(F.regexp_extract(x, r"^(\s+)", 1)) / 2)))
    tokens = estimate_tokens(content)
    size = F.when(tokens > 400, 3).when(tokens > 200, 2).when(tokens > 100, 1).otherwise(0)
    score = F.least(depth, F.lit(5)) + F.least(F.regexp_count(content, F.lit(BRANCHES)), F.lit(10)) + size
    return F.when(score <= 3, "low").when(score <= 7, "medium").when(score <= 12, "high").otherwise("very-high")


def lowered(chunks: DataFrame) -> DataFrame:
    """``chunks`` (id, path, title, kind, language, content) with the text kept in ``raw`` and lower case for the rules."""
    return chunks.select("id", "kind", "language", F.col("path").alias("raw_path"), F.col("content").alias("raw"), *[F.lower(c).alias(c) for c in ("path", "title", "content")])


def enriched(chunks: DataFrame) -> DataFrame:
    low = lowered(chunks)
    public = F.contains("raw", F.lit("export")) | F.contains("raw", F.lit("public ")) | F.col("kind").isin("function", "class", "interface")
    return low.select(
        "id", F.expr(rules.first_of(rules.CHUNK_DOMAIN, "unknown")).alias("domain"), complexity(F.col("raw")).alias("complexity"),
        rules.labels(rules.CHUNK_PATTERNS).alias("patterns"), rules.labels(rules.CHUNK_TAGS, F.col("language"), F.col("kind"), cap=20).alias("tags"),
        rules.labels(rules.CHUNK_EFFECTS).alias("side_effects"), public.alias("is_public_api"), F.col("raw_path").rlike(ENTRY).alias("is_entry_point"),
    )


def signature(content: Column, language: Column) -> tuple[Column, Column]:
    """Parameter names and return type in the first line, five and three at most."""
    line = F.get(F.split(content, "\n"), 0)
    found = [(F.regexp_extract(line, p, 0), F.regexp_extract(line, p, 1)) for p in (r"function\s+\w+\s*\(([^)]*)\)", r"(?:const|let)\s+\w+\s*=\s*(?:async\s*)?\(([^)]*)\)", r"(?:async\s+)?\w+\s*\(([^)]*)\)")]
    params = F.coalesce(*[F.when(whole != "", part) for whole, part in found], F.lit(""))
    names = F.filter(F.transform(F.split(params, ","), lambda p: strip(F.get(F.split(strip(p), ":"), 0))), lambda p: p != "")
    result = strip(F.regexp_extract(line, r"\):\s*([^{]+)", 1))
    matched = F.regexp_extract(line, r"\):\s*([^{]+)", 0) != ""
    none = F.array().cast("array<string>")
    return F.when(language.isNull(), none).otherwise(F.slice(names, 1, 5)), F.when(language.isNotNull() & matched, F.array(result)).otherwise(none)


def chunk_summary(chunks: DataFrame, max_tokens: int = 100) -> DataFrame:
    low = lowered(chunks)
    lines = F.slice(F.filter(F.split("raw", "\n"), lambda x: strip(x) != ""), 1, 5)
    inputs, outputs = signature(F.col("raw"), F.col("language"))
    return low.select(
        "id", truncate_tokens(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "), max_tokens).alias("summary"),
        rules.labels(rules.RESPONSIBILITIES).alias("responsibilities"), inputs.alias("inputs"), outputs.alias("outputs"), rules.labels(rules.SUMMARY_EFFECTS).alias("side_effects"),
    )


def file_summary(files: DataFrame, max_tokens: int = 150) -> DataFrame:
    """``files`` (path, language, type, content, symbols, dependencies): path, summary, purpose, exports, dependencies, domain, tags."""
    low = files.select(F.col("path").alias("raw_path"), "language", "type", "symbols", "dependencies", F.lower("path").alias("path"), F.lower("content").alias("content"))
    names = F.array_join(F.transform(F.slice("symbols", 1, 5), lambda s: s["name"]), ", ")
    exports = F.slice(F.transform(F.filter("symbols", lambda s: s["kind"].isin("function", "class", "interface")), lambda s: s["name"]), 1, 20)
    domain, role = F.expr(rules.first_of(rules.FILE_DOMAIN, "unknown")), F.expr(rules.first_of(rules.FILE_ROLE, "General purpose module"))
    text = F.concat("raw_path", F.lit(": "), role, F.lit(". Contains: "), F.when(names == "", "text content").otherwise(names), F.lit("."))
    return low.select(
        F.col("raw_path").alias("path"), "language", truncate_tokens(text, max_tokens).alias("summary"), role.alias("purpose"), exports.alias("exports"),
        F.slice("dependencies", 1, 20).alias("dependencies"), domain.alias("domain"), rules.labels(rules.FILE_TAGS, domain, F.col("language")).alias("tags"),
    )


def module_summary(summaries: DataFrame, max_tokens: int = 200) -> DataFrame:
    """Roll-up of file summaries (module, path, purpose, exports, dependencies, domain, tags). Files count in the order of their paths.

    One pass: every value of every field is a row, and each is first reduced to its first place and its number, so what
    is collected of a module is its vocabulary, not its files. Dependencies and exports are the first thirty, tags all;
    the domain is the most frequent one (of equal ones that of the first path), the purpose that of the first path.
    """
    empty = F.array().cast("array<string>")
    value = lambda name, i, x: F.struct(F.lit(name).alias("field"), i.alias("i"), x.alias("x"))
    of_list = lambda name: F.transform(F.coalesce(name, empty), lambda x, i: value(name, i, x))
    lists, single = ("dependencies", "exports", "tags"), ("domain", "purpose")
    every = F.concat(F.array(*[value(c, F.lit(0), F.col(c)) for c in single]), *map(of_list, lists))
    seen = summaries.select("module", "path", F.explode(every).alias("v")).groupBy("module", "v.field", "v.x").agg(F.min(F.struct("path", "v.i")).alias("at"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("module", "field")
    order = [F.when(F.col("field") == "domain", -F.col("n")).otherwise(0), "at", "x"]
    seen = seen.withColumn("k", F.row_number().over(own.orderBy(*order))).withColumn("files", F.sum("n").over(own))
    cap = F.when(F.col("field").isin(*single), 1).when(F.col("field") != "tags", 30)
    at = lambda name, c: F.when(F.col("field") == name, c)
    listed = lambda name: F.transform(F.sort_array(F.collect_list(at(name, F.struct("k", "x")))), lambda p: p["x"]).alias(name)
    out = seen.where(cap.isNull() | (F.col("k") <= cap)).groupBy("module").agg(
        F.max(at("domain", F.col("files"))).alias("files"), *[F.max(at(c, F.col("x"))).alias(c) for c in single], *map(listed, lists),
    )
    text = F.concat(F.lit("Module '"), "module", F.lit("': "), "files", F.lit(" files. Purpose: "), "purpose", F.lit(". Exports: "), F.array_join(F.slice("exports", 1, 5), ", "), F.lit("."))
    return out.withColumn("summary", truncate_tokens(text, max_tokens))


def project_flags(files: DataFrame) -> DataFrame:
    """One row: the frameworks, patterns and purpose that any of ``files`` (path, content) shows. Texts are never joined together."""
    low = files.select(F.lower("path").alias("path"), F.lower("content").alias("content"))
    tests = {f"f{i}": c for i, (_, c) in enumerate(rules.FRAMEWORKS)} | {f"p{i}": c for i, (_, c) in enumerate(rules.PROJECT_PATTERNS)}
    tests |= {f"u{i}_{j}": c for i, (_, cs) in enumerate(rules.PURPOSES) for j, c in enumerate(cs)}
    seen = low.agg(*[F.coalesce(F.bool_or(F.expr(c)), F.lit(False)).alias(k) for k, c in tests.items()])
    pick = lambda prefix, table, cap: F.slice(F.array_compact(F.array(*[F.when(F.col(f"{prefix}{i}"), n) for i, (n, _) in enumerate(table)])), 1, cap)
    purpose = F.lit("Software project")
    for i, (name, cs) in reversed(list(enumerate(rules.PURPOSES))):
        every = F.lit(True)
        for j in range(len(cs)):
            every = every & F.col(f"u{i}_{j}")
        purpose = F.when(every, name).otherwise(purpose)
    return seen.select(pick("f", rules.FRAMEWORKS, 10).alias("frameworks"), pick("p", rules.PROJECT_PATTERNS, 8).alias("patterns"), purpose.alias("purpose"))


def project_summary(name: str, files: DataFrame, modules: DataFrame, max_tokens: int = 300) -> DataFrame:
    """One row for the whole project: languages, frameworks, patterns, purpose, counts and the summary text."""
    langs = files.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    top = langs.orderBy(F.desc("n"), "first").limit(5).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "first", "language"))), lambda x: x["language"]).alias("languages"))
    entries = files.where(F.col("path").rlike(PROJECT_ENTRY)).orderBy("path").limit(5).agg(F.sort_array(F.collect_list("path")).alias("entry_points"))
    # Each side is one row.
    one = files.agg(F.count(F.lit(1)).alias("files")).crossJoin(modules.agg(F.count(F.lit(1)).alias("modules"))).crossJoin(top).crossJoin(entries).crossJoin(project_flags(files))
    used = F.array_join("frameworks", ", ")
    text = F.concat(F.lit(f"Project '{name}': "), "files", F.lit(" files across "), "modules", F.lit(" modules. Languages: "), F.array_join("languages", ", "), F.lit(". Frameworks: "), F.when(used == "", "none detected").otherwise(used), F.lit("."))
    return one.withColumn("summary", truncate_tokens(text, max_tokens))
