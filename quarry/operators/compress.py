"""Compression of chunks, and context packages within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RETRIEVAL
from ..functions.text import estimate_tokens, strip

# Lines that compression may drop, lines that it keeps, and the languages that count as code.
BOILERPLATE = [
    r"^\s*//.*$", r"^\s*/\*[\s\S]*?\*/\s*$", r"^\s*#.*$", r"""^\s*import\s+.*from\s+['"][^'"]+['"]\s*;?\s*$""", r"""^\s*require\s*\(['"]""",
    r"^\s*use\s+\w+", r"^\s*package\s+\w+", r"^\s*\*\s", r"^\s*\*/\s*$", r"^\s*/\*\*\s*$",
    r"(?i:^\s*@(param|returns?|throws?|type|author|version|since|deprecated)\s)", r"^\s*console\.(log|debug|info)\s*\(",
    r"(?i:^\s*//\s*(eslint|tslint|prettier|stylelint))", r"(?i:^\s*//\s*(TODO|FIXME|HACK|XXX))",
]
CRITICAL = [
    r"^\s*(export\s+)?(async\s+)?function\s+\w+", r"^\s*(export\s+)?(abstract\s+)?class\s+\w+", r"^\s*(export\s+)?interface\s+\w+",
    r"^\s*(export\s+)?type\s+\w+\s*=", r"^\s*(export\s+)?const\s+\w+\s*=", r"^\s*return\s+", r"^\s*throw\s+", r"^\s*if\s*\(", r"^\s*for\s*\(",
    r"^\s*while\s*\(", r"^\s*switch\s*\(", r"^\s*case\s+", r"^\s*catch\s*\(", r"^\s*await\s+", r"^\s*yield\s+",
]
CODE = ["javascript", "typescript", "python", "go", "rust", "java", "c", "cpp", "csharp"]


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def compress_code(content: Column, ratio: float = RETRIEVAL.compression) -> Column:
    """Drops the first removable lines (boilerplate or blank, and not critical) until the share of lines is met."""

    def removable(line):
        return let(strip(line), lambda x: ~x.rlike("|".join(CRITICAL)) & (x.rlike("|".join(BOILERPLATE)) | (x == "")))

    def short(lines):
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        target = F.ceil(F.size(lines) * F.lit(ratio)).cast("int")
        marked = F.filter(F.transform(lines, lambda x, i: F.when(removable(x), i)), lambda i: i.isNotNull())
        gone = F.slice(marked, 1, F.greatest(F.size(lines) - target, F.lit(0)))
        return F.array_join(F.transform(F.array_except(places, gone), lambda i: F.get(lines, i)), "\n")

    return let(F.split(content, "\n"), short)


def sentences(content: Column) -> Column:
    return F.split(F.regexp_replace(content, r"([.!?])\s+", "$1\x01"), "\x01")


def compress_text(content: Column, ratio: float = RETRIEVAL.compression) -> Column:
    """Keeps the first, the last, and evenly spaced sentences between."""

    def short(parts):
        n = F.size(parts)
        target = F.ceil(n * F.lit(ratio)).cast("int")
        steps = F.sequence(F.lit(1), F.greatest(target - 2, F.lit(1)))
        keep = F.array_union(F.array(F.lit(0), n - 1), F.transform(steps, lambda i: F.floor(i * (n / (target - 2).cast("double")) + 0.5).cast("int")))
        some = F.array_join(F.transform(F.filter(F.array_sort(keep), lambda i: i < n), lambda i: F.get(parts, i)), " ")
        return F.when((n <= target) | (n <= 3), content).otherwise(some)

    return let(sentences(content), short)


def compress(content: Column, language: Column, ratio: float = RETRIEVAL.compression) -> Column:
    out = F.when(F.coalesce(language.isin(CODE), F.lit(False)), compress_code(content, ratio)).otherwise(compress_text(content, ratio))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def within_budget(ranked: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """The rows (query_id, rank, ...) of each query before the first that would take the sum of ``tokens`` over ``budget``."""
    run = F.sum(tokens).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", run).where(F.col("used") <= budget)


def _in_rank_order(part: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), glue)


def assemble(ranked: DataFrame, budget: int) -> DataFrame:
    """query_id and context: the chunks within budget (rank, title, path, start_line, end_line, body, tokens) as one text."""
    head = F.concat(F.lit("### "), "title", F.lit("\n// "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("\n"), "body")
    return within_budget(ranked, budget).groupBy("query_id").agg(_in_rank_order(head, "\n\n---\n\n").alias("context"))


def package(ranked: DataFrame, budget: int = 8000, relations: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """query_id, kept chunks (ids in order), their tokens, whether some were cut off and how many.

    ``relations`` (query_id, source_id, kind, target_id) and ``summaries`` (query_id, summary) come along as sorted
    lists; to switch either off, leave it out.
    """
    every = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    kept = within_budget(ranked, budget).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"), F.sum("tokens").alias("tokens"))
    out = every.join(kept, "query_id", "left").withColumn("kept", F.coalesce(F.size("ids"), F.lit(0)))
    out = out.select("query_id", "ids", "kept", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("kept") < F.col("n")).alias("truncated"), (F.col("n") - F.col("kept")).alias("omitted"))
    for name, rows, value in (("relations", relations, F.concat_ws(" ", "source_id", "kind", "target_id")), ("summaries", summaries, F.col("summary"))):
        if rows is not None:
            lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_set(value)).alias(name))
            out = out.join(lists, "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def serialize(query: DataFrame, ranked: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """query_id and text: a Markdown rendering of a query (query_id, query), its chunks (rank, path, start_line, score, body) and relations (source_id, kind, target_id)."""
    entry = F.concat(F.lit("### "), "rank", F.lit(". "), "path", F.lit(":"), "start_line", F.lit(" [score: "), F.format_string("%.2f", "score"), F.lit("]\n"), "body", F.lit("\n"))
    chunks = ranked.groupBy("query_id").agg(_in_rank_order(entry, "\n").alias("chunks"))
    out = query.join(chunks, "query_id", "left")
    if relations is not None:
        line = F.concat(F.lit("- "), "source_id", F.lit(" --["), "kind", F.lit("]--> "), "target_id")
        rel = relations.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("relations"))
        out = out.join(rel, "query_id", "left")
    else:
        out = out.withColumn("relations", F.lit(None).cast("string"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{title}\n"), c, F.lit("\n"))).otherwise("")
    return out.select("query_id", F.concat(F.lit("# Context for: "), "query", F.lit("\n\n"), part("## Relevant Code", "chunks"), part("## Relations", "relations")).alias("text"))
