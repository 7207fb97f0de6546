"""Chunkers: folds over arrays of lines, paragraphs or symbols, each document in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNKING, Chunking
from ..functions.text import estimate_tokens, make_id, strip

BLOCKS = "array<struct<begin:int,end:int,nominal:int>>"


def _fold_lines(lines: Column, max_tokens: int, overlap: int) -> Column:
    """Blocks of ``lines`` as array<struct<begin, end, nominal>> (0-based, end exclusive).

    A block is always a run of lines, so the state is where it begins and its tokens: lines count one by one, each
    rounded up, and a carried overlap (of a few lines) counts as one text. ``nominal`` is the first line that is
    reported, which supposes a full overlap.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("begin"), F.lit(0).alias("tokens"), F.lit(1).alias("nominal"), F.array().cast(BLOCKS).alias("out"))

    def fold(acc, line):
        i = acc["i"]
        tokens = F.ceil(F.length(line) / 4).cast("int")
        flush = (acc["tokens"] + tokens > max_tokens) & (i > acc["begin"])
        begin = F.greatest(acc["begin"], i - overlap)
        chars = lambda: F.aggregate(F.slice(lines, begin + 1, i - begin), F.lit(-1), lambda n, x: n + F.length(x) + 1)
        kept = F.when(~flush | (begin >= i), 0).otherwise(F.ceil(chars() / 4)).cast("int")
        block = F.struct(acc["begin"].alias("begin"), i.alias("end"), acc["nominal"].alias("nominal"))
        return F.struct(
            (i + 1).alias("i"), F.when(flush, begin).otherwise(acc["begin"]).alias("begin"),
            F.when(flush, kept + tokens).otherwise(acc["tokens"] + tokens).alias("tokens"),
            F.when(flush, i - overlap + 1).otherwise(acc["nominal"]).alias("nominal"),
            F.when(flush, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc):
        last = F.struct(acc["begin"].alias("begin"), acc["i"].alias("end"), acc["nominal"].alias("nominal"))
        return F.concat(acc["out"], F.array(last))

    return F.aggregate(lines, zero, fold, finish)


def _with_lines(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("_lines", F.split(content, "\n"))


def _joined(begin: Column, end: Column) -> Column:
    return F.array_join(F.slice("_lines", begin + 1, end - begin), "\n")


def line_blocks(docs: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """Chunks of ``docs`` (document_id, content): document_id, idx, chunk_id, title, content, tokens, start_line, end_line, block_start.

    ``start_line`` is the nominal first line after an overlap; ``block_start`` is the real one.
    """
    overlap = -(-cfg.overlap_tokens // 4)
    df = _with_lines(docs.select("document_id", F.coalesce("content", F.lit("")).alias("content")), "content")
    blocks = F.transform(_fold_lines(F.col("_lines"), cfg.max_tokens, overlap), lambda b: F.struct(b["begin"].alias("begin"), b["end"].alias("end"), b["nominal"].alias("nominal"), _joined(b["begin"], b["end"]).alias("content")))
    # The chunk's number counts the blocks that stay; they are in order here, so no text is shuffled for it.
    df = df.select("document_id", F.posexplode(F.filter(blocks, lambda b: estimate_tokens(b["content"]) >= cfg.min_tokens)).alias("idx", "b"))
    return df.select("document_id", "idx", "b.content", estimate_tokens(F.col("b.content")).alias("tokens"), F.col("b.nominal").alias("start_line"), F.col("b.end").alias("end_line"), (F.col("b.begin") + 1).alias("block_start")).select(
        "*", make_id("chunk", F.col("document_id"), F.col("idx")).alias("chunk_id"), F.concat(F.lit("lines "), "start_line", F.lit("-"), "end_line").alias("title"),
    )


def greedy_batches(sizes: Column, budget: int) -> Column:
    """The batch number of each element: a batch closes before the element that would take it over ``budget``."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts"))

    def fold(acc, n):
        new = (acc["i"] == 0) | (acc["sum"] + n > budget) & (acc["sum"] > 0)
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])  # boundaries only
        return F.struct((acc["i"] + 1).alias("i"), F.when(new, n).otherwise(acc["sum"] + n).cast("int").alias("sum"), starts.alias("starts"))

    def numbered(acc):
        ends = F.transform(acc["starts"], lambda s, k: F.coalesce(F.get(acc["starts"], k + 1), acc["i"]) - s)
        return F.flatten(F.transform(ends, lambda n, k: F.array_repeat(k, n)))

    return F.aggregate(sizes, zero, fold, numbered)


def token_batches(docs: DataFrame, budget: int, content: str = "content") -> DataFrame:
    """The lines of each document in batches of at most ``budget`` tokens: document_id, batch, n_lines, tokens. A longer line is a batch of its own."""
    df = docs.select("document_id", F.transform(F.split(content, "\n"), lambda x: F.ceil(F.length(x) / 4).cast("int")).alias("n"))
    df = df.select("document_id", F.explode(F.arrays_zip("n", greedy_batches(F.col("n"), budget).alias("batch"))).alias("x"))
    return df.groupBy("document_id", F.col("x.batch").alias("batch")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("x.n").alias("tokens"))


def pack_paragraphs(sections: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """Chunks of long sections (key, title, content): paragraphs in order, a part closed before the one that would take it over the limit.

    The last part of a section goes if it is short, the others stay.
    """
    paras = F.split("content", r"\n\n+")
    df = sections.select("key", "title", paras.alias("p"), F.transform(paras, lambda x: F.ceil(F.length(x) / 4).cast("int")).alias("n"))
    df = df.withColumn("part", greedy_parts(F.col("p"), F.col("n"), cfg.max_tokens))
    df = df.select("key", "title", F.posexplode("part").alias("i", "text"), (F.size("part") - 1).alias("last"))
    keep = (F.col("i") < F.col("last")) | ((F.length(strip(F.col("text"))) > 0) & (F.ceil(F.length("text") / 4) >= cfg.min_tokens))
    return df.where(keep).select("key", "i", F.concat("title", F.lit(" (part "), F.col("i") + 1, F.lit(")")).alias("title"), strip(F.col("text")).alias("content"))


def greedy_parts(paras: Column, sizes: Column, budget: int) -> Column:
    """``paras`` joined by blank lines into parts of at most ``budget`` tokens; empty text never closes a part, and none begins with it."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("begin"), F.lit(False).alias("full"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def fold(acc, both):
        # Sizes come with the paragraphs: as a column of their own inside the fold, they would be computed anew for each one.
        para, n, i = both["para"], both["n"], acc["i"]
        close = (acc["sum"] + n > budget) & acc["full"]
        part = F.struct(acc["begin"].alias("begin"), i.alias("end"))
        return F.struct(
            (i + 1).alias("i"), F.when(close, n).otherwise(acc["sum"] + n).alias("sum"), F.when(close | ~acc["full"], i).otherwise(acc["begin"]).alias("begin"),
            ((F.length(para) > 0) | (acc["full"] & ~close)).alias("full"), F.when(close, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"),
        )

    last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("begin"), acc["i"].alias("end"))))
    return F.transform(F.aggregate(F.arrays_zip(paras.alias("para"), sizes.alias("n")), zero, fold, last), lambda p: F.array_join(F.slice(paras, p["begin"] + 1, p["end"] - p["begin"]), "\n\n"))


def section_chunks(sections: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """Chunks of sections (document_id, type, pos, title, level, content): document_id, pos, part, kind, title, content.

    Sections of fewer than ``min_tokens`` go; long ones are packed by paragraphs; the others stay whole.
    """
    df = sections.withColumn("tokens", estimate_tokens(F.col("content"))).where(F.col("tokens") >= cfg.min_tokens)
    kind = F.when(F.col("type") == "config", "config-block").when(F.col("level") == 1, "section").otherwise("paragraph")
    whole = df.where(F.col("tokens") <= cfg.max_tokens).select("document_id", "pos", F.lit(0).alias("part"), kind.alias("kind"), "title", "content")
    long = pack_paragraphs(df.where(F.col("tokens") > cfg.max_tokens).select(F.struct("document_id", "pos").alias("key"), "title", "content"), cfg)
    return whole.unionByName(long.select("key.document_id", "key.pos", F.col("i").alias("part"), F.lit("paragraph").alias("kind"), "title", "content"))


def code_chunks(docs: DataFrame, cfg: Chunking = CHUNKING) -> DataFrame:
    """Chunks of code (document_id, content, symbols: array<struct<name,kind,start_line,end_line>>): document_id, pos, part, kind, title, content, start_line, end_line.

    Top-level symbols become chunks. A large class with methods becomes its header and its methods; other symbols over
    the limit are cut by lines with overlap; short ones go. Documents that yield nothing are cut by line blocks.
    """
    overlap = -(-cfg.overlap_tokens // 4)
    df = docs.select("document_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("symbols", F.array().cast(docs.schema["symbols"].dataType)).alias("symbols"))
    df = df.withColumn("_lines", F.split("content", "\n"))
    tops = F.filter("symbols", lambda s: s["kind"].isin("class", "interface", "function", "module"))
    body = lambda a, b: F.array_join(F.slice("_lines", a, F.greatest(b - a + 1, F.lit(0))), "\n")
    one = df.select("document_id", "content", "_lines", "symbols", F.posexplode(tops).alias("pos", "s")).withColumn("text", body(F.col("s.start_line"), F.col("s.end_line")))
    one = one.withColumn("tokens", estimate_tokens(F.col("text"))).withColumn(
        "methods", F.filter("symbols", lambda m: (m["kind"] == "method") & (m["start_line"] >= F.col("s.start_line")) & (m["end_line"] <= F.col("s.end_line")))
    )
    split = (F.col("s.kind") == "class") & (F.col("tokens") > cfg.large_node_tokens) & (F.size("methods") > 0)
    row = ("document_id", "pos")
    first = F.get("methods", 0)["start_line"] - 1
    header = one.where(split).select(*row, F.lit(0).alias("part"), F.lit("class").alias("kind"), F.concat("s.name", F.lit(" (header)")).alias("title"), body(F.col("s.start_line"), first).alias("content"), F.col("s.start_line"), first.alias("end_line"))
    each = one.where(split).select(*row, "s", "_lines", F.posexplode("methods").alias("i", "m"))
    methods = each.select(*row, (F.col("i") + 1).alias("part"), F.lit("method").alias("kind"), F.concat_ws(".", "s.name", "m.name").alias("title"), body(F.col("m.start_line"), F.col("m.end_line")).alias("content"), "m.start_line", "m.end_line")
    small = header.unionByName(methods).where(estimate_tokens(F.col("content")) >= cfg.min_tokens)
    rest = one.where(~split)
    kind = F.when(F.col("s.kind").isin("class", "interface"), F.col("s.kind")).otherwise("function")
    whole = rest.where(F.col("tokens").between(cfg.min_tokens, cfg.max_tokens)).select(*row, F.lit(0).alias("part"), kind.alias("kind"), F.col("s.name").alias("title"), F.col("text").alias("content"), "s.start_line", "s.end_line")
    long = _with_lines(rest.where(F.col("tokens") > cfg.max_tokens).select(*row, "s", "text"), "text")
    long = long.select(*row, "s", "_lines", F.posexplode(_fold_lines(F.col("_lines"), cfg.max_tokens, overlap)).alias("part", "b"))
    long = long.select(*row, "part", F.lit("function").alias("kind"), F.concat("s.name", F.lit(" (part "), F.col("part") + 1, F.lit(")")).alias("title"), _joined(F.col("b.begin"), F.col("b.end")).alias("content"), "s.start_line", "s.end_line")
    found = small.unionByName(whole).unionByName(long)
    bare = docs.join(found.select("document_id").distinct(), "document_id", "left_anti").select("document_id", "content")
    blocks = line_blocks(bare, cfg).select("document_id", F.col("idx").alias("pos"), F.lit(0).alias("part"), F.lit("fallback").alias("kind"), "title", "content", "start_line", "end_line")
    return found.unionByName(blocks)


def chunk_documents(docs: DataFrame, symbols: DataFrame | None = None, sections: DataFrame | None = None, cfg: Chunking = CHUNKING) -> DataFrame:
    """Chunks of ``docs`` (document_id, type, content) by their type: document_id, pos, part, kind, title, content, start_line, end_line.

    Code is cut by ``symbols`` (document_id, symbols), documentation, config and data by ``sections`` (document_id,
    type, pos, title, level, content, start_line, end_line), anything else (a null type too) by line blocks. So are
    documents without a section, and code that yields no chunk of its own: no document is left out for want of a table.
    """
    kind = F.coalesce("type", F.lit("unknown"))
    by_section = kind.isin("documentation", "config", "data")
    plain = docs.where(~by_section & (kind != "code"))
    if symbols is None:
        plain = plain.unionByName(docs.where(kind == "code"))
    bare = docs.where(by_section)
    if sections is not None:
        bare = bare.join(sections.select("document_id").distinct(), "document_id", "left_anti").select(*docs.columns)
    out = line_blocks(plain.unionByName(bare), cfg)
    out = out.select("document_id", F.col("idx").alias("pos"), F.lit(0).alias("part"), F.lit("fallback").alias("kind"), "title", "content", "start_line", "end_line")
    if symbols is not None:
        code = docs.where(kind == "code").join(symbols, "document_id", "left").select("document_id", "content", "symbols")
        out = out.unionByName(code_chunks(code, cfg))
    if sections is not None:
        own = sections.join(docs.where(by_section).select("document_id").distinct(), "document_id", "left_semi")
        lines = own.select("document_id", "pos", "start_line", "end_line")
        out = out.unionByName(section_chunks(own.drop("start_line", "end_line"), cfg).join(lines, ["document_id", "pos"]).select(*out.columns))
    return out


def fallback_segments(docs: DataFrame, min_chars: int = 50, max_chars: int = 2000) -> DataFrame:
    """Segments of plain text (document_id, content): closed at a blank line after more than three lines, or beyond ``max_chars``; short ones go.

    A document without a segment gets one, its first ``max_chars`` characters.
    """
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("begin"), F.lit(0).alias("chars"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def fold(acc, x):
        chars = acc["chars"] + F.length(x) + 1
        close = ((strip(x) == "") & (acc["i"] - acc["begin"] + 1 > 3)) | (chars - 1 > max_chars)
        seg = F.struct(acc["begin"].alias("begin"), (acc["i"] + 1).alias("end"))
        return F.struct(
            (acc["i"] + 1).alias("i"), F.when(close, acc["i"] + 1).otherwise(acc["begin"]).alias("begin"), F.when(close, 0).otherwise(chars).alias("chars"),
            F.when(close, F.concat(acc["out"], F.array(seg))).otherwise(acc["out"]).alias("out"),
        )

    segs = F.aggregate(lines, zero, fold, lambda acc: F.when(acc["begin"] < acc["i"], F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("begin"), acc["i"].alias("end"))))).otherwise(acc["out"]))
    df = docs.select("document_id", "content", lines.alias("_lines"), segs.alias("segs"))
    texts = F.transform("segs", lambda s: F.struct(strip(F.array_join(F.slice("_lines", s["begin"] + 1, s["end"] - s["begin"]), "\n")).alias("content"), (s["begin"] + 1).alias("start_line"), s["end"].alias("end_line")))
    kept = F.filter(texts, lambda s: F.length(s["content"]) >= min_chars)
    whole = F.array(F.struct(F.substring(F.coalesce("content", F.lit("")), 1, max_chars).alias("content"), F.lit(1).alias("start_line"), F.size("_lines").alias("end_line")))
    df = df.withColumn("kept", kept).select("document_id", F.posexplode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(whole)).alias("idx", "s"))
    return df.select("document_id", "idx", "s.content", "s.start_line", "s.end_line")
