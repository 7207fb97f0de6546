"""Secret scans with multipart credential linking, in built-in functions.

A credential has parts: an identifier, a secret, and the endpoint that they open. Parts that tell by themselves
(``BASE``) are always reported. Weak ones (``WEAK``: addresses, names of users, vague assignments, hosts) are reported
only where what completes them lies within the same scope: the same block of lines without a blank one between, and
within ``REACH`` code points. The search for it is an interval join on blocks and cells of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch, table

#: How far apart, in code points between their beginnings, the parts of one credential may be.
REACH = 300


def either(words: str) -> str:
    """A pattern of ``words`` (an alternation) with letters in either case. Written out, as flags differ between engines beyond ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Between a name and its value.
IS = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A kind of part: matches of ``pattern``, leftmost and without overlap, whose ``group`` has ``least`` characters."""

    name: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1


# The patterns that are always reported. The lengths of the last two are in the pattern, which makes no difference to runs.
BASE = (
    Kind("assign", "secret", f"({either('password|passwd|secret|token|api_?key')}){IS}([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", "identifier", "AKIA[A-Z0-9]{16,}"),
    Kind("hex", "secret", "[0-9a-f]{24,}"),
)
WEAK = (
    Kind("user", "identifier", rf"(?:{either('user|username|user_?id|login|account|client_?id')}){IS}[A-Za-z0-9._@+-]{{3,}}|[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})+"),
    Kind("pass", "secret", rf"""(?:(?:{either('pass|pwd|pin|auth|credentials?|private_?key|access_?key|secret_?key')}){IS}|{either('bearer')}\x20+)[^\x20\x09-\x0D"',;]{{4,}}"""),
    Kind("endpoint", "endpoint", rf"""[A-Za-z][A-Za-z0-9+.-]{{1,15}}://[^\x20\x09-\x0D"'<>]+|(?:{either('host|hostname|server|endpoint')}){IS}[A-Za-z0-9._:/-]{{4,}}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?::[0-9]{{1,5}})?"""),
)
#: What parts scopes: a blank line.
GAP = Kind("gap", "gap", r"\n[\x20\x09\x0D]*\n")
#: For each weak kind, the sets of roles of which each must be present.
COMPLETE = {"user": ({"secret"},), "pass": ({"identifier", "endpoint"},), "endpoint": ({"identifier"}, {"secret"})}
ROLES = ("identifier", "secret", "endpoint")


def _found(kind: Kind, text: Column, matches: Column) -> Column:
    """array<struct<before, size, ok>> of a text's ``matches``: the characters between the match before and this one, its own, and whether it is long enough."""
    between = F.transform(F.split(text, kind.pattern, -1), F.length)
    own = matches if not kind.group else F.transform(matches, lambda m: F.regexp_extract(m, kind.pattern, kind.group))
    ok = F.transform(own, lambda x: F.length(x) >= kind.least)
    one = F.zip_with(F.slice(between, 1, F.size(matches)), F.arrays_zip(F.transform(matches, F.length).alias("size"), ok.alias("ok")), lambda b, m: F.struct(b.alias("before"), m["size"].alias("size"), m["ok"].alias("ok")))
    return F.when(F.size(matches) > 0, one).otherwise(F.array().cast("array<struct<before:int,size:int,ok:boolean>>"))


def parts(docs: DataFrame, text_col: str = "text", kinds: tuple = BASE + WEAK) -> DataFrame:
    """``rid``, ``row`` (the record without its text) and ``found``, a map from kind to matches, for every record. Gaps only where there are weak parts."""
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).alias("none"))
    df = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.select("row", "text", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(k.name) for k in kinds])
    weak = [F.size(k.name) > 0 for k in kinds if k not in BASE]
    some = weak[0] if weak else F.lit(False)
    for w in weak[1:]:
        some = some | w
    df = df.withColumn("gap", F.when(some, F.regexp_extract_all("text", F.lit(GAP.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    each = [F.struct(F.lit(k.name).alias("kind"), _found(k, F.col("text"), F.col(k.name)).alias("list")) for k in (*kinds, GAP)]
    return df.select(F.monotonically_increasing_id().alias("rid"), "row", F.filter(F.array(*each), lambda x: F.size(x["list"]) > 0).alias("found"))


def located(found: DataFrame, kinds: tuple = BASE + WEAK) -> DataFrame:
    """rid, kind, start and end (code points, end exclusive) of the matches of ``parts``; a match too short still moves those after it."""
    rows = found.select("rid", F.explode("found").alias("f")).select("rid", "f.kind", F.posexplode("f.list").alias("i", "m"))
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.before") + F.col("m.size")).over(upto)
    return rows.withColumn("end", end).where("m.ok").select("rid", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


def linked(spans: DataFrame, reach: int = REACH, kinds: tuple = BASE + WEAK) -> DataFrame:
    """The weak ones of ``spans`` (see ``located``, with gaps) that are complete within their scope: rid, kind, start, end.

    Texts are dealt into cells of ``reach`` characters. Of each cell, block and role only the first and the last part
    matter, so a weak part joins at most three cells and three roles, however many parts a scope holds.
    """
    ordered = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    block = F.sum((F.col("kind") == "gap").cast("int")).over(ordered)
    role = F.create_map(*[F.lit(x) for k in kinds for x in (k.name, k.role)])
    placed = spans.withColumn("block", block).where("kind <> 'gap'").withColumn("role", role[F.col("kind")]).withColumn("cell", F.floor(F.col("start") / reach))
    sums = placed.groupBy("rid", "block", "cell", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = placed.where(F.col("kind").isin([k.name for k in kinds if k not in BASE])).drop("role")
    asked = weak.withColumn("cell", F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])))
    near = (F.col("last") >= F.col("start") - reach) & (F.col("first") <= F.col("start") + reach)
    met = asked.join(sums, ["rid", "block", "cell"]).where(near).groupBy("rid", "kind", "start", "end").agg(F.collect_set("role").alias("roles"))
    complete = F.lit(False)
    for kind, sets in COMPLETE.items():
        own = F.col("kind") == kind
        for roles in sets:
            own = own & F.arrays_overlap("roles", F.array(*[F.lit(r) for r in sorted(roles)]))
        complete = complete | own
    return met.where(complete).select("rid", "kind", "start", "end")


def scanned(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``row`` (the record without its text) and ``spans`` (array of start, place, end, kind: by start, then kind as listed) of every record.

    A null or empty text has no spans. Whole texts are scanned, however long; matches cross no line. Repeated rows get
    equal spans; an empty table gives no rows. Columns travel inside ``row``, so none can clash. Only matches leave
    their text's task: texts are read once and not shuffled.
    """
    names = [k.name for k in BASE + WEAK]
    with scratch() as keep:
        found = materialize(parts(docs, text_col), "secret-parts")
        spans = materialize(located(found), "secret-spans")
        base = spans.where(F.col("kind").isin([k.name for k in BASE]))
        every = base.unionByName(linked(spans, reach))
        place = F.array_position(F.array(*map(F.lit, names)), F.col("kind")).cast("int")
        span = F.struct(F.col("start").cast("long").alias("start"), place.alias("place"), F.col("end").cast("long").alias("end"), F.col("kind").alias("kind"))
        lists = materialize(every.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans")), "secret-lists")
        keep(found, lists)
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return found.select("rid", "row").join(lists, "rid", "left").select("row", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark, sf_dir):
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["place"] <= len(BASE))
    return out.select("row.doc_id", *[F.size(of(k.name)).cast("long").alias(f"n_{k.name}") for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same by plain definitions: every weak part against every part of its block."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT r, '{k.name}' AS kind, {i} AS place, '{k.role}' AS role, regexp_extract_all(x, {quoted(k.pattern)}) AS m, string_split_regex(x, {quoted(k.pattern)}) AS p, {k.group} AS g FROM t"
        for i, k in enumerate((*BASE, *WEAK, GAP), 1)
    )
    needs = " OR ".join(
        f"kind = '{kind}' AND " + " AND ".join(f"EXISTS (SELECT 1 FROM b q WHERE q.r = w.r AND q.block = w.block AND abs(q.s - w.s) <= {REACH} AND q.role IN ({', '.join(repr(x) for x in sorted(roles))}))" for roles in sets)
        for kind, sets in COMPLETE.items()
    )
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({each}),
u AS (SELECT r, kind, place, role, g, unnest(m) AS m, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i FROM f WHERE len(m) > 0),
e AS (SELECT r, kind, place, role, g, m, sum(length(p) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
s AS (SELECT r, kind, place, role, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM e WHERE g = 0 OR length(regexp_extract(m, {quoted(BASE[0].pattern)}, 2)) >= {BASE[0].least}),
b AS MATERIALIZED (SELECT *, sum(CAST(kind = 'gap' AS INT)) OVER (PARTITION BY r ORDER BY s RANGE UNBOUNDED PRECEDING) AS block FROM s),
o AS (SELECT r, kind, place, s, e FROM b WHERE place <= {len(BASE)} UNION ALL SELECT r, kind, place, s, e FROM b w WHERE {needs}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place <= {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (r)"""


SQL = _sql()
