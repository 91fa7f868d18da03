"""Line dedup by site-relative frequency: a line that too large a share of a host's pages contains is boilerplate there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.llm import near_dup
from mixlume.llm.common import materialize, quoted, unused

#: A line is boilerplate where more than this share of its host's pages holds it.
RATIO = 0.02
#: Pages that must hold a line, whatever the ratio: 1 leaves the ratio alone. On a host of fewer than 1 / RATIO pages each line exceeds the ratio.
LEAST_PAGES = 1


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _key(line: str) -> str:
    """SQL: the hash by which lines are equal (outer white space doesn't count); null for a blank line."""
    return f"nullif(xxhash64(trim(BOTH ' \\t\\r' FROM {line})), xxhash64(''))"


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, groups: DataFrame | None = None) -> DataFrame:
    """host, keys: for each host the sorted hashes of its boilerplate lines.

    A page counts once for a line it repeats. Pages and lines are counted with partial sums before the shuffle, so neither a hot host nor a hot line is
    gathered in one task. A host has at most (distinct lines per page) / ratio such lines, however many pages it has. Pages without host form no site.

    With ``groups`` (h, component_id: xxhash64 of a text and its group) the pages of a host that have equal text or are of one group count once, both as pages
    and for the lines that any of them holds: the body of many copies is then no more frequent than that of one page.
    """
    h = [] if groups is None else [F.xxhash64(quoted(text)).alias("h")]
    pages = docs.select(F.col(quoted(host)).alias("host"), *h, F.expr(f"array_compact(array_distinct(transform(split(coalesce({quoted(text)}, ''), '\\n'), x -> {_key('x')})))").alias("keys")).where("host is not null")
    units, lines = pages, pages.select("host", *["h" for _ in h], F.explode("keys").alias("key"))
    if groups is not None:

        def once(rows: DataFrame) -> DataFrame:  # copies are one row before the join
            columns = [c for c in rows.columns if c != "h"]
            named = rows.distinct().join(groups, "h", "left").withColumn("h", F.when(F.col("component_id").isNull(), F.col("h")))
            return named.select(*columns, "component_id", "h").distinct()

        units, lines = once(pages.select("host", "h")), once(lines)
    totals = units.groupBy("host").agg(F.count("*").alias("pages"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = materialize(counts, "lines").join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def mark(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, groups: DataFrame | None = None) -> DataFrame:
    """docs with line_text (the text without its host's boilerplate lines), line_total and line_dropped (lines, and those dropped).

    Lines end at a newline. Lines that stay keep their bytes and order; blank lines stay. Null text stays null with 0 lines; a null host drops nothing; repeated
    rows count as pages of their own without ``groups`` (see boilerplate()); columns of the added names are replaced; an empty table gives no row.
    """
    added = ("line_text", "line_total", "line_dropped")
    others = [c for c in docs.columns if c.lower() not in added]
    site, keys, lines, kept = (unused(x, docs.columns) for x in ("_site", "_keys", "_lines", "_kept"))
    sites = materialize(boilerplate(docs, host, text, ratio, least, groups).toDF(site, keys), "boilerplate")
    out = docs.join(sites, F.col(quoted(host)) == F.col(site), "left").withColumn(lines, F.expr(f"split({quoted(text)}, '\\n')"))
    out = out.withColumn(kept, F.expr(f"if({keys} is null, {lines}, filter({lines}, x -> not coalesce(array_contains({keys}, {_key('x')}), false)))"))
    return out.select(
        *[F.col(quoted(c)) for c in others],
        F.expr(f"if({lines} is null, null, array_join({kept}, '\\n'))").alias("line_text"),
        F.expr(f"if({lines} is null, 0L, cast(size({lines}) as bigint))").alias("line_total"),
        F.expr(f"if({lines} is null, 0L, cast(size({lines}) - size({kept}) as bigint))").alias("line_dropped"),
    )


def deduplicate(docs: DataFrame, percent: int = near_dup.PERCENT, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """docs with boilerplate lines dropped from text, and n_chars set to the new length if there is such a column; columns as in docs, whatever their names.

    Near-duplicates (of ``percent`` % similarity) count as one page of their host, so that a large group of copies doesn't lose its body as boilerplate. report() and its SQL count each page.
    """
    groups = materialize(near_dup.text_groups(docs, percent), "groups")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, columns))
    plain = docs.select(*[F.col(quoted(c)).alias(k) for c, k in named.items()])
    marked = mark(plain, named["source"], named["text"], ratio, least, groups)
    now = {"text": F.col("line_text")}
    if "n_chars" in named:
        own = F.col(named["n_chars"])
        now["n_chars"] = F.when(F.col("line_dropped") > 0, F.char_length("line_text").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return marked.select(*[now.get(c, F.col(k)).alias(c) for c, k in named.items()])


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: its lines, those dropped, and a digest of the text that stays."""
    marked = mark(docs.select("doc_id", "text", "source"))
    return marked.select("doc_id", F.col("line_total").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2(F.coalesce("line_text", F.lit("")), 256).alias("text_sha256"))


_TRIMMED = "trim(x, ' ' || chr(9) || chr(13))"
ORACLE_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), pages AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
seen AS (
    SELECT source, line, count(*) AS n FROM (
        SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: {_TRIMMED}), lambda x: x <> ''))) AS line FROM lines WHERE source IS NOT NULL
    ) GROUP BY source, line 
), sites AS (
    SELECT source, list(line) AS bad FROM seen JOIN pages USING (source) WHERE n > {RATIO} * pages GROUP BY source
), kept AS (
    SELECT doc_id, text, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, {_TRIMMED})) END AS ks
    FROM lines LEFT JOIN sites USING (source)
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(ks) END AS n_dropped,
    sha256(CASE WHEN text IS NULL THEN '' ELSE coalesce(array_to_string(ks, chr(10)), '') END) AS text_sha256
FROM kept
"""
