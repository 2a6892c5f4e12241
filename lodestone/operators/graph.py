"""The link graph of a set of files: resolution, orphans, broken links and anchors, backlinks, statistics.

Inputs: files (rel_path), links (src_rel_path, target, anchor, kind, line; repeats are legal), headings (rel_path, slug).
Links are resolved when asked, against the files there are. A table of names has every way to write each file, and the
file that a name means first; a link looks its name up in one join, so rows stay where they are and as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import pathops as P
from lodestone.functions.textops import anchor_slug, extension, is_markdown

LINK = ["src_rel_path", "target", "anchor", "kind", "line"]


def _names(files: DataFrame) -> DataFrame:
    """(name, to), each name once: a path, a markdown path without its extension, a base name (behind a marker)."""
    path, lower = F.col("rel_path"), F.lower(F.col("rel_path"))
    stem = F.regexp_replace(path, r"\.(?:md|markdown)$", "")
    plain = (stem != path) & (extension(stem) == "")
    rank = F.when(path.endswith(".md"), F.lit(1)).otherwise(F.lit(2))
    ways = F.array(
        F.struct(path.alias("name"), F.lit(0).alias("rank")),
        F.struct(F.when(plain, stem).alias("name"), rank.alias("rank")),
        F.struct(F.concat(F.lit("\x00"), P.base_no_ext(lower)).alias("name"), F.lit(0).alias("rank")),
    )
    named = files.select(path, F.explode(ways).alias("way")).filter("way.name IS NOT NULL")
    best = named.groupBy(F.col("way.name").alias("name")).agg(F.min(F.struct("way.rank", "rel_path")).alias("best")).select("name", F.col("best.rel_path").alias("to"))
    # with a row that nothing names, the table is dealt out anew for a join, and only such a join splits hot names
    return best.unionByName(files.sparkSession.range(1).select(F.lit("\x02").alias("name"), F.lit(None).cast("string").alias("to")))


def _wiki_name(target: Column) -> Column:
    rooted = P.clean(F.regexp_replace(target, "^/", ""))
    return F.when(target.contains("/"), rooted).otherwise(F.concat(F.lit("\x00"), F.lower(P.base_no_ext(target))))


def _no_name(row: Column) -> Column:
    """A name that no file has, another for each row, so that rows that look nothing up are spread like the others."""
    return F.concat(F.lit("\x01"), row)


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` with ``to``: the file each means, null if there is none.

    Relative links look up their path from the linking file, wiki links their path or base name, mentions in code the
    one and then the other. A row for every row of ``links``, repeated ones too; a null target means nothing.
    """
    names, kind = _names(files), F.col("kind")
    rows = links.select(*LINK, F.when(kind == "md", P.candidate(F.col("src_rel_path"), F.col("target"))).otherwise(_wiki_name(F.col("target"))).alias("__name"))
    rows = rows.withColumn("__name", F.coalesce("__name", _no_name(F.col("src_rel_path"))))
    found = rows.join(names.withColumnRenamed("name", "__name"), "__name", "left").drop("__name")
    return found


def resolve_mentions(links: DataFrame, files: DataFrame) -> DataFrame:
    """``resolve`` for links with mentions in code, which look up their relative path if their name means nothing."""
    first = resolve(links, files)
    again = (F.col("kind") == "code") & F.col("to").isNull()
    name = F.when(again, P.candidate(F.col("src_rel_path"), F.col("target")))
    second = _names(files).select(F.col("name").alias("__name"), F.col("to").alias("__to"))
    rows = first.withColumn("__name", F.coalesce(name, _no_name(F.col("src_rel_path"))))
    return rows.join(second, "__name", "left").withColumn("to", F.coalesce("to", "__to")).select(*LINK, "to")


def same_names(files: DataFrame) -> DataFrame:
    """(base, ext, candidates): the files, sorted, of every base name and extension that more than one has."""
    path = F.lower(F.col("rel_path"))
    have = files.select("rel_path").distinct().select("rel_path", P.base_no_ext(path).alias("base"), extension(path).alias("ext"))
    return have.groupBy("base", "ext").agg(F.sort_array(F.collect_list("rel_path")).alias("candidates")).filter(F.size("candidates") > 1)


def basename_candidates(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, candidates): for bare names that more than one file has, the files of that base name and extension."""
    target = F.lower(F.col("target"))
    wanted = targets.select("target").distinct().filter(~F.col("target").contains("/")).select("target", P.base_no_ext(target).alias("base"), extension(target).alias("ext"))
    return wanted.join(same_names(files), ["base", "ext"]).select("target", "candidates")


def edges(links: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved links of the graph: all but mentions in code."""
    return resolve(links.filter("kind <> 'code'"), files).select(*LINK, "to")


def orphans(files: DataFrame, graph: DataFrame) -> DataFrame:
    """Markdown files that nothing links to; a link to oneself counts."""
    linked = graph.filter(F.col("to").isNotNull()).select(F.col("to").alias("rel_path"))
    return files.select("rel_path").distinct().filter(is_markdown(F.col("rel_path"))).join(linked, "rel_path", "left_anti").orderBy("rel_path")


def doc_like(target: Column) -> Column:
    ext = F.lower(extension(F.regexp_extract(target, r"^([^#?]*)", 1)))
    return ext.isin("", ".go", ".md", ".markdown")


def places(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(place): every folder above some file, and ``entries``: what else the walk saw and a link may mean."""
    there = files.select(F.explode(P.ancestors(F.col("rel_path"))).alias("place")).filter("place <> ''")
    there = there.unionByName(files.sparkSession.createDataFrame([(".",)], "place string"))
    if entries is not None:
        there = there.unionByName(entries.select(F.col("rel_path").alias("place")))
    return there.distinct()


def _lost() -> Column:
    return F.col("to").isNull() & doc_like(F.col("target"))


def _place() -> Column:
    """Where a relative link points that may mean a folder; other links point nowhere."""
    relative = F.when(F.col("kind") == "md", F.regexp_replace(P.candidate(F.col("src_rel_path"), F.col("target")), "/+$", ""))
    return F.coalesce(relative, _no_name(F.col("src_rel_path")))


def broken(graph: DataFrame, files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Edges to documents that are not there.

    A relative link may also mean a folder above some file, or one of ``entries`` (rel_path): folders and files without
    extension that the walk saw but did not index.
    """
    return graph.filter(_lost()).withColumn("place", _place()).join(places(files, entries), "place", "left_anti").drop("place")


def _aimed() -> Column:
    return F.col("to").isNotNull() & (F.coalesce("anchor", F.lit("")) != "")


def broken_anchors(graph: DataFrame, headings: DataFrame) -> DataFrame:
    """Resolved edges whose fragment is no heading of the file they point to."""
    known = headings.select(F.col("rel_path").alias("to"), "slug").distinct()
    return graph.filter(_aimed()).withColumn("slug", anchor_slug(F.col("anchor"))).join(known, ["to", "slug"], "left_anti").select(*LINK, "to")


def backlinks(graph: DataFrame, target: str) -> DataFrame:
    import posixpath

    name = posixpath.normpath(target.removeprefix("./"))
    return graph.filter(F.col("to") == name).orderBy("src_rel_path", "line", "kind", "target", "anchor")


def stats(files: DataFrame, graph: DataFrame, headings: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """One row of counts: files, markdown, edges, resolved, broken, broken_anchors, orphans.

    Edges are resolved and read once: each is marked, counted by the file it means, and the counts meet the files.
    """
    there = places(files, entries).withColumn("there", F.lit(True))
    known = headings.select(F.col("rel_path").alias("__of"), F.col("slug").alias("__slug"), F.lit(True).alias("known")).distinct()
    marked = graph.withColumn("place", F.when(_lost(), _place()).otherwise(_no_name(F.col("src_rel_path")))).join(there, "place", "left")
    of = F.when(_aimed(), F.col("to")).otherwise(_no_name(F.col("src_rel_path")))
    marked = marked.withColumn("slug", anchor_slug(F.coalesce("anchor", F.lit("")))).withColumn("of", of)
    marked = marked.join(known, (F.col("of") == F.col("__of")) & (F.col("slug") == F.col("__slug")), "left")
    counts = marked.groupBy("to").agg(
        F.count(F.lit(1)).alias("edges"), F.count("to").alias("resolved"), F.count_if(_lost() & F.col("there").isNull()).alias("broken"),
        F.count_if(_aimed() & F.col("known").isNull()).alias("broken_anchors"),
    )
    own = files.select("rel_path").distinct().withColumn("md", is_markdown(F.col("rel_path")))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name)
    return own.join(counts, F.col("rel_path") == F.col("to"), "full_outer").agg(
        F.count("rel_path").alias("files"), F.count_if("md").alias("markdown"), *(total(n) for n in ("edges", "resolved", "broken", "broken_anchors")),
        F.count_if(F.col("md") & F.col("edges").isNull()).alias("orphans"),
    )


def quoted(text: Column) -> Column:
    """A text in double quotes, with what would end or change it escaped."""
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return F.concat(F.lit('"'), text, F.lit('"'))


def dot(graph: DataFrame) -> DataFrame:
    """Lines of a DOT digraph: one for every resolved edge, those that repeat too, by file and line."""
    line = F.concat(F.lit("  "), quoted(F.col("src_rel_path")), F.lit(" -> "), quoted(F.col("to")), F.lit(";"))
    return graph.filter(F.col("to").isNotNull()).orderBy("src_rel_path", "line", "to").select(line.alias("line"))


def dest_with_anchor(target: Column, anchor: Column) -> Column:
    return F.when(F.coalesce(anchor, F.lit("")) == "", target).otherwise(F.concat(target, F.lit("#"), anchor))
