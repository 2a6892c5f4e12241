"""Documentation lint over links: mentions that could be links, ambiguous and broken mentions, deep relative links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import pathops as P
from lodestone.functions.textops import anchor_slug, extension
from lodestone.operators.graph import _no_name, dest_with_anchor, resolve_mentions, same_names

DEEP = 2  # dot-dots from which a relative link is deep


def analyze(links: DataFrame, files: DataFrame, headings: DataFrame, link_root: str = "") -> DataFrame:
    """Rows (category, src_rel_path, target, anchor, to, suggest, candidates, line); category is unlinked, ambiguous,
    broken (these for mentions in code) or deep (for relative links)."""
    deep_enough = (F.col("kind") == "code") | (P.climb_depth(F.col("target")) >= DEEP)
    found = resolve_mentions(links.filter("kind IN ('code', 'md')").filter(deep_enough), files)
    # a bare name looks up the files that share it; other targets look up nothing
    bare, target = (F.col("kind") == "code") & ~F.col("target").contains("/"), F.lower(F.col("target"))
    found = found.withColumns({"base": F.when(bare, P.base_no_ext(target)).otherwise(_no_name(F.col("src_rel_path"))), "ext": extension(target)})
    found = found.join(same_names(files), ["base", "ext"], "left")
    anchor = F.coalesce("anchor", F.lit(""))
    known = headings.select(F.col("rel_path").alias("__of"), F.col("slug").alias("__slug"), F.lit(True).alias("known")).distinct()
    aimed = F.when(F.col("to").isNotNull() & (anchor != ""), F.col("to")).otherwise(_no_name(F.col("src_rel_path")))
    found = found.withColumns({"of": aimed, "slug": anchor_slug(anchor)}).join(known, (F.col("of") == F.col("__of")) & (F.col("slug") == F.col("__slug")), "left")
    code, fits = F.col("kind") == "code", (anchor == "") | F.coalesce("known", F.lit(False))
    cleaned = P.joined(F.col("src_rel_path"), F.col("target"))
    deep = (P.climb_depth(F.col("target")) >= DEEP) & ~cleaned.startswith("..")
    rooted = F.concat(F.lit("/" + (link_root.strip("/") + "/" if link_root.strip("/") else "")), cleaned)
    category = (
        F.when(code & (F.coalesce(F.size("candidates"), F.lit(0)) > 1), "ambiguous")
        .when(code & F.col("to").isNotNull() & fits, "unlinked")
        .when(code, "broken")
        .when(deep, "deep")
    )
    ambiguous = F.col("category") == "ambiguous"
    return found.withColumn("category", category).filter("category IS NOT NULL").select(
        "category", "src_rel_path", "target", "anchor",
        F.when(~ambiguous, F.col("to")).alias("to"),
        F.when(F.col("category") == "deep", dest_with_anchor(rooted, anchor)).alias("suggest"),
        F.when(ambiguous, F.col("candidates")).alias("candidates"), "line",
    )


def keep_files(report: DataFrame, files: DataFrame) -> DataFrame:
    """The findings in some files, in order."""
    return report.join(files.select(F.col("rel_path").alias("src_rel_path")).distinct(), "src_rel_path", "left_semi").orderBy("src_rel_path", "line")


def _fix_line(category: str, line: str, dest: str, href: str) -> str:
    if category == "deep":
        return line.replace(f"]({dest})", f"]({href})", 1)
    span, at = f"`{dest}`", 0
    while (at := line.find(span, at)) >= 0:
        end = at + len(span)
        if not (line[:at].endswith("[") and line[end:].startswith("](")):
            return f"{line[:at]}[{span}]({href}){line[end:]}"
        at = end
    return line


def fixes(report: DataFrame, contents: DataFrame, link_root: str = "") -> DataFrame:
    """Rows (rel_path, content, fixed, rewrites): files that unlinked and deep findings rewrite, unlinked ones first.

    ``contents`` are (rel_path, content). A finding rewrites one place on its line; one whose line has changed is left.
    ``rewrites`` are (category, old, new, count): how often each destination was rewritten, in order.
    """
    root = link_root.strip("/")
    href = F.when(F.col("category") == "deep", F.col("suggest")).otherwise(
        dest_with_anchor(F.concat(F.lit("/" + (root + "/" if root else "")), F.col("to")), F.col("anchor"))
    )
    todo = report.filter("category IN ('unlinked', 'deep')").groupBy(F.col("src_rel_path").alias("rel_path")).agg(
        F.sort_array(F.collect_list(F.struct(
            (F.col("category") == "deep").alias("later"), "line", "target", "category",
            dest_with_anchor(F.col("target"), F.col("anchor")).alias("dest"), href.alias("href"),
        ))).alias("todo")
    )

    def rewrite(batches):
        for rows in batches:
            out, counts = [], []
            for content, todo in zip(rows["content"], rows["todo"], strict=True):
                lines, done = content.split("\n"), {}
                for x in todo:
                    if 0 < x["line"] <= len(lines):
                        was = lines[x["line"] - 1]
                        lines[x["line"] - 1] = _fix_line(x["category"], was, x["dest"], x["href"])
                        key = (x["category"], x["dest"], x["href"])
                        done[key] = done.get(key, 0) + (lines[x["line"] - 1] != was)
                out.append("\n".join(lines))
                counts.append([{"category": c, "old": d, "new": h, "count": n} for (c, d, h), n in sorted(done.items()) if n])
            rows = rows.assign(fixed=out, rewrites=counts)
            yield rows.loc[rows.fixed != rows.content, ["rel_path", "content", "fixed", "rewrites"]]

    shape = "rel_path string, content string, fixed string, rewrites array<struct<category: string, old: string, new: string, count: int>>"
    return contents.join(todo, "rel_path").mapInPandas(rewrite, shape)
