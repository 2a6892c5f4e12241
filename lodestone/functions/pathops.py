"""Slash-separated paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.textops import extension


#: A path that is clean: dot-dots at its start only, no empty or dot segments.
CLEAN = r"^(?:\.\./)*(?!\.{1,2}(?:/|$))[^/]+(?:/(?!\.{1,2}(?:/|$))[^/]+)*$"


def clean(path: Column) -> Column:
    """The shortest equal path: no empty or dot segments, dot-dots taken back; ``.`` if nothing is left.

    Most paths are clean as they are, or with one folder left again; only the others are taken apart.
    """
    short = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"(^|/)(?!\.\.?/)[^/]+/\.\./", "$1")
    return F.when(path.rlike(CLEAN), path).when(short.rlike(CLEAN), short).otherwise(_clean(path))


def _clean(path: Column) -> Column:
    rooted = path.startswith("/")
    up, none = F.lit(".."), F.array().cast("array<string>")

    def step(done: Column, segment: Column) -> Column:
        deep = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != up)
        return (
            F.when(segment.isin("", "."), done)
            .when((segment == up) & deep, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((segment == up) & rooted, done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def directory(path: Column) -> Column:
    """All before the last slash; empty if there is none."""
    rest = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.left(path, F.greatest(rest, F.lit(0)))


def base_no_ext(path: Column) -> Column:
    """The last segment without its extension."""
    base = F.substring_index(F.when(path.endswith("/"), F.regexp_replace(path, "/+$", "")).otherwise(path), "/", -1)
    return F.when(base.contains("."), F.left(base, F.length(base) - F.length(F.substring_index(base, ".", -1)) - 1)).otherwise(base)


def plain(path: Column) -> Column:
    """Whether a relative path has no segments to take out; false for some that have none either."""
    odd = path.contains("./") | path.contains("//") | path.startswith("/") | path.endswith("/") | path.endswith("/.") | path.endswith("/..")
    return ~odd & ~path.isin("", ".", "..")


def percent_decode(path: Column) -> Column:
    """Percent escapes decoded; the path as it is where they are malformed."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), F.coalesce(decoded, path)).otherwise(path)


def joined(source: Column, to: Column) -> Column:
    """A relative path as seen from a file, clean.

    Plain paths, and those that leave one folder first, are put together at once; only the others are cleaned.
    """
    here = directory(source)
    rest, above = F.substr(to, F.lit(4)), directory(here)
    beside = lambda folder, path: F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))
    one_up = to.startswith("../") & plain(rest) & (here != "")
    return F.when(plain(to), beside(here, to)).when(one_up, beside(above, rest)).otherwise(clean(beside(here, to)))


def candidate(source: Column, target: Column) -> Column:
    """Where a relative or rooted link target points, from the linking file."""
    to = percent_decode(target)
    return F.when(to.startswith("/"), clean(F.regexp_replace(to, "^/", ""))).otherwise(joined(source, to))


def ext_candidates(path: Column) -> Column:
    """Files a path can mean: itself, and with a markdown extension if it has none."""
    return F.when(extension(path) != "", F.array(path)).otherwise(
        F.array(path, F.concat(path, F.lit(".md")), F.concat(path, F.lit(".markdown")))
    )


def climb_depth(target: Column) -> Column:
    """How many directories a relative target climbs."""
    return F.when(target.isNull() | ~target.contains("..") | target.startswith("/"), F.lit(0)).otherwise(
        F.length(F.regexp_extract(F.concat(clean(target), F.lit("/")), r"^((?:\.\./)*)", 1)).cast("int") / 3
    ).cast("int")


def ancestors(path: Column) -> Column:
    """Every directory above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
