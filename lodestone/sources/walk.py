"""Walking a directory on the driver and reading its files on the executors.

Spark's file sources skip names that begin with a dot or underscore, so the walk lists paths itself. Ignore files
count: the root's, ``.git/info/exclude`` (where the root has one), and nested ones for what lies below them.
"""

from __future__ import annotations

import hashlib
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.textops import LANGUAGE_OF

SKIPPED = {".git", ".lodestone", "node_modules"}


class IgnoreRules:
    """The rules of one ignore file; the last rule that matches decides."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            only_dir, line = line.endswith("/"), line.rstrip("/")
            rooted = "/" in line
            body = self._pattern(line.lstrip("/"))
            self.rules.append((re.compile(("" if rooted else r"(?:.*/)?") + body + r"(?P<below>/.*)?\Z", re.S), negated, only_dir))

    @staticmethod
    def _pattern(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + r"(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
                out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
            else:
                i += glob[i] == "\\" and i + 1 < len(glob)
                out, i = out + re.escape(glob[i]), i + 1
        return out

    def ignores(self, path: str, is_dir: bool) -> bool:
        verdict = False
        for pattern, negated, only_dir in self.rules:
            m = pattern.match(path)
            if m and (is_dir or not only_dir or m["below"]):
                verdict = not negated
        return verdict


def _rules(path: str) -> IgnoreRules | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return IgnoreRules(f.read())
    except OSError:
        return None


def walk(root: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Files to index (path, mtime in ns, size), sorted, and other entries a link may mean: all directories and files
    without extension."""
    files, entries, layers = [], [], []
    if top := _rules(os.path.join(root, ".gitignore")):
        layers.append(("", top))
        if more := _rules(os.path.join(root, ".git", "info", "exclude")):
            layers.append(("", more))
    for folder, names, leaves in os.walk(root):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if here == "." else here + "/"
        if prefix and (own := _rules(os.path.join(folder, ".gitignore"))):
            layers.append((prefix, own))
        held = [(p, r) for p, r in layers if prefix.startswith(p)]
        ignored = lambda path, is_dir: any(r.ignores(path[len(p) :], is_dir) for p, r in held)  # noqa: B023, E731
        entries += [prefix + n for n in names if n not in SKIPPED]
        names[:] = sorted(n for n in names if n not in SKIPPED and not ignored(prefix + n, True))
        for leaf in leaves:
            ext = leaf[leaf.rfind(".") :].lower() if "." in leaf else ""
            if not ext:
                entries.append(prefix + leaf)
            if ext in LANGUAGE_OF and not ignored(prefix + leaf, False):
                stat = os.stat(os.path.join(folder, leaf))
                files.append((prefix + leaf, stat.st_mtime_ns, stat.st_size))
    return sorted(files), sorted(entries)


def listing(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The walk as DataFrames: files (rel_path, mtime_ns, size) and entries (rel_path)."""
    files, entries = walk(root)
    return (
        spark.createDataFrame(files, "rel_path string, mtime_ns long, size long"),
        spark.createDataFrame([(e,) for e in entries], "rel_path string"),
    )


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """Rows (rel_path, content, content_hash) for paths below a root that the executors can reach."""

    def run(batches):
        for rows in batches:
            out = []
            for path in rows["rel_path"]:
                with open(os.path.join(root, path), "rb") as f:
                    raw = f.read()
                out.append((path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["rel_path", "content", "content_hash"])

    return paths.select("rel_path").mapInPandas(run, "rel_path string, content string, content_hash string")


def inside(root: str, rel_path: str) -> str:
    """The place of a path below the root; an error if it leads out of it."""
    full, top = os.path.realpath(os.path.join(root, rel_path)), os.path.realpath(root)
    if os.path.commonpath([full, top]) != top:
        raise ValueError(f"{rel_path} leads out of {root}")
    return full


def write_fixes(fixed: DataFrame, root: str) -> list[dict]:
    """Write rewritten files (rel_path, content, fixed, ..) in place, where their content is still what was read.

    What else the rows hold comes back for the files that were written, without the texts.
    """
    done = []
    for row in fixed.toLocalIterator():
        place = inside(root, row["rel_path"])
        with open(place, encoding="utf-8", newline="") as f:
            if f.read() != row["content"]:
                continue
        with open(place, "w", encoding="utf-8", newline="") as f:
            f.write(row["fixed"])
        done.append({k: v for k, v in row.asDict(recursive=True).items() if k not in ("content", "fixed")})
    return done
