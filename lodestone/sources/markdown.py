"""Markdown read for structure: headings, code, links, chunks and generated contents.

A block pass finds fenced, indented and HTML blocks, list and quote containers, ATX and setext headings; an inline
pass finds code spans and links. Only headings outside containers count. Everything here works on one text; the
DataFrame forms at the end run it over (rel_path, content) rows.
"""

from __future__ import annotations

import bisect
import io
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.functions.textops import SIMPLIFY

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
CONTAINER = re.compile(r" {0,3}(?:>|[-+*](?:[ \t]|$)|\d{1,9}[.)](?:[ \t]|$))")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
HTML = re.compile(r" {0,3}<(?:[A-Za-z][\w-]*(?:\s|/?>|$)|/[A-Za-z]|!--|\?|![A-Z])")
FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---[ \t]*\r?\n?(.*)\Z", re.S)
LINK = re.compile(
    r"(?<!!)\[((?:[^\[\]\\]|\\.|!?\[[^\[\]]*\](?:\([^()]*\))?)*)\]"
    r"\(\s*(<[^<>\n]*>|[^\s()<]*(?:\([^()\s]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)"
)
REFERENCE = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?![\[(:])")
DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|\S+)", re.M)
WIKI = re.compile(r"\[\[([^\[\]]+)\]\]")
SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
CONTENTS = re.compile(r"^#{1,6}[ \t]+(?:table of contents|contents)[ \t]*$", re.I | re.M)
ANY_HEADING = re.compile(r"^#{1,6}[ \t]+\S", re.M)
SPACE = " \t\n\v\f\r"  # white space to the block pass; only line feeds end lines
TRIMMED = SPACE + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # cut off the ends of texts
REWRITES = [(re.compile(pattern), into.replace("$", "\\")) for pattern, into in SIMPLIFY]


def simplify(text: str) -> str:
    if "<!--" not in text and "](" not in text and "[[" not in text and "\n\n\n" not in text:
        return text  # no rule can match
    for pattern, into in REWRITES:
        text = pattern.sub(into, text)
    return text


@dataclass
class Heading:
    level: int
    text: str
    start: int  # of its line
    content: int  # where its section's content begins
    atx: bool


def blocks(src: str) -> tuple[list[Heading], list[tuple[int, int]]]:
    """Headings outside containers, and the ranges of code blocks."""
    headings, code = [], []
    fence = para = html = None
    held, at = False, 0  # held: inside a list or quote
    blank = True
    for line in io.StringIO(src, newline="\n"):
        start, at, bare = at, at + len(line), line.rstrip("\r\n")
        if fence:
            m = re.match(r" {0,3}(`+|~+)[ \t]*$", bare.lstrip() if held else bare)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                code.append((opened, start))
                fence = None
            continue
        if html:
            if html in line or html == "\n" and not bare.strip(SPACE):
                html = None
            continue
        if not bare.strip(SPACE):
            para, blank = None, True
            continue
        indent = len(bare) - len(bare.lstrip(" "))
        if held and (indent >= 2 or not blank and not ATX.match(bare) and not FENCE.match(bare)) or CONTAINER.match(bare) and not RULE.match(bare):
            if m := FENCE.match(re.sub(r"^ {0,3}(?:>|[-+*]|\d{1,9}[.)])[ \t]*", "", bare).lstrip()):
                fence, opened = m[1], at
            held, para, blank = True, None, False
            continue
        held = False
        if indent >= 4 or bare.startswith("\t"):
            if para is None:
                code.append((start, at))
                continue
        elif m := FENCE.match(bare):
            fence, opened, para = m[1], at, None
            continue
        elif m := ATX.match(bare):
            text = m[2] or ""
            if text.strip("#" + SPACE):
                begin = start + bare.index(text, len(m[1]))
                after = begin + len(text)
                headings.append(Heading(len(m[1]), text, start, after + 1 if src[after : after + 1] == "\n" else after, True))
            para, blank = None, False
            continue
        elif para is not None and (m := UNDERLINE.match(bare)):
            text = src[para:start].rstrip("\n")
            headings.append(Heading(1 if m[1][0] == "=" else 2, text, para, start, False))
            para, blank = None, False
            continue
        elif RULE.match(bare):
            para, blank = None, False
            continue
        elif para is None and HTML.match(bare):
            end = "-->" if bare.lstrip().startswith("<!--") else "\n"
            html = None if end in bare else end
            blank = False
            continue
        if para is None:
            para = start
        blank = False
    if fence:
        code.append((opened, len(src)))
    return headings, code


def split_frontmatter(content: str) -> tuple[dict, str]:
    """Leading YAML and the rest; text whose front matter is malformed is all body."""
    m = FRONT.match(content.lstrip("\ufeff \t\r\n"))
    if not m:
        return {}, content
    import yaml

    try:
        data = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, content
    return (data, m[2]) if isinstance(data, dict) else ({}, content)


def _scalar(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v).strip() if isinstance(v, str | int | float) else ""


def slugify(heading: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", heading.lower()).strip("-")[:60] or "section"


def is_contents(text: str) -> bool:
    return text.strip(TRIMMED).lower() in ("contents", "table of contents")


def chunk_markdown(content: str) -> list[dict]:
    """Chunks (chunk_key, heading, variant, text, line): title, then path, narrow and full of every section."""
    front, body = split_frontmatter(content)
    before = content[: len(content) - len(body)].count("\n")
    out = []
    if title := _scalar(front.get("title")) or _scalar(front.get("name")):
        tags = front.get("tags")
        tags = [t for t in map(_scalar, tags if isinstance(tags, list) else [tags]) if t]
        out.append({"chunk_key": "title", "heading": "", "variant": "title", "text": title + (f"\n\ntags: {', '.join(tags)}" if tags else ""), "line": 1})
    src = body.strip(TRIMMED)
    if not src:
        return out
    lead = body[: len(body) - len(body.lstrip(TRIMMED))].count("\n") + before + 1
    found, _ = blocks(src)
    if not found:
        out.append({"chunk_key": "body", "heading": "", "variant": "body", "text": simplify(src).strip(TRIMMED), "line": lead})
    breaks = [m.start() for m in re.finditer("\n", src)]
    # where the subtree of each heading ends: at the nearest heading behind it of its level or above
    ends, nearest = [len(src)] * len(found), [len(src)] * 7
    for i in range(len(found) - 1, -1, -1):
        ends[i] = min(nearest[: found[i].level + 1])
        nearest[found[i].level] = found[i].start
    stack: list[tuple[int, str]] = []
    for i, h in enumerate(found):
        name = simplify(h.text).strip(TRIMMED)
        stack = [*(c for c in stack if c[0] < h.level), (h.level, name)]
        if is_contents(name):
            continue
        near = found[i + 1].start if i + 1 < len(found) else len(src)
        path = " > ".join(f"{'#' * k} {t}" for k, t in stack)
        narrow, full = (simplify(src[h.content : end]).strip(TRIMMED) for end in (near, ends[i]))
        line = lead + bisect.bisect_left(breaks, h.start)
        texts = [("path", path)] + [("narrow", f"{path}\n\n{narrow}")] * bool(narrow) + [("full", f"{path}\n\n{full}")] * bool(full and full != narrow)
        out += [{"chunk_key": f"body/{i}/{slugify(name)}/{v}", "heading": path, "variant": v, "text": t, "line": line} for v, t in texts]
    return out


def code_spans(src: str, code: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Inline code outside code blocks: its range and text."""
    out, at = [], 0
    runs = [m for m in re.finditer(r"`+", src) if not any(a <= m.start() < b for a, b in code)]
    for i, m in enumerate(runs):
        if m.start() < at or src[: m.start()].endswith("\\"):
            continue
        for n in runs[i + 1 :]:
            if "\n\n" in src[m.end() : n.start()]:
                break
            if len(n[0]) == len(m[0]):
                out.append((m.start(), n.end(), src[m.end() : n.start()]))
                at = n.end()
                break
    return out


def internal_target(dest: str) -> tuple[str, str] | None:
    """The (target, anchor) of a link inside the corpus; None for others."""
    dest = dest.strip()
    if not dest or dest.startswith(("#", "//")) or SCHEME.match(dest):
        return None
    path, _, anchor = dest.partition("#")
    path = path.partition("?")[0].strip()
    return (path, anchor.partition("?")[0].strip()) if path else None


def code_target(text: str) -> tuple[str, str] | None:
    """A mention in code that names a document or Go file."""
    if re.search(r"[ \t\n]", text.strip()):
        return None
    found = internal_target(text)
    stem = found and found[0].rpartition("/")[2]
    ok = stem and re.search(r"[^/]\.(?:md|markdown|go)$", stem, re.I)
    return found if ok else None


def links(content: str, directive: str = "lodestone-ignore") -> list[dict]:
    """Links (target, anchor, kind, line): md, mentions in code, wiki.

    A comment ``<!-- directive -->`` silences its line, with ``-next-line`` the next, with ``-file`` the file.
    """
    _, body = split_frontmatter(content)
    src = body.strip()
    if not src:
        return []
    lead = content[: len(content) - len(body)].count("\n") + body[: len(body) - len(body.lstrip())].count("\n") + 1
    line_of = lambda off: lead + src.count("\n", 0, off)
    _, code = blocks(src)
    spans = code_spans(src, code)
    hidden = list(src)
    for a, b in [*code, *((a, b) for a, b, _ in spans)]:
        hidden[a:b] = ["\n" if c == "\n" else "\x00" for c in src[a:b]]
    bare, out, labels = "".join(hidden), [], []
    named = {m[1].strip().lower(): m[2].strip("<>") for m in DEFINITION.finditer(bare)}
    places = [(m, m[2].strip("<>")) for m in LINK.finditer(bare)]
    places += [(m, named[k]) for m in REFERENCE.finditer(bare) if (k := (m[2] or m[1]).strip().lower()) in named]
    for m, dest in places:
        labels.append((m.start(1), m.end(1)))
        if found := internal_target(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", dest)):
            out.append((m.start(1), *found, "md"))
    for a, _, text in spans:
        if not any(x <= a < y for x, y in labels) and (found := code_target(text)):
            out.append((a + 1, *found, "code"))
    out.sort(key=lambda x: x[0])
    for m in WIKI.finditer(bare):
        target, _, anchor = m[1].partition("|")[0].partition("#")
        if target.strip():
            out.append((m.start(), target.strip(), anchor.strip(), "wiki"))
    silent = set()
    for off, suffix in directives(src, code, directive):
        if suffix == "-file":
            return []
        silent.add(line_of(off) + bool(suffix))
    rows = [{"target": t, "anchor": a, "kind": k, "line": line_of(off)} for off, t, a, k in out]
    return [r for r in rows if r["line"] not in silent]


def directives(src: str, code: list[tuple[int, int]], directive: str) -> list[tuple[int, str]]:
    """Where comments outside code silence findings, and how far: empty, ``-next-line`` or ``-file``."""
    found = re.finditer(rf"<!--\s*{re.escape(directive)}(-next-line|-file)?\b.*?-->", src)
    return [(m.start(), m[1] or "") for m in found if not any(a <= m.start() < b for a, b in code)]


def ignores_file(content: str, directive: str = "lodestone-ignore") -> bool:
    """Whether a comment of a text silences it whole."""
    src = split_frontmatter(content)[1].strip()
    return directive in src and any(suffix == "-file" for _, suffix in directives(src, blocks(src)[1], directive))


def strip_frontmatter(content: str) -> str:
    if not re.match(r"---\r?\n", content):
        return content
    begin = content.index("\n") + 1
    m = re.compile(r"^---[ \t]*$", re.M).search(content, begin)
    return content[m.end() :].removeprefix("\n") if m else content


def toc(content: str) -> str:
    """The generated contents list: ATX headings from level 2, indented by level."""
    found = [h for h in blocks(strip_frontmatter(content))[0] if h.atx and h.level > 1 and not is_contents(h.text)]
    least = min((h.level for h in found), default=0)
    return "\n".join(f"{'  ' * (h.level - least)}- {h.text.strip()}" for h in found)


def _section(content: str) -> tuple[int, int] | None:
    m = CONTENTS.search(content)
    if not m:
        return None
    after = ANY_HEADING.search(content, m.end())
    return m.end(), after.start() if after else len(content)


def toc_audit(content: str) -> dict:
    """lines, entries, has_block and up_to_date of a text's contents list."""
    listed, place = toc(content), _section(content)
    current = place is not None and content[place[0] : place[1]].strip() == listed
    return {"lines": content.count("\n") + 1, "entries": listed.count("\n") + 1 if listed else 0, "has_block": place is not None, "up_to_date": current}


def toc_rewrite(content: str) -> str:
    """The text with its contents list replaced, or put before the first section."""
    listed, place = toc(content), _section(content)
    if not listed:
        raise ValueError("no headings to tabulate")
    if place:
        rest = content[place[1] :]
        return f"{content[: place[0]]}\n\n{listed}\n" + (f"\n{rest}" if rest else "")
    stripped = strip_frontmatter(content)
    first = next((h for h in blocks(stripped)[0] if h.atx and h.level > 1 and not is_contents(h.text)), None)
    at = len(content) - len(stripped) + first.start
    before = content[:at].rstrip("\n")
    return f"{before}{chr(10) * 2 if before else ''}## Contents\n\n{listed}\n\n{content[at:]}"


def _over(files: DataFrame, make, fields: str) -> DataFrame:
    def run(batches):
        names = [f.split()[0] for f in fields.split(", ")]
        for rows in batches:
            out = [{"rel_path": p, **r} for p, c in zip(rows["rel_path"], rows["content"], strict=True) for r in make(p, c or "")]
            yield pd.DataFrame(out, columns=["rel_path", *names])

    return files.select("rel_path", "content").mapInPandas(run, f"rel_path string, {fields}")


CHUNK = "chunk_key string, heading string, variant string, text string, line int"


def markdown_chunks(files: DataFrame) -> DataFrame:
    return _over(files, lambda p, c: chunk_markdown(c), CHUNK)


def markdown_links(files: DataFrame, directive: str = "lodestone-ignore") -> DataFrame:
    """Link rows as the graph takes them."""
    found = _over(files, lambda p, c: links(c, directive), "target string, anchor string, kind string, line int")
    return found.withColumnRenamed("rel_path", "src_rel_path")


def toc_fixes(files: DataFrame) -> DataFrame:
    """Rows (rel_path, content, fixed) of the files whose contents list a rewrite changes; those without headings stay."""

    def rewritten(path: str, content: str) -> list[dict]:
        fixed = toc_rewrite(content) if toc(content) else content
        return [{"content": content, "fixed": fixed}] if fixed != content else []

    return _over(files, rewritten, "content string, fixed string")


def toc_findings(files: DataFrame, threshold: int = 100, directive: str = "lodestone-ignore") -> DataFrame:
    """Rows (rel_path, lines, entries, reason): files over ``threshold`` lines whose contents are missing or stale.

    A file that silences itself gives none.
    """
    made = _over(files, lambda p, c: [] if ignores_file(c, directive) else [toc_audit(c)], "lines int, entries int, has_block boolean, up_to_date boolean")
    wanted = made.filter(f"lines > {int(threshold)} AND entries > 0 AND NOT up_to_date")
    return wanted.selectExpr("rel_path", "lines", "entries", "CASE WHEN has_block THEN 'stale' ELSE 'missing' END AS reason").orderBy("rel_path")
