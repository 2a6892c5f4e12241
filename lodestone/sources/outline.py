"""Source text read for its outline: comments, and the statements of a container with the range of their block.

A lexical pass finds comments and literals and blanks them (all offsets stay), so that what follows sees structure
only. Statements are then cut at semicolons, blocks and, where a language ends them so, lines. No grammar is needed,
and text that isn't the language it claims to be gives few statements or odd ones, never an error.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

QUOTED = r'"(?:\\.|[^"\\\n])*"'
SINGLE = r"'(?:\\.|[^'\\\n])*'"
TRIPLE = r'"""(?:.|\n)*?"""'
BLOCK_COMMENT = r"/\*(?:.|\n)*?(?:\*/|\Z)"
SLASHES = r"//[^\n]*"
HASH = r"#[^\n]*"
TEMPLATE = r"`(?:\\.|[^`\\])*`"
#: Comment patterns, then literal patterns.
LEXICON = {
    "go": ([SLASHES, BLOCK_COMMENT], [QUOTED, r"`[^`]*`", SINGLE]),
    "typescript": ([r"\A#![^\n]*", SLASHES, BLOCK_COMMENT], [QUOTED, SINGLE, TEMPLATE, r"(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"]),
    "java": ([SLASHES, BLOCK_COMMENT], [TRIPLE, QUOTED, SINGLE]),
    "csharp": ([SLASHES, BLOCK_COMMENT], [TRIPLE, r'\$?@\$?"(?:""|[^"])*"', QUOTED, SINGLE]),
    "rust": ([SLASHES, BLOCK_COMMENT], [r'r(#*)"(?:.|\n)*?"\0', r'"(?:\\(?:.|\n)|[^"\\])*"', r"'(?:\\[^'\n]*|[^'\\\n])'"]),
    "c": ([SLASHES, BLOCK_COMMENT], [QUOTED, SINGLE]),
    "cpp": ([SLASHES, BLOCK_COMMENT], [r'R"\((?:.|\n)*?\)"', QUOTED, SINGLE]),
    "php": ([SLASHES, BLOCK_COMMENT, r"#(?!\[)[^\n]*"], [r"<<<['\"]?(\w+)['\"]?\n(?:.|\n)*?\n[ \t]*\0\b", r'"(?:\\(?:.|\n)|[^"\\])*"', r"'(?:\\(?:.|\n)|[^'\\])*'"]),
    "scala": ([SLASHES, BLOCK_COMMENT], [TRIPLE, QUOTED, r"'(?:\\.|[^'\\\n])'"]),
    "protobuf": ([SLASHES, BLOCK_COMMENT], [QUOTED, SINGLE]),
    "hcl": ([SLASHES, BLOCK_COMMENT, HASH], [r"<<-?(\w+)\n(?:.|\n)*?\n[ \t]*\0\b", QUOTED]),
    "ruby": ([r"^=begin\b(?:.|\n)*?^=end[^\n]*", r"(?<![\w\"'?:])#(?!\{)[^\n]*"], [r'"(?:\\(?:.|\n)|[^"\\])*"', r"'(?:\\(?:.|\n)|[^'\\])*'"]),
    "lua": ([r"--\[(=*)\[(?:.|\n)*?\]\0\]", r"--[^\n]*"], [r"\[(=*)\[(?:.|\n)*?\]\0\]", QUOTED, SINGLE]),
    "bash": ([r"(?<![^\s;(){}|&])#[^\n]*"], [r'"(?:\\(?:.|\n)|[^"\\])*"', r"'[^']*'", r"<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(?:.|\n)*?^[ \t]*\0$"]),
}
LEXICON["javascript"] = LEXICON["typescript"]
PATTERNS = {}


def _pattern(language: str) -> re.Pattern:
    """All parts of a lexicon as one pattern; in a part, ``\\0`` stands for what its own first group found."""
    if language not in PATTERNS:
        parts, groups = [], 0
        for part in [p for kind in LEXICON[language] for p in kind]:
            parts.append("(" + part.replace(r"\0", rf"\{groups + 2}") + ")")
            groups += 1 + re.compile(part.replace(r"\0", "")).groups
        PATTERNS[language] = re.compile("|".join(parts), re.M)
    return PATTERNS[language]


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


@dataclass
class Source:
    """A text, itself without comments and contents of literals, and its comments as ranges in order."""

    text: str
    language: str
    bare: str = ""
    comments: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        marks, comments = LEXICON[self.language][0], []
        begins = ("//", "/*", "#!") if SLASHES in marks else ("--",) if self.language == "lua" else ("#", "=begin")
        begins += ("#",) if self.language in ("php", "hcl") else ()

        def cover(m: re.Match) -> str:
            if m[0].startswith(begins):
                comments.append(m.span())
                return _blank(m[0])
            return m[0] if len(m[0]) < 2 else m[0][0] + _blank(m[0][1:-1]) + m[0][-1]

        self.bare = _pattern(self.language).sub(cover, self.text)
        self.comments = comments
        self.lines = [m.end() for m in re.finditer("\n", self.text)]

    def row(self, at: int) -> int:
        """The number of the line of an offset, from 0."""
        return bisect.bisect_right(self.lines, at)


@dataclass
class Statement:
    """A statement from ``start`` to ``end``; its block, if it has one, lies between ``open`` and ``close`` with its braces."""

    start: int
    end: int
    open: int = -1
    close: int = -1


def closing(bare: str, at: int, limit: int) -> int:
    """The place after the bracket that closes the one at a place; the limit if none does."""
    pairs, stack = {"(": ")", "[": "]", "{": "}"}, []
    for m in re.compile(r"[()\[\]{}]").finditer(bare, at, limit):
        if m[0] in pairs:
            stack.append(pairs[m[0]])
        elif m[0] in stack:
            while stack.pop() != m[0]:
                pass
            if not stack:
                return m.end()
    return limit


CONTINUES = {  # of languages whose statements end with lines: what a line must not end in, nor the next begin with
    "go": (re.compile(r"[^\w)\]}\"'`]\Z"), re.compile(r"(?!)")),
    "hcl": (re.compile(r"[=,(\[{]\Z"), re.compile(r"(?!)")),
    "typescript": (re.compile(r"(?:[-+*/%=<>&|^!~?:,.(\[{]|\b(?:extends|implements|return|new|typeof|as|in|of))\Z"), re.compile(r"[.?:,)\]=&|+*/%<>{]|(?:extends|implements|instanceof|as|in)\b")),
    "scala": (re.compile(r"(?:[-+*/%=<>&|^!~?:,.(\[{]|\b(?:extends|with))\Z"), re.compile(r"[.)\]}{]|(?:extends|with|derives)\b")),
}
CONTINUES["javascript"] = CONTINUES["typescript"]
OPEN_ENDED = {  # statements that go on behind their block, up to a semicolon
    "c": re.compile(r"typedef\b|(?:\w+\s+)*(?:struct|union|enum)\b[^()]*\Z|[^()]*="),
    "java": re.compile(r"[^({]*=(?!=)"),
    "rust": re.compile(r"(?:pub\b[^a-z]*)?(?:static|const|let|use)\b(?!\s+(?:unsafe\s+|async\s+)*fn)"),
    "protobuf": re.compile(r"(?!)"),
}
OPEN_ENDED["cpp"] = re.compile(r"typedef\b|(?:\w+\s+)*(?:struct|union|enum|class)\b[^()]*\Z|[^()]*=")
OPEN_ENDED["csharp"] = OPEN_ENDED["php"] = OPEN_ENDED["java"]
TOKEN = re.compile(r"[;\n(\[{}]")


def statements(source: Source, a: int, b: int) -> Iterator[tuple[int, int] | Statement]:
    """Comments (as ranges) and statements directly in a range, in order."""
    bare, at = source.bare, a
    comments = source.comments[bisect.bisect_left(source.comments, (a, -1)) :]
    seen = 0
    by_line = source.language in CONTINUES
    while at < b:
        while seen < len(comments) and comments[seen][0] < at:
            seen += 1
        m = re.compile(r"[^\s;,]").search(bare, at, b)
        start = m.start() if m else b
        if seen < len(comments) and comments[seen][0] < start and comments[seen][0] < b:
            yield comments[seen]
            at = comments[seen][1]
            continue
        if not m or bare[start] in "})]":
            if not m:
                return
            at = start + 1
            continue
        if source.language in ("c", "cpp") and bare[start] == "#":
            end = _directive(bare, start, b)
            yield Statement(start, end)
            at = end
            continue
        if source.language == "rust" and re.compile(r"#!?\[").match(bare, start, b):
            end = closing(bare, bare.index("[", start), b)
            yield Statement(start, end)
            at = end
            continue
        found = _statement(source, start, b, by_line)
        yield found
        at = max(found.end, start + 1)


def _directive(bare: str, at: int, limit: int) -> int:
    """The end of a preprocessor line, or of all that a condition encloses."""
    line = re.compile(r"(?:[^\n]*\\\n)*[^\n]*")
    end = line.match(bare, at, limit).end()
    if not re.match(r"#\s*if", bare[at:end]):
        return end
    depth = 0
    for m in re.compile(r"^[ \t]*#\s*(if|endif)[^\n]*", re.M).finditer(bare, bare.rfind("\n", 0, at) + 1, limit):
        depth += 1 if m[1] == "if" else -1
        if not depth:
            return m.end()
    return limit


def _statement(source: Source, start: int, limit: int, by_line: bool) -> Statement:
    bare, at, made = source.bare, start, Statement(start, limit)
    while m := TOKEN.search(bare, at, limit):
        at, c = m.end(), m[0]
        if c == ";":
            made.end = at
            return made
        if c == "}":
            made.end = m.start()
            return made
        if c in "([":
            at = closing(bare, m.start(), limit)
        elif c == "{":
            at = closing(bare, m.start(), limit)
            if made.open < 0:
                made.open, made.close = m.start(), at
            if by_line:
                if source.language != "go" and source.language != "hcl" and not re.search(r"=(?!>)(?!=)", bare[start : made.open]):
                    made.end = at
                    return made
            elif not OPEN_ENDED[source.language].match(bare, start, made.open) and not re.match(r"\s*=", bare[at:limit]):
                made.end = at
                return made
        elif by_line:
            before, after = CONTINUES[source.language]
            line = bare[start : m.start()].rstrip()
            following = re.compile(r"\s*").match(bare, at, limit).end()
            if not before.search(line) and not after.match(bare, following, limit):
                made.end = start + len(line)
                return made
    made.end = start + len(bare[start:limit].rstrip())
    return made


RUBY = re.compile(r"(?:^|;)[ \t]*(class|module|def|begin|case|if|unless|while|until|for)\b|\b(do)\b|\b(end)\b|(?<=[=(])[ \t]*(if|case|begin|unless)\b", re.M)
ENDLESS = re.compile(r"\s*def\s+[\w.?!]+\s*(?:\([^()\n]*\))?\s*=(?![=~])")
LUA = re.compile(r"\b(?:(function|if|do|repeat)|(end|until))\b")


def keyword_end(source: Source, at: int, limit: int) -> int:
    """The place after the keyword that ends the block whose opening keyword lies at a place."""
    depth, loop = 0, -1
    for m in (RUBY if source.language == "ruby" else LUA).finditer(source.bare, at, limit):
        if source.language == "lua":
            depth += 1 if m[1] else -1
        else:
            word = m[1] or m[2] or m[3] or m[4]
            line = source.row(m.end())
            if word == "def" and ENDLESS.match(source.bare, m.start(1)):
                continue
            if word == "do" and line == loop:
                continue  # the do of a loop on its line
            if word in ("while", "until", "for"):
                loop = line
            depth += -1 if word == "end" else 1
        if depth <= 0:
            return m.end()
    return limit


def keyword_statements(source: Source, a: int, b: int) -> Iterator[tuple[int, int] | Statement]:
    """``statements`` for languages whose blocks end in a keyword; ``open`` is where a declaration's header ends."""
    bare, at = source.bare, a
    comments = [c for c in source.comments if a <= c[0] < b]
    opens = r"(?:class|module|def)\b" if source.language == "ruby" else r"(?:local\s+)?function\b"
    others = r"(?:begin|case|if|unless|while|until|for)\b" if source.language == "ruby" else r"(?:if|do|repeat|while|for)\b"
    while at < b:
        while comments and comments[0][0] < at:
            comments.pop(0)
        m = re.compile(r"[^\s;]").search(bare, at, b)
        start = m.start() if m else b
        if comments and comments[0][0] < start:
            yield comments[0]
            at = comments[0][1]
            continue
        if not m:
            return
        line_end = bare.find("\n", start, b)
        line_end = b if line_end < 0 else line_end
        if re.compile(opens).match(bare, start, b):
            head = re.compile(r"[^\n;(]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[^\n;]*" if source.language == "ruby" else r"[^\n(]*\([^()]*\)").match(bare, start, b)
            open_ = head.end() if head else line_end
            if ENDLESS.match(bare, start, b) and source.language == "ruby":
                equals = bare.index("=", start, b)
                yield Statement(start, line_end, equals, line_end)
                at = line_end
                continue
            end = keyword_end(source, start, b)
            yield Statement(start, end, open_, end)
            at = end
        elif re.compile(others).match(bare, start, b) or re.search(r"\bdo\b(?:\s*\|[^|\n]*\|)?\s*$", bare[start:line_end]):
            at = keyword_end(source, start, b)
            yield Statement(start, at)
        else:
            yield Statement(start, line_end)
            at = line_end
