"""Source code cut into its declarations, each with its breadcrumb, signature and documentation.

``outline`` gives the statements of a file and of every block; here they are told apart by language. Regular languages
are tables of declarations: how one begins, what it is called, and whether it is shown whole or as its header. Go,
TypeScript, Python, protocol buffers, HCL, YAML and shell have readers of their own. Documentation is the unbroken group
of comments that ends on the line above a declaration.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestone.functions.textops import LANGUAGE_OF
from lodestone.sources.markdown import CHUNK, _over, chunk_markdown
from lodestone.sources.outline import Source, Statement, closing, keyword_statements, statements

VALUE_LIMIT = 80  # bytes of an initial value that are shown


def one_line(text: str) -> str:
    return " ".join(text.split())


def header(text: str) -> str:
    """A signature on one line, without the brace it ends in."""
    return one_line(text).rstrip("{ ")


def bare_header(text: str) -> str:
    """A header without what is left of a cut-off body."""
    return header(text).strip().rstrip("={:").strip()


def whole(text: str) -> str:
    return text.strip().rstrip(";")


def directive(text: str) -> bool:
    """Whether a comment, behind its mark, tells a tool something: ``name:argument`` without a space."""
    return bool(re.match(r"[a-z0-9]+:(?! )(?=.)", text, re.S))


def block_prose(raw: str) -> list[str]:
    lines = raw.removeprefix("/*").removesuffix("*/").split("\n")
    return [x.strip().removeprefix("*").strip() for x in lines]


def prose(*marks: str) -> Callable[[str], list[str]]:
    """A function that gives the lines of a comment that begins with one of the marks, or of a block comment."""

    def lines(raw: str) -> list[str]:
        for mark in marks:
            if raw.startswith(mark):
                rest = raw.removeprefix(mark)
                return [] if directive(rest) else [rest.strip()]
        return block_prose(raw) if raw.startswith("/*") else []

    return lines


def rust_prose(raw: str) -> list[str]:
    if raw.startswith(("///", "//!")):
        return [raw[3:].strip()]
    return block_prose(raw) if raw.startswith("/*") else []


def script_prose(raw: str) -> list[str]:
    return [] if raw.startswith("#!") else prose("#")(raw)


class Docs:
    """The comments seen last, and whether they belong to what follows."""

    def __init__(self, source: Source, lines: Callable[[str], list[str]]):
        self.source, self.lines, self.group = source, lines, []

    def offer(self, span: tuple[int, int]) -> None:
        if self.group and not self.adjoins(self.group[-1][1], span[0]):
            self.group = []
        self.group.append(span)

    def adjoins(self, end: int, start: int) -> bool:
        return 0 <= self.source.row(start) - self.source.row(end) <= 1

    def take(self, start: int) -> str:
        """The text of the comments above a place, if they adjoin it; either way they are used up."""
        group, self.group = self.group, []
        if not group or not self.adjoins(group[-1][1], start):
            return ""
        return "\n".join(x for a, b in group for x in self.lines(self.source.text[a:b])).strip()


class Chunks:
    """The chunks of a file; a key that is there already gets a number."""

    def __init__(self, source: Source | None, prefix: str, again: str = "~", first: int = 1):
        self.source, self.prefix, self.again, self.first, self.seen, self.out = source, prefix, again, first, {}, []

    def add(self, part: str, name: str, crumb: str, variant: str, signature: str, doc: str, row: int) -> None:
        key = "/".join(x for x in (self.prefix, part, name) if x)
        n = self.seen.get(key, 0)
        self.seen[key] = n + 1
        text = "\n\n".join([crumb, *(x for x in (signature.strip(), doc.strip()) if x)])
        self.out.append({"chunk_key": f"{key}{self.again}{n - 1 + self.first}" if n else key, "heading": crumb, "variant": variant, "text": text, "line": row + 1})


# Tables of the regular languages. Of a rule: key part, variant, the pattern of a statement's head with its name as
# group, and how it is shown: "whole"; as "header"; as header if it has "members", which are chunks too, else whole; or not
# at all, as it only gives its members their "scope".
MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|non-sealed|partial|default|async|override|virtual|readonly|open|case|implicit|lazy|new|unsafe|extern|strictfp|native|synchronized|required|inline|transparent|ref)\s+|@\w[\w.]*(?:\([^()]*\))?\s*|\[[^\]]*\]\s*|#\[[^\]]*\]\s*)*"
CALLABLE = r"(?!(?:return|new|else|throw|if|for|while|switch|catch|using|lock)\b)(?:<[^>]*>\s*)?(?:[\w$.<>\[\],?:&*]+\s+)*?[*&]*"
RUST = r"(?:pub(?:\([^)]*\))?\s+)?"
C_FUNCTION = r"(?!(?:typedef|if|for|while|switch|return|else)\b)[^=(){};]*?[\s*&]((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*|(?:[A-Za-z_]\w*::)*operator\s*[^\s\w(]+)\s*\([^;{}]*\)[^;{}()=]*\Z"
TYPEDEF = r"typedef\b(?:[^{}]*\{.*\}\s*|(?:.*?[\s*&])(?=[\w(*\[]))(\(?\**\s*\w+\)?(?:\[[^\]]*\]|\([^()]*\))*)\s*;?\Z"
TABLES: dict[str, tuple[str, Callable, list[tuple[str, str, str, str]]]] = {
    "java": ("java", prose("//", "#"), [
        ("class", "class", MODIFIERS + r"class\s+(\w+)", "members"), ("annotation", "interface", MODIFIERS + r"@\s*interface\s+(\w+)", "header"),
        ("interface", "interface", MODIFIERS + r"interface\s+(\w+)", "members"), ("enum", "enum", MODIFIERS + r"enum\s+(\w+)", "members"),
        ("record", "class", MODIFIERS + r"record\s+(\w+)\s*[(<]", "members"),
        ("method", "method", MODIFIERS + CALLABLE + r"(\w+)\s*\((?:[^=]*\)[^=]*|\s*)\Z", "header"),
    ]),
    "csharp": ("cs", prose("//", "#"), [
        ("class", "class", MODIFIERS + r"class\s+(\w+)", "members"), ("interface", "interface", MODIFIERS + r"interface\s+(\w+)", "members"),
        ("struct", "struct", MODIFIERS + r"struct\s+(\w+)", "members"), ("record", "class", MODIFIERS + r"record\s+(?:class\s+|struct\s+)?(\w+)", "members"),
        ("enum", "enum", MODIFIERS + r"enum\s+(\w+)", "header"), ("namespace", "module", r"namespace\s+([\w.]+)", "members"),
        ("method", "method", MODIFIERS + r"(?!delegate\b|event\b|using\b)" + CALLABLE + r"(\w+)\s*(?:<[^>()]*>)?\s*\((?:[^=]|=(?!>))*\)[^=]*(?:=>.*)?\Z", "header"),
        ("property", "value", MODIFIERS + r"(?!delegate\b|event\b|using\b|const\b)[\w.<>\[\],?]+\s+(\w+)\s*(?:=>.*|\{)\Z", "header"),
    ]),
    "rust": ("rs", rust_prose, [
        ("struct", "struct", RUST + r"struct\s+(\w+)", "members"), ("enum", "enum", RUST + r"enum\s+(\w+)", "members"), ("union", "struct", RUST + r"union\s+(\w+)", "header"),
        ("trait", "trait", RUST + r"(?:unsafe\s+|auto\s+)*trait\s+(\w+)", "members"), ("mod", "module", RUST + r"mod\s+(\w+)", "members"), ("type", "type", RUST + r"type\s+(\w+)", "whole"),
        ("impl", "", r"(?:default\s+)?(?:unsafe\s+)?impl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s*(?:.*?\bfor\s+)?([^{]+?)\s*(?:\bwhere\b.*)?\Z", "scope"),
        ("func", "func", RUST + r"(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(\w+)", "header"), ("macro", "func", r"macro_rules!\s*(\w+)", "header"),
    ]),
    "c": ("c", prose("//"), [
        ("struct", "struct", r"struct\s+(\w+)\s*\Z", "whole"), ("union", "struct", r"union\s+(\w+)\s*\Z", "whole"), ("enum", "enum", r"enum\s+(\w+)\s*\Z", "whole"),
        ("type", "type", TYPEDEF, "whole"), ("func", "func", C_FUNCTION, "header"),
    ]),
    "cpp": ("cpp", prose("//"), [
        ("class", "class", r"class\s+(?:\[\[[^\]]*\]\]\s*)?(\w+)\s*(?:final\s*)?(?::[^;]*)?\Z", "members"), ("struct", "struct", r"struct\s+(\w+)\s*(?:final\s*)?(?::[^;]*)?\Z", "members"),
        ("union", "struct", r"union\s+(\w+)\s*\Z", "whole"), ("enum", "enum", r"enum\s+(?:class\s+|struct\s+)?(\w+)\s*(?::[^;]*)?\Z", "whole"),
        ("namespace", "module", r"(?:inline\s+)?namespace\s+([\w:]+)\s*\Z", "members"), ("type", "type", TYPEDEF, "whole"),
        ("func", "func", r"(?!template\b|extern\b)" + C_FUNCTION.replace(r"[\s*&]((", r"(?:[\s*&]|\b)((", 1), "header"),
    ]),
    "php": ("php", prose("//", "#"), [
        ("class", "class", MODIFIERS + r"class\s+(\w+)", "members"), ("interface", "interface", r"interface\s+(\w+)", "members"), ("trait", "trait", r"trait\s+(\w+)", "members"),
        ("enum", "enum", r"enum\s+(\w+)", "members"), ("func", "func", MODIFIERS + r"function\s+&?(\w+)", "header"),
    ]),
    "scala": ("scala", prose("//", "#"), [
        ("class", "class", MODIFIERS + r"class\s+(\w+)", "members"), ("object", "module", MODIFIERS + r"object\s+(\w+)", "members"), ("trait", "trait", MODIFIERS + r"trait\s+(\w+)", "members"),
        ("enum", "enum", MODIFIERS + r"enum\s+(\w+)", "members"), ("type", "type", MODIFIERS + r"(?:opaque\s+)?type\s+(\w+)", "whole"),
        ("func", "func", MODIFIERS + r"def\s+([\w$]+|[^\s\w(\[:=]+)", "header"),
    ]),
    "ruby": ("rb", prose("#"), [
        ("class", "class", r"class\s+<<\s*(\w+)|class\s+([A-Z][\w:]*)", "members"), ("module", "module", r"module\s+([A-Z][\w:]*)", "members"),
        ("method", "method", r"def\s+(?:\w+\.)?(\w+[?!=]?|[^\s\w(]+)", "header"),
    ]),
    "lua": ("lua", prose("---", "--"), [("func", "func", r"(?:local\s+)?function\s+([\w.:]+)", "header")]),
}


@dataclass
class Declaration:
    part: str
    variant: str
    name: str
    shape: str


class TableReader:
    """The declarations of a regular language."""

    def __init__(self, source: Source):
        self.source = source
        prefix, self.prose, rules = TABLES[source.language]
        self.rules = [(part, variant, re.compile(pattern, re.S), shape) for part, variant, pattern, shape in rules]
        self.chunks = Chunks(source, prefix)
        self.parts = keyword_statements if source.language in ("ruby", "lua") else statements

    def declaration(self, s: Statement, inside: str) -> Declaration | None:
        text = self.source.bare[s.start : s.open if s.open >= 0 else s.end].rstrip("; \n\t")
        if self.source.language == "csharp" and s.open >= 0:
            text += "{"
        if self.source.language in ("c", "cpp") and s.open >= 0:
            # what stands behind a block tells a type from a variable of that type
            tail = self.source.bare[s.close : s.end].strip()
            if text.lstrip().startswith("typedef"):
                text += "{}" + tail.rstrip(";")
            elif tail not in ("", ";"):
                return None
        at = self.source.bare[s.start :][:1]
        if self.source.language == "rust" and at == "#" or self.source.language in ("c", "cpp") and at == "#":
            return None
        for part, variant, pattern, shape in self.rules:
            m = pattern.match(text)
            if m:
                name = next(g for g in m.groups() if g)
                if self.source.language == "php" and part == "func" and inside:
                    return Declaration("method", "method", name, shape)
                if part == "func" and self.source.language in ("c", "cpp") and s.open < 0:
                    # without a body a function is a declaration: of a method where it has a type, else of no symbol
                    typed = re.match(r"(?:(?:virtual|static|inline|explicit|constexpr)\s+)*[\w:<>,*&\s]+?[\s*&]" + re.escape(name), text)
                    own = name.lstrip("~").rpartition("::")[2] == inside.rstrip(".").rpartition(".")[2]
                    return Declaration("method", "method", name, "whole") if self.in_class and typed and not own else None
                return Declaration(part, variant, name, shape)
        return None

    def head(self, s: Statement) -> str:
        """A declaration's header: up to its body, and up to a comment that comes before."""
        source, end = self.source, s.open if s.open >= 0 else s.end
        if source.language == "scala":
            m = re.compile(r"(?<![=<>!:])=(?![=>])").search(source.bare, s.start, end)
            depth = lambda a: source.bare.count("(", s.start, a) - source.bare.count(")", s.start, a)
            while m and depth(m.start()):
                m = re.compile(r"(?<![=<>!:])=(?![=>])").search(source.bare, m.end(), end)
            end = m.start() if m else end
        elif source.language == "csharp" and (m := re.compile(r"=>").search(source.bare, s.start, end)) and "(" in source.bare[s.start : m.start()]:
            end = m.start()
        elif source.language in ("ruby", "lua"):
            body = re.compile(r"[^\s;]").search(source.bare, s.open, s.close)
            empty = body and re.compile(r"end\b").match(source.bare, body.start()) and body.start() + 3 >= s.close
            end = s.close if empty else s.open
        cut = [a for a, _ in source.comments if s.start < a < end]
        return bare_header(source.text[s.start : min([*cut, end])])

    def inner(self, s: Statement) -> tuple[int, int]:
        return (s.open, s.close - 3) if self.source.language in ("ruby", "lua") else (s.open + 1, s.close - 1)

    in_class = False

    def has_members(self, s: Statement, name: str, in_class: bool) -> bool:
        if s.open < 0:
            return False
        was, self.in_class = self.in_class, in_class
        found = False
        for x in self.parts(self.source, *self.inner(s)):
            if isinstance(x, Statement) and (d := self.declaration(self.trimmed(x), name + ".")) and d.shape != "scope":
                found = True
                break
        self.in_class = was
        return found

    def trimmed(self, s: Statement) -> Statement:
        """A member of a C++ class without the access label before it."""
        if self.source.language == "cpp" and (m := re.compile(r"(?:(?:public|private|protected)\s*:\s*)+").match(self.source.bare, s.start, s.end)):
            return Statement(m.end(), s.end, s.open, s.close)
        return s

    def read(self, a: int, b: int, prefix: str = "", in_class: bool = False) -> list[dict]:
        source, docs = self.source, Docs(self.source, self.prose)
        self.in_class = in_class
        for s in self.parts(source, a, b):
            if not isinstance(s, Statement):
                docs.offer(s)
                continue
            member = self.trimmed(s)
            if member.start != s.start:  # comments between the label and the member are inside what was one statement
                docs.group = [c for c in source.comments if s.start < c[0] < member.start]
            s = member
            self.in_class = in_class
            d, doc = self.declaration(s, prefix), docs.take(s.start)
            if not d:
                continue
            name = prefix + d.name
            classlike = d.variant in ("class", "struct")
            members = d.shape in ("members", "scope") and self.has_members(s, d.name, classlike)
            if d.shape == "scope":
                if members:
                    self.read(*self.inner(s), d.name + ".", True)
                continue
            shown = d.shape == "header" or members
            end = s.close if source.language in ("c", "cpp") and s.open >= 0 and d.part != "type" else s.end
            self.chunks.add(d.part, name, name, d.variant, self.head(s) if shown else whole(source.text[s.start : end]), doc, source.row(s.start))
            closed = d.part == "enum" and source.language in ("java", "php")  # their members are not reached
            if members and not closed:
                self.read(*self.inner(s), name + ".", classlike)
        return self.chunks.out


def read_table(source: Source) -> list[dict]:
    return TableReader(source).read(0, len(source.text))


def read_go(source: Source) -> list[dict]:
    """Package documentation, types, functions, methods, and documented constants and variables."""
    bare, text = source.bare, source.text
    package = re.search(r"^[ \t]*package\s+(\w+)", bare, re.M)
    if not package:
        return []
    chunks, docs, named = Chunks(source, "go"), Docs(source, prose("//")), False

    def add(part: str, name: str, variant: str, signature: str, doc: str, at: int) -> None:
        chunks.add(part, name, f"{package[1]} > {name}", variant, signature, doc, source.row(at))

    for s in statements(source, 0, len(text)):
        if not isinstance(s, Statement):
            docs.offer(s)
            continue
        doc, found = docs.take(s.start), bare[s.start : s.end]
        head = text[s.start : s.open if s.open >= 0 else s.end]
        if re.match(r"package\b", found):
            if doc and not named:
                crumb = f"package {package[1]}"
                chunks.add("package", "", crumb, "package", "", doc, source.row(s.start))
            named = True
        elif m := re.match(r"func\s+(\w+)", found):
            add("func", m[1], "func", header(_go_head(source, s)), doc, s.start)
        elif m := re.match(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(?:\w+\.)?(\w+)[^)]*\)\s*(\w+)", found):
            add("method", f"{m[1]}.{m[2]}", "method", header(_go_head(source, s)), doc, s.start)
        elif m := re.match(r"type\s*(\()?", found):
            if m[1]:
                inside = s.start + m.start(1)
                specs = [x for x in statements(source, inside + 1, closing(bare, inside, s.end) - 1) if isinstance(x, Statement)]
            else:
                specs = [Statement(s.start + m.end(), s.end)]
            for x in specs:
                n = re.match(r"(\w+)(\[[^\]]*\])?\s*=?\s*", bare[x.start : x.end])
                if n:
                    shown = f"type {n[1]} " + whole(text[x.start + n.end() : x.end]) if len(specs) > 1 else whole(text[s.start : s.end])
                    add("type", n[1], "type", shown, doc, x.start)
        elif (m := re.match(r"(const|var)\s*(\()?\s*(\w+)", found)) and doc and m[3] != "_" and not (m[2] and m[1] == "var"):
            add(m[1], m[3], "value", whole(head if s.open < 0 else text[s.start : s.end]), doc, s.start)
    return chunks.out


def _go_head(source: Source, s: Statement) -> str:
    """A function up to its body: the last block of its line, as results may hold blocks of types."""
    at, body = s.start, s.end
    for m in re.compile(r"[({\[]").finditer(source.bare, s.start, s.end):
        if m.start() < at:
            continue
        at = closing(source.bare, m.start(), s.end)
        if m[0] == "{" and not re.search(r"\b(?:struct|interface)\s*\Z", source.bare[s.start : m.start()]):
            body = m.start()
            break
    return source.text[s.start : body]


FUNCTION = re.compile(r"(?:async\s+)?function\b|(?:async\s*)?(?:<[^>]*>\s*)?(?:\w+|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)(?:\s*:\s*(?:[^=;{]|=(?!>))+?)?)\s*=>", re.S)


class ScriptReader:
    """TypeScript and JavaScript: only comments of documentation count, whatever lies between them and a declaration."""

    def __init__(self, source: Source):
        self.source, self.bare, self.text = source, source.bare, source.text
        self.chunks = Chunks(source, "ts", "#", 2)

    def doc(self, span: tuple[int, int]) -> str:
        raw = self.text[slice(*span)]
        return "\n".join(x for x in block_prose("/*" + raw.removeprefix("/**"))).strip() if raw.startswith("/**") else ""

    def add(self, part: str, name: str, variant: str, signature: str, doc: str, at: int) -> None:
        self.chunks.add(part, name, name, variant, signature, doc, self.source.row(at))

    def read_file(self) -> list[dict]:
        parts = [x for x in statements(self.source, 0, len(self.text)) if isinstance(x, Statement) or not self.text.startswith("#!", x[0])]
        prologue = lambda x: isinstance(x, Statement) and bool(re.fullmatch(r"([\"']) *\1;?", self.bare[x.start : x.end]))
        first = next((i for i, x in enumerate(parts) if not prologue(x)), len(parts))
        if first < len(parts) and not isinstance(parts[first], Statement) and (doc := self.doc(parts[first])):
            after = parts[first + 1] if first + 1 < len(parts) else None
            if not isinstance(after, Statement) or prologue(after) or self.undeclared(after):
                self.chunks.add("file", "", "file", "file", "", doc, self.source.row(parts[first][0]))
        self.read(0, len(self.text), "")
        return self.chunks.out

    def undeclared(self, s: Statement) -> bool:
        """An import, or an export that declares nothing."""
        found = self.bare[s.start : s.end]
        return bool(re.match(r"import\b(?!\s*\()", found)) or bool(re.match(r"export\b", found)) and not re.match(self.DECLARES, found)

    DECLARES = re.compile(r"export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+class|async\s+function|class|function|interface|enum|const|let|var|namespace|module)\b|export\s+(?:declare\s+)?type\s+[\w$]+\s*[=<]|export\s+(?:default\s+)?@")

    def read(self, a: int, b: int, prefix: str) -> None:
        doc = ""
        for s in statements(self.source, a, b):
            if not isinstance(s, Statement):
                doc = self.doc(s)
                continue
            start = s.start
            m = re.compile(r"(?:@[\w.]+(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*)+").match(self.bare, start, s.end)
            start = m.end() if m else start
            if start >= s.end:
                continue  # a decorator on lines of its own
            if m := re.compile(r"export\s+(?:default\s+)?(?:@[\w.]+(?:\([^()]*\))?\s*)*").match(self.bare, start, s.end):
                if not self.DECLARES.match(self.bare, start, s.end):
                    doc = ""
                    continue
                start = m.end()
            self.declare(Statement(start, s.end, s.open, s.close), prefix, doc)
            doc = ""

    def declare(self, s: Statement, prefix: str, doc: str) -> None:
        found = self.bare[s.start : s.end]
        head = lambda: header(self.text[s.start : s.open if s.open >= 0 else s.end])
        if m := re.match(r"(?:async\s+)?function\b\s*\*?\s*([\w$]+)", found):
            body = self.body(s)
            if body >= 0:
                self.add("func", prefix + m[1], "func", header(self.text[s.start : body]), doc, s.start)
        elif m := re.match(r"(?:abstract\s+)?class\s+([\w$]+)", found):
            self.add("class", prefix + m[1], "class", head(), doc, s.start)
            if s.open >= 0:
                self.members(s.open + 1, s.close - 1, prefix + m[1])
        elif m := re.match(r"(?:(interface)|(type)(?=\s+[\w$]+\s*[=<])|(?:const\s+)?(enum))\s+([\w$]+)", found):
            kind = m[1] or m[2] or m[3]
            self.add(kind, prefix + m[4], kind, whole(self.text[s.start : s.end]), doc, s.start)
        elif m := re.match(r"(const|let|var)\b", found):
            self.values(Statement(s.start + m.end(), s.end), m[1], prefix, doc)
        elif (m := re.match(r"(?:namespace|module)\s+([\w$.]+)", found)) and s.open >= 0:
            self.read(s.open + 1, s.close - 1, f"{prefix}{m[1]}.")
        elif m := re.match(r"(module\s*\.\s*exports)\s*=(?!=)\s*", found):
            if found.startswith("{", m.end()):
                self.exports(s.start + m.end(), s.end, prefix)
        elif m := re.match(r"(?:module\s*\.\s*)?exports\s*\.\s*([\w$]+)\s*=(?!=)\s*", found):
            self.assigned("value", prefix + m[1], self.text[s.start : s.start + m.end()], s.start + m.end(), s.end, s.start, doc)

    def body(self, s: Statement) -> int:
        """Where the body of a function begins: the block behind its parameters and type; -1 without one."""
        at = self.bare.find("(", s.start, s.end)
        at = closing(self.bare, at, s.end) if at >= 0 else s.start
        while m := re.compile(r"[{;]").search(self.bare, at, s.end):
            if m[0] == ";":
                return -1
            before = self.bare[at : m.start()].rstrip()
            if before.endswith((":", "|", "&", "<", ",", "=>")):  # a type in braces
                at = closing(self.bare, m.start(), s.end)
                continue
            return m.start()
        return -1

    def function_end(self, at: int, limit: int) -> int | None:
        """Where the body of a function value begins, if one lies at a place."""
        m = FUNCTION.match(self.bare, at, limit)
        if not m:
            return None
        if re.match(r"(?:async\s+)?function\b", m[0]):
            body = self.body(Statement(at, limit))
            return body if body >= 0 else limit
        after = re.compile(r"\s*").match(self.bare, m.end(), limit).end()
        return after if after < limit else m.end()

    def assigned(self, part: str, name: str, target: str, at: int, end: int, start: int, doc: str) -> None:
        """A function or documented value that is given to a target."""
        body = self.function_end(at, end)
        if body is not None:
            self.add("func", name, "func", header(target + self.text[at:body]), doc, start)
        elif doc.strip():
            value = one_line(self.text[at:end].rstrip().rstrip(";"))
            head = header(target)
            shown = head.rstrip("= ") if len(value.encode()) > VALUE_LIMIT else f"{head} {value}"
            self.add(part, name, "value", shown, doc, start)

    def values(self, s: Statement, keyword: str, prefix: str, doc: str) -> None:
        at = s.start
        while at < s.end:
            m = re.compile(r"[\s,]*([\w$]+)").match(self.bare, at, s.end)
            end = self.comma(at if not m else m.end(), s.end)
            if m:
                start = m.start(1)
                eq = re.compile(r"(?<![=<>!])=(?![=>])\s*").search(self.bare, m.end(), end)
                if eq:
                    self.assigned(keyword, prefix + m[1], f"{keyword} {self.text[start : eq.end()]}", eq.end(), end, start, doc)
                elif doc.strip():
                    self.add(keyword, prefix + m[1], "value", header(f"{keyword} {self.text[start:end].rstrip().rstrip(';')}"), doc, start)
            at = end + 1

    def comma(self, at: int, limit: int) -> int:
        """The next comma outside brackets."""
        while m := re.compile(r"[,({\[]").search(self.bare, at, limit):
            if m[0] == ",":
                return m.start()
            at = closing(self.bare, m.start(), limit)
        return limit

    def exports(self, at: int, limit: int, prefix: str) -> None:
        """The functions of an object of exports."""
        end, doc = closing(self.bare, at, limit) - 1, ""
        at += 1
        while at < end:
            stop = self.comma(at, end)
            for c in self.source.comments:
                if at <= c[0] < stop and not self.bare[at : c[0]].strip():
                    doc = self.doc(c)
            if m := re.compile(r"\s*([\w$\"']+|\[[^\]]*\])\s*:\s*").match(self.bare, at, stop):
                key, body = self.text[slice(*m.span(1))], self.function_end(m.end(), stop)
                if body is not None:
                    self.add("func", prefix + key, "func", header(self.text[m.start(1) : body]), doc, m.start(1))
            at, doc = stop + 1, ""

    def members(self, a: int, b: int, owner: str) -> None:
        doc = ""
        for s in statements(self.source, a, b):
            if not isinstance(s, Statement):
                doc = self.doc(s)
                continue
            m = re.compile(r"(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*)+").match(self.bare, s.start, s.end)
            start = m.end() if m else s.start
            if start >= s.end:
                continue
            m = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|accessor|get|set)\s+(?=[\w$#*\[\"']))*\*?\s*([#\w$]+|\[[^\]]*\]|\"[^\"]*\"|'[^']*')[?!]?\s*").match(self.bare, start, s.end)
            if m:
                name, after = f"{owner}.{self.text[slice(*m.span(1))]}", self.bare[m.end() : m.end() + 1]
                eq = re.compile(r"(?<![=<>!])=(?![=>])\s*").search(self.bare, m.end(), s.end)
                if after in ("(", "<"):
                    body = self.body(Statement(m.end(), s.end))
                    signature = self.text[start : body if body >= 0 else s.end]
                    self.add("method", name, "method", header(signature if body >= 0 else signature.rstrip().rstrip(";")), doc, start)
                elif eq and (body := self.function_end(eq.end(), s.end)) is not None:
                    self.add("method", name, "method", header(self.text[start:body]), doc, start)
            doc = ""


def read_python(text: str) -> list[dict]:
    """Module documentation, classes, functions and methods, and documented constants of a module."""
    chunks = Chunks(None, "py")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _python_lines(text, chunks)
    raw = text.encode()
    begins = [0]
    for line in raw.split(b"\n"):
        begins.append(begins[-1] + len(line) + 1)
    offset = lambda line, column: begins[line - 1] + column
    comments = []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            comments.append((t.start[0], len(t.line[: t.start[1]].encode()), t.string))
    cut = lambda a, b: raw[a:b].decode("utf-8", "replace")

    def documented(statement: ast.stmt | None) -> str:
        """The text of a statement that is only a string."""
        is_text = isinstance(statement, ast.Expr) and (isinstance(statement.value, ast.Constant) and isinstance(statement.value.value, str) or isinstance(statement.value, ast.JoinedStr))
        if not is_text:
            return ""
        found = cut(offset(statement.lineno, statement.col_offset), offset(statement.end_lineno, statement.end_col_offset))
        m = re.fullmatch(r"[rRbBuUfF]*(\"\"\"|'''|\"|')(.*)\1", found, re.S)
        return "\n".join(x.strip() for x in m[2].split("\n")).strip() if m else ""

    def above(low: tuple[int, int], first: int) -> str:
        """The group of comments behind a place that ends on the line above another."""
        group: list[tuple[int, str]] = []
        for line, column, said in comments:
            if (line, column) >= low and line < first:
                group = [*group, (line, said)] if group and line - group[-1][0] <= 1 else [(line, said)]
        if not group or first - group[-1][0] > 1:
            return ""
        return "\n".join(x for _, said in group for x in prose("#")(said)).strip()

    def visit(body: list[ast.stmt], names: str, low: tuple[int, int]) -> None:
        pending = None
        for node in body:
            decorated = [d.lineno for d in getattr(node, "decorator_list", [])]
            first = min([node.lineno, *decorated])
            if pending is not None and (said := documented(node)):
                target = pending.targets[0] if isinstance(pending, ast.Assign) else pending.target
                name = cut(offset(target.lineno, target.col_offset), offset(target.end_lineno, target.end_col_offset))
                if not name.startswith("_"):
                    shown = cut(offset(pending.lineno, pending.col_offset), offset(pending.end_lineno, pending.end_col_offset))
                    chunks.add("const", name, name, "value", one_line(shown), said, pending.lineno - 1)
                pending, low = None, (node.end_lineno, node.end_col_offset)
                continue
            pending = node if isinstance(node, ast.Assign | ast.AnnAssign) and not names else None
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class, inner = isinstance(node, ast.ClassDef), node.body[0]
                opened = min([inner.lineno, *(d.lineno for d in getattr(inner, "decorator_list", []))])
                column = inner.col_offset if opened == inner.lineno else next(d.col_offset - 1 for d in inner.decorator_list if d.lineno == opened)
                start = min([offset(node.lineno, node.col_offset), *(offset(d.lineno, d.col_offset) - 1 for d in node.decorator_list)])
                shown = header(cut(start, offset(opened, column))).rstrip(":")
                part = "class" if is_class else "method" if names else "func"
                chunks.add(part, names + node.name, names + node.name, part, shown, documented(inner) or above(low, first), first - 1)
                if is_class:
                    visit(node.body, f"{names}{node.name}.", (node.lineno, node.col_offset))
            low = (node.end_lineno, node.end_col_offset)

    if tree.body and (said := documented(tree.body[0])):
        chunks.add("module", "", "module", "package", "", said, 0)
    visit(tree.body, "", (0, 0))
    return chunks.out


def _python_lines(text: str, chunks: Chunks) -> list[dict]:
    """What a text that is no valid Python still says: its classes and functions by line, members by indentation."""
    held: list[tuple[int, str]] = []
    for m in re.finditer(r"^([ \t]*)(?:(class)|(?:async[ \t]+)?def)[ \t]+(\w+)[^\n]*", text, re.M):
        held = [h for h in held if h[0] < len(m[1])]
        if held and not held[-1][1]:
            continue
        names = held[-1][1] + "." if held else ""
        part = "class" if m[2] else "method" if names else "func"
        chunks.add(part, names + m[3], names + m[3], part, header(m[0]).rstrip(":"), "", text.count("\n", 0, m.start()))
        held.append((len(m[1]), names + m[3] if m[2] else ""))
    return chunks.out


def read_protobuf(source: Source) -> list[dict]:
    """Messages and enums whole, services as headers, and their calls."""
    bare, text, chunks = source.bare, source.text, Chunks(source, "proto")
    package = ""

    def read(a: int, b: int, prefix: str) -> None:
        nonlocal package
        docs = Docs(source, prose("//"))
        for s in statements(source, a, b):
            if not isinstance(s, Statement):
                docs.offer(s)
                continue
            doc, found = docs.take(s.start), bare[s.start : s.end]
            if m := re.match(r"package\s+([\w.]+)", found):
                package = m[1]
            elif m := re.match(r"(message|enum|service|rpc)\s+(\w+)", found):
                kind, name = m[1], prefix + m[2]
                shown = whole(text[s.start : s.end])
                if kind == "service" and s.open >= 0:
                    first = re.compile(r"\brpc\b").search(bare, s.open, s.close)
                    stops = [first.start() if first else s.close, *(c for c, _ in source.comments if s.open < c < s.close)]
                    shown = bare_header(text[s.start : min(stops)])
                chunks.add(kind, name, f"{package} > {name}" if package else name, kind, shown, doc, source.row(s.start))
                if kind in ("message", "service") and s.open >= 0:
                    read(s.open + 1, s.close - 1, name + ".")

    read(0, len(text), "")
    return chunks.out


def read_hcl(source: Source) -> list[dict]:
    """Blocks by type and labels; those in blocks by the names of what holds them."""
    bare, text, chunks = source.bare, source.text, Chunks(source, "hcl")
    is_block = re.compile(r"[\w-]+(?:[ \t]+(?:\"[^\"\n]*\"|[\w-]+))*[ \t]*\Z")

    def read(a: int, b: int, prefix: str) -> None:
        docs = Docs(source, prose("#", "//"))
        for s in statements(source, a, b):
            if not isinstance(s, Statement):
                docs.offer(s)
                continue
            doc = docs.take(s.start)
            if s.open >= 0 and is_block.match(bare[s.start : s.open]):
                name = prefix + ".".join(x.strip('"') for x in re.findall(r'"[^"\n]*"|[\w-]+', text[s.start : s.open]))
                chunks.add("block", name, name, "block", whole(text[s.start : s.end]), doc, source.row(s.start))
                read(s.open + 1, s.close - 1, name + ".")

    read(0, len(text), "")
    return chunks.out


def read_yaml(text: str) -> list[dict]:
    """Documents, named by kind and name, and their keys that hold more than a scalar."""
    import yaml

    try:
        documents = [d for d in yaml.compose_all(text, Loader=yaml.SafeLoader) if d is not None]
    except (yaml.YAMLError, ValueError):
        return []
    chunks, nested = Chunks(None, "yaml"), (yaml.MappingNode, yaml.SequenceNode)
    lines = text.split("\n")

    def end(node) -> int:
        if isinstance(node, yaml.ScalarNode) or node.flow_style or not node.value:
            return node.end_mark.index
        last = node.value[-1]
        return end(last[1] if isinstance(last, tuple) else last)

    def blocks(node) -> Iterator:
        """Block mappings and sequences in a node, the shallowest first."""
        queue = [node]
        while queue:
            n = queue.pop(0)
            if isinstance(n, nested):
                if not n.flow_style:
                    yield n
                queue += [x for v in n.value for x in (v if isinstance(v, tuple) else (v,))]

    def scalar(node) -> str:
        return "" if any(True for _ in blocks(node)) else text[node.start_mark.index : end(node)].strip().strip("\"'")

    def comments(first: int, least: int) -> str:
        """The comments directly above a line."""
        group = []
        while first - 1 >= least and lines[first - 1].lstrip().startswith("#"):
            first -= 1
            group.insert(0, lines[first].strip())
        return "\n".join(x for raw in group for x in prose("#")(raw)).strip()

    least = 0
    for i, node in enumerate(documents):
        mapping = next((n for n in blocks(node) if isinstance(n, yaml.MappingNode)), None)
        name = f"doc{i}"
        if mapping:
            top = {k: scalar(v) for a, v in mapping.value if (k := scalar(a))}
            inner = next((n for a, v in mapping.value if scalar(a) == "metadata" for n in blocks(v) if isinstance(n, yaml.MappingNode)), None)
            own = top.get("name") or (next((scalar(v) for a, v in inner.value if scalar(a) == "name"), "") if inner else "")
            name = "/".join(x for x in (top.get("kind"), own) if x) or name
        crumb = "" if name == f"doc{i}" else name
        at = node.start_mark
        row = at.line - (at.line > least and i > 0 and lines[at.line - 1].strip() == "---")
        chunks.add("doc", name, crumb or "document", "document", whole(text[at.index : end(node)]), comments(row, least), row)
        for k, (a, v) in enumerate(mapping.value if mapping else []):
            if (key := scalar(a)) and any(True for _ in blocks(v)):
                said = comments(a.start_mark.line, at.line) if k else ""
                chunks.add("key", f"{name}.{key}", f"{crumb} > {key}" if crumb else key, "section", whole(text[a.start_mark.index : end(v)]), said, a.start_mark.line)
        least = text.count("\n", 0, end(node)) + 1
    return chunks.out


def read_bash(source: Source) -> list[dict]:
    """The comment a script begins with, its functions, and documented variables."""
    bare, text, chunks, docs = source.bare, source.text, Chunks(source, "sh"), Docs(source, script_prose)
    lead: list[tuple[int, int]] = []
    for c in source.comments:
        if bare[: c[0]].strip() or lead and source.row(c[0]) - source.row(lead[-1][1]) > 1:
            break
        lead.append(c)
    said = "\n".join(x for a, b in lead for x in script_prose(text[a:b])).strip()
    if said:
        chunks.add("header", "", "script", "package", "", said, 0)
    word = re.compile(r"[{}()]|\b(?:if|case|do|fi|esac|done)\b|\n|;")
    comments, at = list(source.comments), 0
    while at < len(text):
        m = re.compile(r"[^\s;]").search(bare, at)
        start = m.start() if m else len(text)
        while comments and comments[0][0] < at:
            comments.pop(0)
        if comments and comments[0][0] < start:
            docs.offer(comments[0])
            at = comments[0][1]
            continue
        if not m:
            break
        doc, depth, end = docs.take(start), 0, len(text)
        for w in word.finditer(bare, start):
            if w[0] in "{(" or w[0] in ("if", "case", "do"):
                depth += 1
            elif w[0] in "})" or w[0] in ("fi", "esac", "done"):
                depth = max(0, depth - 1)
            elif depth == 0 and not (w[0] == "\n" and re.search(r"(?:\\|\|\|?|&&|\(\)\s*)\Z", bare[start : w.start()])):
                end = w.start()
                break
        if f := re.compile(r"(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*[{(]").match(bare, start, end):
            name = f[1] or f[2]
            chunks.add("func", name, name, "func", name + "()", doc, source.row(start))
        elif doc and (v := re.compile(r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=\S*\s*\Z").match(bare, start, end)):
            chunks.add("var", v[1], v[1], "value", one_line(text[start:end]), doc, source.row(start))
        elif doc and (v := re.compile(r"([A-Za-z_]\w*)=[\"'(]").match(bare, start, end)):
            chunks.add("var", v[1], v[1], "value", one_line(text[start:end]), doc, source.row(start))
        at = max(end, start + 1)
    return chunks.out


READERS = {
    "go": read_go, "typescript": lambda s: ScriptReader(s).read_file(), "javascript": lambda s: ScriptReader(s).read_file(),
    "protobuf": read_protobuf, "hcl": read_hcl, "bash": read_bash,
}
TEXT_READERS = {"markdown": chunk_markdown, "python": read_python, "yaml": read_yaml}


def chunk_code(content: str, language: str) -> list[dict]:
    """Chunks (chunk_key, heading, variant, text, line) of a source file; none if it is blank or the language is unknown."""
    if not content.strip():
        return []
    if language in TEXT_READERS:
        return TEXT_READERS[language](content)
    if language in READERS or language in TABLES:
        return READERS.get(language, read_table)(Source(content, language))
    return []


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunk rows of files (rel_path, content), each by the language of its extension; markdown included."""

    def make(path: str, content: str) -> list[dict]:
        ext = re.search(r"\.[^./]*$", path)
        return chunk_code(content, LANGUAGE_OF.get(ext[0].lower(), "") if ext else "")

    return _over(files, make, CHUNK)
