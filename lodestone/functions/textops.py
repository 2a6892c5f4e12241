"""Markdown text and heading functions as columns, so that they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension, and other names a language goes by.
EXTENSIONS = {
    "markdown": ["md", "markdown"],
    "go": ["go"],
    "typescript": ["ts", "mts", "cts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
    "java": ["java"],
    "csharp": ["cs"],
    "rust": ["rs"],
    "c": ["c"],
    "cpp": ["cc", "cpp", "cxx", "h", "hpp", "hh"],
    "ruby": ["rb"],
    "php": ["php"],
    "scala": ["scala", "sc"],
    "lua": ["lua"],
    "protobuf": ["proto"],
    "hcl": ["tf", "tfvars", "hcl"],
    "yaml": ["yaml", "yml"],
    "bash": ["sh", "bash"],
}
ALIASES = {
    "cpp": ["c++", "cplusplus"],
    "csharp": ["c#", "cs"],
    "go": ["golang"],
    "javascript": ["js"],
    "typescript": ["ts", "tsx"],
    "python": ["py"],
    "rust": ["rs"],
    "ruby": ["rb"],
    "markdown": ["md"],
    "protobuf": ["proto"],
    "hcl": ["terraform", "tf"],
    "yaml": ["yml", "kubernetes", "k8s"],
    "bash": ["sh", "shell"],
}
# What is rewritten before a text is embedded or shown, in this order: a generated list of contents, other
# comments, images and links as their text, wiki links as their label, runs of blank lines.
SIMPLIFY = [
    (r"(?is)<!--[\t\n\f\r ]*toc[\t\n\f\r ]*-->.*?<!--[\t\n\f\r ]*tocstop[\t\n\f\r ]*-->", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[\[(?:[^\]|]+\|(?=[^\]]+\]\])|(?=[^\]|]+\]\]))([^\]]+)\]\]", "$1"),
    (r"\n{3,}", "\n\n"),
]
LANGUAGE_OF = {"." + e: k for k, names in EXTENSIONS.items() for e in names}
ALIAS_OF = {a: k for k, names in ALIASES.items() for a in names}


def language(name: str) -> str:
    """The canonical name of a language given by name or alias, in any case, with or without a dot before it."""
    key = name.strip().lower().removeprefix(".")
    found = ALIAS_OF.get(key, key)
    if found not in EXTENSIONS:
        raise ValueError(f"unknown language {name!r}; known: {', '.join(sorted(EXTENSIONS))}")
    return found


def extension(path: Column) -> Column:
    """The extension of a path with its dot, as written; empty if there is none."""
    base = F.substring_index(path, "/", -1)
    return F.when(base.contains("."), F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise(F.lit(""))


def lang_of_path(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return table[F.lower(extension(path))]


def is_markdown(path: Column) -> Column:
    lower = F.lower(path)
    return lower.endswith(".md") | lower.endswith(".markdown")


def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")


def simplify(text: Column) -> Column:
    """Markdown reduced to what is read: no generated contents, no comments, links as their text."""
    for pattern, into in SIMPLIFY:
        text = F.regexp_replace(text, pattern, into)
    return text


def slugify(heading: Column) -> Column:
    """A heading as a key: runs of other than a-z and 0-9 become a dash, none at the ends; then cut to 60 characters."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", F.lit("section")).otherwise(F.substring(dashed, 1, 60))


def anchor_slug(heading: Column) -> Column:
    """The fragment that a link to a heading uses: every space is a dash, those at the ends too."""
    return F.when(heading == "", heading).otherwise(F.translate(F.regexp_replace(F.lower(heading), "[^a-z0-9_ -]", ""), " ", "-"))


def heading_leaf(breadcrumb: Column) -> Column:
    """The last heading of a breadcrumb, without its marks."""
    last = F.element_at(F.split(breadcrumb, " > "), -1)
    return trim_space(F.regexp_replace(last, "^#+", ""))


def is_contents(heading: Column) -> Column:
    return F.lower(trim_space(heading)).isin("contents", "table of contents")
