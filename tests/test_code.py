"""Chunks of source files: keys, kinds, headings, and what of a declaration is shown."""

import pytest

from lodestone.plans.fixtures import SOURCES
from lodestone.sources.code import chunk_code


def chunks(language, source):
    found = chunk_code(source, language)
    assert len({c["chunk_key"] for c in found}) == len(found) and all(c["text"].startswith(c["heading"]) and c["line"] >= 1 for c in found)
    return {c["chunk_key"]: c for c in found}


def shown(language, source):
    """(key, variant, heading, the text below the heading) of every chunk."""
    return [(c["chunk_key"], c["variant"], c["heading"], c["text"].removeprefix(c["heading"]).strip()) for c in chunks(language, source).values()]


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_chunks(language):
    source, want = SOURCES[language]
    assert [(*x, c["line"]) for x, c in zip(shown(language, source), chunks(language, source).values(), strict=True)] == want


def test_what_is_not_source():
    assert chunk_code("this is no go {{{", "go") == chunk_code("package bare\n", "go") == []
    assert chunk_code("", "typescript") == chunk_code("// only a remark\n", "typescript") == chunk_code("x", "cobol") == []
    assert [x[0] for x in shown("python", "class A:\n  def b(self):\n    return (\ndef c(: pass\n")] == ["py/class/A", "py/method/A.b", "py/func/c"]


def test_javascript():
    tsx = "/** Button draws. */\nexport function Button(props: Props) {\n  return <button onClick={props.go}>{props.label}</button>;\n}"
    assert shown("typescript", tsx) == [("ts/func/Button", "func", "Button", "function Button(props: Props)\n\nButton draws.")]
    assert [x[0] for x in shown("javascript", "function sub(a, b) { return a - b; }\nmodule.exports = { sub, inline: (a, b) => a / b };")] == ["ts/func/sub", "ts/func/inline"]
    long = "/** Much. */\nconst many = [" + "1, " * 50 + "];"
    assert shown("javascript", long) == [("ts/const/many", "value", "many", "const many\n\nMuch.")]


@pytest.mark.parametrize(
    "source",
    [
        '/**\n * A store.\n *\n * Writes once.\n */\nimport { open } from "node:fs";\n\n/** put writes. */\nexport function put(id: string): void {}\n', "/** A thing. */\nexport {};\n", "/** A thing. */\n",
        "/** A thing. */\n\n/** put. */\nexport function put(): void {}\n", '"use client";\n\n/** A thing. */\nimport { open } from "fs";\n', '/** A thing. */\n"use client";\n',
        '#!/usr/bin/env node\n/** A thing. */\nimport { open } from "fs";\n', '/** A thing. */\nexport * from "./thing";\n',
    ],
)
def test_what_a_file_says_of_itself(source):
    assert chunks("typescript", source)["ts/file"]["variant"] == "file"


def test_documented_declarations_are_not_about_the_file():
    assert [x[0] for x in shown("typescript", "/** put writes. */\nexport function put(): void {}\n")] == ["ts/func/put"]
    assert chunk_code('// notes\nimport { open } from "fs";\n', "typescript") == []


LANGUAGES = "go typescript javascript python java csharp rust c cpp ruby php scala lua protobuf hcl yaml bash markdown".split()


@pytest.mark.parametrize("language", LANGUAGES)
def test_anything_is_read_without_error(language):
    for source in ("", "   \n\n", "\x00\x01\x02", "}{)(][", "nope " * 500, "{" * 50 + "(" * 50, "/* open", '"open', "class", "def", "a: [", "\ufeffx"):
        assert all(c["chunk_key"] for c in chunk_code(source, language))
