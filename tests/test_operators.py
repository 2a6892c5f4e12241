import numpy as np
import pytest

from lodestone.functions import pathops as P
from lodestone.functions import textops as T
from lodestone.functions import vectors as V
from lodestone.operators import dupes as D
from lodestone.operators import graph as G
from lodestone.operators import lint as L
from lodestone.operators import search as S
from lodestone.sources import markdown, walk
from lodestone.sources.store import Corpus
from lodestone.streaming.changes import apply_changes, current, maintain
from pyspark.sql import functions as F

CHUNK = "rel_path string, chunk_key string, heading string, variant string, text string, line int, vec array<float>"


def chunk(path, key, vec, heading="", variant="narrow"):
    return (path, key, heading, variant, key, 1, vec)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_search_ranks_collapses_and_promotes(spark):
    rows = [chunk("a.md", "p", [1.0, 0.0], "# D > ## R", "path"), chunk("a.md", "n", [0.8, 0.2], "# D > ## R"), chunk("a.md", "o", [0.9, 0.1], "# O"), chunk("b.go", "x", [0.7, 0.7]), chunk("c.md", "z", [])]
    df = spark.createDataFrame(rows, CHUNK)
    assert [r.chunk_key for r in S.search(df, [1.0, 0.0]).collect()] == ["n", "x", "z"]
    assert [r.chunk_key for r in S.search(df, [1.0, 0.0], collapsed=False, limit=2).collect()] == ["p", "o"]
    assert [r.rel_path for r in S.search(df, [1.0, 0.0], kind="code", langs=["golang"]).collect()] == ["b.go"]
    assert S.search(df.limit(0), [1.0]).count() == 0
    with pytest.raises(ValueError):
        S.search(df, [])
    with pytest.raises(ValueError):
        S.search(df, [1.0], langs=["cobol"]).count()


def test_cosine_has_a_value_everywhere(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(a(1, 0), a(2, 0))) == 1
    assert one(spark, V.cosine(a(1, 0), a(-1, 0))) == -1
    assert one(spark, V.cosine(a(0, 0), a(1, 0))) == 0
    assert one(spark, V.cosine(a(1), a(1, 0))) == 0


def test_dupes_blocked_and_in_one_block(spark):
    rows = [chunk("b.md", "1", [1.0, 0.0]), chunk("a.md", "1", [1.0, 0.0]), chunk("a.md", "2", [1.0, 0.01]), chunk("c.md", "1", [0.0, 1.0]), chunk("d.md", "t", [1.0, 0.0], variant="path")]
    df = spark.createDataFrame(rows, CHUNK)
    ends = lambda d: [(r.a_path, r.a_key, r.b_path, r.b_key) for r in d.collect()]
    assert ends(D.dupes(df)) == [("a.md", "1", "b.md", "1"), ("a.md", "2", "b.md", "1")]
    assert len(ends(D.dupes(df, within_file=True))) == 3
    small = D.pairs_over(df.filter("variant = 'narrow'"), 0.9, True, block=1)
    assert sorted(ends(small)) == sorted(ends(D.dupes(df, within_file=True)))


def test_dupes_visit_only_what_they_can_reach(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    x = np.concatenate([c + rng.normal(size=(30, 8)) * 0.4 for c in centres])
    rows = [(f"f{i % 50}.md", f"{i:03}", v.tolist()) for i, v in enumerate(x)] + [("z.md", "zero", [0.0] * 8), ("z.md", "none", []), ("y.md", "short", [1.0, 2.0]), ("y.md", "twin", [2.0, 4.0])]
    df = spark.createDataFrame(rows, "rel_path string, chunk_key string, vec array<double>")
    for least in (0.95, 0.6, 0.0, -0.5):
        want = set()
        for i, (p, k, v) in enumerate(rows):
            for q, l, w in rows[:i]:
                size = np.linalg.norm(v) * np.linalg.norm(w)
                score = float(np.dot(v, w) / size) if len(v) == len(w) and size > 0 else 0.0
                if score >= least and abs(score - least) > 1e-9 or score == least == 0.0:
                    want.add(tuple(sorted([(p, k), (q, l)])))
        got = [((r.a_path, r.a_key), (r.b_path, r.b_key)) for r in D.pairs_over(df, least, True, block=16).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_paths(spark):
    for path, want in (("a/./b//../c", "a/c"), ("../../x", "../../x"), ("", "."), ("/..//a/", "/a"), ("a/..", ".")):
        assert one(spark, P.clean(F.lit(path))) == want
    assert one(spark, P.candidate(F.lit("docs/a.md"), F.lit("Dynamic%20Models.md"))) == "docs/Dynamic Models.md"
    assert one(spark, P.candidate(F.lit("docs/a.md"), F.lit("/x+%zz.md"))) == "x+%zz.md"
    assert one(spark, P.climb_depth(F.lit("../../a"))) == 2


def test_text(spark):
    assert one(spark, T.slugify(F.lit("Google Reviews: 3.2 / 5 · 198"))) == "google-reviews-3-2-5-198"
    assert one(spark, T.slugify(F.lit("a" * 59 + " b"))) == "a" * 59 + "-" == markdown.slugify("a" * 59 + " b") and one(spark, T.slugify(F.lit("··"))) == "section"
    assert one(spark, T.anchor_slug(F.lit("Alice & Bob"))) == "alice--bob" and one(spark, T.anchor_slug(F.lit(" x "))) == "-x-"
    assert one(spark, T.simplify(F.lit("[[a|b]] [[c]] ![i](x) [t](u)<!-- n -->"))) == "b c i t"
    assert T.language("C++") == "cpp" and T.language(".tsx") == "typescript"


LINK = "src_rel_path string, target string, anchor string, kind string, line int"


def test_graph(spark):
    files = spark.createDataFrame([(f,) for f in ("a.md", "docs/b.md", "docs/c.md", "docs/Dynamic Models.md", "lonely.md")], "rel_path string")
    rows = [("docs/c.md", "../a", "", "md", 1), ("a.md", "b", "", "wiki", 1), ("a.md", "docs/Dynamic%20Models.md", "x", "md", 2), ("a.md", "ghost.md", "", "md", 3), ("a.md", "docs", "", "md", 4), ("a.md", "d.png", "", "md", 5), ("a.md", "docs/c.md", "", "md", 6), ("a.md", "docs/c.md", "", "md", 6)]
    graph = G.edges(spark.createDataFrame(rows, LINK), files)
    to = {r.target: r.to for r in graph.collect()}
    assert to == {"../a": "a.md", "b": "docs/b.md", "docs/Dynamic%20Models.md": "docs/Dynamic Models.md", "ghost.md": None, "docs": None, "d.png": None, "docs/c.md": "docs/c.md"}
    assert graph.count() == len(rows)
    assert [r.rel_path for r in G.orphans(files, graph).collect()] == ["lonely.md"]
    assert [r.target for r in G.broken(graph, files).collect()] == ["ghost.md"]
    heads = spark.createDataFrame([("a.md", "x")], "rel_path string, slug string")
    assert G.broken_anchors(graph, heads).count() == 1
    assert [r.line for r in G.dot(graph).collect()].count('  "a.md" -> "docs/c.md";') == 2  # repeated edges stay
    assert one(spark, G.quoted(F.lit('a"b\\c'))) == '"a\\"b\\\\c"'
    assert G.stats(files, graph, heads).first().asDict() == {"files": 5, "markdown": 5, "edges": 8, "resolved": 5, "broken": 1, "broken_anchors": 1, "orphans": 1}


def test_lint_and_fixes(spark):
    files = spark.createDataFrame([("a.md",), ("x/s.go",), ("y/s.go",), ("pkg/run.go",)], "rel_path string")
    content = "`run.go` and [`run.go`](z) `s.go`\n`no.go`\n[deep](../../pkg/run.go)\n"
    links = markdown.markdown_links(spark.createDataFrame([("d/e/n.md", content)], "rel_path string, content string"))
    report = L.analyze(links, files, spark.createDataFrame([], "rel_path string, slug string"), "repo")
    assert sorted((r.category, r.target) for r in report.collect()) == [("ambiguous", "s.go"), ("broken", "no.go"), ("deep", "../../pkg/run.go"), ("unlinked", "run.go")]
    fixed = L.fixes(report, spark.createDataFrame([("d/e/n.md", content)], "rel_path string, content string"), "repo").first().fixed
    assert fixed.split("\n")[0] == "[`run.go`](/repo/pkg/run.go) and [`run.go`](z) `s.go`"
    assert fixed.split("\n")[2] == "[deep](/repo/pkg/run.go)"


def test_markdown():
    text = "---\ntitle: T\n---\n# A\n\n[x](b.md#s)\n```\n# no [n](n.md)\n```\n## B\n- # in list\n\nSet\n---\n[[W|l]] <!-- lodestone-ignore-next-line -->\n[gone](g.md)\n"
    keys = [c["chunk_key"] for c in markdown.chunk_markdown(text)]
    assert keys == ["title", "body/0/a/path", "body/0/a/narrow", "body/0/a/full", "body/1/b/path", "body/1/b/narrow", "body/2/set/path", "body/2/set/narrow"]
    assert [(x["target"], x["line"]) for x in markdown.links(text)] == [("b.md", 6), ("W", 15)]
    again = markdown.toc_rewrite(text)
    assert markdown.toc_rewrite(again) == again and markdown.toc_audit(again)["up_to_date"]
    assert markdown.chunk_markdown("") == [] and markdown.links("") == []


def test_markdown_lines_end_at_line_feeds():
    text = "# A\x0bb\u2028c\x1c\n\nx\x85y\n\n## \x0c\n\n## D\r\n"
    assert [(c["heading"], c["variant"], c["line"]) for c in markdown.chunk_markdown(text)] == [
        ("# A\x0bb\u2028c\x1c", "path", 1), ("# A\x0bb\u2028c\x1c", "narrow", 1), ("# A\x0bb\u2028c\x1c", "full", 1), ("# A\x0bb\u2028c\x1c > ## D", "path", 7)
    ]


def test_ignore_rules():
    rules = walk.IgnoreRules("build/\n*.tmp\n!keep.tmp\n/top\na/**/z\n")
    assert rules.ignores("x/build", True) and not rules.ignores("build", False) and rules.ignores("build/q", False)
    assert rules.ignores("d/a.tmp", False) and not rules.ignores("keep.tmp", False)
    assert rules.ignores("top", False) and not rules.ignores("d/top", False) and rules.ignores("a/b/c/z", False)


def test_corpus_sync(spark, tmp_path):
    (tmp_path / ".hid").mkdir()
    for name, text in (("a.md", "# A\n[b](b.md)\n"), (".hid/b.md", "# B\n"), ("x.py", "def f(): pass\n"), (".gitignore", "skip.md\n"), ("skip.md", "# S\n")):
        (tmp_path / name).write_text(text)
    corpus = Corpus(spark, str(tmp_path))
    assert corpus.sync()["added"] == 3 and corpus.sync()["unchanged"] == 3
    (tmp_path / "a.md").write_text("# A2 longer\n")
    (tmp_path / "x.py").unlink()
    done = corpus.sync()
    assert (done["updated"], done["deleted"], done["files"]) == (1, 1, 2)
    assert corpus.table("links").count() == 0 and not corpus.stale()
    with pytest.raises(ValueError):
        walk.inside(str(tmp_path), "../out.md")


def test_corpus_keeps_vectors_and_redoes_links_alone(spark, tmp_path, monkeypatch):
    from lodestone.sources import store

    for name, text in (("a.md", "# A\n\n[b](b.md)\n"), ("b.md", "# B\n")):
        (tmp_path / name).write_text(text)
    corpus = Corpus(spark, str(tmp_path))
    corpus.sync()
    seen = lambda: sorted((r.rel_path, r.chunk_key, tuple(r.vec)) for r in corpus.table("chunks").collect())
    before = seen()
    other = Corpus(spark, str(tmp_path), embed_id="other+d4")
    assert other.stale() == ["embed_id"] and not other.stale(embed=False) and "embedding model" in other.reason()
    assert other.sync(embed=False)["unchanged"] == 2 and seen() == before and corpus.manifest()["stamps"]["embed_id"] == "fake+d4"
    (tmp_path / "a.md").write_text("# A\n\n[b](b.md)\n\n## New\n\nwords\n")
    assert other.sync(embed=False)["updated"] == 1  # what stayed keeps its vector, the rest has none yet
    assert {k: len(v) for _, k, v in seen()}["body/0/a/path"] == 4 and {k: len(v) for _, k, v in seen()}["body/1/new/path"] == 0
    assert corpus.sync()["updated"] == 1 and all(len(v) == 4 for _, _, v in seen())
    monkeypatch.setitem(store.STAMPS, "link_version", 99)
    before, segments = seen(), corpus.table("files").select("chunk_seg").distinct().count()
    done = corpus.sync()
    assert (done["relinked"], done["updated"]) == (2, 0) and "link extraction" in done["reason"] and seen() == before
    assert corpus.table("links").count() == 1 and corpus.table("files").select("chunk_seg").distinct().count() == segments
    monkeypatch.setattr(store, "COMPACT", 2)
    assert corpus.sync()["unchanged"] == 2 and len(corpus.manifest()["segments"]) == 1 and seen() == before
    monkeypatch.setitem(store.STAMPS, "chunk_version", 99)
    assert corpus.sync(embed=False)["updated"] == 2 and seen() == before  # even rebuilt, equal texts keep their vectors


def test_corpus_of_the_first_layout(spark, tmp_path):
    import json

    (tmp_path / "a.md").write_text("# A\n\n[b](b.md)\n")
    corpus = Corpus(spark, str(tmp_path))
    corpus.sync()
    old, chunks = tmp_path / "old", corpus.table("chunks")
    before = sorted(map(str, chunks.collect()))
    chunks.write.parquet(str(old / "snap=3/chunks"))
    corpus.table("links").write.parquet(str(old / "snap=3/links"))
    corpus.table("files").drop("chunk_seg", "link_seg").write.parquet(str(old / "snap=3/files"))
    corpus.table("entries").write.parquet(str(old / "snap=3/entries"))
    stamps = corpus.manifest()["stamps"]
    (old / "manifest.json").write_text(json.dumps({"snapshot": 3, "stamps": stamps}))
    moved = Corpus(spark, str(tmp_path), str(old))
    assert sorted(map(str, moved.table("chunks").collect())) == before and moved.table("links").count() == 1 and moved.manifest()["layout"] == 2
    assert moved.sync()["unchanged"] == 1
    (old / "manifest.json").write_text(json.dumps({**moved.manifest(), "layout": 3}))
    with pytest.raises(ValueError):
        Corpus(spark, str(tmp_path), str(old))


def test_change_stream(spark, tmp_path):
    schema = "rel_path string, content string, op string, seq long"
    changes = spark.createDataFrame([("a.md", "# A\n", "upsert", 1), ("a.md", "# A2\n", "upsert", 2), ("b.md", "# B\n", "upsert", 1), ("b.md", None, "delete", 2)], schema)
    chunks = apply_changes(spark.createDataFrame([("b.md", "k", "", "body", "t", 1)], "rel_path string, chunk_key string, heading string, variant string, text string, line int"), changes)
    assert [r.text for r in chunks.collect()] == ["# A2"]
    changes.write.parquet(str(tmp_path / "in"))
    maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in current(spark, str(tmp_path / "out")).collect()] == ["# A2"]
    later = spark.createDataFrame([("a.md", None, "delete", 3), ("c.md", "# C\n", "upsert", 1)], schema)
    later.write.mode("append").parquet(str(tmp_path / "in"))
    maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in current(spark, str(tmp_path / "out")).collect()] == ["# C"]
