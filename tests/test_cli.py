import json

import numpy as np
import pytest

from lodestone import cli
from lodestone.functions import models


@pytest.fixture
def run(spark, tmp_path):
    root = tmp_path / "repo"
    (root / ".git").mkdir(parents=True)
    (root / "vault" / "pkg").mkdir(parents=True)
    (root / "vault" / "a.md").write_text("# A\n\nSee `run.go` and `no.go`, [b](b.md#gone), [x](ghost.md).\n")
    (root / "vault" / "b.md").write_text("# B\n\nSame words.\n")
    (root / "vault" / "c.md").write_text("# C\n\n" + "line\n\n" * 60 + "## D\n\ntext\n")
    (root / "vault" / "pkg" / "run.go").write_text("package p\n\n// Run runs.\nfunc Run() {\n}\n")

    def call(*argv, code=0):
        said = []
        assert cli.main(["--root", str(root / "vault"), "--model", "digest", *argv], spark, said.append) == code
        return "\n".join(said)

    call.root = root / "vault"
    return call


def test_commands(run):
    assert run("status").endswith("none yet")
    assert run("init").startswith("indexed 4 files (+4 ~0 =0 -0)") and run("index").startswith("indexed 4 files (+0 ~0 =4 -0)")
    hits = json.loads(run("--no-sync", "search", "words", "--json"))
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True) and len(hits) == 4
    assert [h["path"] for h in json.loads(run("--no-sync", "search", "words", "--lang", "golang", "--json"))] == ["pkg/run.go"]
    assert run("--no-sync", "search", "words", "--code", "-n", "1").startswith("pkg/run.go:")
    run("--no-sync", "search", " ", code=2)
    run("--no-sync", "search", "x", "--lang", "cobol", code=2)
    pairs = json.loads(run("--no-sync", "dupes", "--min-score", "0", "-n", "0", "--json"))
    assert pairs and all((p["a"]["path"], p["a"]["key"]) < (p["b"]["path"], p["b"]["key"]) for p in pairs)
    assert run("--no-sync", "dupes", "--min-score", "2").startswith("nothing is as alike")
    assert "chunks\t" in run("status") and "go" in run("langs").split() and run("version").startswith("lodestone")


def test_graph_and_lint(run):
    stats = dict(x.split("\t") for x in run("graph").splitlines())
    assert stats == {"files": "4", "markdown": "3", "edges": "2", "resolved": "1", "broken": "1", "broken anchors": "1", "orphans": "2"}
    assert run("--no-sync", "graph", "--broken") == "a.md:3\tghost.md\t(md)"
    assert run("--no-sync", "graph", "--broken-anchors") == "a.md:3\tb.md#gone → b.md (without that section)\t(md)"
    assert run("--no-sync", "graph", "--orphans").split() == ["a.md", "c.md"]
    assert run("--no-sync", "graph", "--backlinks", "./b.md") == "a.md:3\t(md)" and '"a.md" -> "b.md"' in run("--no-sync", "graph", "--dot")
    assert len(json.loads(run("--no-sync", "graph", "--json"))["edges"]) == 2
    found = json.loads(run("--no-sync", "lint", "--json", code=1))
    assert {k: len(v) for k, v in found.items()} == {"unlinked": 1, "ambiguous": 0, "broken": 1, "deep_relative": 0, "missing_toc": 1}
    assert run("--no-sync", "lint", "b.md") == "nothing to mend" and "a.md:3\trun.go → pkg/run.go" in run("--no-sync", "lint", code=1)
    assert run("--no-sync", "lint", "--fix").splitlines() == [
        "a.md\trun.go → /vault/pkg/run.go", "c.md\tcontents written", "1 link(s) in 1 file(s) and 1 list(s) of contents rewritten", "by hand: 1",
    ]
    assert "[`run.go`](/vault/pkg/run.go)" in (run.root / "a.md").read_text() and "## Contents\n\n- D" in (run.root / "c.md").read_text()
    assert json.loads(run("lint", "--json", code=1))["missing_toc"] == []
    run("lint", "../../out.md", code=2)


def test_commands_without_vectors_keep_those_there_are(run, spark):
    from lodestone.sources.store import Corpus

    run("index")
    vectors = lambda: sorted((r.rel_path, r.chunk_key, r.vec) for r in Corpus(spark, str(run.root)).table("chunks").collect())
    before = vectors()
    assert before and all(v for _, _, v in before)
    for command in (["lint"], ["graph"]):
        assert cli.main(["--root", str(run.root), "--model", models.DEFAULT, *command], spark, lambda x: None) in (0, 1)
    assert vectors() == before and Corpus(spark, str(run.root)).manifest()["stamps"]["embed_id"] == models.select("digest").space
    run("--no-sync", "search", "words")  # the vectors are still known as what they are


def test_models(monkeypatch):
    monkeypatch.delenv("LODESTONE_MODELS", raising=False)
    monkeypatch.setenv("XDG_CACHE_HOME", "/c")
    assert models.cache_dir() == "/c/lodestone/models"
    monkeypatch.setenv("LODESTONE_MODELS", "/m")
    assert models.cache_dir() == "/m"
    assert models.select("ALL-minilm-l6-V2").pooling == "mean" and models.select().name == models.DEFAULT
    assert models.select("bge-small-en-v1.5").space == "bge-small-en-v1.5+cls+l2+d384+s512"
    with pytest.raises(ValueError):
        models.select("none-such")
    with pytest.raises(ValueError):
        models.embedder(models.select(), "/nowhere")
    states, mask = np.array([[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]]), np.array([1, 1, 0])
    assert np.allclose(models.pool(states, mask, "cls"), [0.6, 0.8])
    assert np.allclose(models.pool(states, mask, "mean"), np.array([2.0, 2.0]) / 8**0.5)
    assert not models.pool(np.zeros((1, 2)), np.array([1]), "cls").any()


def test_fetching(tmp_path, monkeypatch):
    import tarfile
    import zipfile

    from lodestone.functions import fetch

    model = models.select("arctic-embed-xs")
    repo, weights = fetch.PUBLISHED[model.name]
    (tmp_path / "hub" / repo / "resolve/main/onnx").mkdir(parents=True)
    (tmp_path / "hub" / repo / "resolve/main/onnx" / weights).write_bytes(b"w" * 3_000_000)
    (tmp_path / "hub" / repo / "resolve/main/tokenizer.json").write_text("{}")
    hub, heard = (tmp_path / "hub").as_uri() + "/", []
    monkeypatch.setenv("LODESTONE_NO_DOWNLOAD", "1")
    with pytest.raises(ValueError):
        fetch.ensure(model, str(tmp_path / "models"), hub=hub)
    monkeypatch.delenv("LODESTONE_NO_DOWNLOAD")
    assert fetch.ensure(model, str(tmp_path / "models"), lambda *x: heard.append(x), hub) == ["model.onnx", "tokenizer.json"]
    assert model.installed(str(tmp_path / "models")) and ("model.onnx", 3_000_000, 3_000_000) in heard and fetch.ensure(model, str(tmp_path / "models"), hub=hub) == []
    with pytest.raises(OSError):
        fetch.fetch(hub + "none", str(tmp_path / "x" / "none"))
    (tmp_path / "libthing.so.1").write_bytes(b"code")
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        t.add(tmp_path / "hub", "pkg/libthing.so")  # a folder of that name
        t.add(tmp_path / "libthing.so.1", "pkg/lib/libthing.so.1")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "libthing.so.1", "pkg/libthing.so.1")
    for archive in ("a.tgz", "a.zip"):
        out = tmp_path / archive[:3] / "lib.so"
        fetch.extract(str(tmp_path / archive), lambda n: n.startswith("libthing"), str(out))
        assert out.read_bytes() == b"code"
        with pytest.raises(ValueError):
            fetch.extract(str(tmp_path / archive), lambda n: n == "other", str(out))
        with pytest.raises(ValueError):
            fetch.extract(str(tmp_path / archive), lambda n: n.startswith("libthing"), str(tmp_path / "much"), limit=3)
    assert not (tmp_path / "much").exists() and not list(tmp_path.glob(".part-*"))


def test_status_line():
    import io

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    for stream, want in ((Terminal(), "\rlong text\rshort    \r     \r"), (io.StringIO(), "")):
        status = cli.Status(stream)
        status.show("long text")
        status.show("short")
        status.clear()
        assert stream.getvalue() == want
