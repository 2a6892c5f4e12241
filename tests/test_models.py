"""Embedding by a real ONNX session: a tiny network written out by hand, whose states are rows of a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models

VOCAB = ["[UNK]", "[CLS]", "tea", "kettle", "water", "hot", "Represent", "this"]
TABLE = np.random.default_rng(2).normal(size=(len(VOCAB), 6)).astype("<f4")


def field(number: int, value) -> bytes:
    """A field of a protocol buffer: an integer, or bytes with their length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name: str, kind: int, *sizes) -> bytes:
    shape = b"".join(field(1, field(2, s) if isinstance(s, str) else field(1, s)) for s in sizes)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def network() -> bytes:
    node = field(1, "table") + field(1, "input_ids") + field(2, "states") + field(4, "Gather")
    weights = field(1, TABLE.shape[0]) + field(1, TABLE.shape[1]) + field(2, 1) + field(8, "table") + field(9, TABLE.tobytes())
    graph = field(1, node) + field(2, "g") + field(5, weights) + field(11, tensor("input_ids", 7, "n", "tokens")) + field(12, tensor("states", 1, "n", "tokens", TABLE.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    from tokenizers import Tokenizer, pre_tokenizers, processors
    from tokenizers.models import WordLevel

    made = tmp_path_factory.mktemp("models")
    for name, *_ in models.CHECKPOINTS:
        (made / name).mkdir()
        (made / name / "model.onnx").write_bytes(network())
        tok = Tokenizer(WordLevel({w: i for i, w in enumerate(VOCAB)}, unk_token="[UNK]"))
        tok.pre_tokenizer = pre_tokenizers.Whitespace()
        tok.post_processor = processors.TemplateProcessing(single="[CLS] $A", special_tokens=[("[CLS]", 1)])
        tok.save(str(made / name / "tokenizer.json"))
    return str(made)


def unit(v):
    return v / np.linalg.norm(v)


def ids(text, most):
    return [1, *(VOCAB.index(w) if w in VOCAB else 0 for w in text.split())][:most]


def test_documents_and_queries(spark, folder):
    texts = ["tea kettle", "water water hot", "", None, " ".join(["kettle", "tea"] * 400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for name, pooling, most in (("all-MiniLM-L6-v2", "mean", 256), ("arctic-embed-xs", "cls", 512)):
        model = models.select(name)
        got = {r.i: r.v for r in rows.select("i", models.embedder(model, folder)(F.col("text")).alias("v")).collect()}
        for i, text in enumerate(texts):
            states = TABLE[ids(text or "", most)]
            assert np.allclose(got[i], unit(states[0] if pooling == "cls" else states.mean(0)), atol=1e-6)
        query = models.query_vector(spark, model, folder, "  hot tea ")
        states = TABLE[ids(model.query_prefix + "hot tea", most)]
        assert np.allclose(query, unit(states[0] if pooling == "cls" else states.mean(0)), atol=1e-6)
        with pytest.raises(ValueError):
            models.query_vector(spark, model, folder, "   ")


def test_search_refuses_vectors_of_another_model(spark, folder, tmp_path, capsys):
    from lodestone import cli

    (tmp_path / "a.md").write_text("# Tea\n\nhot water\n")
    (tmp_path / "b.md").write_text("# Kettle\n\nkettle\n")

    def call(*argv):
        said = []
        return cli.main(["--root", str(tmp_path), "--models-dir", folder, *argv], spark, said.append), "\n".join(said)

    assert call("--model", "all-MiniLM-L6-v2", "index")[0] == 0
    code, said = call("--model", "all-MiniLM-L6-v2", "search", "kettle", "-n", "1")
    assert code == 0 and ".md:1\t" in said
    assert call("--model", "arctic-embed-xs", "--no-sync", "search", "kettle")[0] == 2 and "another model" in capsys.readouterr().err
    code, said = call("--model", "arctic-embed-xs", "index")
    assert code == 0 and "embedding model" in said and "~2" in said
