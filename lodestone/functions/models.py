"""Embedding checkpoints by name, and embedders over those that lie in a local folder.

Checkpoints are not shipped or fetched: ``<folder>/<name>/model.onnx`` and ``tokenizer.json`` have to be there, in a
folder that all executors reach.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vectors import fake_embedding, representation_id

# The marker that two families put before queries, and the checkpoints
# (name, dimension, most tokens, pooling, query prefix, size in MB).
MARKER = "Represent this sentence for searching relevant passages: "
CHECKPOINTS = (
    ("all-MiniLM-L6-v2", 384, 256, "mean", "", 90),
    ("arctic-embed-xs", 384, 512, "cls", MARKER, 90),
    ("bge-small-en-v1.5", 384, 512, "cls", MARKER, 127),
    ("bge-small-en-v1.5-int8", 384, 512, "cls", MARKER, 33),
)
DEFAULT = "arctic-embed-xs"
STAND_IN = "digest"


@dataclass(frozen=True)
class Model:
    name: str
    dim: int
    max_seq_len: int
    pooling: str
    query_prefix: str = ""
    approx_mb: int = 0
    doc_prefix: str = ""

    @property
    def space(self) -> str:
        return representation_id(self.name, self.pooling, self.dim, self.max_seq_len, self.doc_prefix)

    def folder(self, models_dir: str) -> str:
        return os.path.join(models_dir, self.name)

    def installed(self, models_dir: str) -> bool:
        return all(os.path.isfile(os.path.join(self.folder(models_dir), f)) for f in ("model.onnx", "tokenizer.json"))


MODELS = {name.lower(): Model(name, *rest) for name, *rest in CHECKPOINTS}


def cache_dir() -> str:
    """Where checkpoints lie unless told otherwise: $LODESTONE_MODELS, or a folder of the user's cache."""
    home = os.environ.get("XDG_CACHE_HOME", "").strip() or os.path.join(os.path.expanduser("~"), ".cache")
    return os.environ.get("LODESTONE_MODELS", "").strip() or os.path.join(home, "lodestone", "models")


def select(name: str = "") -> Model:
    """The checkpoint of a name in any case; without one, that of $LODESTONE_MODEL or the default."""
    wanted = name.strip() or os.environ.get("LODESTONE_MODEL", "").strip() or DEFAULT
    if wanted.lower() == STAND_IN:
        return Model(STAND_IN, 4, 0, "none")
    if wanted.lower() not in MODELS:
        raise ValueError(f"unknown model {wanted!r}; known: {', '.join(m.name for m in MODELS.values())}")
    return MODELS[wanted.lower()]


def pool(states: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """One vector of length one for token states (tokens, dim): the first token's, or the mean under the mask."""
    v = states[0] if pooling == "cls" else (states * mask[:, None]).sum(0) / max(float(mask.sum()), 1e-9)
    length = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / length if length > 0 else v


class Session:
    """A checkpoint in memory. Texts run one by one on one thread, so a vector never depends on its batch."""

    def __init__(self, model: Model, folder: str):
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        self.model = model
        self.net = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), options, providers=["CPUExecutionProvider"])
        self.takes = {x.name for x in self.net.get_inputs()}
        self.tokens = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        self.tokens.no_padding()

    def vector(self, text: str) -> np.ndarray:
        coded, most = self.tokens.encode(text), self.model.max_seq_len
        given = {"input_ids": coded.ids, "attention_mask": coded.attention_mask, "token_type_ids": coded.type_ids}
        given = {k: np.array([v[:most]], np.int64) for k, v in given.items()}
        states = self.net.run(None, {k: v for k, v in given.items() if k in self.takes})[0][0]
        return pool(states, given["attention_mask"][0], self.model.pooling)


@functools.cache
def session(model: Model, folder: str) -> Session:
    """One session per process and checkpoint."""
    return Session(model, folder)


def _ready(model: Model, models_dir: str) -> str:
    if not model.installed(models_dir):
        raise ValueError(f"model {model.name} is not in {models_dir or 'any folder'}; put model.onnx and tokenizer.json in {model.folder(models_dir)}")
    return model.folder(models_dir)


def embedder(model: Model, models_dir: str) -> Callable[[Column], Column]:
    """A function from a text column to document vectors. A null text counts as empty."""
    if model.name == STAND_IN:
        return fake_embedding
    folder = _ready(model, models_dir)

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = session(model, folder)
        for texts in batches:
            yield pd.Series([own.vector(model.doc_prefix + (t or "")).astype(float).tolist() for t in texts])

    return vectors


def query_vector(spark, model: Model, models_dir: str, query: str) -> list[float]:
    """The vector of a query, behind the marker that the model wants; an error if the query is empty."""
    if not query.strip():
        raise ValueError("the query is empty")
    if model.name == STAND_IN:
        return list(spark.range(1).select(fake_embedding(F.lit(query.strip()))).first()[0])
    return session(model, _ready(model, models_dir)).vector(model.query_prefix + query.strip()).astype(float).tolist()
