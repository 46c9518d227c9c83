"""Models that embed texts, dense and sparse in one pass over Arrow batches.

A model is any object with ``encode(texts, return_dense, return_sparse)``, which gives a dict of ``dense`` (a row of numbers a
text, or None) and ``sparse`` (a dict of token id to weight a text, or None).  A task makes its model once, by the
function it was given, and asks it for ``batch`` texts at a time.

Defined results: a null text is embedded as an empty one; a vector of another length than ``dim``, or fewer answers than texts,
fails the query; dense and sparse both off is an error before anything runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vector as V

_TERMS = re.compile(r"[a-z]+|[0-9]+|[一-鿿]")
#: Sparse token ids of the hash model: 28 bits of the term's md5.
_ID_DIGITS = 7
#: Terms whose hashes a task keeps.
_KEPT_TERMS = 1 << 16


@lru_cache(_KEPT_TERMS)
def _hashed(term: str) -> tuple[int, int]:
    """(number of which the place is the remainder, token id)."""
    name = md5(term.encode()).hexdigest()
    return int(name[:8], 16), int(name[:_ID_DIGITS], 16)


class HashModel:
    """The deterministic default: terms hashed to places (dense, of length 1) and to token ids (sparse, with their counts)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str], return_dense: bool = True, return_sparse: bool = True) -> dict:
        counts = [Counter(_TERMS.findall(t.lower())) for t in texts]
        dense = np.zeros((len(texts), self.dim))
        if return_dense:
            for row, c in zip(dense, counts, strict=True):
                for t, n in c.items():
                    row[_hashed(t)[0] % self.dim] += n
            dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        sparse: list[Counter] = [Counter() for _ in texts]
        if return_sparse:
            for out, c in zip(sparse, counts, strict=True):
                for t, n in c.items():
                    out[_hashed(t)[1]] += float(n)
        return {"dense": dense if return_dense else None, "sparse": sparse if return_sparse else None}


def embedding(text: Column, model: Callable[[], object] = HashModel, dim: int | None = 64, dense: bool = True, sparse: bool = True, batch: int = 32) -> Column:
    """struct(dense array<double>, sparse map<int, double>) of a text Column; what is off is null."""
    if not dense and not sparse:
        raise ValueError("dense and sparse are not both off")

    kind = pa.struct([("dense", pa.list_(pa.float64())), ("sparse", pa.map_(pa.int32(), pa.float64()))])

    def answered(encoder, part: list[str]) -> pa.Array:
        got = encoder.encode(part, return_dense=dense, return_sparse=sparse)
        for on, name in ((dense, "dense"), (sparse, "sparse")):
            if on and (got[name] is None or len(got[name]) != len(part)):
                raise ValueError(f"the model gave no {name} answer for each of {len(part)} texts")
        vectors = [[float(x) for x in v] for v in got["dense"]] if dense else [None] * len(part)
        if dense and dim is not None and any(len(v) != dim for v in vectors):
            raise ValueError(f"the model's vectors are not of length {dim}")
        maps = [[(int(k), float(w)) for k, w in m.items()] for m in got["sparse"]] if sparse else [None] * len(part)
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((vectors, maps), kind, strict=True)], fields=list(kind))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = model()
        for texts in columns:
            # answers become Arrow part by part: as Python objects those of a whole column take some 40 KB a text
            parts = [answered(encoder, [t or "" for t in texts.slice(at, batch).to_pylist()]) for at in range(0, len(texts), batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "dense array<double>, sparse map<int, double>")(text)


def embedded(df: DataFrame, text: str, **options) -> DataFrame:
    """df with dense and sparse of a text column: each text is read and tokenised once."""
    rows = df.withColumn("_e", embedding(F.col(text), **options))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("dense", "sparse")], F.col("_e.dense").alias("dense"), F.col("_e.sparse").alias("sparse"))


def sparse_weights(rows: DataFrame, keys: list[str], name: str = "w") -> DataFrame:
    """(keys, term, name): sparse maps as rows for ``search.sparse_topk``."""
    return rows.select(*keys, F.explode("sparse").alias("term", name))


def pair_scores(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """pairs with dense_score (cosine of dense and qdense) and lexical_score (of sparse and qsparse); without them."""
    dense = F.round(V.cosine(F.col("qdense"), F.col("dense")), digits).alias("dense_score")
    lexical = F.round(V.lexical_score(F.col("qsparse"), F.col("sparse")), digits).alias("lexical_score")
    keep = [c for c in pairs.columns if c not in ("dense", "sparse", "qdense", "qsparse")]
    return pairs.select(*keep, dense, lexical)


def score_matrix(queries: DataFrame, docs: DataFrame, by: str, normalised: bool = True) -> DataFrame:
    """(by, query_id, doc_ids, scores): for each query (by, query_id, qdense) its products with all documents (by, doc_id, dense) of its group, in the order of their ids.

    A group is a pool of candidates of a query or a few of them, so that its matrix fits one call; without ``normalised`` vectors are taken as they are.
    """
    kinds = {"q": dict(queries.dtypes)["query_id"], "d": dict(docs.dtypes)["doc_id"], "b": dict(docs.dtypes)[by]}

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame([])
        d = d.sort_values("doc_id")
        x, y = np.stack(q["qdense"]).astype(float), np.stack(d["dense"]).astype(float)
        if normalised:
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        ids = d["doc_id"].tolist()
        return pd.DataFrame({by: q[by], "query_id": q["query_id"], "doc_ids": [ids] * len(q), "scores": list(x @ y.T)})

    return queries.groupBy(by).cogroup(docs.groupBy(by)).applyInPandas(run, f"{by} {kinds['b']}, query_id {kinds['q']}, doc_ids array<{kinds['d']}>, scores array<double>")
