"""Where models plug in, with deterministic stand-ins that need no weights.

An encoder is a vectorised UDF text -> array<float>, a reranker any column over (query tokens, pair tokens), a backend
any callable (query, context) -> answer text that runs inside ``mapInPandas``.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from corpusloom.errors import BackendUnavailable


class Backend(Protocol):
    """What an answer generator has to offer; ``load`` runs once a task."""

    def load(self) -> None: ...
    def unload(self) -> None: ...
    def generate(self, query: str, context: str) -> str: ...
    def info(self) -> dict: ...


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: What compatibility composition leaves alone: ASCII, letters of Latin-1 and of the Arabic block, without marks.
SETTLED = r"^[\x{00}-\x{9F}\x{C0}-\x{FF}\x{060C}-\x{064A}\x{0660}-\x{066F}\x{0671}-\x{0674}\x{0679}-\x{06D3}]*$"


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these text columns in NFKC. Rows that it cannot change, nearly all, stay in the JVM."""
    settled = F.lit(True)
    for c in columns:
        settled = settled & F.coalesce(F.col(c), F.lit("")).rlike(SETTLED)
    changed = df.filter(~settled).withColumns({c: nfkc(c) for c in columns})
    return df.filter(settled).unionByName(changed.select(df.columns))


def hashed_encoder(dim: int = 64) -> Callable:
    """A bag of hashed words with unit length: stands in for a neural encoder."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim, np.float32)
                for w in (t or "").split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if h & 0x10000 else -1.0
                n = float(np.sqrt((v * v).sum()))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, ArrayType(FloatType()))


def overlap_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's distinct words that the text holds: stands in for a cross-encoder."""
    words = F.array_distinct(query_tokens)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, text_tokens)) / F.size(words)).otherwise(0.0)


class ExtractiveBackend:
    """Answers with the first sentence of the first source, as JSON that cites it."""

    def load(self) -> None:
        pass

    def unload(self) -> None:
        pass

    def info(self) -> dict:
        return {"backend": "extractive"}

    def generate(self, query: str, context: str) -> str:
        import json

        lines = (context or "").split("\n")
        if len(lines) < 4:
            return json.dumps({"answer": "insufficient evidence", "citations": []})
        return json.dumps({"answer": lines[2].partition(": ")[2].split(".")[0], "citations": [{"source_id": lines[3].partition(": ")[2]}]}, ensure_ascii=False)


def generated(df: DataFrame, backend: Backend, query: str = "query", context: str = "context", out: str = "raw_answer") -> DataFrame:
    """Add ``out``: the backend's text for every row, loaded once a task."""
    names = df.columns

    def run(batches):
        backend.load()
        try:
            for pdf in batches:
                pdf[out] = [backend.generate(q, c) for q, c in zip(pdf[query], pdf[context])]
                yield pdf[[*names, out]]
        finally:
            backend.unload()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, `{out}` string")


def pick_backend(name: str, local: Backend | None = None, remote: Backend | None = None) -> Backend:
    """``auto``: the local one, else the remote one, else the extractive stand-in; any other name must be there."""
    known = {"local": local, "remote": remote, "extractive": ExtractiveBackend()}
    if name == "auto":
        return local or remote or known["extractive"]
    if known.get(name) is None:
        raise BackendUnavailable(f"backend {name!r} is not available")
    return known[name]
