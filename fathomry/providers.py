"""What can be plugged in: extractors, embeddings, summaries, and the log of queries.

Providers are callables on DataFrames or plain values; none needs a network.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .sources import extract
from .sources.languages import BY_EXTENSION, SKIPPED

Reader = Callable[[str, str], tuple[list[dict], list[dict], list[dict]]]


@dataclass
class Registry:
    """Readers by extension; a file's reader gives symbols, call sites and imports."""

    readers: dict[str, Reader] = field(default_factory=dict)
    skipped: set[str] = field(default_factory=set)

    @staticmethod
    def default() -> Registry:
        r = Registry()
        for ending, language in BY_EXTENSION.items():
            r.register((ending,), extract.read_file, SKIPPED.get(language, ()))
        return r

    def register(self, endings: tuple[str, ...], reader: Reader, skipped: tuple[str, ...] = ()) -> None:
        self.readers |= {e.lower(): reader for e in endings}
        self.skipped |= set(skipped)

    def reader_of(self, path: str) -> Reader | None:
        dot = path.rfind(".")
        return self.readers.get(path[dot:].lower()) if dot > path.rfind("/") else None

    def extract(self, sources: DataFrame) -> DataFrame:
        """As :func:`extract.extract`, with the registered readers."""
        readers = dict(self.readers)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Registry(readers)
            for b in batches:
                rows = [(own.reader_of(p) or (lambda *_: ([], [], [])))(p, t or "") for p, t in zip(b["path"], b["content"], strict=True)]
                yield pd.DataFrame({"path": b["path"], "symbols": [r[0] for r in rows], "sites": [r[1] for r in rows], "imports": [r[2] for r in rows]})

        return sources.select("path", "content").mapInPandas(run, extract._SCHEMA)


class EmbeddingProvider(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashedTerms:
    """Embeddings without a model: terms hashed to signed places, then made unit length."""

    dimensions: int = 64
    name: str = "hashed-terms"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for k, t in enumerate(texts):
            for term in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
                out[k, h % self.dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).tolist()


def embedder(provider: EmbeddingProvider, batch: int = 32, attempts: int = 3) -> Callable[[DataFrame], DataFrame]:
    """(id, text) -> (id, embedding) with a provider, in batches; those that keep failing are left out.

    Partitions run side by side, so their number bounds the requests under way.
    """
    from .plans.catalog import retried

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                try:
                    yield pd.DataFrame({"id": part["id"], "embedding": retried(lambda part=part: provider.embed(part["text"].fillna("").tolist()), attempts)})
                except Exception:
                    continue

    return lambda texts: texts.select("id", "text").mapInPandas(run, "id string, embedding array<float>")


LEAST_DESCRIPTION = 100


def prompt(files: DataFrame, symbols: DataFrame, richness: str = "standard") -> DataFrame:
    """(path, prompt): what a model is asked about each file; more fields the richer."""
    wanted = ["purpose (string)", "exports (array of strings)", "dependencies (array of strings)", "side_effects (array of strings)", "throws (array of strings)"]
    wanted += ["detailed_purpose (string, two or three sentences)", "internal_patterns (array of strings)"] if richness != "minimal" else []
    wanted += ["architectural_role (string)", "llm_description (string, one paragraph)"] if richness == "rich" else []
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), F.coalesce("signature", F.lit("")))
    listed = symbols.groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))), lambda x: x["t"]), "\n").alias("symbols"))
    ask = F.lit("Answer with one JSON object with the keys " + "; ".join(wanted) + ".")
    joined = files.join(listed, "path", "left")
    return joined.select("path", F.concat_ws("\n\n", F.concat(F.lit("Summarise this "), F.coalesce("language", F.lit("source")), F.lit(" file: "), "path"), "content", F.concat(F.lit("Symbols:\n"), F.coalesce("symbols", F.lit("none"))), ask).alias("prompt"))


def feature_prompt(features: DataFrame, files: DataFrame, symbols: DataFrame, n: int = 20) -> DataFrame:
    """(id, prompt): what a model is asked about each group of files."""
    member = features.select("id", F.explode("files").alias("path"))
    purposes = member.join(files.select("path", "purpose"), "path", "left").groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "path", F.lit(": "), F.coalesce("purpose", F.lit("unknown"))))), "\n").alias("files")
    )
    keys = feature_symbols(features, symbols, n).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("qualified_name")), ", ").alias("keys"))
    ask = F.lit("Name the feature that these files make up. Answer with one JSON object with the keys name; description; entry_points; data_flow; key_symbols.")
    return purposes.join(keys, "id", "left").select("id", F.concat_ws("\n\n", F.concat(F.lit("Files:\n"), "files"), F.concat(F.lit("Symbols: "), F.coalesce("keys", F.lit("none"))), ask).alias("prompt"))


def feature_symbols(features: DataFrame, symbols: DataFrame, n: int = 20) -> DataFrame:
    """(id, qualified_name): up to ``n`` symbols of a feature's files, also where the symbol's path is the longer one.

    Paths are met by their last segment, so no theta join is made.
    """
    from .operators.lookup import top_of_group

    member = features.select("id", F.explode("files").alias("path")).withColumn("base", T.base_name(F.col("path")))
    own = symbols.select("qualified_name", "file", "line", T.base_name(F.col("file")).alias("base"))
    hit = member.join(own, "base").where((F.col("file") == F.col("path")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("path"))))
    return top_of_group(hit.dropDuplicates(["id", "qualified_name"]), ["id"], [F.col("file"), F.col("line"), F.col("qualified_name")], n).select("id", "qualified_name")


def enriched(files: DataFrame, answers: DataFrame) -> DataFrame:
    """Files with what a model said (path, answer): lenient about form, and kept only if it says enough."""
    v = T.lenient_object(F.col("answer"))
    said = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    long = F.when(F.length(said("llm_description")) >= LEAST_DESCRIPTION, said("llm_description"))
    new = answers.select("path", said("purpose").alias("__p"), said("detailed_purpose").alias("__d"), long.alias("__l"))
    joined = files.join(new, "path", "left")
    return joined.withColumns({"purpose": F.coalesce("__p", "purpose"), "detailed_purpose": F.coalesce("__d", "detailed_purpose"), "llm_description": F.coalesce("__l", "llm_description")}).select(*files.columns)


@dataclass
class QueryLog:
    """Calls that failed or gave nothing; rows for a table, written by :meth:`table`."""

    rows: list[tuple] = field(default_factory=list)
    clock: Callable[[], float] = time.time

    def run(self, endpoint: str, args: dict, call: Callable[[], str]) -> str:
        """The call's text; an exception is logged and its message returned."""
        shown = json.dumps(args, default=str, sort_keys=True)
        try:
            text = call()
        except Exception as e:  # the endpoint answers with the message
            self.rows.append((self.clock(), "EXCEPTION", endpoint, shown, str(e)))
            return f"Error: {endpoint}: {e}"
        if text.startswith("Error"):
            self.rows.append((self.clock(), "ERROR", endpoint, shown, text))
        elif not text.strip():
            self.rows.append((self.clock(), "EMPTY_RESULT", endpoint, shown, ""))
        return text

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "at double, kind string, endpoint string, args string, message string")
