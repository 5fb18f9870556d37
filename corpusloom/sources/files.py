"""Files: corpora as JSON arrays, sample rows, reports, staged ingest, settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import MissingReport, SettingsError
from corpusloom.sources.json_arrays import read_json_array

CORPUS = "document_id string, jurisdiction string, law_id string, law_name string, article_id string, raw_text string, normalized_text string, embedding_text string, version_id string, source string"
SAMPLE = [(str(i), "sample", "law-1", "Sample Act", str(i), t, t, t, None, "sample") for i, t in enumerate(["Everyone may read the law.", "A contract binds its parties.", "Costs follow the event."], 1)]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds one array of documents, read in byte ranges."""
    return read_json_array(spark, path, CORPUS)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of ``paths`` that exists and has rows, else the sample rows."""
    for path in paths:
        if exists(spark, path):
            df = read_corpus(spark, path)
            if not df.isEmpty():
                return df
    return spark.createDataFrame(SAMPLE, CORPUS)


def write_staged(docs: DataFrame, path: str) -> None:
    """Replace the staging area; what is live does not change."""
    docs.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report's metrics as columns; MissingReport if there is none."""
    if not exists(spark, path):
        raise MissingReport(path)
    return spark.read.option("multiLine", True).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, md5 of every file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def parse_dotenv(text: str) -> dict[str, str]:
    out = {}
    for line in map(str.strip, text.splitlines()):
        name, sign, value = line.partition("=")
        if sign and not line.startswith("#"):
            out[name.strip()] = value.strip().strip('"')
    return out


def parse_flat_yaml(text: str) -> dict:
    """``name: value`` lines of any depth, and lists of ``- value`` lines below a name. Values are JSON where they read as
    JSON. Nested names are joined by dots; names inside a list's entries are not read."""
    out, path = {}, []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        bare, depth = body.strip(), len(body) - len(body.lstrip())
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- "):
            above = [p[1] for p in path if p[0] <= depth]
            if above:
                out.setdefault(".".join(above), []).append(scalar(bare[2:]))
            continue
        name, sign, value = bare.partition(":")
        if not sign:
            continue
        path = [p for p in path if p[0] < depth]
        if value.strip():
            out[".".join([*[p[1] for p in path], name])] = scalar(value)
        else:
            path.append((depth, name))
    return out


def scalar(value: str):
    try:
        return json.loads(value)
    except ValueError:
        return value.strip().strip("'\"")


def settings(defaults: dict, yaml_text: str = "", dotenv_text: str = "", env: dict | None = None) -> dict:
    """Defaults, then the YAML file, then .env, then the environment; a later one wins. Kinds follow the defaults."""
    out = dict(defaults)
    layers = [parse_flat_yaml(yaml_text), parse_dotenv(dotenv_text), dict(os.environ if env is None else env)]
    for layer in layers:
        for name, default in defaults.items():
            found = next((layer[k] for k in (name, name.upper(), *[k for k in layer if k.endswith(f".{name}")]) if k in layer), None)
            if found is not None:
                try:
                    out[name] = str(found).lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(found) if default is not None else found
                except (TypeError, ValueError) as e:
                    raise SettingsError(f"{name}: {found!r} is no {type(default).__name__}") from e
    return out
