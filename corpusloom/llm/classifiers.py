"""Language identification and text quality with the byte network of :mod:`bytecnn`.

Both learn on the driver from a bounded sample of labelled rows, those with the smallest hashes of their ids: three quarters of
TRAIN_ROWS as labels come, a quarter label by label, so that rare labels take part. If their texts
have more than TRAIN_BYTES together, windows are drawn from the longest ones: as many as leave every text the same
part of the bytes, evenly over the whole text. Every window of every text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bytecnn import WINDOW, ByteCnn, windows_of
from corpusloom.llm.common import check_kept, forget, free_name, small_batches, utf8, written

#: Bounds of the sample: labelled rows (and labels), and bytes of what is learned of their texts.
TRAIN_ROWS, TRAIN_BYTES = 2000, 8 << 20
OVERLAP = 64
ROWS = 64


def crc_of(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary"))


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's category L is in ``text``."""
    return bool(text) and any(map(str.isalpha, text))


def even_shares(sizes: list[int], total: int) -> int:
    """The largest bound for which sizes cut to it add up to ``total`` at most; the largest size if all of them fit."""
    left, held = len(sizes), 0
    for n in sorted(sizes):
        if held + n * left > total:
            return (total - held) // left
        held, left = held + n, left - 1
    return max(sizes, default=0)


def drawn_rows(labelled: DataFrame) -> DataFrame:
    """TRAIN_ROWS of the rows (id, label) at most. A quarter is drawn in equal shares of all labels, and more of those that have
    more if others have fewer (of more labels than a quarter has rows the most frequent ones); the rest as they come."""
    rows, quarter = labelled.distinct(), -(-TRAIN_ROWS // 4)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(quarter).collect()}
    most = even_shares(list(counts.values()), quarter)
    spare = quarter - sum(min(n, most) for n in counts.values())
    quota = {}
    for label in sorted((x for x, n in counts.items() if n > most), key=str):  # what does not divide evenly
        quota[label], spare = (most + 1, spare - 1) if spare > 0 else (most, 0)
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ranked = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most + 1)  # limited before the shuffle
    bound = rows.sparkSession.createDataFrame([(x, quota.get(x, most)) for x in counts], f"label {labelled.schema['label'].dataType.simpleString()}, quota int")
    shares = ranked.join(F.broadcast(bound), "label").filter("nth <= quota").select("id", "label")
    order = [F.xxhash64("id"), "id", "label"]
    both = shares.withColumn("late", F.lit(0)).unionByName(rows.orderBy(*order).limit(TRAIN_ROWS).withColumn("late", F.lit(1)))
    return both.groupBy("id", "label").agg(F.min("late").alias("late")).orderBy("late", *order).limit(TRAIN_ROWS).select("id", "label")


def sample(docs: DataFrame, labelled: DataFrame, key: str, text: str, stride: int) -> list[tuple]:
    """[(label, windows)] of the bounded sample of ``labelled`` (id, label).

    An id that repeats is drawn once a label, with the smallest of its texts. What reaches the driver has TRAIN_ROWS rows and
    about TRAIN_BYTES at most, and a window a text at least, however long single texts are.
    """
    if labelled.isEmpty():
        return []
    rows = small_batches(docs).select(F.col(key).alias("id"), utf8(text).alias("text")).join(F.broadcast(drawn_rows(labelled)), "id")
    drawn = written(docs.sparkSession, rows.groupBy("id", F.col("label").cast("string").alias("label")).agg(F.min("text").alias("text")), "sample", narrow=True)
    bound = even_shares([r[0] for r in drawn.select(F.octet_length("text")).collect()], TRAIN_BYTES)

    def cut(batches):
        for batch in batches:
            parts = []
            for raw in batch.column(1).to_pylist():
                w = windows_of([raw], stride)[0]
                if len(raw) > bound:
                    w = w[np.unique(np.linspace(0, len(w) - 1, max(1, bound // stride)).astype(np.int64))]
                parts.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["label", "windows"])

    found = sorted((r["label"], bytes(r["windows"])) for r in drawn.select("label", "text").mapInArrow(cut, "label string, windows binary").collect())
    forget(docs.sparkSession, drawn)
    return [(label, np.frombuffer(w, np.uint8).reshape(-1, WINDOW)) for label, w in found]


def train(rows: list[tuple], names: list[str], epochs: int) -> ByteCnn:
    """One target a window; rows weigh alike however many windows they have, and rare labels weigh more."""
    at = {n: i for i, n in enumerate(names)}
    target = np.concatenate([np.full(len(w), at[label]) for label, w in rows])
    count = np.bincount([at[label] for label, _ in rows], minlength=len(names))
    weight = np.concatenate([np.full(len(w), count[at[label]] ** -0.5 / len(w)) for label, w in rows]).astype(np.float32)
    return ByteCnn(len(names)).fit(np.concatenate([w for _, w in rows]), target, weight, epochs)


def learn_language(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[ByteCnn, list[str]] | None:
    labelled = docs.filter(usable & F.col(lang).isNotNull()).select(F.col(key).alias("id"), F.col(lang).alias("label"))
    rows = sample(docs, labelled, key, text, WINDOW)
    if not rows:
        return None
    names = sorted({label for label, _ in rows})
    return train(rows, names, epochs=2), names


def identify_language(spark: SparkSession, docs: DataFrame, model: tuple[ByteCnn, list[str]] | None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, the columns ``keep``, _lang_pred and _score for every row of ``docs``.

    Windows of a whole text are scored one by one, however long it is; the language has the highest mean log-probability,
    the first in order at a tie, and the score is its mean probability. Null texts and texts without any letter
    (category L), and all texts if nothing was labelled, are ``und`` with score 0. Repeated rows and rows with a null key
    are scored each on its own. Columns of ``docs`` that are not in ``keep`` are ignored, whatever their names; a column of
    ``keep`` with the name of ``key`` or of a column of the result is an error.
    """
    keep = check_kept(keep, [key, "_lang_pred", "_score"])
    read = text if text in keep else free_name("_text", [key, *keep])
    sent = spark.sparkContext.broadcast(model and (model[0].p, model[1]))

    def scan(batches):
        net = sent.value and ByteCnn.of(sent.value[0])
        tables = net and net.tables()
        for batch in batches:
            langs, scores = [], []
            for at in range(0, batch.num_rows, ROWS):
                texts = batch.column(batch.schema.get_field_index(read))[at : at + ROWS].to_pylist()
                if sent.value is None:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                names = sent.value[1]
                x, count = windows_of([t.encode() if t else b"" for t in texts])
                z = net.logits(x, tables).astype(np.float64)
                z -= z.max(1, keepdims=True)
                z -= np.log(np.exp(z).sum(1, keepdims=True))
                first = np.cumsum(count) - count
                best = np.add.reduceat(z, first).argmax(1)
                p = (np.add.reduceat(np.exp(z), first) / count[:, None])[np.arange(len(best)), best]
                known = [has_letter(t) for t in texts]
                langs += [names[b] if k else "und" for b, k in zip(best, known)]
                scores += [float(v) if k else 0.0 for v, k in zip(p, known)]
            n = 1 + len(keep)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:n], "_lang_pred", "_score"])

    kept = small_batches(docs).select(key, *keep, *([] if text in keep else [F.col(text).alias(read)]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: 1 + len(keep)])
    return kept.mapInArrow(scan, f"{kinds}, _lang_pred string, _score double")


def learn_quality(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[ByteCnn, np.ndarray] | None:
    """The window network, and the weights that combine a document's mean, largest and smallest window logit."""
    labelled = labels.filter(usable & F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).alias("label")).distinct()
    rows = sample(docs, labelled, key, text, WINDOW - OVERLAP)
    if len({x for x, _ in rows}) < 2:
        return None
    net = train(rows, ["0", "1"], epochs=2)
    x = np.concatenate([w for _, w in rows])
    z = net.logits(x)
    f = combined(z[:, 1] - z[:, 0], np.array([len(w) for _, w in rows]))
    return net, logistic(f, np.array([x == "1" for x, _ in rows], float))


def combined(z: np.ndarray, count: np.ndarray) -> np.ndarray:
    first = np.cumsum(count) - count
    z = np.clip(z.astype(np.float64), -20, 20)
    return np.stack([np.ones(len(count)), np.add.reduceat(z, first) / count, np.maximum.reduceat(z, first), np.minimum.reduceat(z, first)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def score_quality(spark: SparkSession, docs: DataFrame, model: tuple[ByteCnn, np.ndarray] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) for every row of ``docs``: overlapping chunks of the whole text, max-pooled, then combined.

    Null and empty texts are one chunk of padding. Without labels of both kinds every score is 0.5. Repeated rows and rows
    with a null key are scored each on its own, very long texts to their end. Other columns of ``docs`` are ignored,
    whatever their names.
    """
    sent = spark.sparkContext.broadcast(model and (model[0].p, model[1]))

    def scan(batches):
        net = sent.value and ByteCnn.of(sent.value[0])
        tables = net and net.tables()
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            for at in range(0, batch.num_rows if sent.value else 0, ROWS):
                x, count = windows_of(batch.column(1)[at : at + ROWS].to_pylist(), WINDOW - OVERLAP)
                z = net.logits(x, tables)
                scores[at : at + ROWS] = 1 / (1 + np.exp(-combined(z[:, 1] - z[:, 0], count) @ sent.value[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(scan, "doc_id long, score double")
