import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.ingest import ordered_digest
from corpusloom.operators.quantiles import exact_quantile


@pytest.mark.parametrize("small", [100, 1 << 16])
def test_quantiles_by_brackets(spark, small):
    """Ties, outliers, negative values, groups of one, without values and without a name, in several passes."""
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0, 3.0], 1000), "wild": 10 ** rng.uniform(-200, 200, 3000) * rng.choice([-1, 1], 3000),
        "one": np.array([4.0]), "two": np.array([1.0, 3.0]), None: np.arange(700.0), "outlier": np.append(np.zeros(2000), 1e300),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for q in (0.95, 0.5):
        got = {r.g: r.quantile for r in exact_quantile(df, "g", "v", q, small=small).collect()}
        assert got.pop("none") is None and set(got) == set(groups)
        for g, x in groups.items():
            assert got[g] == pytest.approx(float(np.quantile(x, q)), rel=1e-9), (g, q)


def test_digest_in_order(spark):
    rows = spark.range(100_000).select(F.col("id"), F.hash("id").alias("o"))
    order = rows.orderBy("o", F.col("id").cast("string")).collect()
    want = hashlib.sha256("|".join(str(r.id) for r in order).encode()).hexdigest()
    assert ordered_digest(rows, "o", F.col("id").cast("string")).first()[0] == want
    assert ordered_digest(rows.limit(0), "o", F.col("id").cast("string"), length=16).first()[0] == hashlib.sha256().hexdigest()[:16]
    some = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "o int, p string")
    assert ordered_digest(some, "o", F.col("p"), "-").first()[0] == hashlib.sha256(b"b-c").hexdigest()
