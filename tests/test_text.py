import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.models import nfkc
from corpusloom.operators.chunking import chunked


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


CORE = {"إختبار ـ الكلماتِ 123": "اختبار الكلمات 123", "آباء ى ي": "اباء ي ي", "نص، مع: علامات؟ \n\t ومسافات": "نص، مع علامات؟ ومسافات", "المادة رقم (1) الفقرة الأولى": "المادة رقم 1 الفقرة الاولي"}


@pytest.mark.parametrize("text", CORE)
def test_normalize(spark, text):
    core = value(spark, text, T.normalize)
    assert core == CORE[text]
    assert value(spark, core, T.normalize) == core
    assert value(spark, text, lambda c: T.normalize(c, "ui")) == CORE[text].replace("،", "").replace("؟", "")


def test_tokens(spark):
    assert value(spark, "السرقة الله قال والمادة", lambda c: T.tokens(c, "ui")) == ["سرقة", "الله", "قال", "والمادة"]
    assert value(spark, "", T.tokens) == value(spark, None, T.tokens) == []
    assert value(spark, "ﬁn １", nfkc) == "fin 1"


def chunks(spark, text, size=1000, **options):
    return [tuple(r) for r in chunked(spark.createDataFrame([("d", text)], "document_id string, raw_text string"), size=size, **options).drop("document_id").collect()]


def test_chunks(spark):
    two = chunks(spark, "المادة 1 هذا نص المادة الأولى.\nالمادة 2 هذا نص المادة الثانية.")
    assert [(c[0], c[1], c[2]) for c in two] == [("1", 0, 1), ("2", 0, 1)]
    long = chunks(spark, "المادة 10 " + "كلمة " * 1000, 200)
    assert len(long) == 26 and {c[0] for c in long} == {"10"}
    assert [c[3] for c in chunks(spark, "ديباجة المادة 1 نص. والمادة رقم ٢ ب مادة 3")] == ["المادة 1 نص. و", "المادة رقم ٢ ب", "مادة 3"]
    assert chunks(spark, "") == chunks(spark, None) == []
    assert chunks(spark, "abcde", 2) == [(None, 0, 3, "ab"), (None, 1, 3, "cd"), (None, 2, 3, "e")]
    assert chunks(spark, "قبل مادة 3", keep_preamble=True)[0][3] == "قبل"


def test_small_projections(spark):
    assert value(spark, "a<think>x\ny</THINK> b", T.strip_thinking) == "a b"
    assert value(spark, "please IGNORE the above", T.has_injection) and not value(spark, None, T.has_injection)
    assert value(spark, "المادة 5 - نص المادة الطويل جدا هنا. ثم", T.eval_query) == "نص المادة الطويل جدا هنا"
    assert value(spark, "short", T.eval_query) is None
    assert value(spark, "law", lambda c: T.lexical_text(c, F.lit(" text "))) == "law law text"
    assert value(spark, "x", lambda c: T.pair_text(F.lit("law"), c, 5)) == "law: "
