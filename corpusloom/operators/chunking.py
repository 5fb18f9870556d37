"""Article-aware chunks of texts, as array expressions: one row gives an array, ``inline`` gives rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

#: Fixed pattern of an article heading; digits of any script.
HEADING = r"((?:ال)?مادة[\s\p{Z}]*(?:رقم[\s\p{Z}]*)?(\p{Nd}+))"
CUT = "\x01\x02\x01"


def windows(text: Column, article: Column, size: int) -> Column:
    """Pieces of ``size`` characters, each stripped; an empty text has none."""
    count = F.ceil(F.length(text) / size).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(article.alias("article_id"), i.alias("chunk_index"), count.alias("chunk_count"), strip(F.substring(text, i * size + 1, F.lit(size))).alias("text")),
    )
    return F.when(F.length(text) > 0, pieces).otherwise(F.expr("cast(array() as array<struct<article_id:string,chunk_index:int,chunk_count:int,text:string>>)"))


def chunks(text: Column, size: int = 2000, heading: str = HEADING, keep_preamble: bool = False) -> Column:
    """Chunks of one text: spans from heading to heading, long ones in windows; without headings plain windows.

    Text before the first heading is left out unless ``keep_preamble``; then it is a span without article.
    """
    body = F.coalesce(text, F.lit(""))
    spans = F.split(F.regexp_replace(body, heading, f"{CUT}$1"), CUT)
    first = F.slice(spans, 1, 1) if keep_preamble else F.expr("cast(array() as array<string>)")
    rest = F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0)))
    articles = F.transform(F.filter(F.transform(F.concat(first, rest), strip), lambda s: s != ""), lambda s: windows(s, F.nullif(F.regexp_extract(s, "^" + heading, 2), F.lit("")), size))
    return F.when(F.size(spans) > 1, F.flatten(articles)).otherwise(windows(body, F.lit(None).cast("string"), size))


def chunked(docs: DataFrame, document_id: str = "document_id", text: str = "raw_text", size: int = 2000, keep: list[str] | None = None, **options) -> DataFrame:
    """document_id, the columns ``keep``, article_id, chunk_index, chunk_count, text: a row a chunk."""
    return docs.select(document_id, *(keep or []), F.inline(chunks(F.col(text), size, **options)))
