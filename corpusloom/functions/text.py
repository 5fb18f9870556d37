"""Text expressions: normalisation, tokens, projections of records, prompts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"
ALEF_FROM, ALEF_TO = "إأآٱىـ", "ااااي"  # the last one, tatweel, has no target and goes
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}]"
ARABIC = r"[\x{060C}-\x{0671}]"  # holds all characters that the next steps change
NOT_WORD = r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]+"
UI_MARKS = r"[؟،؛]"
ARTICLE_PREFIX = r"(?<![\p{L}\p{N}_])ال(?=.{3,})"
HEADING_PREFIX = r"^[\s\p{Z}]*المادة[\s\p{Z}]*[^\s\p{Z}]*[\s\p{Z}]*[-:]?[\s\p{Z}]*"
UNKNOWN_LAW, NO_ARTICLE, DEFAULT_TITLE = "غير محدد", "N/A", "مصدر قانوني"
INJECTION_PHRASES = ["ignore the above", "ignore previous instructions", "ignore all previous instructions", "disregard the system prompt", "system:", "assistant:"]


def strip(c: Column) -> Column:
    """Unicode white space off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalize(c: Column, profile: str = "core") -> Column:
    """Retrieval form of a text. ``core`` keeps the marks ؟ ، ؛ glued to words, ``ui`` takes them for blanks.

    NFKC comes before it, as a step on tables (:func:`corpusloom.functions.models.composed`): Spark has no function for it.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    arabic = F.regexp_replace(F.translate(low, ALEF_FROM, ALEF_TO), DIACRITICS, "")
    if profile == "ui":
        arabic = F.regexp_replace(arabic, UI_MARKS, " ")
    out = F.when(low.rlike(ARABIC), arabic).otherwise(low)  # texts without these letters skip the slow steps
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def tokens(c: Column, profile: str = "core") -> Column:
    """Words of the retrieval form; an empty text has none. ``ui`` also takes the article off longer words."""
    words = F.filter(F.split(normalize(c, profile), " "), lambda w: w != "")
    # words without these two letters, nearly all in other scripts, skip the slow step
    return F.transform(words, lambda w: F.when(w.contains("ال"), F.regexp_replace(w, ARTICLE_PREFIX, "")).otherwise(w)) if profile == "ui" else words


def lexical_text(law: Column, text: Column) -> Column:
    """The law's name twice, then the text: the name counts double in term frequencies."""
    name = strip(F.coalesce(law, F.lit("")))
    twice = F.when(name != "", F.concat(name, F.lit(" "), name, F.lit(" "))).otherwise("")
    return F.rtrim(F.concat(twice, strip(F.coalesce(text, F.lit("")))))  # both are stripped: only the blank between them may be left over


def harness_text(normalized: Column, raw: Column) -> Column:
    return filled(normalized, raw)


def record_fields(document_id: Column, alt_id: Column, row: Column, content: Column, raw: Column, normalized: Column, title: Column, embedding: Column, law: Column, article: Column) -> list[Column]:
    """One record from its possible spellings: empty strings fall through to the next one."""
    return [
        filled(document_id, alt_id, row.cast("string")).alias("document_id"),
        F.coalesce(filled(content, raw, normalized), F.lit("")).alias("text"),
        F.coalesce(filled(title, embedding), F.lit("")).alias("title"),
        F.coalesce(filled(law), F.lit(UNKNOWN_LAW)).alias("law_name"),
        F.coalesce(filled(article), F.lit(NO_ARTICLE)).alias("article_id"),
    ]


def eval_query(raw: Column, max_chars: int = 140, min_chars: int = 15) -> Column:
    """A query cut from a text: heading off, up to the first sentence end, null if too short."""
    body = strip(F.regexp_replace(F.coalesce(raw, F.lit("")), HEADING_PREFIX, ""))
    piece = strip(F.substring(F.regexp_extract(body, r"(?s)^[^.\x{06D4}؟!]*", 0), 1, max_chars))
    return F.when(F.length(piece) >= min_chars, piece)


def pair_text(law: Column, text: Column, max_chars: int = 3500) -> Column:
    return F.substring(F.concat(F.coalesce(law, F.lit("")), F.lit(": "), F.coalesce(text, F.lit(""))), 1, max_chars)


def source_block(number: Column, law: Column, article: Column, text: Column, document_id: Column) -> Column:
    """Four lines that name and quote one source."""
    title = F.coalesce(filled(squeeze(law)), F.lit(DEFAULT_TITLE))
    return F.concat(
        F.lit("[SOURCE "), number.cast("string"), F.lit("]\nالعنوان: "), title, F.lit(" - المادة "), F.coalesce(article, F.lit("")),
        F.lit("\nالنص: "), squeeze(F.coalesce(text, F.lit(""))), F.lit("\nمعرّف المصدر: "), F.coalesce(document_id, F.lit("None")),
    )


def has_injection(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for phrase in INJECTION_PHRASES:
        out = out | text.contains(phrase)
    return out


def strip_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<\|thinking\|>.*?<\|/thinking\|>", ""))


def prompt(system: str, query: Column, context: Column, instructions: str) -> Column:
    return F.concat(F.lit(f"SYSTEM:\n{system}\n\nLEGAL_CONTEXT:\n"), context, F.lit("\n\nUSER_QUERY:\n"), query, F.lit(f"\n\nINSTRUCTIONS:\n{instructions}"))


def messages(system: str, user: Column) -> Column:
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(one("system", F.lit(system)), one("user", user))


def digest(c: Column) -> Column:
    """SHA-256 of a text, null counting as empty."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)
