"""Personal data by weak supervision, in DataFrame expressions only.

Four base kinds (email, ip, card, phone) are found by pattern and check; they always stay. Further candidates (long
mixed tokens, national phone numbers, identity numbers, bank accounts with right check digits, street addresses, names) get votes from labelers of
three sorts: patterns of the span's shape, gazetteers and number ranges, and the words before it. Votes are counted by
their combination; expectation-maximisation over these counts estimates how reliable each labeler is, and so how likely
each combination is personal. A logistic classifier is then fitted to these likelihoods on features that no labeler sees:
length, shares of digits and capitals, variety of characters, what stands right before and after, place in the line. Its
linear form is applied as a column expression and decides. What reaches the driver is one row for each combination of
votes and features; features have a few values each, so their number is bounded whatever the size of the table.

Positions are code points. They come from the pieces between matches, whose lengths are summed in blocks, and candidates
are held against base spans by running maxima over both in order; so a text with very many matches costs little more
than linear time. All patterns are linear: runs are possessive, and a run is only entered at its start or right after a
match.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Fixed patterns of the base kinds, in the order of their rank in results.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Gazetteers. Prefixes of issued keys, cue words by kind, kinds of streets, titles, first names, countries.
KEY_PREFIXES = "AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|sk_|pk_|rk_|xox[abprs]-|eyJ|ya29|npm_|pypi-|SG|hf_|dop_v1_|shpat_|key-|whsec_"
CUES = {
    "secret": "pass(?:word|wd|phrase)?|pwd|token|secret|key|auth|bearer|credential",
    "phone": "tel|phone|call|fax|mobile|cell|dial",
    "id": "ssn|social|passport|identity|taxpayer|tin|id",
    "iban": "iban|account|acct|bank|konto|cuenta|compte|transfer",
    "street": "address|live|lives|lived|living|resides|at|to|adresse|mail",
    "name": "name|dear|contact|by|from|signed|regards|sincerely|patient|client|with",
}
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq|Terrace|Highway|Hwy|Way|Place|Pl|Parkway|Pkwy|Circle|Crescent|Close|Alley|Row|Trail|Gardens"
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Rev|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Signor|Signora|Don|Doña"
FIRST_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Nancy|Matthew|Lisa|Anthony|Margaret|Mark|Sandra|Steven|Ashley"
    "|Andrew|Emily|Joshua|Donna|Kenneth|Michelle|Kevin|Carol|Brian|Amanda|George|Melissa|Timothy|Deborah|Edward|Stephanie|Jason|Rebecca|Jeffrey|Laura|Ryan|Helen|Jacob|Sharon|Nicholas|Cynthia|Eric|Kathleen|Jonathan|Amy"
    "|Paul|Anna|Peter|Maria|Hans|Jürgen|Sabine|Klaus|Ursula|Wolfgang|Monika|Stefan|Petra|Andreas|Claudia|Matthias|Heike|Pierre|Marie|Jean|Isabelle|François|Nathalie|Philippe|Céline|Laurent|Sophie|Olivier|Camille"
    "|Carlos|Juan|José|Carmen|Luis|Ana|Miguel|Lucía|Antonio|Pilar|Javier|Marta|Francesco|Giulia|Giovanni|Chiara|Mohammed|Fatima|Ahmed|Aisha|Omar|Layla|Ali|Yusuf|Priya|Rahul|Wei|Yuki|Hiroshi|Olga|Ivan|Natalia|Dmitri"
)
COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
#: Patterns of candidates, by kind; of secrets there is no pattern but a long run of their characters.
SHAPES = {
    "id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "iban": r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "street": rf"(?=[0-9])(?<![0-9.])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:{STREETS})(?![a-z])",
    "name": rf"(?=[A-Z])(?<!\p{{L}})(?:(?:{TITLES})\.? [A-Z]\p{{Ll}}{{1,20}}|(?:{FIRST_NAMES}) [A-Z]\p{{Ll}}{{1,20}})(?!\p{{L}})",
}
#: A long run is entered at the start of a word, or where the last match ends, and nowhere else.
CANDIDATE = "(?=[A-Za-z0-9(])(?:" + "|".join(SHAPES.values()) + r"|(?:\G|(?<![A-Za-z0-9]))[A-Za-z0-9][A-Za-z0-9_/+-]{14,}+)"
#: Weight of the prior on a labeler's rates, as a share of all candidates of a kind.
PRIOR = 0.005
#: What the counts of a fit add up to.
SCALE = 1000.0
LABELERS = ("shape", "issued", "cue", "mixed", "plain")
KINDS = ("email", "ip", "card", "phone", "id", "secret", "iban", "street", "name")
#: Features and how many values each of them has, from 0.
FEATURES = {"size": 4, "digits": 4, "capitals": 3, "variety": 4, "before": 4, "after": 4, "assigned": 2, "first": 2}
BLOCK = 256
CONTEXT = 24


def running(values: Column, kind: str, zero: Column, join) -> Column:
    """The running ``join`` (associative) of an array of ``kind``: in blocks of BLOCK, then block by block."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    start = F.struct(zero.alias("s"), none.alias("a"))
    inner = lambda part: F.aggregate(part, start, lambda acc, x: F.struct(join(acc["s"], x).alias("s"), F.concat(acc["a"], F.array(join(acc["s"], x))).alias("a")))["a"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda j: inner(F.slice(values, j * BLOCK + 1, F.lit(BLOCK))))
    begin = F.struct(zero.alias("s"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("a"))
    joined = F.aggregate(blocks, begin, lambda acc, b: F.struct(join(acc["s"], F.element_at(b, -1)).alias("s"), F.concat(acc["a"], F.array(F.transform(b, lambda x: join(acc["s"], x)))).alias("a")))["a"]
    return F.when(F.size(values) == 0, none).when(F.size(values) <= BLOCK, inner(values)).otherwise(F.flatten(joined))


def running_sum(values: Column) -> Column:
    return running(values, "int", F.lit(0), lambda x, y: x + y)


def located(df: DataFrame, name: str, pattern: str, text: str = "_text") -> DataFrame:
    """Add ``name``: array of (start, end, body, left, right) of all matches; left is the end of the text between a match
    and the one before it, right the beginning of that after it."""
    none = F.expr("cast(array() as array<string>)")
    some = F.col(text).rlike(pattern)
    df = df.withColumn("_m", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    n = F.size("_m")
    gaps = F.zip_with(F.transform(F.slice("_p", F.lit(1), n), F.length), F.concat(F.array(F.lit(0)), F.transform(F.slice("_m", F.lit(1), F.greatest(n - 1, F.lit(0))), F.length)), lambda p, m: p + m)
    df = df.withColumn("_g", F.when(n > 0, gaps).otherwise(F.expr("cast(array() as array<int>)")))
    df = df.withColumn("_s", F.when(n > 0, running_sum(F.col("_g"))).otherwise(F.expr("cast(array() as array<int>)")))
    spans = F.transform(F.arrays_zip(F.col("_s").alias("s"), F.col("_m").alias("m"), F.slice("_p", F.lit(1), n).alias("p"), F.slice("_p", F.lit(2), n).alias("q")), lambda z: F.struct(z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end"), z["m"].alias("body"), F.substring(z["p"], -CONTEXT, CONTEXT).alias("left"), F.substring(z["q"], 1, 1).alias("right")))
    return df.withColumn(name, spans).drop("_m", "_p", "_g", "_s")


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Double every second digit from the right; the sum of all digits must be divisible by ten."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def is_fine(kind: str, body: Column) -> Column:
    if kind == "ip":
        return body.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        number = digits(body)
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(body)).between(10, 15)
    return F.lit(True)


def valid_iban(body: Column) -> Column:
    """Country, and the check digits: moved to the end, with letters as two digits from ten, the number is 1 modulo 97."""
    plain = F.replace(body, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return plain.rlike(f"^(?:{COUNTRIES})") & (rest == 1)


def kind_of(body: Column) -> Column:
    """The first kind whose pattern the whole candidate has; else a secret."""
    out, whole = None, lambda kind: body.rlike(f"^(?:{SHAPES[kind]})$")
    for kind in SHAPES:
        out = F.when(whole(kind), kind) if out is None else out.when(whole(kind), kind)
    return out.otherwise("secret")


def by_kind(kind: Column, other: Column, **votes: Column) -> Column:
    """The vote of the candidate's kind, ``other`` for kinds without one."""
    for k, vote in votes.items():
        other = F.when(kind == k, vote).otherwise(other)
    return other


def judged(c: Column, kind: Column) -> Column:
    """Kind, place, votes (1 personal, 0 not, -1 silent) and features of a candidate (start, end, body, left, right)."""
    body, left = c["body"], F.lower(c["left"])
    number, length = digits(body), F.length(body)
    share = F.length(number) / length
    vote = lambda c: F.when(c, 1).otherwise(0)
    shape = vote(body.rlike("^(?:[0-9a-f]{16,}|[A-Z0-9]{16,}|[A-Za-z0-9_-]{32,})$") & body.rlike("[0-9]") & body.rlike("[A-Za-z]"))
    key = F.when(body.rlike(f"^(?:{KEY_PREFIXES})"), 1).otherwise(-1)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, left.rlike(rf"(?:^|[^a-z])(?:{words})[^a-z0-9]*$") if k != "secret" else left.rlike(rf"(?:{words})[^a-z0-9]*$")).otherwise(cue)
    mixed = F.when(kind == "secret", vote(share.between(0.15, 0.9) & (F.size(F.array_distinct(F.split(body, ""))) >= 9))).otherwise(-1)
    plain = F.when(kind == "name", -1).when(body.rlike("[/+_-].*[/+_-].*[/+_-]") | left.rlike("[/.=]$") & ~left.rlike(f"(?:{CUES['secret']})") | ~body.rlike("[0-9]"), 0).otherwise(-1)
    step = lambda x, *cuts: sum((F.when(x >= v, 1).otherwise(0) for v in cuts), F.lit(0)).cast("int")
    beside = lambda x: F.when(x.isNull() | x.rlike(r"^[\s]?$"), 0).when(x.rlike("[\"'`=:]"), 1).when(x.rlike("[/.@_-]"), 2).otherwise(3)
    facts = {
        "size": step(length, 18, 32, 48), "digits": step(share, 0.15, 0.5, 0.9), "capitals": step(F.length(F.regexp_replace(body, "[^A-Z]", "")) / length, 0.01, 0.5),
        "variety": step(F.size(F.array_distinct(F.split(body, ""))) / length, 0.3, 0.5, 0.7), "before": beside(F.substring(c["left"], -1, 1)), "after": beside(c["right"]),
        "assigned": vote(left.rlike("[=:]\\s*[\"']?$")), "first": vote((c["start"] == 0) | left.rlike("\\n\\s*$")),
    }
    return F.struct(
        kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        by_kind(kind, shape, id=F.lit(1), phone=F.lit(1), iban=F.lit(1), street=F.lit(1), name=F.lit(-1)).alias("shape"),
        by_kind(kind, key, phone=vote(number.rlike("^[2-9][0-9]{2}[2-9]")), id=vote(~number.rlike("^(?:000|666|9)")), iban=F.lit(1), street=F.lit(1), name=F.lit(1)).alias("issued"),
        F.when(cue, 1).otherwise(-1).alias("cue"), mixed.alias("mixed"), plain.alias("plain"), *[facts[f].alias(f) for f in FEATURES],
    )


def kept_spans(kind: str) -> Column:
    fine = F.filter(f"_{kind}", lambda c: is_fine(kind, c["body"]))
    return F.transform(fine, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("long")


def apart_from(df: DataFrame, spans: str, base: str, out: str) -> DataFrame:
    """Add ``out``: those of the array ``spans`` (structs with start and end) that no span of ``base`` touches: none before
    them reaches in, none begins in them. Each step is a column of its own, since what a lambda refers to is otherwise
    made anew for each element."""
    kind = df.schema[spans].dataType.elementType.simpleString()
    event = lambda c, own, payload: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(own).alias("own"), payload.alias("c"))
    last, none = 2**31 - 1, F.lit(None).cast(kind)
    both = F.concat(F.transform(base, lambda c: event(c, False, none)), F.transform(spans, lambda c: event(c, True, c)))
    df = df.withColumn("_rows", F.when((F.size(spans) > 0) & (F.size(base) > 0), F.array_sort(both)).otherwise(F.slice(both, 1, 0)))
    df = df.withColumn("_ends", F.transform("_rows", lambda e: F.when(e["own"], -1).otherwise(e["end"])))
    df = df.withColumn("_starts", F.transform(F.reverse("_rows"), lambda e: F.when(e["own"], last).otherwise(e["start"])))
    df = df.withColumn("_reach", running(F.col("_ends"), "int", F.lit(-1), lambda x, y: F.greatest(x, y)))
    df = df.withColumn("_ahead", F.reverse(running(F.col("_starts"), "int", F.lit(last), lambda x, y: F.least(x, y))))
    free = F.filter(F.arrays_zip("_rows", "_reach", "_ahead"), lambda z: z["_rows"]["own"] & (z["_reach"] <= z["_rows"]["start"]) & (z["_ahead"] >= z["_rows"]["end"]))
    kept = F.when((F.size(spans) == 0) | (F.size(base) == 0), F.col(spans)).otherwise(F.transform(free, lambda z: z["_rows"]["c"]))
    return df.withColumn(out, kept).drop("_rows", "_ends", "_starts", "_reach", "_ahead")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (kind, start, end), more (judged candidates that touch no base span) for every row."""
    df = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind, pattern in BASE.items():
        df = located(df, f"_{kind}", pattern)
    df = located(df, "_more", CANDIDATE)
    df = df.withColumn("base", F.concat(*[kept_spans(kind) for kind in BASE]))
    kinds = F.transform(F.filter("_more", lambda c: c["body"].rlike("[0-9]| ")), lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "body", "left", "right")], kind_of(c["body"]).alias("kind")))
    fine = F.filter("_kinds", lambda c: (c["kind"] != "iban") | valid_iban(c["body"]))  # like a card without its check digit
    df = df.withColumn("_kinds", kinds).withColumn("_kinds", fine)
    df = apart_from(df, "_kinds", "base", "_apart")
    return df.select("doc_id", "base", F.transform("_apart", lambda c: judged(c, c["kind"])).alias("more"))


def estimated(rows: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[list[float], list[dict], list[dict]]:
    """EM for independent labelers with a hidden truth: (P(personal) for each row's votes, each labeler's rates of its three
    outcomes among personal candidates, and among others). Counts weigh the rows.

    Silence is an outcome like a vote: a labeler that says yes or nothing is worth as much as one that says yes or no. Each
    rate has a prior, worth PRIOR of all candidates: as silent as the labeler is on the whole, and right in four of five
    votes. So only shares of combinations matter, not how many candidates there are. Beliefs start from the share of
    positive votes.
    """
    total = sum(c for _, c in rows)
    labelers = range(len(rows[0][0]))
    share = [{v: sum(c for votes, c in rows if votes[j] == v) / total for v in (-1, 0, 1)} for j in labelers]
    guess = lambda j, good: {-1: share[j][-1], 1: (1 - share[j][-1]) * good, 0: (1 - share[j][-1]) * (1 - good)}
    belief = []
    for votes, _ in rows:
        cast = [v for v in votes if v >= 0]
        belief.append((sum(cast) + 0.5) / (len(cast) + 1) if cast else 0.5)
    rates = []
    for _ in range(rounds):
        prior = (sum(b * c for b, (_, c) in zip(belief, rows)) / total + PRIOR) / (1 + 2 * PRIOR)
        rates = []
        for good, weights in ((0.8, belief), (0.2, [1 - b for b in belief])):
            held = sum(w * c for w, (_, c) in zip(weights, rows)) / total
            rates.append([{v: (sum(w * c for w, (votes, c) in zip(weights, rows) if votes[j] == v) / total + PRIOR * p) / (held + PRIOR) for v, p in guess(j, good).items()} for j in labelers])
        new = []
        for votes, _ in rows:
            z = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                yes, no = rates[0][j][v], rates[1][j][v]
                if yes > 0 and no > 0:
                    z += math.log(yes / no)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        done = max(abs(x - y) for x, y in zip(belief, new)) < 1e-9
        belief = new
        if done:
            break
    return belief, rates[0], rates[1]


def features(row: dict) -> list[float]:
    """One number for each value of each feature but the first, and for each kind but the first."""
    kinds = [float(row["kind"] == k) for k in KINDS[1:]]
    return [1.0, *kinds, *[float(row[f] == v) for f, n in FEATURES.items() for v in range(1, n)]]


def fit(rows: list[tuple[list[float], float, int]], rounds: int = 30, ridge: float = 0.1) -> list[float]:
    """Logistic regression on expected labels by Newton's method; rows are (features, likelihood, count). Counts are scaled to
    SCALE together, so that the ridge weighs alike in small and large tables."""
    x, y, n = (np.array([r[i] for r in rows], float) for i in range(3))
    n = n * (SCALE / n.sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    return w.tolist()


def linear(w: list[float], c: Column) -> Column:
    """The classifier's logit of a judged candidate as an expression."""
    facts = [F.lit(True), *[c["kind"] == k for k in KINDS[1:]], *[c[f] == v for f, n in FEATURES.items() for v in range(1, n)]]
    out = F.lit(0.0)
    for v, fact in zip(w, facts):
        out = out + F.when(fact, v).otherwise(0.0)
    return out


def likelihoods(counts: list[dict]) -> list[float]:
    """How likely each combination of votes and features is personal, by its votes alone, estimated kind by kind."""
    votes: dict[str, dict[tuple[int, ...], int]] = {}
    for r in counts:
        of = votes.setdefault(r["kind"], {})
        key = tuple(r[x] for x in LABELERS)
        of[key] = of.get(key, 0) + r["count"]
    belief = {kind: dict(zip(of, estimated(list(of.items()))[0])) for kind, of in votes.items()}
    return [belief[r["kind"]][tuple(r[x] for x in LABELERS)] for r in counts]


def learned(counts: list[dict]) -> list[float]:
    """The classifier's weights from counted combinations of kind, votes and features."""
    return fit([(features(r), b, r["count"]) for r, b in zip(counts, likelihoods(counts))])


def find_pii(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by start, then kind) for every row of ``docs``.

    Null and empty texts have no spans. Rows that repeat and rows with a null key are handled each on its own. Very long
    texts are searched whole, in about linear time. Extra spans touch no base span; without candidates nothing is added.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    found = written(spark, candidates(docs, key, text), "pii")
    facts = ["kind", *LABELERS, *FEATURES]
    counts = [r.asDict() for r in found.select(F.explode("more").alias("c")).select(*[F.col(f"c.{f}") for f in facts]).groupBy(*facts).count().collect()]  # combinations of facts
    counts.sort(key=lambda r: tuple(str(r[f]) for f in facts))
    more = F.col("more")
    if counts:
        w = learned(counts)
        more = F.filter("more", lambda c: linear(w, c) >= 0)
    added = F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.concat("base", added)).alias("spans"))


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
