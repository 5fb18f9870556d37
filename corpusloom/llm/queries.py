"""The registered queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.classifiers import crc_of, identify_language, learn_language, learn_quality, score_quality
from corpusloom.llm.common import read_documents
from corpusloom.llm.decontaminate import contamination
from corpusloom.llm.encoding import default_path
from corpusloom.llm.line_dedup import LineIndex, strip_shared_lines
from corpusloom.llm.merkle import checked, leaf_digest, merkle_manifest
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.periods import longest_run, periodic_runs
from corpusloom.llm.pii import BASE, count_of, find_pii, joined
from corpusloom.llm.sharding import shard_by_bytes
from corpusloom.llm.simhash import near_duplicates
from corpusloom.llm.substrings import remove_repeats
from corpusloom.llm.token_files import token_files
from corpusloom.llm.topk import top_k


def op1_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark, read_documents(spark, sf_dir), shards=8)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    index = LineIndex(spark)
    index.insert(docs)
    out = strip_shared_lines(index, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line,
         translate(trim(line, e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
shared AS (SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT l.doc_id, l.n, l.line, coalesce(s.first_doc < l.doc_id, false) AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = crc_of("doc_id") % 3
    out = score_quality(spark, docs, learn_quality(docs, labels, fold != 1))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark, read_documents(spark, sf_dir), default_path("byte_bpe_50k.json"), spaced=True, end_id=2, capacity=1024)
    digest = packed.pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packed.assign(digest)


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read_documents(spark, sf_dir), crc_of("doc_id") % 4
    out = identify_language(spark, docs, learn_language(docs, fold != 2))
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(spark, read_documents(spark, sf_dir))
    counts = [count_of(kind).alias(f"n_{kind}") for kind in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, read_documents(spark, sf_dir), words=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10, scale=1024)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scores)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10
"""


def op9_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files(spark, read_documents(spark, sf_dir), default_path("word_bpe_49k.json"), spaced=False, end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark, read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("items") > 0)
    return out.select("doc_id", F.lit(True).alias("contaminated"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


#: CRC-32 of a decimal number, bit by bit: DuckDB has no such function.
CRC_SQL = """xor(list_reduce(list_transform(range(-1, 8 * len(CAST(doc_id AS VARCHAR))), lambda k:
  CASE WHEN k < 0 THEN 4294967295 WHEN k % 8 = 0 THEN CAST(ascii(CAST(doc_id AS VARCHAR)[k // 8 + 1]) AS BIGINT) ELSE 0 END),
  lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)"""


def op11_merkle_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row by hash is tampered with: line ends go from its text."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.when(crc_of("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = read_documents(spark, sf_dir).withColumn("held", leaf_digest(*[text if f == "text" else F.col(f) for f in fields]))
    manifest = merkle_manifest(spark, docs, fields=fields, keep=["held"])
    out = checked(manifest, "held", ["doc_id", "leaf", "subroot", "root"])
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaf_sql(text: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    return f"sha256({' || '.join(part.format(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


OP11_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT *, {leaf_sql('text')} AS leaf, {leaf_sql('tampered')} AS held,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {CRC_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents)),
low AS (
  SELECT s, 0 AS level, i, leaf AS h, n FROM docs
  UNION ALL
  SELECT s, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY s, level, i // 3, n),
subroots AS MATERIALIZED (SELECT s, h AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, s AS i, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3, n),
nodes AS MATERIALIZED (
  SELECT s AS tree, level, i, h, n FROM low UNION ALL SELECT -1, level, i, h, n FROM high),
siblings AS (
  SELECT d.doc_id, 0 AS part, k.level, k.i, k.h FROM docs d JOIN nodes k ON k.tree = d.s AND k.n > 1
    AND k.i // 3 = d.i // CAST(3 ** (k.level + 1) AS BIGINT) AND k.i <> d.i // CAST(3 ** k.level AS BIGINT)
  UNION ALL
  SELECT d.doc_id, 1, k.level, k.i, k.h FROM docs d JOIN nodes k ON k.tree = -1 AND k.n > 1
    AND k.i // 3 = d.s // CAST(3 ** (k.level + 1) AS BIGINT) AND k.i <> d.s // CAST(3 ** k.level AS BIGINT)),
proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY part, level, i)) AS proof_sha256 FROM siblings GROUP BY 1),
folded AS (
  SELECT doc_id, s, s AS tree, 0 AS level, i, held AS h, n FROM docs
  UNION ALL
  SELECT f.doc_id, f.s, CASE WHEN f.n = 1 THEN -1 ELSE f.tree END, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END,
         CASE WHEN f.n = 1 THEN f.s ELSE f.i // 3 END,
         CASE WHEN f.n = 1 THEN any_value(f.h) ELSE sha256(string_agg(CASE WHEN k.i = f.i THEN f.h ELSE k.h END, '' ORDER BY k.i)) END,
         CASE WHEN f.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (f.n + 2) // 3 END
  FROM folded f JOIN nodes k ON k.tree = f.tree AND k.level = f.level AND k.i // 3 = f.i // 3
  WHERE f.n > 1 OR f.tree >= 0 GROUP BY f.doc_id, f.s, f.tree, f.level, f.i, f.n)
SELECT d.doc_id, d.leaf, r.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM docs d JOIN subroots r USING (s) JOIN (SELECT h FROM high WHERE n = 1) t ON true LEFT JOIN proofs p USING (doc_id)
JOIN (SELECT doc_id, h FROM folded WHERE tree = -1 AND n = 1) f USING (doc_id)
"""


def op12_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, read_documents(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, unnest(range(greatest(len(w) - 19, 0))) AS i,
         unnest(list_transform(range(greatest(len(w) - 19, 0)), lambda j: sha256(array_to_string(w[j + 1:j + 20], ' ')))) AS k FROM words),
firsts AS (SELECT k, min(struct_pack(doc_id := doc_id, i := i)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows JOIN firsts USING (k) WHERE struct_pack(doc_id := doc_id, i := i) > f),
lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY 1),
flat AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM words),
kept AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.i) AS t FROM flat f ANTI JOIN gone g ON g.doc_id = f.doc_id AND g.i = f.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document by hash the words from a place on repeat, with a period of a few parts of them."""
    h = crc_of("doc_id")
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    text = F.when((h % 10 == 0) & (F.size(words) > 0), F.transform(F.array(words), repeat)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_harmonic_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(spark, planted_periods(read_documents(spark, sf_dir)), exponent=4, least=6)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest_run().alias("r"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP13_SQL = rf"""
WITH hashed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         {CRC_SQL} AS h FROM documents),
parts AS (SELECT *, h // 10 AS g, len(w) AS n FROM hashed),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM parts),
words AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w
  FROM placed),
flat AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM words),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, p, min(i) AS s, max(i) + 1 + p AS e FROM islands GROUP BY doc_id, p, island),
runs AS MATERIALIZED (SELECT doc_id, s, e, min(p) AS p FROM stretches WHERE e - s >= greatest(6, 4 * p) GROUP BY doc_id, s, e),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, p) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, e)) AS i FROM runs),
kept AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.i) AS t FROM flat f ANTI JOIN gone g ON g.doc_id = f.doc_id AND g.i = f.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.e - b.s AS length, b.p AS period, 1000 * (b.e - b.s) // b.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_histogram_sort_sharding": op1_histogram_sort_sharding,
        "op2_line_dedup": op2_line_dedup,
        "op3_byte_cnn_quality": op3_byte_cnn_quality,
        "op4_complement_packing": op4_complement_packing,
        "op5_byte_cnn_language": op5_byte_cnn_language,
        "op6_weak_supervision_pii": op6_weak_supervision_pii,
        "op7_pigeonhole_simhash": op7_pigeonhole_simhash,
        "op8_uniform_threshold_topk": op8_uniform_threshold_topk,
        "op9_rans_token_files": op9_rans_token_files,
        "op10_spaced_seed_decontamination": op10_spaced_seed_decontamination,
        "op11_merkle_forest": op11_merkle_forest,
        "op12_seed_extend": op12_seed_extend,
        "op13_harmonic_periods": op13_harmonic_periods,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op8_uniform_threshold_topk": OP8_SQL, "op11_merkle_forest": OP11_SQL, "op12_seed_extend": OP12_SQL, "op13_harmonic_periods": OP13_SQL}
