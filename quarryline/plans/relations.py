"""Relations that the registered queries share, built from the test tables, and the same in SQL.

Vectors are `embeddings`; a document holds the vectors of one label within a run of
30 numbers. Questions are the vectors whose number divides by 100, each against all
other vectors. Model scores that the engine takes as inputs (rerank, entailment) are
synthetic here: fixed functions of vector products, no model's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cls_max, dot, doubles, logsumexp, maxsim
from ..operators import search
from ..operators.graph import section_pairs

EXPAND, K, M = 60, 20, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = (F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / 30)).cast("long")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec_pos"), doc.alias("doc_idx"), "label", doubles("embedding").alias("vector"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("vec_pos") % 100 == 0).select(F.col("vec_pos").alias("sample_id"), F.col("label").alias("truth"), "vector")


def hits(spark: SparkSession, sf_dir: str, expand: int = EXPAND) -> DataFrame:
    """The expand best vectors of each sample with their documents."""
    v = vectors(spark, sf_dir)
    found = search.top_k(samples(spark, sf_dir), v, expand)
    return found.join(v.select("vec_pos", "doc_idx", "label"), "vec_pos")


SCORED = """
v AS (SELECT vec_id AS vec_pos, CAST(label AS BIGINT) * 1000000 + vec_id // 30 AS doc_idx, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
q AS (SELECT vec_pos AS sample_id, label AS truth, vector FROM v WHERE vec_pos % 100 = 0),
scored AS (SELECT q.sample_id, q.truth, v.vec_pos, v.doc_idx, v.label, list_dot_product(q.vector, v.vector) AS score FROM q JOIN v ON q.sample_id <> v.vec_pos)"""
HITS = SCORED + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, vec_pos) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= {EXPAND})"""


def doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each document, K documents at most."""
    return search.first_per_document(hits(spark, sf_dir), K)


DOC_HITS = HITS + f""",
firsts AS (SELECT *, row_number() OVER (PARTITION BY sample_id, doc_idx ORDER BY rank) AS n FROM hits),
doc_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS doc_rank FROM firsts WHERE n = 1) WHERE doc_rank <= {K})"""


def candidates(spark: SparkSession, sf_dir: str, m: int = M) -> DataFrame:
    """The m best hits of each sample as its sections: idx from 0, similarity, rerank (synthetic), vector."""
    v = vectors(spark, sf_dir)
    found = search.top_k(samples(spark, sf_dir), v, m)
    out = found.join(v, "vec_pos")
    return out.select("sample_id", (F.col("rank") - 1).cast("int").alias("idx"), "vec_pos", "doc_idx", F.col("score").alias("similarity"), (F.col("score") * 4 - F.pmod("vec_pos", F.lit(7)) / 10.0).alias("rerank"), "vector")


CANDIDATES = HITS + f""",
cand AS (SELECT h.sample_id, CAST(h.rank - 1 AS INTEGER) AS idx, h.vec_pos, h.doc_idx, h.score AS similarity, h.score * 4 - (h.vec_pos % 7) / 10.0::DOUBLE AS rerank, v.vector
  FROM ranked h JOIN v ON h.vec_pos = v.vec_pos WHERE h.rank <= {M})"""


def relations(spark: SparkSession, sf_dir: str, cands: DataFrame | None = None) -> DataFrame:
    """All pairs of a sample's sections (cands) with synthetic relation probabilities of both directions."""
    pairs = section_pairs((cands if cands is not None else candidates(spark, sf_dir)).select("sample_id", "idx", "vec_pos", "vector"))
    s = pairs.select("sample_id", "i", "j", (dot("vector_i", "vector_j") / 2 + 0.5).alias("s"), F.pmod(F.col("vec_pos_i") + F.col("vec_pos_j"), F.lit(5)).alias("r"))
    ent, con = F.col("s") * (1 - F.col("r") * 0.1), (1 - F.col("s")) * F.col("r") * 0.2
    return s.select("sample_id", "i", "j", ent.alias("ent_ij"), con.alias("con_ij"), (1 - ent - con).alias("neu_ij"), (ent * 0.9).alias("ent_ji"), con.alias("con_ji"), (1 - ent * 0.9 - con).alias("neu_ji"))


RELATIONS = CANDIDATES + """,
pair AS (SELECT a.sample_id, a.idx AS i, b.idx AS j, list_dot_product(a.vector, b.vector) / 2 + 0.5::DOUBLE AS s, (a.vec_pos + b.vec_pos) % 5 AS r FROM cand a JOIN cand b ON a.sample_id = b.sample_id AND a.idx < b.idx),
p1 AS (SELECT sample_id, i, j, s * (1 - r * 0.1::DOUBLE) AS ent, (1 - s) * r * 0.2::DOUBLE AS con FROM pair),
rel AS (SELECT sample_id, i, j, (ent + ent * 0.9::DOUBLE) / 2 AS p_ent, con AS p_con, ((1 - ent - con) + (1 - ent * 0.9::DOUBLE - con)) / 2 AS p_neu, ent - con AS d1, ent * 0.9::DOUBLE - con AS d2 FROM p1)"""

#: Gates of the registered graphs.
GATES = {"e_min": 0.45, "margin": 0.15, "tau": 0.25}
EDGES = RELATIONS + f""",
edge AS (SELECT sample_id, i, j, least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_ent - p_con)) AS weight FROM rel
  WHERE p_ent >= {GATES['e_min']} AND p_ent - p_con >= {GATES['margin']} AND least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_ent - p_con)) >= {GATES['tau']})"""


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("sec"), "vec_id", doubles("embedding").alias("x"))
    rows = e.groupBy("sec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("t")).filter(F.size("t") == 8)
    return rows.select("sec", F.transform("t", lambda r: r["x"]).alias("tokens"), F.transform("t", lambda r: r["vec_id"] % 5 != 0).alias("mask"))


def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents that image search finds for each sample, with the scores that late interaction ranks by.

    A section is a run of eight vectors with one of its document in it, numbered
    within the document; its vectors are its tokens, masked where their number divides
    by 5. A sample asks with the first four of its own run.
    """
    tokens = _token_rows(spark, sf_dir)
    own = vectors(spark, sf_dir).select("doc_idx", "label", F.floor(F.col("vec_pos") / 8).cast("long").alias("sec")).distinct().join(tokens, "sec")
    sections = own.withColumn("section_idx", search.rank_by("doc_idx", F.asc("sec")) - 1)
    ask = tokens.select(F.col("sec").alias("asked"), F.slice("tokens", 1, 4).alias("q"))
    found = doc_hits(spark, sf_dir).select("sample_id", "doc_idx", "doc_rank", "score")
    pairs = found.select("sample_id", "doc_idx", "doc_rank").join(sections, "doc_idx").withColumn("asked", F.floor(F.col("sample_id") / 8).cast("long")).join(F.broadcast(ask), "asked")
    scored = pairs.select(
        "sample_id", "doc_idx", "doc_rank", "label", "section_idx", cls_max("q", F.get("tokens", F.lit(0))).alias("cls_max"), maxsim("q", "tokens", "mask").alias("maxsim"), logsumexp("q", "tokens", "mask").alias("lse"),
    )
    return search.score_by_document(scored, found, "score").withColumnRenamed("score", "vision")


SECTION_SCORES = DOC_HITS + """,
tok AS (SELECT vec_id // 8 AS sec, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) FILTER (vec_id % 5 <> 0) AS kept, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS every FROM embeddings GROUP BY ALL HAVING count(*) = 8),
own AS (SELECT DISTINCT doc_idx, label, vec_pos // 8 AS sec FROM v),
sect AS (SELECT doc_idx, own.label, tok.*, row_number() OVER (PARTITION BY doc_idx ORDER BY sec) - 1 AS section_idx FROM own JOIN tok USING (sec)),
prods AS (SELECT d.sample_id, d.truth, d.doc_idx, d.doc_rank, d.score AS vision, s.label, s.section_idx, list_transform(a.every[1:4], lambda x: list_transform(s.kept, lambda y: list_dot_product(x, y))) AS m, list_transform(a.every[1:4], lambda x: list_dot_product(x, s.every[1])) AS c
  FROM doc_hits d JOIN sect s USING (doc_idx) JOIN tok a ON a.sec = d.sample_id // 8),
sscore AS (SELECT sample_id, truth, doc_idx, doc_rank, vision, label, section_idx, list_max(c) AS cls_max, list_avg(list_transform(m, lambda r: list_max(r))) AS maxsim,
  list_avg(list_transform(m, lambda r: list_max(r) + ln(list_sum(list_transform(r, lambda x: exp(x - list_max(r))))) - ln(len(r)::DOUBLE))) AS lse FROM prods),
variants AS (SELECT * EXCLUDE (cls_max, maxsim, lse), unnest(['cls_max', 'maxsim', 'logsumexp', 'vision_maxsim', 'vision_cls_max']) AS variant, unnest([cls_max, maxsim, lse, 0.5::DOUBLE * vision + 0.5::DOUBLE * maxsim, 0.5::DOUBLE * vision + 0.5::DOUBLE * cls_max]) AS variant_score FROM sscore),
vranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, variant ORDER BY variant_score DESC, doc_rank, section_idx) AS section_rank FROM variants),
vfirst AS (SELECT *, min(section_rank) OVER (PARTITION BY sample_id, variant, doc_idx) = section_rank AS first FROM vranked),
vplaced AS (SELECT *, CASE WHEN NOT starts_with(variant, 'vision') THEN section_rank WHEN first THEN count(*) FILTER (first) OVER (PARTITION BY sample_id, variant ORDER BY section_rank) END AS doc_place FROM vfirst)"""


def label_truth(spark: SparkSession, sf_dir: str, title: str) -> DataFrame:
    """Truth by titles: that of the sample's label, and its section number sample_id / 100 mod 3; every third sample has no section."""
    name = F.concat(F.lit(title), F.col("truth").cast("string"))
    pair = F.struct(name.alias("title"), F.pmod(F.floor(F.col("sample_id") / 100), F.lit(3)).cast("int").alias("section_id"))
    return samples(spark, sf_dir).select("sample_id", F.array(name).alias("titles"), F.filter(F.array(pair), lambda p: F.col("sample_id") % 300 != 0).alias("pairs"))


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each doc_idx of the vectors: a title by label, some naming lists, and the lines of one of `documents`."""
    own = vectors(spark, sf_dir).select("doc_idx", "label", F.floor(F.col("vec_pos") / 30).cast("long").alias("run")).distinct()
    title = F.concat(F.when(F.col("run") % 7 == 3, "List of things").otherwise("Things"), F.lit(" of label "), F.col("label").cast("string"), F.lit(" ("), F.col("run").cast("string"), F.lit(")"))
    texts = titled(spark, sf_dir).select(F.col("doc_idx").alias("doc_id"), "section_titles", "section_texts")
    return own.withColumn("doc_id", F.col("run") * 10 + F.col("label")).join(texts, "doc_id").select("doc_idx", title.alias("title"), "section_titles", "section_texts")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a derived title and their lines as sections; some titles name lists, many repeat."""
    docs = table(spark, sf_dir, "documents")
    lead = F.when(F.col("doc_id") % 7 == 0, "List of ").when(F.col("doc_id") % 11 == 0, "Outline of ").otherwise("")
    title = F.concat(lead, F.substring_index("text", " ", 2), F.lit(" ("), F.col("lang"), F.lit(")"))
    lines = F.split("text", "\n")
    names = F.transform(lines, lambda x, i: F.when(i % 9 == 4, F.lit(" See also ")).when(i % 9 == 7, F.lit("Notes")).otherwise(F.concat(F.lit("Part "), i.cast("string"))))
    return docs.select(F.col("doc_id").alias("doc_idx"), title.alias("title"), names.alias("section_titles"), lines.alias("section_texts"))


TITLED = """
titled AS (SELECT doc_id AS doc_idx, (CASE WHEN doc_id % 7 = 0 THEN 'List of ' WHEN doc_id % 11 = 0 THEN 'Outline of ' ELSE '' END) || array_to_string(string_split(text, ' ')[1:2], ' ') || ' (' || lang || ')' AS title,
  string_split(text, chr(10)) AS lines FROM documents)"""
NORMALIZED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\([^)]*\)', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): a user's turn and the assistant's next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("then"), F.lead("text").over(w).alias("answer")).filter("role = 'user' AND then = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


ANSWERS = """
nexts AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS then_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
answers AS (SELECT conv_id, turn, text AS question, answer FROM nexts WHERE role = 'user' AND then_role = 'assistant')"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stage rows: the type is the stage, the value latency and power, the time the clock."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("sample_id"), F.col("event_type").alias("stage"), F.col("value").alias("latency_s"), (F.col("value") / 10).alias("peak_vram_gb"), (F.col("value") * 2).alias("energy_j"),
        (F.col("event_id") % 10 == 0).alias("is_warmup"), (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6).alias("t"), F.col("user_id"),
    )


TELEMETRY = """
tele AS (SELECT event_id AS sample_id, event_type AS stage, value AS latency_s, value / 10 AS peak_vram_gb, value * 2 AS energy_j, event_id % 10 = 0 AS is_warmup, epoch_us(ts) / 1e6::DOUBLE AS t, user_id FROM events)"""
