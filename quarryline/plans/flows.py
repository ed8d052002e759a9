"""The evidence pipeline from vector hits to clusters, for all samples at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import is_list_page
from ..operators import graph, metrics, search, segments
from .config import Settings


def retrieve(samples: DataFrame, vectors: DataFrame, documents: DataFrame, cfg: Settings) -> DataFrame:
    """The k best documents of each sample with similarity and img_norm.

    samples: sample_id, vector. vectors: vec_pos, doc_idx, vector. documents: doc_idx, title.
    Vectors of list pages leave before the search, so no hit is spent on them.
    """
    able = vectors.join(documents.filter(~is_list_page("title")).select("doc_idx"), "doc_idx", "left_semi")
    found = search.top_k(samples, able, cfg.search_width).join(able.select("vec_pos", "doc_idx"), "vec_pos")
    first = search.first_per_document(found, cfg.k)
    return first.withColumn("img_norm", scores.softmax("score", "sample_id", cfg.softmax_temperature)).withColumnRenamed("score", "similarity")


def candidates(retrieved: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections of the documents retrieved; each document is cut once, whatever the samples that found it."""
    wanted = documents.join(retrieved.select("doc_idx").distinct(), "doc_idx", "left_semi")
    return retrieved.join(segments.sections(wanted), "doc_idx")


def fuse(cands: DataFrame, cfg: Settings) -> DataFrame:
    """The m best sections by combined score. cands has img_norm and rerank_score, a scorer's output (see operators.scorers)."""
    both = cands.withColumn("rerank_norm", scores.sigmoid("rerank_score", cfg.sigmoid_temperature))
    scored = both.withColumn("combined_score", scores.weighted("img_norm", "rerank_norm", cfg.image_weight, cfg.rerank_weight))
    ranked = search.rank_sections(scored, scores.present("combined_score"))
    return ranked.filter(F.col("section_rank") <= cfg.m).withColumn("idx", F.col("section_rank") - 1)


def cluster(top: DataFrame, relations: DataFrame, cfg: Settings, mode: str = "consistency") -> DataFrame:
    """Clusters of each sample's sections; relations are an entailment scorer's output over graph.section_pairs(top)."""
    averaged = graph.average_relations(relations)
    if mode == "clique":
        edges = graph.relation_edges(averaged, cfg.alpha, cfg.beta, cfg.clamp_weights, cfg.e_min, cfg.margin, cfg.tau, cfg.edge_rule, cfg.dir_margin)
        return graph.clique_clusters(top, edges, cfg.m, cfg.max_cluster_size, "similarity", cfg.lambda_score)
    edges = graph.relation_edges(averaged, cfg.alpha, cfg.beta, False, 0.0, -1.0, cfg.tau, cfg.edge_rule, cfg.dir_margin)
    have = [c for c in cfg.strength_columns if c in top.columns]
    return graph.consistency_clusters(top.withColumn("strength", scores.strength(*have)), edges, cfg.target_size, cfg.hybrid_lambda)


def evaluate(top: DataFrame, truth: DataFrame, max_k: int, by: tuple[str, ...] = (), section_rank: str = "section_rank", doc_rank: str = "section_rank") -> DataFrame:
    """(*by, level, k, hits, total, recall) of documents and of sections over ranked sections.

    top: sample_id, norm_title, section_idx, the ranks and the columns `by`. truth:
    sample_id, titles, pairs; samples without a title are left out, those without a
    section count as misses. A row with a null rank does not count.
    """
    known = truth.filter(F.col("titles").isNotNull())
    title = F.exists("titles", lambda t: t == F.col("norm_title"))
    pair = F.exists("pairs", lambda p: (p["title"] == F.col("norm_title")) & (p["section_id"] == F.col("section_idx")))
    best = top.join(known, "sample_id").groupBy("sample_id", *by).agg(F.min(F.when(title, F.col(doc_rank))).alias("document"), F.min(F.when(pair, F.col(section_rank))).alias("section"))
    cells = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(k).alias("k"), (F.col(level) <= k).alias("hit")) for level in ("document", "section") for k in metrics.k_values(max_k)])).alias("c")
    asked = top.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(k).alias("k")) for level in ("document", "section") for k in metrics.k_values(max_k)])).alias("c")).select("c.*")
    hits = best.select(*by, cells).select(*by, "c.*").groupBy(*by, "level", "k").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"))
    if not by:  # without a ranked section all is missed
        hits = asked.join(hits, ["level", "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    total = F.broadcast(known.agg(F.count("*").alias("total")).withColumn("j", F.lit(1)))  # one row
    return hits.withColumn("j", F.lit(1)).join(total, "j").select(*by, "level", "k", "hits", "total", (F.col("hits") / F.col("total")).alias("recall"))
