"""Driver queries for kNN retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.knn import assign_lists, build_ivf, ivf_knn_join, knn_join, with_scores
from quarry.plans.registry import register
from quarry.session import cut
from quarry.sources.tables import load_table

R = 6  # decimal places of every reported double


def embedding_questions(spark, sf_dir):
    """Every vector of ``embeddings`` asked as a question (whole table)."""
    e = load_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"), "label")


def embedding_corpus(spark, sf_dir):
    return load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _rounded(hits):
    return with_scores(hits).select(
        "qid", "rank", "vec_id", F.round("d2", R).alias("d2"),
        F.round("score", R).alias("score"), F.round("cosine", R).alias("cosine"))


_KNN_SQL = """
WITH d AS (
  SELECT q.vec_id AS qid, e.vec_id,
         list_sum(list_transform(range(1, len(q.embedding) + 1),
                  lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)
                          * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))) AS d2
  FROM embeddings q JOIN embeddings e ON {on}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank FROM d
)
SELECT qid, rank::INTEGER AS rank, vec_id, round(d2, 6) AS d2, round(1 - d2, 6) AS score,
       round(1 - d2 / 2, 6) AS cosine
FROM r {where}
"""


@register("knn_exact_top3", _KNN_SQL.format(on="TRUE", where="WHERE rank <= 3"))
def knn_exact_top3(spark, sf_dir):
    hits = knn_join(embedding_questions(spark, sf_dir), embedding_corpus(spark, sf_dir), 3,
                    q_id="qid", q_vec="q_vec", c_id="vec_id", c_vec="embedding")
    return _rounded(hits)


# The same query through the other two physical plans (the automatic choice
# at this scale is the index broadcast): corpus streamed past a broadcast
# question batch (while the questions fit one), and the hash-salted grid with
# small blocks (many cells).
@register("knn_exact_top3_streamed", _KNN_SQL.format(on="TRUE", where="WHERE rank <= 3"))
def knn_exact_top3_streamed(spark, sf_dir):
    hits = knn_join(embedding_questions(spark, sf_dir), embedding_corpus(spark, sf_dir), 3,
                    q_id="qid", q_vec="q_vec", c_id="vec_id", c_vec="embedding", strategy="streamed")
    return _rounded(hits)


@register("knn_exact_top3_grid", _KNN_SQL.format(on="TRUE", where="WHERE rank <= 3"))
def knn_exact_top3_grid(spark, sf_dir):
    hits = knn_join(embedding_questions(spark, sf_dir), embedding_corpus(spark, sf_dir), 3,
                    q_id="qid", q_vec="q_vec", c_id="vec_id", c_vec="embedding", strategy="grid",
                    q_block=128, c_block=128)
    return _rounded(hits)


# J5 + J9: each question searches only vectors with its own label (metadata
# equality filter) and asks for k = label % 4 results, NULL (label % 4 = 0)
# meaning the default k = 3.
@register("knn_filtered", _KNN_SQL.format(
    on="q.label = e.label",
    where="WHERE rank <= coalesce(nullif((SELECT label FROM embeddings x WHERE x.vec_id = r.qid) % 4, 0), 3)"))
def knn_filtered(spark, sf_dir):
    q = embedding_questions(spark, sf_dir).withColumn(
        "k", F.when(F.col("label") % 4 == 0, F.lit(None)).otherwise(F.col("label") % 4))
    hits = knn_join(q, embedding_corpus(spark, sf_dir), 3, q_id="qid", q_vec="q_vec",
                    c_id="vec_id", c_vec="embedding", k_col="k", on=["label"])
    return _rounded(hits)


_KNN_FILTERED_SQL = _KNN_SQL.format(
    on="q.label = e.label",
    where="WHERE rank <= coalesce(nullif((SELECT label FROM embeddings x WHERE x.vec_id = r.qid) % 4, 0), 3)")


@register("knn_filtered_grid", _KNN_FILTERED_SQL)
def knn_filtered_grid(spark, sf_dir):
    """knn_filtered through the grid plan with small blocks: each label is
    split into several question and vector blocks from its own counts (the
    hot-key path of a filter value holding many rows)."""
    q = embedding_questions(spark, sf_dir).withColumn(
        "k", F.when(F.col("label") % 4 == 0, F.lit(None)).otherwise(F.col("label") % 4))
    hits = knn_join(q, embedding_corpus(spark, sf_dir), 3, q_id="qid", q_vec="q_vec",
                    c_id="vec_id", c_vec="embedding", k_col="k", on=["label"], strategy="grid",
                    q_block=16, c_block=16)
    return _rounded(hits)


def _ivf(spark, sf_dir, n_lists, nprobe):
    corpus = embedding_corpus(spark, sf_dir)
    centroids, assigned = build_ivf(corpus, n_lists, c_id="vec_id", c_vec="embedding", seed=7)
    return ivf_knn_join(embedding_questions(spark, sf_dir), centroids, assigned, 3, nprobe,
                        q_id="qid", q_vec="q_vec", c_id="vec_id", c_vec="embedding")


# J2 with every list probed must equal the exact join.
@register("knn_ivf_all_lists", _KNN_SQL.format(on="TRUE", where="WHERE rank <= 3"))
def knn_ivf_all_lists(spark, sf_dir):
    return _rounded(_ivf(spark, sf_dir, 8, 8))


# Fixed centroids, so that SQL can follow: lists are the means of the labels'
# vectors, groups of lists the means of the vectors of two labels.
def _label_means(spark, sf_dir, width, id_name, vec_name):
    e = embedding_corpus(spark, sf_dir).where("embedding is not null and label is not null")
    part = e.select(F.floor(F.col("label") / width).cast("int").alias(id_name), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    # exact sums: the order of additions does not change them
    mean = part.groupBy(id_name, "i").agg((F.sum(F.col("x").cast("decimal(30,15)")).cast("double") / F.count("*")).alias("x"))
    return mean.groupBy(id_name).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vec_name))


LISTS_PROBED, GROUPS_PROBED, SPILL = 5, 4, 2


def _two_level(spark, sf_dir):
    """Every vector in its two nearest of ten lists; a question ranks the
    lists of its four nearest (of five) groups and probes five of them."""
    corpus = embedding_corpus(spark, sf_dir)
    lists, groups = (cut(_label_means(spark, sf_dir, *x)) for x in ((1, "list_id", "centroid"), (2, "group_id", "center")))
    near = knn_join(lists, groups, 1, q_id="list_id", q_vec="centroid", c_id="group_id", c_vec="center", strategy="index_broadcast")
    lists = lists.join(near.select("list_id", "group_id"), "list_id")
    assigned = cut(assign_lists(corpus, lists.select("list_id", "centroid"), c_id="vec_id", c_vec="embedding", spill=SPILL))
    return ivf_knn_join(embedding_questions(spark, sf_dir), lists, assigned, 3, LISTS_PROBED, q_id="qid", q_vec="q_vec", c_id="vec_id",
                        c_vec="embedding", groups=groups, n_groups=GROUPS_PROBED, once=True)


_D2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"


def _means_sql(width):
    return f"""SELECT id, list(x ORDER BY i) AS v FROM (
    SELECT label // {width} AS id, i, sum(embedding[i]::DOUBLE::DECIMAL(30, 15))::DOUBLE / count(*) AS x
    FROM embeddings, range(1, 65) t(i) WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY id"""


_TWO_LEVEL_SQL = f"""
WITH lists AS ({_means_sql(1)}),
groups AS ({_means_sql(2)}),
lg AS (SELECT id, v, g FROM (SELECT l.id, l.v, g.id AS g, row_number() OVER (PARTITION BY l.id ORDER BY {_D2.format(a='l.v', b='g.v')}, g.id) AS r
  FROM lists l, groups g) WHERE r = 1),
held AS (SELECT vec_id, id FROM (SELECT e.vec_id, l.id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_D2.format(a='e.embedding', b='l.v')}, l.id) AS r
  FROM embeddings e, lists l) WHERE r <= {SPILL}),
qg AS (SELECT qid, g FROM (SELECT q.vec_id AS qid, g.id AS g, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2.format(a='q.embedding', b='g.v')}, g.id) AS r
  FROM embeddings q, groups g) WHERE r <= {GROUPS_PROBED}),
ql AS (SELECT qid, id FROM (SELECT qg.qid, lg.id, row_number() OVER (PARTITION BY qg.qid ORDER BY {_D2.format(a='q.embedding', b='lg.v')}, lg.id) AS r
  FROM qg JOIN lg ON lg.g = qg.g JOIN embeddings q ON q.vec_id = qg.qid) WHERE r <= {LISTS_PROBED}),
cand AS (SELECT DISTINCT ql.qid, held.vec_id FROM ql JOIN held ON held.id = ql.id),
approx AS (SELECT * FROM (SELECT qid, vec_id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank
  FROM (SELECT c.qid, c.vec_id, {_D2.format(a='q.embedding', b='e.embedding')} AS d2
    FROM cand c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings e ON e.vec_id = c.vec_id)) WHERE rank <= 3)"""


@register("knn_ivf_two_level", _TWO_LEVEL_SQL + """
SELECT qid, rank::INTEGER AS rank, vec_id, round(d2, 6) AS d2, round(1 - d2, 6) AS score, round(1 - d2 / 2, 6) AS cosine FROM approx
""")
def knn_ivf_two_level(spark, sf_dir):
    return _rounded(_two_level(spark, sf_dir))


@register("knn_ivf_recall", _TWO_LEVEL_SQL + f""",
exact AS (SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2.format(a='q.embedding', b='e.embedding')}, e.vec_id) AS rank
  FROM embeddings q, embeddings e) WHERE rank <= 3)
SELECT (SELECT count(*) FROM lists)::INTEGER AS n_lists, {LISTS_PROBED} AS nprobe, count(*) AS exact_hits, count(approx.qid) AS found,
  round(count(approx.qid) / count(*), 6) AS recall, count(approx.qid) >= 0.9 * count(*) AS enough
FROM exact LEFT JOIN approx ON approx.qid = exact.qid AND approx.vec_id = exact.vec_id
""")
def knn_ivf_recall(spark, sf_dir):
    """Recall@3 of the two-level index against the exact join."""
    approx = _two_level(spark, sf_dir).select("qid", "vec_id", F.lit(1).alias("_found"))
    exact = knn_join(embedding_questions(spark, sf_dir), embedding_corpus(spark, sf_dir), 3,
                     q_id="qid", q_vec="q_vec", c_id="vec_id", c_vec="embedding")
    n_lists = embedding_corpus(spark, sf_dir).select(F.count_distinct("label").cast("int")).scalar()
    j = exact.join(approx, ["qid", "vec_id"], "left").agg(F.count("*").alias("exact_hits"), F.count("_found").alias("found"))
    return j.select(n_lists.alias("n_lists"), F.lit(LISTS_PROBED).alias("nprobe"), "exact_hits", "found",
                    F.round(F.col("found") / F.col("exact_hits"), R).alias("recall"), (F.col("found") >= 0.9 * F.col("exact_hits")).alias("enough"))


@register("embed_normalize", """
SELECT vec_id, i::INTEGER AS pos,
       round(embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
""")
def embed_normalize(spark, sf_dir):
    from quarry.operators.embed import normalize
    e = normalize(load_table(spark, sf_dir, "embeddings"), "embedding", "v")
    return e.select("vec_id", F.posexplode("v").alias("pos", "value")).select(
        "vec_id", (F.col("pos") + 1).alias("pos"), F.round("value", R).alias("value"))


@register("embed_truncate", """
WITH t AS (SELECT vec_id, embedding[1:16] AS v FROM embeddings)
SELECT vec_id, i::INTEGER AS pos,
       round(v[i]::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS value
FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM t)
""")
def embed_truncate(spark, sf_dir):
    from quarry.operators.embed import truncate
    e = truncate(load_table(spark, sf_dir, "embeddings"), "embedding", 16, "v")
    return e.select("vec_id", F.posexplode("v").alias("pos", "value")).select(
        "vec_id", (F.col("pos") + 1).alias("pos"), F.round("value", R).alias("value"))
