"""Driver queries of the index tables: batches that are committed or not (K1,
K2), filters by question through the attribute index (J5), and lexical search
over stored postings (J6)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.attributes import attribute_rows, knn_map_filters
from quarry.operators.chunking import chunk
from quarry.operators.index import TABLES, read_index, read_term_stats, stage_batch, write_batch
from quarry.operators.postings import bm25_search
from quarry.operators.rerank import B, K1
from quarry.plans.q_files import _STRIP, WHOLE
from quarry.plans.q_retrieval import _rounded, embedding_corpus
from quarry.plans.q_text import _toks, lexical
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.tables import load_table

R = 6


@register("index_partial_batch", f"""
WITH s AS (SELECT coalesce(lang, '') AS lang, {_STRIP.format('text')} AS t FROM documents),
l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS r, count(*) FILTER (t <> '') AS n, count(*) FILTER (regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) AS v,
  coalesce(sum(length(t)), 0) AS c FROM s GROUP BY lang),
steps AS (SELECT lang, 2 * r - 1 AS step, 'stopped' AS event, r - 1 AS upto FROM l UNION ALL SELECT lang, 2 * r, 'committed', r FROM l
  UNION ALL SELECT min(lang), 2 * max(r) + 1, 'replayed', max(r) FROM l)
SELECT step, steps.lang, event, coalesce(sum(n), 0)::BIGINT AS n_chunks, coalesce(sum(v), 0)::BIGINT AS n_vectors,
  coalesce(sum(c), 0)::BIGINT AS n_chars, coalesce(sum(n), 0)::BIGINT AS n_docs
FROM steps LEFT JOIN l ON l.r <= steps.upto GROUP BY step, steps.lang, event
""")
def q_index_partial_batch(spark, sf_dir):
    """K1, K2: a batch for each language.  Every batch is first tried by a writer
    that dies behind one of its folders, then written; at the end the first batch
    is written again.  After each step a reader looks at the index."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    path, seen = scratch_path(spark, "index-partial"), []

    def look(event: str, lang: str) -> None:
        index = read_index(spark, path)
        step, label = F.lit(len(seen) + 1).cast("long").alias("step"), (F.lit(lang).alias("lang"), F.lit(event).alias("event"))
        if index is None:
            none = [F.lit(0).cast("long").alias(c) for c in ("n_chunks", "n_vectors", "n_chars", "n_docs")]
            seen.append(spark.range(1).select(step, *label, *none))
            return
        chunks, vectors = index
        n_docs = read_term_stats(spark, path)[1].select(F.coalesce(F.sum("n_docs"), F.lit(0))).scalar()
        n_vectors = vectors.select(F.count("*")).scalar()
        seen.append(chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("n_chars"))
                    .select(step, *label, "n_chunks", n_vectors.alias("n_vectors"), "n_chars", n_docs.cast("long").alias("n_docs")))

    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())  # the batches of this load
    made = lambda lang: chunk(docs.where(F.col("lang") == lang), "text", WHOLE, 0, id_cols=("doc_id",))
    for i, lang in enumerate(langs):
        stage_batch(made(lang), path, f"lang-{lang}", stop_after=TABLES[i % (len(TABLES) - 1)])
        look("stopped", lang)
        write_batch(made(lang), path, f"lang-{lang}")
        look("committed", lang)
    if langs:
        write_batch(made(langs[0]), path, f"lang-{langs[0]}")
        look("replayed", langs[0])
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


@register("knn_map_filters", f"""
WITH m AS (SELECT e.vec_id, e.embedding, e.label, d.source, d.lang FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
d AS (
  SELECT q.vec_id AS qid, e.vec_id,
         list_sum(list_transform(range(1, len(q.embedding) + 1),
                  lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))) AS d2
  FROM m q JOIN m e ON CASE q.label % 5 WHEN 1 THEN e.lang = q.lang WHEN 2 THEN e.lang = q.lang AND e.source = q.source
    WHEN 3 THEN e.label = q.label WHEN 4 THEN FALSE ELSE TRUE END),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank FROM d)
SELECT qid, rank::INTEGER AS rank, vec_id, round(d2, 6) AS d2, round(1 - d2, 6) AS score, round(1 - d2 / 2, 6) AS cosine FROM r WHERE rank <= 3
""")
def q_knn_map_filters(spark, sf_dir):
    """Every question with a map of its own: none, its language, language
    and source, its label, or a key that no vector has."""
    docs = load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    e = embedding_corpus(spark, sf_dir)
    meta = e.select("vec_id", "label").join(docs, "vec_id", "left")
    entry = lambda *keys: F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))])
    style = F.col("label") % 5
    asked = e.join(meta.drop("label"), "vec_id").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"),
        F.when(style == 1, entry("lang")).when(style == 2, entry("lang", "source")).when(style == 3, entry("label"))
        .when(style == 4, F.create_map(F.lit("shelf"), F.lit("x"))).alias("filters"))
    hits = knn_map_filters(asked, e, attribute_rows(meta, "vec_id"), 3, c_id="vec_id")
    return _rounded(hits)


@register("bm25_search_top3", f"""
WITH dt AS (SELECT doc_id, {_toks('text')} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY doc_id, term),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_toks('text')}) AS term FROM benchmark)),
dfq AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT qt.item_id, tf.doc_id, round(sum(ln(1 + (st.n - dfq.df + 0.5) / (dfq.df + 0.5)) * tf.tf * {K1 + 1!r}::DOUBLE
    / (tf.tf + {K1!r}::DOUBLE * ({1 - B!r}::DOUBLE + {B!r}::DOUBLE * dl.dl / st.avgdl))), 9) AS s
  FROM qt JOIN tf ON tf.term = qt.term JOIN dfq ON dfq.term = qt.term JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY qt.item_id, tf.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, round(s, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM sc) WHERE rank <= 3
""")
def q_bm25_search_top3(spark, sf_dir):
    """J6 on the whole corpus: the three best documents of every passage."""
    texts, blocks = lexical(spark, sf_dir)
    questions = load_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    hits = bm25_search(questions, texts, blocks, 3, q_id="item_id", q_text="question", d_id="doc_id")
    return hits.select("item_id", "rank", "doc_id", F.round("score", R).alias("score"))
