"""Driver queries over text: embedding by hashing, chunking, lexical rerank,
contexts, prompts, messages, extractive answers, HTML, corpus reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import py_strip, tokens
from quarry.operators.chunking import SEPARATORS_4, cap_chunks, chunk, default_metadata
from quarry.operators.context import context_joined, context_numbered, context_top1, hydrate, sources
from quarry.operators.embed import hash_embed
from quarry.operators.generate import NO_DOCS_ANSWER, answer_extractive, with_default_answer
from quarry.operators.knn import knn_join, with_scores
from quarry.operators.prompts import (
    CHAT_SYSTEM, chat_messages, flatten_labelled, flatten_titled, preview, prompt_brief,
    question_intake, split_system,
)
from quarry.operators.postings import bm25_rerank_postings, store_pass
from quarry.operators.rerank import B, K1, passthrough
from quarry.plans.registry import register
from quarry.plans.sql_chunks import chunks_cte, chunks_sql
from quarry.session import cut
from quarry.sources.files import load_report
from quarry.sources.html import html_to_text, pages_to_documents, sql_html_to_text
from quarry.sources.tables import load_table

R = 6
DIM = 64
TOK_RE = r"[^\p{L}\p{N}]+"


# --------------------------------------------------------------------------- #
# shared Spark building blocks
# --------------------------------------------------------------------------- #

def doc_vectors(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return hash_embed(docs, "doc_id", "text", DIM, "embedding")


def question_vectors(spark, sf_dir):
    b = load_table(spark, sf_dir, "benchmark")
    return hash_embed(b, "item_id", "text", DIM, "q_vec", short_texts=True)


def text_hits(spark, sf_dir, k):
    """benchmark questions -> k nearest documents by hashed embedding.  Both
    vector tables are materialised once (the document side is the index
    table) so the size checks of the join do not recompute them."""
    return knn_join(cut(question_vectors(spark, sf_dir)), cut(doc_vectors(spark, sf_dir)), k,
                    q_id="item_id", q_vec="q_vec", c_id="doc_id", c_vec="embedding")


def lexical(spark, sf_dir):
    """(texts, blocks): the one token pass over the documents, stored."""
    return store_pass(load_table(spark, sf_dir, "documents"), "doc_id", "text", DIM)


def reranked(spark, sf_dir, first_k=10, top_n=3):
    """Candidates by hashed vectors, reranked by BM25; both from the stored
    token pass, so no text is read again.  Returns (candidates, reranked)."""
    questions = load_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    texts, blocks = lexical(spark, sf_dir)
    vectors = texts.where("embedding is not null").select("doc_id", "embedding")
    cands = cut(knn_join(cut(question_vectors(spark, sf_dir)), vectors, first_k, q_id="item_id", q_vec="q_vec", c_id="doc_id", c_vec="embedding"))
    return cands, bm25_rerank_postings(cands, questions, texts, blocks, q_id="item_id", q_text="question", d_id="doc_id", top_n=top_n)


# --------------------------------------------------------------------------- #
# shared DuckDB fragments
# --------------------------------------------------------------------------- #

def _toks(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{TOK_RE}'), lambda t: t <> '')"


def _hash_cte(name: str, table: str, id_col: str, text_col: str) -> str:
    return f"""
{name}_t AS (SELECT {id_col} AS id, unnest({_toks(text_col)}) AS tok FROM {table}),
{name}_b AS (SELECT id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM})::INTEGER AS bucket,
                    CASE WHEN substr(md5(tok), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM {name}_t),
{name}_s AS (SELECT id, bucket, sum(sign)::DOUBLE AS w FROM {name}_b GROUP BY id, bucket),
{name}_r AS (SELECT id, list_transform(range(0, {DIM}), lambda i: coalesce(map_extract(m, i)[1], 0)::DOUBLE) AS raw
             FROM (SELECT id, map(list(bucket), list(w)) AS m FROM {name}_s GROUP BY id)),
{name}_n AS (SELECT id, raw, sqrt(list_sum(list_transform(raw, lambda y: y * y))) AS nrm FROM {name}_r),
{name} AS (SELECT id, CASE WHEN nrm = 0 THEN raw ELSE list_transform(raw, lambda x: x / nrm) END AS v FROM {name}_n)"""


def _text_hits_cte(k: int) -> str:
    return (_hash_cte("hq", "benchmark", "item_id", "text") + "," + _hash_cte("hd", "documents", "doc_id", "text") +
            f""",
th_d AS (SELECT q.id AS item_id, d.id AS doc_id,
                list_sum(list_transform(range(1, {DIM} + 1), lambda i: (q.v[i] - d.v[i]) * (q.v[i] - d.v[i]))) AS d2
         FROM hq q, hd d),
th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d2, doc_id) AS rank FROM th_d)
       WHERE rank <= {k})""")


def _bm25_cte(first_k: int, top_n: int) -> str:
    return _text_hits_cte(first_k) + f""",
dt AS (SELECT doc_id, {_toks('text')} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY doc_id, term),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_toks('text')}) AS term FROM benchmark)),
dfq AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT th.item_id, th.doc_id,
              sum(ln(1 + (st.n - dfq.df + 0.5) / (dfq.df + 0.5)) * tf.tf * {K1 + 1!r}::DOUBLE
                  / (tf.tf + {K1!r}::DOUBLE * ({1 - B!r}::DOUBLE + {B!r}::DOUBLE * dl.dl / st.avgdl))) AS s
       FROM th JOIN qt ON qt.item_id = th.item_id
               JOIN tf ON tf.doc_id = th.doc_id AND tf.term = qt.term
               JOIN dfq ON dfq.term = qt.term
               JOIN dl ON dl.doc_id = th.doc_id, st
       GROUP BY th.item_id, th.doc_id),
rr AS (SELECT th.item_id, th.doc_id, round(coalesce(sc.s, 0), 9) AS rs FROM th LEFT JOIN sc USING (item_id, doc_id)),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rs DESC, doc_id) AS rerank FROM rr)
       WHERE rerank <= {top_n})"""


_EMB_KNN = """
ek AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank FROM (
      SELECT q.vec_id AS qid, e.vec_id,
             list_sum(list_transform(range(1, len(q.embedding) + 1),
                      lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)
                              * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))) AS d2
      FROM embeddings q, embeddings e))
  WHERE rank <= 3),
eh AS (SELECT ek.*, d.text, d.source FROM ek LEFT JOIN documents d ON d.doc_id = ek.vec_id)"""


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# --------------------------------------------------------------------------- #
# embedding, chunking, corpus
# --------------------------------------------------------------------------- #

@register("hash_embed", "WITH " + _hash_cte("hd", "documents", "doc_id", "text").lstrip() + f"""
SELECT id AS doc_id, (i - 1)::INTEGER AS bucket, round(v[i], 6) AS weight
FROM (SELECT id, v, unnest(range(1, {DIM} + 1)) AS i FROM hd)
WHERE v[i] <> 0
""")
def q_hash_embed(spark, sf_dir):
    v = doc_vectors(spark, sf_dir)
    return (v.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
             .where(F.col("weight") != 0)
             .select("doc_id", F.col("bucket").cast("int"), F.round("weight", R).alias("weight")))


def _chunks(spark, sf_dir, size, overlap, separators=SEPARATORS_4):
    docs = load_table(spark, sf_dir, "documents")
    return chunk(docs, "text", size, overlap, separators, id_cols=("doc_id",),
                 keep=["doc_id", "source", "lang"])


@register("chunk_256_20", chunks_sql(256, 20))
def q_chunk_256_20(spark, sf_dir):
    return _chunks(spark, sf_dir, 256, 20).select("doc_id", "chunk_index", "n_chars", "chunk_id")


@register("chunk_512_50", chunks_sql(512, 50))
def q_chunk_512_50(spark, sf_dir):
    return _chunks(spark, sf_dir, 512, 50).select("doc_id", "chunk_index", "n_chars", "chunk_id")


@register("chunk_invariants", """
SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g'))::BIGINT AS nonws_chars,
       0::BIGINT AS oversized_with_separator, 0::BIGINT AS not_in_document
FROM documents
""")
def q_chunk_invariants(spark, sf_dir):
    """Overlap 0: the chunks' non-whitespace characters add up exactly to the
    document's (nothing lost, nothing repeated); no chunk above the size
    still holds a separator; every chunk is a substring of its document."""
    docs = load_table(spark, sf_dir, "documents")
    ch = chunk(docs, "text", 256, 0, SEPARATORS_4, id_cols=("doc_id",), keep=["doc_id"])
    # containment is checked through a join back to the document (the text is
    # not copied into every chunk row of the Arrow batches)
    ch = ch.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    has_sep = F.lit(False)
    for s in SEPARATORS_4:
        has_sep = has_sep | F.contains(py_strip("text"), F.lit(s))
    agg = ch.groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("nonws_chars"),
        F.count_if((F.col("n_chars") > 256) & has_sep).alias("oversized_with_separator"),
        F.count_if(F.instr("doc_text", F.col("text")) == 0).alias("not_in_document"))
    return (docs.select("doc_id").join(agg, "doc_id", "left")
            .select("doc_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                for c in ("nonws_chars", "oversized_with_separator", "not_in_document")]))


@register("corpus_cap", """
SELECT doc_id, source, n_chars, 1 AS n_meta, row_number() OVER (ORDER BY source, doc_id) - 1 AS position,
       row_number() OVER (ORDER BY source, doc_id) <= 500 AS within_cap
FROM documents
""")
def q_corpus_cap(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    docs = default_metadata(docs).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("lang"), F.col("lang"))))
    return cap_chunks(docs, 500, ("source", "doc_id")).select(
        "doc_id", "source", "n_chars", F.size("metadata").alias("n_meta"), "position", "within_cap")


@register("source_report", f"""
WITH corpus AS (
  SELECT doc_id, source, 'text' AS file_type, text FROM documents
  UNION ALL
  SELECT page_id, url, 'html', {sql_html_to_text('html')} FROM pages)
SELECT file_type, count(*) AS n_documents, count(DISTINCT source) AS n_files,
       sum(length(text))::BIGINT AS n_chars
FROM corpus GROUP BY ROLLUP (file_type)
""")
def q_source_report(spark, sf_dir):
    """Documents and web pages unioned into one corpus, load
    report by file type with a rollup total (file_type NULL)."""
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.lit("text").alias("file_type"), "text")
    pages = pages_to_documents(load_table(spark, sf_dir, "pages")).select("doc_id", "source", "file_type", "text")
    corpus = docs.unionByName(pages, allowMissingColumns=True)
    return load_report(corpus, "text")


@register("html_text", f"""
SELECT page_id, url, {sql_html_to_text('html')} AS text FROM pages
""")
def q_html_text(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages")
    return p.select("page_id", "url", html_to_text("html").alias("text"))


# --------------------------------------------------------------------------- #
# retrieval over text, rerank
# --------------------------------------------------------------------------- #

@register("text_knn_top5", "WITH " + _text_hits_cte(5).lstrip() + """
SELECT item_id, rank::INTEGER AS rank, doc_id, round(d2, 6) AS d2 FROM th
""")
def q_text_knn_top5(spark, sf_dir):
    h = text_hits(spark, sf_dir, 5)
    return h.select("item_id", "rank", "doc_id", F.round("d2", R).alias("d2"))


@register("bm25_rerank_top3", "WITH " + _bm25_cte(10, 3).lstrip() + """
SELECT item_id, rerank::INTEGER AS rerank, doc_id, round(rs, 6) AS rerank_score FROM bm
""")
def q_bm25_rerank_top3(spark, sf_dir):
    _, r = reranked(spark, sf_dir, 10, 3)
    return r.select("item_id", "rerank", "doc_id", F.round("rerank_score", R).alias("rerank_score"))


@register("rerank_passthrough", "WITH " + _text_hits_cte(10).lstrip() + """
SELECT item_id, rank::INTEGER AS rank, doc_id, NULL::DOUBLE AS rerank_score FROM th WHERE rank <= 3
""")
def q_rerank_passthrough(spark, sf_dir):
    h = passthrough(text_hits(spark, sf_dir, 10), top_n=3)
    return h.select("item_id", "rank", "doc_id", "rerank_score")


# --------------------------------------------------------------------------- #
# contexts and sources (embeddings hits hydrated with documents, vec_id = doc_id)
# --------------------------------------------------------------------------- #

def _emb_hits(spark, sf_dir):
    from quarry.plans.q_retrieval import embedding_corpus, embedding_questions
    hits = knn_join(embedding_questions(spark, sf_dir), embedding_corpus(spark, sf_dir), 3,
                    q_id="qid", q_vec="q_vec", c_id="vec_id", c_vec="embedding")
    docs = load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    return hydrate(with_scores(hits), docs, "vec_id", ("text", "source"))


@register("context_joined", "WITH " + _EMB_KNN.lstrip() + """
SELECT qid, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '') AS context FROM eh GROUP BY qid
""")
def q_context_joined(spark, sf_dir):
    return context_joined(_emb_hits(spark, sf_dir))


@register("context_numbered", "WITH " + _EMB_KNN.lstrip() + """
SELECT qid, string_agg('[Document ' || rank || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
FROM eh GROUP BY qid
""")
def q_context_numbered(spark, sf_dir):
    return context_numbered(_emb_hits(spark, sf_dir))


@register("context_top1", "WITH " + _EMB_KNN.lstrip() + """
SELECT qid, text AS context FROM eh WHERE rank = 1
""")
def q_context_top1(spark, sf_dir):
    return context_top1(_emb_hits(spark, sf_dir))


@register("answer_sources", "WITH " + _EMB_KNN.lstrip() + """
SELECT qid, rank::INTEGER AS pos, coalesce(source, 'Unknown') AS filename, round(1 - d2, 6) AS score,
       NULL::DOUBLE AS rerank_score
FROM eh
""")
def q_answer_sources(spark, sf_dir):
    h = _emb_hits(spark, sf_dir).withColumnRenamed("source", "filename")
    s = sources(h, "qid", "rank", "filename", "score", "rerank_score")
    return s.select("qid", F.explode("sources").alias("s")).select(
        "qid", F.col("s.rank").cast("int").alias("pos"), F.col("s.filename").alias("filename"),
        F.round("s.score", R).alias("score"), F.col("s.rerank_score").alias("rerank_score"))


# --------------------------------------------------------------------------- #
# prompts and answers (benchmark questions over documents)
# --------------------------------------------------------------------------- #

def _q_text(spark, sf_dir):
    return load_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))


@register("prompt_brief", "WITH " + _text_hits_cte(1).lstrip() + """
SELECT th.item_id, 'Context: ' || d.text || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10)
       || 'Answer (be brief):' AS prompt
FROM th JOIN documents d ON d.doc_id = th.doc_id JOIN benchmark b ON b.item_id = th.item_id
""")
def q_prompt_brief(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    ctx = context_top1(hydrate(text_hits(spark, sf_dir, 1), docs, "doc_id"), "item_id")
    return ctx.join(_q_text(spark, sf_dir), "item_id").select("item_id", prompt_brief().alias("prompt"))


@register("prompt_chat", "WITH " + _text_hits_cte(3).lstrip() + f""",
c AS (SELECT th.item_id, string_agg(d.text, chr(10) || chr(10) ORDER BY th.rank) AS context
      FROM th JOIN documents d ON d.doc_id = th.doc_id GROUP BY th.item_id)
SELECT c.item_id, '{CHAT_SYSTEM}' AS system,
       'Context:' || chr(10) || c.context || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10)
       || 'Provide a brief, direct answer.' AS user
FROM c JOIN benchmark b ON b.item_id = c.item_id
""")
def q_prompt_chat(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    ctx = context_joined(hydrate(text_hits(spark, sf_dir, 3), docs, "doc_id"), "item_id")
    m = ctx.join(_q_text(spark, sf_dir), "item_id").select("item_id", chat_messages().alias("m"))
    return m.select("item_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"))


def _extractive_sql(before: str = "WITH ", columns: str = "best.item_id IS NOT NULL AS retrieved", of: str = "b.item_id") -> str:
    return before + _bm25_cte(10, 3).lstrip() + f""",
ctx AS (SELECT bm.item_id, string_agg(d.text, chr(10) || chr(10) ORDER BY bm.rerank) AS context
        FROM bm JOIN documents d ON d.doc_id = bm.doc_id GROUP BY bm.item_id),
sp AS (SELECT item_id, string_split_regex(context, '[.!?]\\s+|\\n') AS ss FROM ctx),
s AS (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sp),
sx AS (SELECT s.item_id, s.i, s.s,
              len(list_intersect(list_distinct({_toks('s.s')}), list_distinct({_toks('b.text')}))) AS ov
       FROM s JOIN benchmark b ON b.item_id = s.item_id
       WHERE {_strip_sql('s.s')} <> ''),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ov DESC, i) AS r FROM sx) WHERE r = 1)
SELECT {of},
       coalesce(array_to_string(string_split_regex({_strip_sql('best.s')}, '\\s+')[1:50], ' '),
                '{NO_DOCS_ANSWER}') AS answer,
       {columns}
FROM benchmark b LEFT JOIN best ON best.item_id = b.item_id
"""


@register("extractive_answers", _extractive_sql())
def q_extractive_answers(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    _, hits = reranked(spark, sf_dir, 10, 3)
    ctx = context_joined(hydrate(hits, docs, "doc_id"), "item_id", rank_col="rerank")
    qs = _q_text(spark, sf_dir)
    ans = answer_extractive(ctx.join(qs, "item_id"), "context", "question", 50).select("item_id", "answer", "error")
    out = with_default_answer(qs.select("item_id"), ans, "item_id", NO_DOCS_ANSWER)
    return out.select("item_id", "answer", "retrieved")


# --------------------------------------------------------------------------- #
# messages (conversations)
# --------------------------------------------------------------------------- #

@register("messages_flat_labelled", """
SELECT conv_id,
       coalesce(string_agg(CASE role WHEN 'system' THEN 'System: ' || text WHEN 'user' THEN 'User: ' || text
                                     WHEN 'assistant' THEN 'Assistant: ' || text END,
                           chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Assistant:', 'Assistant:') AS prompt
FROM conversations GROUP BY conv_id
""")
def q_messages_flat_labelled(spark, sf_dir):
    return flatten_labelled(load_table(spark, sf_dir, "conversations"))


@register("messages_flat_titled", """
SELECT conv_id,
       coalesce(string_agg(CASE role WHEN 'system' THEN text || chr(10) WHEN 'user' THEN 'Question: ' || text || chr(10) END,
                           chr(10) ORDER BY turn) || chr(10) || 'Answer:', 'Answer:') AS prompt
FROM conversations GROUP BY conv_id
""")
def q_messages_flat_titled(spark, sf_dir):
    return flatten_titled(load_table(spark, sf_dir, "conversations"))


@register("messages_system_split", """
SELECT conv_id,
       nullif(arg_max(text, turn) FILTER (WHERE role = 'system'), '') AS system,
       (count(*) FILTER (WHERE role <> 'system'))::INTEGER AS n_messages,
       coalesce(string_agg(role, ',' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS roles,
       md5(coalesce(string_agg(text, chr(1) ORDER BY turn) FILTER (WHERE role <> 'system'), '')) AS content_md5
FROM conversations GROUP BY conv_id
""")
def q_messages_system_split(spark, sf_dir):
    s = split_system(load_table(spark, sf_dir, "conversations"))
    return s.select("conv_id", "system", F.size("messages").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\u0001")).alias("content_md5"))


@register("question_intake", f"""
SELECT conv_id, turn, {_strip_sql('text')} AS question
FROM conversations
WHERE role = 'user' AND {_strip_sql('text')} <> '' AND lower({_strip_sql('text')}) NOT IN ('exit', 'quit')
""")
def q_question_intake(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return question_intake(c.select("conv_id", "turn", F.col("text").alias("question")), "question")


@register("answer_preview", """
SELECT conv_id, turn, substring(text, 1, 100) || '...' AS preview FROM conversations WHERE role = 'assistant'
""")
def q_answer_preview(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", preview("text").alias("preview"))


__all__ = ["doc_vectors", "question_vectors", "text_hits", "reranked", "tokens"]


# --------------------------------------------------------------------------- #
# retrieval quality against verbatim ground truth
# --------------------------------------------------------------------------- #

@register("retrieval_recall", "WITH " + _bm25_cte(10, 10).lstrip() + """,
truth AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ks(k) AS (VALUES (1), (3), (5), (10)),
hits AS (SELECT 'hash_knn' AS method, k, th.item_id, th.doc_id FROM th, ks WHERE th.rank <= k
         UNION ALL
         SELECT 'bm25_rerank', k, bm.item_id, bm.doc_id FROM bm, ks WHERE bm.rerank <= k),
per AS (SELECT m.method, ks.k FROM (VALUES ('hash_knn'), ('bm25_rerank')) m(method), ks)
SELECT per.method, per.k::INTEGER AS k,
       (SELECT count(DISTINCT item_id) FROM truth) AS n_questions,
       (SELECT count(*) FROM truth) AS n_relevant,
       count(DISTINCT h.item_id) AS n_questions_hit,
       count(h.doc_id) AS n_relevant_found,
       round(count(h.doc_id)::DOUBLE / (SELECT count(*) FROM truth), 6) AS recall
FROM per LEFT JOIN (hits h JOIN truth t ON t.item_id = h.item_id AND t.doc_id = h.doc_id)
  ON h.method = per.method AND h.k = per.k
GROUP BY per.method, per.k
""")
def q_retrieval_recall(spark, sf_dir):
    """Recall@k (k = 1, 3, 5, 10) of the hashed-embedding kNN and of its BM25
    rerank, against the documents that contain each benchmark passage
    verbatim (found by ``verbatim_matches``, an equi-join, no cross join)."""
    from quarry.operators.match import verbatim_matches
    docs = load_table(spark, sf_dir, "documents")
    bench = load_table(spark, sf_dir, "benchmark")
    truth = cut(verbatim_matches(bench, docs, p_id="item_id", p_text="text", d_id="doc_id", d_text="text"))
    hits, rr = reranked(spark, sf_dir, 10, 10)
    ranked = (hits.select(F.lit("hash_knn").alias("method"), "item_id", "doc_id", F.col("rank").alias("r"))
              .unionByName(rr.select(F.lit("bm25_rerank").alias("method"), "item_id", "doc_id",
                                     F.col("rerank").alias("r"))))
    found = ranked.join(truth, ["item_id", "doc_id"])
    # expand each found hit to the k values it counts for (r <= k): k is a
    # fixed 4-value list, so this is a bounded explode, not a join
    found = found.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in (1, 3, 5, 10)]),
                                                     lambda k: F.col("r") <= k)))
    agg = found.groupBy("method", "k").agg(F.count_distinct("item_id").alias("n_questions_hit"),
                                           F.count("*").alias("n_relevant_found"))
    n_rel = truth.select(F.count("*")).scalar()
    n_q = truth.select(F.count_distinct("item_id")).scalar()
    all_mk = ranked.select("method").distinct().select(
        "method", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k"))
    out = all_mk.join(agg, ["method", "k"], "left")
    return out.select("method", F.col("k").cast("int").alias("k"), n_q.alias("n_questions"),
                      n_rel.alias("n_relevant"),
                      F.coalesce("n_questions_hit", F.lit(0)).alias("n_questions_hit"),
                      F.coalesce("n_relevant_found", F.lit(0)).alias("n_relevant_found"),
                      F.round(F.coalesce("n_relevant_found", F.lit(0)) / n_rel, R).alias("recall"))


def _qa_sql() -> str:
    """The extractive SQL over chunks instead of documents: a CTE of that name
    takes their place."""
    chunks = chunks_cte("c", "documents", "doc_id", "text", 256, 20).lstrip()
    held = """
documents AS (SELECT md5(id || chr(1) || chunk_index || chr(1) || text) AS doc_id, text FROM c),
"""
    return _extractive_sql("WITH RECURSIVE " + chunks + "," + held,
                           "(SELECT count(*) FROM bm WHERE bm.item_id = b.item_id)::INTEGER AS n_sources, false AS from_cache, 'computed' AS served_by",
                           "b.item_id AS qid")


@register("qa_batch_answers", _qa_sql())
def q_qa_batch_answers(spark, sf_dir):
    """SURVEY 3.2 end to end: documents chunked, embedded and written as the
    index, then every benchmark question answered in one batch (retrieval
    over all chunks, BM25 rerank, extractive answer, cache bookkeeping)."""
    from quarry.plans.flagship import flagship
    return flagship(spark, sf_dir).select(
        "qid", "answer", F.size("sources").alias("n_sources"), "from_cache", "served_by")
