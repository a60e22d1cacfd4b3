"""Retrieval (documents × benchmark queries) and interview (conversations) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.operators import dialogue as D
from tastemill.operators import retrieval as T
from tastemill.plans.registry import query
from tastemill.sources import tables as S

TOP = 2


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TOK = T.TOKEN_PATTERN
TFIDF_CTE = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + nd.n) / (1.0 + count(*))) + 1.0 AS idf FROM tf, nd GROUP BY term, nd.n),
dw AS (SELECT doc_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS w
       FROM tf JOIN idf USING (term))"""

RETRIEVE_CTE = TFIDF_CTE + f""",
qtok AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark),
qtf AS (SELECT query_id, term, count(*) AS tf FROM qtok GROUP BY query_id, term),
qw AS (SELECT query_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id)) AS w
       FROM qtf JOIN idf USING (term)),
dots AS (SELECT q.query_id, d.doc_id, sum(q.w * d.w) AS score FROM qw q JOIN dw d ON d.term = q.term
         GROUP BY q.query_id, d.doc_id HAVING sum(q.w * d.w) > 0),
hits AS (SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
           FROM dots) z WHERE rank <= {TOP})"""


@query("tokenize", f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents)
SELECT term, CAST(count(*) AS BIGINT) AS n_occ, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM tok GROUP BY term""")
def tokenize(spark, sf):
    t = T.tokenize(S.corpus(spark, sf), "doc_id")
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n_occ"), F.countDistinct("doc_id").alias("n_docs"))


@query("tfidf_weights", f"""WITH {TFIDF_CTE}
SELECT doc_id, term, round(w, 6) AS weight FROM dw""")
def tfidf_weights(spark, sf):
    w, _ = T.tfidf_weights(S.corpus(spark, sf), "doc_id")
    return w.select("doc_id", "term", r6("weight").alias("weight"))


@query("retrieve_topn", f"WITH {RETRIEVE_CTE} SELECT * FROM hits")
def retrieve_topn(spark, sf):
    return T.retrieve_topn(S.queries_table(spark, sf), S.corpus(spark, sf), TOP)


@query("context_block", f"""WITH {RETRIEVE_CTE},
b AS (SELECT h.query_id, string_agg(CAST(h.doc_id AS VARCHAR) || ':' || chr(10) || d.text, chr(10) || chr(10)
             ORDER BY h.rank) AS context
      FROM hits h JOIN documents d ON d.doc_id = h.doc_id GROUP BY h.query_id)
SELECT q.item_id AS query_id, coalesce(b.context, {_lit(T.NO_CONTEXT)}) AS context
FROM benchmark q LEFT JOIN b ON b.query_id = q.item_id""")
def context_block(spark, sf):
    qs = S.queries_table(spark, sf)
    docs = S.corpus(spark, sf)
    return T.context_block(qs, T.retrieve_topn(qs, docs, TOP), docs)


@query("two_way_context", f"""WITH {TFIDF_CTE},
qs AS (SELECT item_id * 2 AS query_id, split_part(text, '.', 1) AS text FROM benchmark
       UNION ALL SELECT item_id * 2 + 1, text FROM benchmark),
qtok AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM qs),
qtf AS (SELECT query_id, term, count(*) AS tf FROM qtok GROUP BY query_id, term),
qw AS (SELECT query_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id)) AS w
       FROM qtf JOIN idf USING (term)),
dots AS (SELECT q.query_id, d.doc_id, sum(q.w * d.w) AS score FROM qw q JOIN dw d ON d.term = q.term
         GROUP BY q.query_id, d.doc_id HAVING sum(q.w * d.w) > 0)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM dots) z
WHERE rank <= {TOP}""")
def two_way_context(spark, sf):
    """Two contexts per benchmark text: of its first sentence (what it is
    about) and of all of it."""
    q = S.read_table(spark, sf, "benchmark")
    way = lambda i, text: q.select((F.col("item_id") * 2 + i).alias("query_id"), text.alias("text"))
    qs = way(0, F.substring_index("text", ".", 1)).unionByName(way(1, F.col("text")))
    return T.retrieve_topn(qs, S.corpus(spark, sf), TOP)


_LINE = "CASE role WHEN 'assistant' THEN 'Interviewer' WHEN 'user' THEN 'User' END || ': ' || text"
_STOPS = ", ".join(_lit(s) for s in D.STOP_ANSWERS)
_KEPT = f"""u AS (SELECT conv_id, turn, text,
              CASE WHEN lower(trim(text)) IN ({_STOPS}) THEN 1 ELSE 0 END AS stop
       FROM conversations WHERE role = 'user'),
s AS (SELECT *, max(stop) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM u),
k0 AS (SELECT conv_id, turn, trim(text) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
       FROM s WHERE stopped = 0),
kept AS (SELECT * FROM k0 WHERE k <= {1 + D.MAX_FOLLOWUPS}),
agg AS (SELECT conv_id, count(*) AS n_answers, string_agg(answer, ' ' ORDER BY k) AS aggregate FROM kept GROUP BY conv_id)"""


@query("running_history", f"""SELECT conv_id, turn, {_LINE} AS line,
  sum(length({_LINE}) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
    AS history_chars
FROM conversations WHERE role IN ('assistant', 'user')""")
def running_history(spark, sf):
    return D.running_history(S.turns(spark, sf))


@query("transcript", f"""SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn) AS transcript
FROM conversations WHERE role IN ('assistant', 'user') GROUP BY conv_id""")
def transcript(spark, sf):
    return D.transcript(S.turns(spark, sf))


_VAL = "CASE WHEN " + " OR ".join(f"starts_with(lower(trim(text)), {_lit(p)})" for p in D.FOLLOWUP_PREFIXES) + \
       f" THEN trim(text) ELSE {_lit(D.FALLBACK_QUESTION)} END"


@query("validate_followup", f"""SELECT conv_id, turn, {_VAL} AS followup FROM conversations WHERE role = 'assistant'""")
def validate_followup(spark, sf):
    t = S.turns(spark, sf).filter(F.col("role") == "assistant")
    return t.select("conv_id", "turn", D.validate_followup(F.col("text")).alias("followup"))


@query("fallback_rate", f"""SELECT conv_id, round(avg(CASE WHEN ({_VAL}) = {_lit(D.FALLBACK_QUESTION)} THEN 1.0 ELSE 0.0 END), 6)
  AS fallback_rate, CAST(count(*) AS BIGINT) AS n_questions
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def fallback_rate(spark, sf):
    t = S.turns(spark, sf).filter(F.col("role") == "assistant")
    v = D.validate_followup(F.col("text"))
    return t.groupBy("conv_id").agg(
        F.round(F.avg(F.when(v == F.lit(D.FALLBACK_QUESTION), 1.0).otherwise(0.0)), 6).alias("fallback_rate"),
        F.count(F.lit(1)).alias("n_questions"))


@query("stop_detection", f"""WITH {_KEPT}
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_before_stop FROM k0 GROUP BY conv_id""")
def stop_detection(spark, sf):
    t = S.turns(spark, sf).filter(F.col("role") == "user").withColumn("stop", D.is_stop(F.col("text")).cast("int"))
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return (t.withColumn("stopped", F.max("stop").over(w)).filter(F.col("stopped") == 0)
            .groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_before_stop")))


@query("cap_followups", f"""WITH {_KEPT}
SELECT conv_id, turn, CAST(k AS INTEGER) AS k FROM kept""")
def cap_followups(spark, sf):
    return D.kept_answers(S.turns(spark, sf)).select("conv_id", "turn", F.col("k").cast("int"))


@query("aggregate_topic", f"""WITH {_KEPT}
SELECT conv_id, CAST(n_answers AS BIGINT) AS n_answers, aggregate FROM agg""")
def aggregate_topic(spark, sf):
    return D.aggregate_topic(S.turns(spark, sf))


_parts = D.PROMPT_TEMPLATE.split("%s")
_PROMPT = (f"{_lit(_parts[0])} || CAST(a.conv_id AS VARCHAR) || {_lit(_parts[1])} || h.transcript || "
           f"{_lit(_parts[2])} || CAST(a.conv_id AS VARCHAR) || {_lit(_parts[3])} || a.aggregate || {_lit(_parts[4])}")


@query("render_prompt", f"""WITH {_KEPT},
h AS (SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn) AS transcript
      FROM conversations WHERE role IN ('assistant', 'user') GROUP BY conv_id)
SELECT a.conv_id, {_PROMPT} AS prompt FROM agg a JOIN h ON h.conv_id = a.conv_id""")
def render_prompt(spark, sf):
    return D.render_prompt(S.turns(spark, sf))


@query("interview_summary", f"""WITH {_KEPT},
last AS (SELECT conv_id, arg_max(trim(text), turn) AS last_text, max(turn) AS last_turn
         FROM conversations WHERE role = 'user' GROUP BY conv_id),
mk AS (SELECT conv_id, max(turn) AS last_kept FROM kept GROUP BY conv_id)
SELECT a.conv_id, CAST(a.n_answers AS BIGINT) AS n_answers, a.aggregate,
       CASE WHEN l.last_turn > m.last_kept AND lower(l.last_text) NOT IN ({_STOPS}) AND l.last_text <> ''
            THEN l.last_text END AS final_comment
FROM agg a JOIN last l ON l.conv_id = a.conv_id JOIN mk m ON m.conv_id = a.conv_id""")
def interview_summary(spark, sf):
    """Per topic: the aggregate, and the last answer as a closing comment
    when it came after the topic was closed (cap or stop) and is not a
    stop word itself."""
    t = S.turns(spark, sf)
    a = D.aggregate_topic(t)
    last = (t.filter(F.col("role") == "user").groupBy("conv_id")
            .agg(F.max_by(F.trim("text"), "turn").alias("last_text"), F.max("turn").alias("last_turn")))
    mk = D.kept_answers(t).groupBy("conv_id").agg(F.max("turn").alias("last_kept"))
    j = a.join(last, "conv_id").join(mk, "conv_id")
    closing = F.when((F.col("last_turn") > F.col("last_kept")) & ~D.is_stop(F.col("last_text"))
                     & (F.col("last_text") != ""), F.col("last_text"))
    return j.select("conv_id", "n_answers", "aggregate", closing.alias("final_comment"))
