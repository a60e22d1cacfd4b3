"""Text-rule audit queries over documents (author = source)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.operators import rules as U
from tastemill.plans.registry import query
from tastemill.sources import tables as S

CHECKED = [r for r, _, _ in U.RULES if r not in U.NOT_CHECKED]
LINE_R = [2, 4, 6, 8, 9, 18]
STANZA_R = [10, 13, 19]
DOC_R = [5, 15, 16, 20]
LEX_R = [3, 4, 7, 11, 17]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words):
    return "[" + ", ".join(_lit(w) for w in words) + "]"


def _cnt(words):
    return f"len(list_filter(words, lambda w: list_contains({_list(words)}, w)))"


_W = U.WORD_PATTERN
RULE_CTE = f"""x AS (SELECT doc_id, source AS author, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
x2 AS (SELECT *, CASE WHEN trim(line) = '' THEN 1 ELSE 0 END AS blank FROM x),
x3 AS (SELECT *, sum(blank) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS stanza FROM x2),
lines AS (SELECT doc_id, author, pos, line, stanza, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no,
                 regexp_extract_all(lower(line), '{_W}') AS words FROM x3 WHERE blank = 0),
lc AS (SELECT doc_id, author, stanza, line_no, line, words,
  (CASE WHEN len(words) < 2 THEN 0 ELSE len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) END) = 1 AS r2,
  {_cnt(U.ELEMENTS)} > 0 AS r4,
  {_cnt(U.FORBIDDEN)} = 0 AS r6,
  CASE WHEN line_no % 2 = 1 THEN coalesce(len(words) >= 3 AND substr(words[1], 1, 1) = substr(words[2], 1, 1)
       AND substr(words[2], 1, 1) = substr(words[3], 1, 1)
       AND regexp_full_match(substr(words[1], 1, 1), '[b-df-hj-np-tv-z]'), false) ELSE true END AS r8,
  CASE WHEN line_no % 2 = 0 THEN ends_with(rtrim(line), '?') ELSE true END AS r9,
  len(list_filter(words, lambda w: length(w) >= 10)) > 0 AS r18,
  {_cnt(U.COLOURS)} AS n_colour, {_cnt(U.ANIMALS)} AS n_animal, {_cnt(U.SOUNDS)} AS n_sound,
  {_cnt(U.SEASONS)} AS n_season, {_cnt(U.SIMILE_WORDS)} > 0 AS simile,
  regexp_matches(line, '[eE]') AS has_e, regexp_matches(line, '\\p{{N}}') AS has_num,
  regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(line, '\\p{{Ll}}') AS all_caps,
  len(list_filter(words, lambda w: length(w) >= 3 AND reverse(w) = w)) > 0 AS palin,
  contains(lower(line), 'dear reader') AS dear
  FROM lines),
pl AS (SELECT doc_id, author, bool_and(r2) AS r2, bool_and(r4) AS r4, bool_and(r6) AS r6, bool_and(r8) AS r8,
              bool_and(r9) AS r9, bool_and(r18) AS r18, bool_or(palin) AS r5, bool_or(dear) AS r15,
              count_if(all_caps) = 1 AS r16, arg_max(words, line_no) AS last_words
       FROM lc GROUP BY doc_id, author),
st0 AS (SELECT doc_id, stanza, sum(n_colour) AS n_colour, sum(n_animal) AS n_animal, sum(n_sound) AS n_sound,
               sum(n_season) AS n_season, bool_or(simile) AS simile, bool_or(has_e) AS has_e,
               bool_or(has_num) AS has_num FROM lc GROUP BY doc_id, stanza),
st AS (SELECT doc_id, count(*) AS n_stanzas, bool_and(n_colour >= 2) AS r3, bool_and(n_animal >= 1) AS a_ok,
              bool_or(NOT has_e) AS r10, bool_and(n_sound >= 1) AS r11, bool_and(simile) AS r13,
              bool_and(n_season >= 1) AS s_ok, bool_and(has_num) AS r19 FROM st0 GROUP BY doc_id),
da AS (SELECT doc_id, count(DISTINCT w) AS n_animals FROM (
         SELECT doc_id, unnest(list_filter(words, lambda w: list_contains({_list(U.ANIMALS)}, w))) AS w FROM lc) a
       GROUP BY doc_id),
ds AS (SELECT doc_id, count(DISTINCT w) AS n_seasons FROM (
         SELECT doc_id, unnest(list_filter(words, lambda w: list_contains({_list(U.SEASONS)}, w))) AS w FROM lc) a
       GROUP BY doc_id),
found AS (SELECT pl.doc_id, st.n_stanzas, r2, r3, r4, r5, r6,
               a_ok AND coalesce(n_animals, 0) >= n_stanzas AS r7, r8, r9, r10, r11, r13, r15, r16,
               s_ok AND coalesce(n_seasons, 0) >= n_stanzas AS r17, r18, r19,
               coalesce(last_words[-1] = 'fin', false) AS r20
        FROM pl JOIN st ON st.doc_id = pl.doc_id LEFT JOIN da ON da.doc_id = pl.doc_id
        LEFT JOIN ds ON ds.doc_id = pl.doc_id),
res AS (SELECT d.doc_id, d.author, coalesce(n_stanzas, 0) AS n_stanzas,
               {", ".join(f"coalesce(r{r}, {str(r not in U.SOMEWHERE).lower()}) AS r{r}" for r in CHECKED)}
        FROM (SELECT DISTINCT doc_id, source AS author FROM documents) d LEFT JOIN found ON found.doc_id = d.doc_id),
br AS (SELECT doc_id, author, list_filter([{", ".join(f"CASE WHEN NOT r{r} THEN {r} END" for r in CHECKED)}],
                                          lambda x: x IS NOT NULL) AS broken FROM res)"""


def _results(spark, sf):
    return U.rule_results(S.rule_texts(spark, sf))


def _flags_sql(rs):
    return ", ".join(f"CAST(r{r} AS INTEGER) AS r{r}" for r in rs)


def _flags(df, rs):
    return df.select("doc_id", *[F.col(f"r{r}").cast("int").alias(f"r{r}") for r in rs])


@query("split_lines_stanzas", f"""WITH {RULE_CTE}
SELECT d.doc_id, CAST(count(l.line_no) AS BIGINT) AS n_lines, CAST(count(DISTINCT l.stanza) AS BIGINT) AS n_stanzas
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id""")
def split_lines_stanzas(spark, sf):
    """Lines and stanzas per text; a null or blank text has none of either."""
    texts = S.rule_texts(spark, sf)
    li = U.split_lines(texts)
    n = li.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("stanza").alias("n_stanzas"))
    return texts.select("doc_id").distinct().join(n, "doc_id", "left").fillna(0, ["n_lines", "n_stanzas"])


@query("rule_line_checks", f"WITH {RULE_CTE} SELECT doc_id, {_flags_sql(LINE_R)} FROM res")
def rule_line_checks(spark, sf):
    return _flags(_results(spark, sf), LINE_R)


@query("rule_stanza_checks", f"WITH {RULE_CTE} SELECT doc_id, {_flags_sql(STANZA_R)} FROM res")
def rule_stanza_checks(spark, sf):
    return _flags(_results(spark, sf), STANZA_R)


@query("rule_doc_checks", f"WITH {RULE_CTE} SELECT doc_id, {_flags_sql(DOC_R)} FROM res")
def rule_doc_checks(spark, sf):
    return _flags(_results(spark, sf), DOC_R)


@query("rule_lexicon_checks", f"WITH {RULE_CTE} SELECT doc_id, {_flags_sql(LEX_R)} FROM res")
def rule_lexicon_checks(spark, sf):
    return _flags(_results(spark, sf), LEX_R)


@query("broken_rules", f"""WITH {RULE_CTE}
SELECT doc_id, author, broken, CAST(len(broken) AS INTEGER) AS n_broken FROM br""")
def broken_rules(spark, sf):
    return U.broken_rules(_results(spark, sf))


@query("rule_league", f"""WITH {RULE_CTE},
a AS (SELECT author, count(*) AS n_texts, avg(len(broken)) AS avg_broken FROM br GROUP BY author)
SELECT author, CAST(n_texts AS BIGINT) AS n_texts, round(avg_broken, 6) AS avg_broken,
       CAST(rank() OVER (ORDER BY round(avg_broken, 6)) AS INTEGER) AS rank FROM a""")
def rule_league(spark, sf):
    lg = U.author_league(U.broken_rules(_results(spark, sf)))
    return lg.select("author", "n_texts", r6("avg_broken").alias("avg_broken"), F.col("rank").cast("int"))


_VALUES = ", ".join(f"({i}, {_lit(t)})" for i, t, _ in U.RULES)
_UNPIVOT = " UNION ALL ".join(f"SELECT {r} AS rule_id, r{r} AS passed FROM res" for r in CHECKED)


@query("rule_table", f"""WITH {RULE_CTE},
rl AS (SELECT * FROM (VALUES {_VALUES}) v(rule_id, title)),
p AS ({_UNPIVOT})
SELECT rl.rule_id, rl.title, CAST(count(p.passed) AS BIGINT) AS n_checked,
       CAST(coalesce(sum(CASE WHEN p.passed THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_passed
FROM rl LEFT JOIN p ON p.rule_id = rl.rule_id GROUP BY rl.rule_id, rl.title""")
def rule_table(spark, sf):
    """Rules (parsed from their JSON form) with pass counts over all texts."""
    import json
    doc = json.dumps({"rules": [{"id": i, "title": t, "description": d} for i, t, d in U.RULES]})
    parsed = (spark.createDataFrame([(doc,)], "j string")
              .select(F.explode(F.from_json("j", "struct<rules: array<struct<id:int,title:string,description:string>>>")
                                .getField("rules")).alias("r"))
              .select(F.col("r.id").alias("rule_id"), F.col("r.title").alias("title")))
    res = _results(spark, sf)
    stack = ", ".join(f"{r}, r{r}" for r in CHECKED)
    p = res.selectExpr(f"stack({len(CHECKED)}, {stack}) as (rule_id, passed)")
    agg = p.groupBy("rule_id").agg(F.count("passed").alias("n_checked"),
                                   F.sum(F.col("passed").cast("int")).cast("bigint").alias("n_passed"))
    return (parsed.join(F.broadcast(agg), "rule_id", "left")   # at most 20 rows
            .select("rule_id", "title", F.coalesce("n_checked", F.lit(0)).cast("bigint").alias("n_checked"),
                    F.coalesce("n_passed", F.lit(0)).cast("bigint").alias("n_passed")))
