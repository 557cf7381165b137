"""Answer visibility queries."""

from pyspark.sql import functions as F

from ..operators import answers
from . import sqlurl as q
from .base import half_even, query

BRAND, RIVALS, DOMAINS = ["Acme"], ["Globex", "Initech"], ["example.com", "ththth.example.net"]
V = ("v_answers", "v_answer_urls")

HOST = q.bare(q.host("url"))
OURS = f"({HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} = 'ththth.example.net' OR {HOST} LIKE '%.ththth.example.net')"
BASE = f"""WITH hosts AS (SELECT DISTINCT answer_id, {HOST} AS host FROM v_answer_urls WHERE {HOST} <> 'vertexaisearch.cloud.google.com'),
  own AS (SELECT answer_id, bool_or({OURS}) AS hit FROM v_answer_urls GROUP BY 1),
  an AS (SELECT a.*, coalesce(own.hit, FALSE) AS our_url_cited, regexp_matches(answer,'(?i)(^|[^a-z0-9_])acme([^a-z0-9_]|$)') AS brand_mentioned,
    strpos(answer,'Globex') AS g, strpos(answer,'Initech') AS i, strpos(lower(answer),'acme') AS b FROM v_answers a LEFT JOIN own USING (answer_id)),
  s AS (SELECT *, CASE WHEN brand_mentioned THEN CAST(1 + (CASE WHEN g > 0 AND g < b THEN 1 ELSE 0 END) + (CASE WHEN i > 0 AND i < b THEN 1 ELSE 0 END) AS INTEGER) END AS brand_position,
    CASE WHEN g > 0 AND (i = 0 OR g < i) THEN CASE WHEN i > 0 THEN 'Globex,Initech' ELSE 'Globex' END WHEN i > 0 THEN CASE WHEN g > 0 THEN 'Initech,Globex' ELSE 'Initech' END ELSE '' END AS rivals FROM an)"""
RATES = f"""count(*) AS calls, count(*) FILTER (WHERE error IS NOT NULL) AS failed,
  {half_even('count(*) FILTER (WHERE error IS NULL AND brand_mentioned)', 'count(*) FILTER (WHERE error IS NULL)', 4)} AS mention_rate,
  {half_even('count(*) FILTER (WHERE error IS NULL AND our_url_cited)', 'count(*) FILTER (WHERE error IS NULL)', 4)} AS citation_rate,
  {half_even('sum(brand_position) FILTER (WHERE error IS NULL)', 'count(brand_position) FILTER (WHERE error IS NULL)', 2)} AS avg_position"""
COST = "CAST(CAST(sum(cost_micros) AS DECIMAL(18,0)) / 1000000 AS DECIMAL(18,6)) AS cost_usd"


def _analyzed(t):
    return answers.analyze(answers.attach_urls(t.v_answers, t.v_answer_urls), BRAND, RIVALS, DOMAINS)


@query("answer_mentions", f"{BASE} SELECT answer_id, brand_mentioned, our_url_cited, rivals AS competitors FROM s", V)
def answer_mentions(t):
    return _analyzed(t).select(
        "answer_id", "brand_mentioned", "our_url_cited", F.array_join("competitors_mentioned", ",").alias("competitors")
    )


@query("brand_position", f"{BASE} SELECT answer_id, brand_position FROM s", V)
def brand_position(t):
    return _analyzed(t).select("answer_id", "brand_position")


@query("cited_domains", f"{BASE} SELECT answer_id, host AS domain FROM hosts", V)
def cited_domains(t):
    return _analyzed(t).select("answer_id", F.explode("cited_domains").alias("domain"))


FIGS = """WITH fg AS (SELECT answer_id, engine, prompt_id, run, answer, unnest(regexp_extract_all(answer, '\\$\\s?(?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?')) AS figure,
    strpos(lower(answer),'acme') + 3 AS brand_end FROM v_answers WHERE regexp_matches(answer,'(?i)(^|[^a-z0-9_])acme([^a-z0-9_]|$)')),
  near AS (SELECT DISTINCT answer_id, engine, prompt_id, run, figure FROM fg WHERE strpos(answer, figure) - 1 - brand_end <= 300)"""


@query(
    "unverified_figures",
    f"""{FIGS} SELECT answer_id, figure, 'check by hand' AS note FROM near
        WHERE CAST(replace(figure,'$','') AS DECIMAL(18,6)) NOT IN (SELECT CAST(replace(figure,'$','') AS DECIMAL(18,6)) FROM v_facts)""",
    ("v_answers", "v_facts"),
)
def unverified_figures(t):
    return answers.unverified_figures(t.v_answers, BRAND, t.v_facts, ["answer_id"])


@query(
    "figures_to_check",
    f"""{FIGS} SELECT engine, prompt_id, run, figure, 'check by hand' AS note FROM near
        WHERE CAST(replace(figure,'$','') AS DECIMAL(18,6)) NOT IN (SELECT CAST(replace(figure,'$','') AS DECIMAL(18,6)) FROM v_facts)""",
    ("v_answers", "v_facts"),
)
def figures_to_check(t):
    keys = ["answer_id", "engine", "prompt_id", "run"]
    return answers.figures_to_check(answers.unverified_figures(t.v_answers, BRAND, t.v_facts, keys))


@query(
    "money_figures",
    """SELECT figure, rtrim(rtrim(CAST(CAST(replace(figure,'$','') AS DECIMAL(18,6)) AS VARCHAR),'0'),'.') AS money_key, count(*) AS n
       FROM (SELECT unnest(regexp_extract_all(answer, '\\$\\s?(?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?')) AS figure FROM v_answers) GROUP BY 1,2""",
    ("v_answers",),
)
def money_figures(t):
    from ..functions import text

    f = t.v_answers.select(F.explode(text.money_figures("answer")).alias("figure"))
    return f.groupBy("figure", text.money_key("figure").alias("money_key")).agg(F.count("*").alias("n"))


@query("engine_summary", f"{BASE} SELECT engine, {RATES}, {COST} FROM s GROUP BY engine", V)
def engine_summary(t):
    return answers.engine_summary(_analyzed(t))


@query(
    "prompt_summary",
    f"{BASE} SELECT * EXCLUDE (failed) FROM (SELECT prompt_id, arg_min(kind, answer_id) AS kind, {RATES} FROM s GROUP BY prompt_id)",
    V,
)
def prompt_summary(t):
    return answers.prompt_summary(_analyzed(t))


@query("answer_cube", f"{BASE} SELECT engine, prompt_id, kind, {RATES} FROM s GROUP BY CUBE(engine, prompt_id, kind)", V)
def answer_cube(t):
    return answers.answer_cube(_analyzed(t))


@query("top_cited", f"{BASE} SELECT host AS domain, count(*) AS answers FROM hosts JOIN s USING (answer_id) WHERE error IS NULL GROUP BY host", V)
def top_cited(t):
    return answers.top_cited(_analyzed(t))


@query(
    "offsite_gap",
    f"""{BASE} SELECT host AS domain, count(*) AS answers FROM hosts JOIN s USING (answer_id) WHERE error IS NULL
        AND host NOT IN ('example.com','ththth.example.net') AND host NOT LIKE '%.example.com' AND host NOT LIKE '%.ththth.example.net'
        GROUP BY host HAVING NOT bool_or(brand_mentioned)""",
    V,
)
def offsite_gap(t):
    return answers.offsite_gap(_analyzed(t), DOMAINS)


@query(
    "run_variance",
    f"""{BASE} SELECT engine, prompt_id, count(*) AS runs, count(*) FILTER (WHERE brand_mentioned) AS mentions,
        {half_even('greatest(count(*) FILTER (WHERE brand_mentioned), count(*) FILTER (WHERE NOT brand_mentioned))', 'count(*)', 4)} AS agreement,
        min(brand_position) AS best_position, max(brand_position) AS worst_position FROM s WHERE error IS NULL GROUP BY 1,2""",
    V,
)
def run_variance(t):
    return answers.run_variance(_analyzed(t))


@query("cost_report", f"SELECT engine, kind, count(*) AS calls, {COST} FROM v_answers GROUP BY 1,2", V)
def cost_report(t):
    return answers.cost_report(t.v_answers)


@query(
    "share_of_voice",
    f"""{BASE}, m AS (SELECT 'Acme' AS name FROM s WHERE error IS NULL AND brand_mentioned UNION ALL SELECT 'Globex' FROM s WHERE error IS NULL AND g > 0
        UNION ALL SELECT 'Initech' FROM s WHERE error IS NULL AND i > 0)
        SELECT name, count(*) AS mentions, {half_even('count(*)', '(SELECT count(*) FROM m)', 4)} AS share FROM m GROUP BY name""",
    V,
)
def share_of_voice(t):
    return answers.share_of_voice(_analyzed(t), "Acme")


@query(
    "call_plan",
    """SELECT *, call_no <= 1000 AS in_budget FROM (SELECT prompt_id, prompt_pos, kind, run, engine_no, engine, row_number() OVER (ORDER BY prompt_pos, prompt_id, run, engine_no) AS call_no
       FROM (SELECT prompt_id, prompt_pos, kind, unnest([1,2,3]) AS run FROM v_prompts), (SELECT unnest([0,1,2]) AS engine_no, unnest(['engine0','engine1','engine2']) AS engine))""",
    ("v_prompts",),
)
def call_plan(t):
    return answers.call_plan(t.v_prompts, ["engine0", "engine1", "engine2"], 3, 1000)


@query(
    "ai_delta",
    f"""{BASE}, p AS (SELECT engine, {RATES} FROM s WHERE run < 3 GROUP BY engine), c AS (SELECT engine, {RATES} FROM s WHERE run >= 3 GROUP BY engine)
        SELECT c.engine, c.mention_rate, c.citation_rate, c.mention_rate - p.mention_rate AS mention_delta, c.citation_rate - p.citation_rate AS citation_delta
        FROM c LEFT JOIN p USING (engine)""",
    V,
)
def ai_delta(t):
    a = _analyzed(t)
    return answers.ai_delta(
        answers.engine_summary(a.filter("run < 3")), answers.engine_summary(a.filter("run >= 3"))
    )
