"""Checked queries for H1-H20, C14-C15 and the session tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import chat_rules as CR
from quarry.operators import chat as H
from quarry.operators import profile as P
from quarry.plans.clean_plan import smart_clean
from quarry.registry import register, rounded
from quarry.registry.views import (CHAT_RESPONSES_SQL, CHAT_TAGGED_SQL, DIRTY_ORDERS_SQL,
                                   chat_responses, chat_tagged, dirty_orders)
from quarry.session import read_table

_TABLES = ("region nation customer supplier part orders lineitem events documents "
           "embeddings pages benchmark labels conversations").split()


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _h1_sql(r: str, bullets: bool) -> str:
    expl = (rf"CASE WHEN regexp_matches({r}, '(?is)EXPLANATION:') THEN "
            + _strip(rf"regexp_replace(regexp_extract({r}, '(?is)EXPLANATION:\s*(.*)', 1), "
                     r"'(?is)(CODE:|NEXT_STEPS:|CHART_TYPE:|DOMAIN_INSIGHTS:).*$', '')")
            + f" ELSE {_strip(r)} END")
    code_re = r"'(?is)CODE:\s*```python\n(.*?)\n```'"
    code = (f"CASE WHEN regexp_matches({r}, {code_re}) THEN "
            + _strip(f"regexp_extract({r}, {code_re}, 1)") + " END")
    block = (rf"regexp_replace(regexp_extract({r}, '(?is)NEXT_STEPS:\s*(.*)', 1), "
             r"'(?is)(CHART_TYPE:|DOMAIN_INSIGHTS:).*$', '')")
    item = _strip(r"regexp_replace(s, '^[-•*]\s*', '')") if bullets else _strip("s")
    steps = (rf"CASE WHEN regexp_matches({r}, '(?is)NEXT_STEPS:') THEN array_to_string("
             f"list_transform(list_filter(string_split({block}, chr(10)), lambda s: {_strip('s')} <> ''), "
             f"lambda s: {item}), chr(10)) ELSE '' END")
    chart_re = r"'(?i)CHART_TYPE:\s*(\w+)'"
    chart = f"CASE WHEN regexp_matches({r}, {chart_re}) THEN regexp_extract({r}, {chart_re}, 1) END"
    ins = (rf"CASE WHEN regexp_matches({r}, '(?is)DOMAIN_INSIGHTS:') THEN "
           + _strip(rf"regexp_extract({r}, '(?is)DOMAIN_INSIGHTS:\s*(.*)', 1)") + " END")
    return (f"{expl} AS explanation, {code} AS code, {steps} AS next_steps, "
            f"{chart} AS chart_type, {ins} AS domain_insights")


def _flat(parsed):
    return [parsed["explanation"].alias("explanation"), parsed["code"].alias("code"),
            F.array_join(parsed["next_steps"], "\n").alias("next_steps"),
            parsed["chart_type"].alias("chart_type"),
            parsed["domain_insights"].alias("domain_insights")]


@register("parse_response", f"WITH {CHAT_RESPONSES_SQL}\nSELECT conv_id, turn, {_h1_sql('response', False)} "
          "FROM chat_responses")
def parse_response(spark, sf):
    r = chat_responses(spark, sf)
    return r.select("conv_id", "turn", *_flat(H.parse_structured_response(F.col("response"))))


def _h2_sql(r: str) -> str:
    g = f"(CASE WHEN json_valid({r}) THEN {r} ELSE '{{}}' END)"
    is_obj = f"(ltrim({r}) LIKE '{{%' AND json_valid({r}) AND json_type({g}) = 'OBJECT')"
    g = f"(CASE WHEN {is_obj} THEN {r} ELSE '{{}}' END)"

    def js(k):
        return f"nullif(json_extract_string({g}, '$.{k}'), '')"
    arr = (f"array_to_string(coalesce(CAST(json_extract({g}, '$.nextSteps') AS VARCHAR[]), "
           f"CAST(json_extract({g}, '$.next_steps') AS VARCHAR[]), []), chr(10))")
    fields = _h1_sql(r, True).split(" AS ")
    # pieces alternate expr / alias; rebuild each field as CASE obj THEN json ELSE text-parse
    h1 = {}
    exprs = _h1_sql(r, True)
    for name in ("explanation", "code", "next_steps", "chart_type", "domain_insights"):
        head, _, exprs = exprs.partition(f" AS {name}")
        h1[name] = head.lstrip(", ")
    del fields
    jv = {"explanation": f"coalesce({js('explanation')}, {js('content')}, {r})",
          "code": f"json_extract_string({g}, '$.code')", "next_steps": arr,
          "chart_type": f"coalesce({js('chartType')}, {js('chart_type')})",
          "domain_insights": f"coalesce({js('domainInsights')}, {js('domain_insights')})"}
    return ", ".join(f"CASE WHEN {is_obj} THEN {jv[k]} ELSE {h1[k]} END AS {k}" for k in jv)


_H2 = f"WITH {CHAT_RESPONSES_SQL}\nSELECT conv_id, turn, {_h2_sql('response')} FROM chat_responses"


@register("parse_json_response", _H2)
def parse_json_response(spark, sf):
    r = chat_responses(spark, sf)
    return r.select("conv_id", "turn", *_flat(H.parse_json_response(F.col("response"))))


@register("message_type", f"""SELECT conv_id, turn, CASE WHEN coalesce(code, '') <> '' THEN 'code'
  WHEN coalesce(chart_type, '') <> '' THEN 'chart' ELSE 'text' END AS type FROM ({_H2}) p""")
def message_type(spark, sf):
    r = chat_responses(spark, sf)
    p = H.parse_json_response(F.col("response"))
    return r.select("conv_id", "turn", H.message_type(p["code"], p["chart_type"]).alias("type"))


_CODES = f"""WITH {CHAT_RESPONSES_SQL},
codes AS (SELECT conv_id, turn, code FROM (SELECT conv_id, turn, {_h2_sql('response')} FROM chat_responses) p
          WHERE code IS NOT NULL)"""


@register("screen_code_patterns", _CODES + "\nSELECT conv_id, turn, ("
          + " OR ".join(f"regexp_matches(lower(code), '{p}')" for p in CR.BLOCKED_PATTERNS)
          + ") AS blocked FROM codes")
def screen_code_patterns(spark, sf):
    r = chat_responses(spark, sf)
    p = r.select("conv_id", "turn", H.parse_json_response(F.col("response"))["code"].alias("code"))
    return p.where("code IS NOT NULL").select("conv_id", "turn", H.blocked_code(F.col("code")).alias("blocked"))


@register("screen_code")
def screen_code(spark, sf):
    """Rows-only: the parse/import check runs Python's ``ast`` (tested in pytest)."""
    r = chat_responses(spark, sf)
    p = r.select("conv_id", "turn", H.parse_json_response(F.col("response"))["code"].alias("code"))
    return p.where("code IS NOT NULL").select("conv_id", "turn", "code",
                                              H.screen_code(F.col("code")).alias("safe"))


@register("auto_run_class", _CODES + "\nSELECT conv_id, turn, CASE WHEN ("
          + " OR ".join(f"regexp_matches(code, '(?i){p}')" for p in CR.AUTO_RUN_UNSAFE)
          + ") THEN false ELSE (" + " OR ".join(f"regexp_matches(code, '(?i){p}')" for p in CR.AUTO_RUN_SAFE)
          + ") END AS auto_run FROM codes")
def auto_run_class(spark, sf):
    r = chat_responses(spark, sf)
    p = r.select("conv_id", "turn", H.parse_json_response(F.col("response"))["code"].alias("code"))
    return p.where("code IS NOT NULL").select("conv_id", "turn", H.auto_run_allowed(F.col("code")).alias("auto_run"))


def _prompt_type_sql(x):
    arms = " ".join(f"WHEN {_any(x, words)} THEN '{name}'" for name, words in CR.PROMPT_TYPE_RULES)
    return f"CASE {arms} ELSE '{CR.PROMPT_TYPE_DEFAULT}' END"


@register("prompt_type", f"WITH {CHAT_TAGGED_SQL}\nSELECT conv_id, turn, "
          f"{_prompt_type_sql('lower(text)')} AS prompt_type FROM chat_tagged WHERE role = 'user'")
def prompt_type(spark, sf):
    c = chat_tagged(spark, sf).where("role = 'user'")
    return c.select("conv_id", "turn", H.prompt_type(F.col("text")).alias("prompt_type"))


def _dataset_facts(spark, sf):
    """Domain, numeric-column count and total missing of the cleaned
    dirty_orders table (the dataset the conversations talk about)."""
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    from quarry.functions.kinds import numeric_columns
    total = P.missing_summary(full).first()["total_missing"]
    return H.domain_of(full.columns), len(numeric_columns(full)), total


_CLEANED_TOTAL = f"""WITH {DIRTY_ORDERS_SQL},
tot AS (SELECT sum((CASE WHEN lower(trim(price_txt)) IN ('na','n/a','none','null','nan','missing','unknown','')
                         OR NOT regexp_matches(trim(price_txt), '^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$')
                         THEN 1 ELSE 0 END)
                 + (CASE WHEN order_date_txt = 'not a date' THEN 1 ELSE 0 END)
                 + (CASE WHEN amt IS NULL THEN 1 ELSE 0 END)) AS n FROM dirty_orders)"""


@register("rule_answer", _CLEANED_TOTAL + f""", {CHAT_TAGGED_SQL}
SELECT conv_id, turn, CASE
  WHEN {_any('lower(text)', CR.RULE_CLEAN_WORDS)} THEN
    '{CR.RULE_CLEAN_TEXT.split('{domain}')[0]}' || 'financial' || ' dataset with ' || CAST(tot.n AS VARCHAR)
    || ' missing values:' || chr(10) || chr(10) || '**Immediate Actions:**' || chr(10)
    || '1. Use Deep Clean feature' || chr(10) || '2. Numerical: Impute with median/mean' || chr(10)
    || '3. Categorical: Use mode or "Unknown"' || chr(10) || '4. Remove columns >50% missing'
    || chr(10) || chr(10) || '{CR.RULE_DOMAIN_ADVICE['financial']}'
  WHEN {_any('lower(text)', CR.RULE_MODEL_WORDS)} THEN
    '🤖 **ML Model Recommendations**' || chr(10) || chr(10) || '• Linear Regression' || chr(10)
    || '• Random Forest' || chr(10) || '• XGBoost' || chr(10) || chr(10) || '**Next Steps:**' || chr(10)
    || '1. Preprocess data' || chr(10) || '2. Feature engineering' || chr(10)
    || '3. Train-validation split' || chr(10) || '4. Model evaluation'
  ELSE '💡 I can help with:' || chr(10) || '• Data cleaning' || chr(10) || '• ML models' || chr(10)
    || '• Python code' || chr(10) || '• Visualizations' || chr(10) || '• Statistical analysis'
  END AS answer
FROM chat_tagged, tot WHERE role = 'user'""".replace("{CR.RULE_CLEAN_TEXT.split('{domain}')[0]}",
                                                     CR.RULE_CLEAN_TEXT.split("{domain}")[0].replace("\n", "' || chr(10) || '")))
def rule_answer(spark, sf):
    domain, n_num, total = _dataset_facts(spark, sf)
    c = chat_tagged(spark, sf).where("role = 'user'")
    return c.select("conv_id", "turn", H.rule_answer(F.col("text"), F.lit(domain), F.lit(n_num),
                                                     F.lit(total)).alias("answer"))


def _focus_sql(x, domain):
    arms = []
    for kw, focus in CR.FOCUS_DOMAIN_RULES.get(domain, []):
        arms.append(f"WHEN contains({x}, '{kw}') THEN '{focus}'")
    for name, words in CR.FOCUS_GENERAL_RULES:
        arms.append(f"WHEN {_any(x, words)} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{CR.FOCUS_DEFAULT}' END"


@register("focus", f"WITH {CHAT_TAGGED_SQL}\nSELECT conv_id, turn, {_focus_sql('lower(text)', 'financial')} "
          "AS focus FROM chat_tagged WHERE role = 'user'")
def focus(spark, sf):
    domain, _, _ = _dataset_facts(spark, sf)
    c = chat_tagged(spark, sf).where("role = 'user'")
    return c.select("conv_id", "turn", H.detect_focus(F.col("text"), F.lit(domain)).alias("focus"))


@register("chat_history", f"""WITH {CHAT_TAGGED_SQL}
SELECT conv_id, turn, role, text, coalesce(string_agg(upper(role) || ': ' || text, chr(10)) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 'No history') AS history
FROM chat_tagged""")
def chat_history(spark, sf):
    return H.chat_history(chat_tagged(spark, sf))


@register("chat_history_gaps", """WITH g AS (SELECT conv_id, turn * 700 AS turn, role, text FROM conversations WHERE turn % 3 <> 1)
SELECT conv_id, turn, role, text, coalesce(string_agg(upper(role) || ': ' || text, chr(10)) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 'No history') AS history FROM g""")
def chat_history_gaps(spark, sf):
    from pyspark.sql import functions as F
    g = read_table(spark, sf, "conversations").where("turn % 3 <> 1").withColumn("turn", F.col("turn") * 700)
    return H.chat_history(g)


def _completed_sql():
    parts = [f"SELECT conv_id, {i} AS i, '{tag}' AS tag, min(turn) AS first FROM chat_tagged "
             f"WHERE role = 'assistant' AND contains(lower(text), '{kw}') GROUP BY conv_id"
             for i, (kw, tag) in enumerate(CR.ANALYSIS_TAGS)]
    return f"""{CHAT_TAGGED_SQL},
hits AS ({' UNION ALL '.join(parts)}),
done AS (SELECT c.conv_id, coalesce(list(h.tag ORDER BY h.first, h.i) FILTER (WHERE h.tag IS NOT NULL), [])
         AS completed FROM (SELECT DISTINCT conv_id FROM chat_tagged) c
         LEFT JOIN hits h ON c.conv_id = h.conv_id GROUP BY c.conv_id)"""


@register("completed_analyses", f"WITH {_completed_sql()}\n"
          "SELECT conv_id, array_to_string(completed, ',') AS completed FROM done")
def completed_analyses(spark, sf):
    d = H.completed_analyses(chat_tagged(spark, sf))
    return d.select("conv_id", F.array_join("completed", ",").alias("completed"))


def _steps_sql(domain):
    base = "[" + ", ".join(f"'{s}'" for s in CR.DOMAIN_NEXT_STEPS.get(domain, CR.DOMAIN_NEXT_STEPS["general"])) + "]"
    gaps = "list_filter([" + ", ".join(
        f"CASE WHEN NOT list_contains(completed, '{tag}') THEN '{txt}' END" for tag, txt in CR.GAP_NEXT_STEPS
    ) + "], lambda x: x IS NOT NULL)"
    adv = "CASE WHEN len(completed) >= 2 THEN [" + ", ".join(f"'{s}'" for s in CR.ADVANCED_NEXT_STEPS) + "] ELSE [] END"
    return f"list_slice(list_concat(list_concat({base}, {gaps}), {adv}), 1, 6)"


@register("suggested_steps", f"WITH {_completed_sql()}\n"
          f"SELECT conv_id, array_to_string({_steps_sql('financial')}, '|') AS steps FROM done")
def suggested_steps(spark, sf):
    domain, _, _ = _dataset_facts(spark, sf)
    d = H.completed_analyses(chat_tagged(spark, sf))
    return d.select("conv_id", F.array_join(H.suggested_steps(F.col("completed"), F.lit(domain)), "|").alias("steps"))


_DOMAINS = ("financial", "healthcare", "ecommerce", "education", "other")


def _first_steps_sql():
    cases = " ".join(f"WHEN {i} THEN '{'|'.join(CR.FIRST_SESSION_STEPS.get(d, CR.FIRST_SESSION_STEPS['general']))}'"
                     for i, d in enumerate(_DOMAINS))
    return f"SELECT DISTINCT conv_id, CASE conv_id % 5 {cases} END AS steps FROM conversations"


@register("first_session_steps", _first_steps_sql())
def first_session_steps(spark, sf):
    """The list shown for a new session, for conversations dealt over all domains."""
    convs = read_table(spark, sf, "conversations").select("conv_id").distinct()
    domain = F.get(F.array(*[F.lit(d) for d in _DOMAINS]), (F.col("conv_id") % 5).cast("int"))
    return convs.select("conv_id", F.array_join(H.first_session_steps(domain), "|").alias("steps"))


@register("retained_messages", f"""WITH {CHAT_TAGGED_SQL}
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
FROM chat_tagged) t WHERE rn <= 50""")
def retained_messages(spark, sf):
    return H.recent_messages(chat_tagged(spark, sf), 50)


@register("recent_messages", f"""WITH {CHAT_TAGGED_SQL}
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
FROM chat_tagged) t WHERE rn <= 5""")
def recent_messages(spark, sf):
    return H.recent_messages(chat_tagged(spark, sf), 5)


@register("session_rollup", f"""WITH {CHAT_RESPONSES_SQL},
typed AS (SELECT conv_id, turn, CASE WHEN coalesce(code, '') <> '' THEN 'code'
  WHEN coalesce(chart_type, '') <> '' THEN 'chart' ELSE 'text' END AS type
  FROM (SELECT conv_id, turn, {_h2_sql('response')} FROM chat_responses) p
  UNION ALL SELECT conv_id, turn, 'text' FROM conversations WHERE role <> 'assistant')
SELECT conv_id, count(*) AS total_interactions, count(*) FILTER (WHERE type = 'code') AS code_generation_count,
  count(*) FILTER (WHERE type = 'chart') AS visualization_requests,
  count(*) FILTER (WHERE type = 'execution') AS code_executions, max(turn) AS last_turn
FROM typed GROUP BY conv_id""")
def session_rollup(spark, sf):
    r = chat_responses(spark, sf)
    p = H.parse_json_response(F.col("response"))
    typed = r.select("conv_id", "turn", H.message_type(p["code"], p["chart_type"]).alias("type"))
    others = read_table(spark, sf, "conversations").where("role <> 'assistant'") \
        .select("conv_id", "turn", F.lit("text").alias("type"))
    return H.session_rollup(typed.unionByName(others))


@register("conversation_context", f"""WITH {_completed_sql()},
lastq AS (SELECT conv_id, arg_max(text, turn) AS q FROM chat_tagged WHERE role = 'user' GROUP BY conv_id),
rec AS (SELECT conv_id, list(turn ORDER BY turn) AS turns,
        string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM (SELECT *, row_number() OVER
        (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM chat_tagged) t WHERE rn <= 5 GROUP BY conv_id)
SELECT d.conv_id, array_to_string(rec.turns, ',') AS recent_turns, rec.messages AS recent_messages,
  'Completed analyses: ' || coalesce(nullif(array_to_string(d.completed, ', '), ''), 'None')
  || '. Current focus: ' || CASE WHEN lastq.q IS NULL THEN 'general_analysis' ELSE {_focus_sql('lower(lastq.q)', 'financial')} END
  || '. Domain: financial' AS analysis_progress,
  array_to_string({_steps_sql('financial').replace('completed', 'd.completed')}, '|') AS suggested_questions,
  'financial' AS domain
FROM done d LEFT JOIN lastq ON d.conv_id = lastq.conv_id LEFT JOIN rec ON d.conv_id = rec.conv_id""")
def conversation_context(spark, sf):
    domain, _, _ = _dataset_facts(spark, sf)
    ctx = H.conversation_context(chat_tagged(spark, sf), F.lit(domain))
    said = F.transform("recent_messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return ctx.select("conv_id", F.array_join("recent_turns", ",").alias("recent_turns"),
                      F.array_join(said, "\n").alias("recent_messages"),
                      "analysis_progress", F.array_join("suggested_questions", "|").alias("suggested_questions"),
                      "domain")


@register("proactive_question", _CLEANED_TOTAL + f"""
SELECT CASE WHEN n > 0 THEN 'Found ' || CAST(n AS VARCHAR) || ' missing values. Would you like automatic handling or a preview?' END AS question FROM tot""")
def proactive_question(spark, sf):
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    ms = P.missing_summary(full)
    return ms.select(H.proactive_question(F.col("total_missing")).alias("question"))


_NOW = "2024-01-31 00:00:00"
_SESS_SQL = """sess AS (SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS last_active,
  count(*) AS total_interactions, arg_min(event_type, (ts, event_type)) AS domain FROM events GROUP BY user_id)"""


def _sessions(spark, sf):
    return H.sessions_from_activity(read_table(spark, sf, "events"))


@register("session_stats", f"""WITH {_SESS_SQL}
SELECT count(*) AS total_sessions,
  count(*) FILTER (WHERE epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last_active) < {CR.ACTIVE_WINDOW_S} * CAST(1000000 AS BIGINT)) AS active_sessions,
  CAST(sum(total_interactions) AS BIGINT) AS total_interactions,
  round(coalesce(avg((epoch_us(TIMESTAMP '{_NOW}') - epoch_us(created_at)) / 1e6)
     FILTER (WHERE epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last_active) < {CR.ACTIVE_WINDOW_S} * CAST(1000000 AS BIGINT)), 0.0), 3)
     AS avg_session_age_s
FROM sess""")
def session_stats(spark, sf):
    return rounded(H.session_stats(_sessions(spark, sf), _NOW), 3)


@register("domain_breakdown", f"WITH {_SESS_SQL}\nSELECT coalesce(domain, 'unknown') AS domain, count(*) AS sessions "
          "FROM sess GROUP BY 1")
def domain_breakdown(spark, sf):
    return H.domain_breakdown(_sessions(spark, sf))


@register("evict_oldest", f"""WITH {_SESS_SQL}
SELECT * FROM sess WHERE (SELECT count(*) FROM sess) < 100 OR session_id NOT IN (
  SELECT session_id FROM sess ORDER BY last_active, session_id LIMIT 10)""")
def evict_oldest(spark, sf):
    return H.evict_oldest(_sessions(spark, sf))


@register("expire_sessions", f"""WITH {_SESS_SQL}
SELECT 'idle' AS mode, count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_active) > {CR.IDLE_TIMEOUT_S} * CAST(1000000 AS BIGINT)) AS removed,
  count(*) FILTER (WHERE NOT (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_active) > {CR.IDLE_TIMEOUT_S} * CAST(1000000 AS BIGINT))) AS remaining FROM sess
UNION ALL
SELECT 'backend', count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(created_at) > {CR.BACKEND_SESSION_TTL_S} * CAST(1000000 AS BIGINT)),
  count(*) FILTER (WHERE NOT (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(created_at) > {CR.BACKEND_SESSION_TTL_S} * CAST(1000000 AS BIGINT))) FROM sess""")
def expire_sessions(spark, sf):
    s = _sessions(spark, sf)
    out = None
    for mode in ("idle", "backend"):
        e = H.expire_sessions(s, "2024-01-30 12:00:00", mode).agg(
            F.count_if("expired").alias("removed"), F.count_if(~F.col("expired")).alias("remaining"))
        e = e.select(F.lit(mode).alias("mode"), "removed", "remaining")
        out = e if out is None else out.unionByName(e)
    return out


@register("session_json", f"""WITH {_SESS_SQL}
SELECT session_id AS sessionId, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS createdAt,
  strftime(last_active, '%Y-%m-%dT%H:%M:%S.%f') AS lastActive, total_interactions AS totalInteractions,
  domain FROM sess""")
def session_json(spark, sf):
    docs = H.session_to_json(_sessions(spark, sf))
    back = H.session_from_json(docs)
    return back.select("session.sessionId", "session.createdAt", "session.lastActive",
                       "session.metadata.totalInteractions", "session.metadata.domain")


_TYPED = "CASE turn % 4 WHEN 1 THEN 'code' WHEN 2 THEN 'chart' WHEN 3 THEN 'execution' ELSE 'text' END"


@register("session_documents", f"""WITH {_completed_sql()},
t AS (SELECT *, {_TYPED} AS type FROM chat_tagged),
lastq AS (SELECT conv_id, arg_max(text, turn) AS q FROM t WHERE role = 'user' GROUP BY conv_id),
kept AS (SELECT conv_id, count(*) AS n_messages, string_agg(conv_id || '-' || turn || ' ' || role || ' ' || type || ': ' || text,
  chr(10) ORDER BY turn) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM t) x
  WHERE rn <= {CR.MAX_MESSAGES} GROUP BY conv_id),
n AS (SELECT conv_id, min(turn) AS lo, count(*) AS total, count(*) FILTER (WHERE type = 'code') AS codes,
  count(*) FILTER (WHERE type = 'chart') AS charts, count(*) FILTER (WHERE type = 'execution') AS runs FROM t GROUP BY conv_id)
SELECT CAST(d.conv_id AS VARCHAR) AS session_id, n_messages, messages, total, codes, charts, runs,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(lo), '%Y-%m-%d %H:%M:%S') AS created, '2025-06-01 12:00:00' AS active,
  CASE WHEN q IS NULL THEN 'initial_analysis' ELSE {_focus_sql('lower(q)', 'financial')} END AS focus,
  array_to_string(d.completed, '|') AS completed,
  array_to_string({_steps_sql('financial').replace('completed', 'd.completed')}, '|') AS steps,
  'orders.csv' AS filename, (SELECT count(*) FROM orders) AS rows, 'financial' AS domain
FROM done d JOIN n ON n.conv_id = d.conv_id JOIN kept ON kept.conv_id = d.conv_id LEFT JOIN lastq ON lastq.conv_id = d.conv_id""")
def session_documents(spark, sf):
    from quarry.plans.report import dataset_context
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    msgs = chat_tagged(spark, sf).withColumn("type", F.expr(_TYPED)).withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, turn)"))
    docs = H.export_sessions(H.chat_sessions(msgs, dataset_context(full, "orders.csv", ["o_orderkey"])))
    x = H.import_sessions(docs, "2025-06-01 12:00:00").select("session.*")
    said = F.transform("messages", lambda m: F.concat(m["id"], F.lit(" "), m["role"], F.lit(" "), m["type"], F.lit(": "), m["content"]))
    stamp = (lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return x.select(
        F.col("sessionId").alias("session_id"), F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(said, "\n").alias("messages"), F.col("metadata.totalInteractions").alias("total"),
        F.col("metadata.codeGenerationCount").alias("codes"), F.col("metadata.visualizationRequests").alias("charts"),
        F.col("metadata.codeExecutions").alias("runs"), stamp("createdAt").alias("created"), stamp("lastActive").alias("active"),
        F.col("analysisState.currentFocus").alias("focus"), F.array_join("analysisState.completedAnalyses", "|").alias("completed"),
        F.array_join("analysisState.suggestedNextSteps", "|").alias("steps"), F.col("datasetContext.filename").alias("filename"),
        F.col("datasetContext.shape.rows").alias("rows"), F.col("metadata.domain").alias("domain"))


def _column_lists(spark, sf):
    """(table_name, columns, rows): the schema of every driver table with
    its row count (C1 + C15: a dataset is reported with its shape)."""
    from quarry.sources.catalog import table_row_counts
    rows = [(t, read_table(spark, sf, t).columns) for t in _TABLES]
    names = spark.createDataFrame(rows, "table_name string, columns array<string>")
    for t in _TABLES:
        read_table(spark, sf, t).createOrReplaceTempView(t)
    counts = table_row_counts(spark, _TABLES).withColumnRenamed("name", "table_name")
    return names.join(counts, "table_name")


_COLS_SQL = """cols AS (SELECT table_name, lower(string_agg(column_name, ' ' ORDER BY ordinal_position)) AS names
  FROM information_schema.columns WHERE table_name IN ('""" + "', '".join(_TABLES) + """')
  GROUP BY table_name),
counts AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES) + ")"


@register("domain_detect", f"WITH {_COLS_SQL}\nSELECT cols.table_name, counts.rows, CASE "
          + " ".join(f"WHEN {_any('names', words)} THEN '{name}'" for name, words in CR.DOMAIN_RULES)
          + f" ELSE '{CR.DOMAIN_DEFAULT}' END AS domain FROM cols JOIN counts ON cols.table_name = counts.table_name")
def domain_detect(spark, sf):
    c = _column_lists(spark, sf)
    return c.select("table_name", "rows", H.detect_domain(F.col("columns")).alias("domain"))


@register("domain_hints", f"WITH {_COLS_SQL}\nSELECT cols.table_name, counts.rows, concat_ws('|', "
          f"CASE WHEN {_any('names', CR.FINANCIAL_HINT_WORDS)} THEN '{CR.FINANCIAL_HINT}' END, "
          f"CASE WHEN {_any('names', CR.HEALTHCARE_HINT_WORDS)} THEN '{CR.HEALTHCARE_HINT}' END) AS hints "
          "FROM cols JOIN counts ON cols.table_name = counts.table_name")
def domain_hints(spark, sf):
    c = _column_lists(spark, sf)
    return c.select("table_name", "rows", F.array_join(H.domain_hints(F.col("columns")), "|").alias("hints"))


_CLEAN_COLS = ["o_orderkey", "price_txt", "code_txt", "order_date_txt", "status", "int_like", "amt",
               "o_orderpriority"]


def _prompt_sql() -> str:
    from quarry.registry.clean import _WITH_CLEANED
    t = CR.PROMPT_TEMPLATE
    head, rest = t.split("{history}")
    mid, tail = rest.split("{query}")

    def lit(s):
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    head_sql = (lit(head.split("{rows}")[0].replace("{filename}", "orders.csv")) + " || CAST(m.rows AS VARCHAR) || "
                + lit(head.split("{rows}")[1].split("{missing}")[0]
                      .replace("{columns}", "8").replace("{column_list}", ", ".join(_CLEAN_COLS))
                      .replace("{numerical}", "o_orderkey, price_txt, int_like, amt")
                      .replace("{categorical}", "code_txt, order_date_txt, status, o_orderpriority"))
                + " || m.summary || " + lit(head.split("{missing}")[1]))
    miss = " || ', ' || ".join(
        f"'{c}: ' || CAST(count(*) - count({c}) AS VARCHAR)" for c in ["price_txt", "order_date_txt", "amt"])
    return (_WITH_CLEANED.rstrip() + f""",
m AS (SELECT count(*) AS rows, {miss} AS summary FROM cleaned),
{CHAT_TAGGED_SQL},
h AS (SELECT conv_id, turn, role, text, coalesce(string_agg(upper(role) || ': ' || text, chr(10)) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 'No history') AS history
  FROM chat_tagged)
SELECT h.conv_id, h.turn, {head_sql} || h.history || {lit(mid)} || h.text || {lit(tail)} AS prompt
FROM h, m WHERE h.role = 'user'""")


@register("build_prompts", _prompt_sql())
def build_prompts(spark, sf):
    from quarry.functions.kinds import categorical_columns, numeric_columns
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    mc = {r["column_name"]: r["missing"] for r in P.missing_counts(full).orderBy("ord").collect()}
    rows = P.shape(full).first()["rows"]
    hist = H.chat_history(chat_tagged(spark, sf)).where("role = 'user'")
    out = H.build_prompts(hist, "orders.csv", rows, full.columns, numeric_columns(full),
                          categorical_columns(full), mc)
    return out.select("conv_id", "turn", "prompt")
