"""Inbox, resolution, turn and complaint queries over the chat tables."""

from pyspark.sql import functions as F

from tellerlake.functions.calendar import local_day
from tellerlake.functions.money import cost_usd
from tellerlake.operators.latest import newest_per_group, page_after
from tellerlake.plans import service as S
from tellerlake.registry import query
from tellerlake.standin import oracle

ZONE, FIRST, LAST = "America/Bogota", "2024-03-01", "2024-03-04"
KEY = "coalesce(customer_id, user_email, user_id)"
REASON = "(SELECT chat_id, arg_max(reason, {'t': created_at, 'i': handoff_id}) AS reason FROM handoffs GROUP BY 1)"
LATEST_OPEN = f"(SELECT *, {KEY} AS customer_key FROM chats WHERE closed_at IS NULL QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY created_at DESC, chat_id DESC) = 1)"


def local(c):
    return f"timezone('{ZONE}', timezone('UTC', {c}))"


INSIDE = f"{{0}} >= timezone('UTC', timezone('{ZONE}', TIMESTAMP '{FIRST}')) AND {{0}} < timezone('UTC', timezone('{ZONE}', TIMESTAMP '{LAST}' + INTERVAL 1 DAY))"


@query("f37_customer_key", oracle("chats", f"SELECT chat_id, {KEY} AS customer_key FROM chats"))
def _(b):
    return b.chats.select("chat_id", S.customer_key().alias("customer_key"))


@query("j12_latest_reason", oracle("chats handoffs", """
  SELECT chat_id, (SELECT reason FROM handoffs h WHERE h.chat_id = c.chat_id ORDER BY created_at DESC, handoff_id DESC LIMIT 1) AS reason FROM chats c"""))
def _(b):
    return b.chats.select("chat_id").join(S.latest_reason(b.handoffs), "chat_id", "left")


@query("p08_inbox_listing", oracle("chats handoffs", f"""
  SELECT c.chat_id, c.handled_by, c.use_case, r.reason FROM chats c LEFT JOIN {REASON} r USING (chat_id)
  WHERE handled_by IN ('human_queue', 'human_agent') AND intent = 'GENERAL_INQUIRY' AND closed_at IS NULL AND reason = 'complaint'"""))
def _(b):
    return S.inbox(b.chats, b.handoffs, S.HUMAN, intent="GENERAL_INQUIRY", status="open", handoff_reason="complaint").select("chat_id", "handled_by", "use_case", "reason")


@query("p10_user_scope", oracle("chats", "SELECT chat_id, user_id FROM chats WHERE user_id = 'u7'"))
def _(b):
    return S.scope(b.chats, "u7").select("chat_id", "user_id")


INBOX = f"""rows_ AS (SELECT l.chat_id, l.customer_key, n AS conversation_count, r.reason, coalesce(m.t, l.created_at) AS updated_at
  FROM {LATEST_OPEN} l JOIN (SELECT {KEY} AS customer_key, count(*) AS n FROM chats GROUP BY 1) USING (customer_key) LEFT JOIN {REASON} r USING (chat_id)
  LEFT JOIN (SELECT chat_id, max(created_at) AS t FROM messages GROUP BY 1) m USING (chat_id))"""


@query("a23_customer_inbox", oracle("chats messages handoffs", f"WITH {INBOX} SELECT * FROM rows_"))
def _(b):
    return S.customer_inbox(b.chats, b.messages, b.handoffs).select("chat_id", "customer_key", "conversation_count", "reason", "updated_at")


@query("p09_keyset_page", """
  SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '2000-06-30', 10000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21""")
def _(b):
    import datetime
    return page_after(b.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20, (datetime.datetime(2000, 6, 30), 10000)).select("o_orderkey", "o_orderdate")


@query("j13_semi_join_page", oracle("chats messages", """
  SELECT message_id, chat_id FROM messages WHERE chat_id IN (SELECT chat_id FROM chats ORDER BY created_at DESC, chat_id DESC LIMIT 20)"""))
def _(b):
    page = b.chats.orderBy(F.desc("created_at"), F.desc("chat_id")).limit(20).select("chat_id")
    return b.messages.join(page, "chat_id", "left_semi").select("message_id", "chat_id")


COUNTS = """count(*) FILTER (WHERE closed_at IS NULL AND handled_by IN ('human_queue', 'human_agent')) AS open_human, count(*) FILTER (WHERE closed_at IS NULL AND handled_by = 'ai_agent') AS ai_agent,
  count(*) FILTER (WHERE closed_at IS NULL AND handled_by = 'human_agent') AS with_advisor, count(*) FILTER (WHERE handled_by = 'human_queue') AS unattended,
  count(*) FILTER (WHERE closed_at IS NOT NULL) AS resolved, count(*) FILTER (WHERE assigned_to = 'advisor0@example.com' AND closed_at IS NULL) AS mine"""


@query("a22_console_counts", oracle("chats", f"SELECT use_case, {COUNTS} FROM chats GROUP BY 1"))
def _(b):
    return S.console_counts(b.chats, "advisor0@example.com")


@query("a22_console_counts_by_customer", oracle("chats", f"SELECT use_case, {COUNTS} FROM {LATEST_OPEN} GROUP BY 1"))
def _(b):
    return S.console_counts(b.chats, "advisor0@example.com", by_customer=True)


@query("a22_open_reasons", oracle("chats handoffs", f"""
  SELECT reason, count(*) AS n FROM chats JOIN {REASON} USING (chat_id) WHERE closed_at IS NULL AND handled_by IN ('human_queue', 'human_agent') GROUP BY 1"""))
def _(b):
    return S.open_reasons(b.chats, b.handoffs)


@query("a24_chat_owners", oracle("chats", "SELECT user_id, max(user_email) AS user_email FROM chats GROUP BY 1"))
def _(b):
    return S.chat_owners(b.chats)


@query("w19_last_customer_message", oracle("messages", """
  SELECT chat_id, message_id FROM messages WHERE sender_type = 'customer' OR (sender_type IS NULL AND role = 'user')
  QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, message_id DESC) = 1"""))
def _(b):
    return S.last_customer_message(b.messages).select("chat_id", "message_id")


@query("w19_latest_handoff", oracle("handoffs", """
  SELECT chat_id, handoff_id, reason FROM handoffs QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, handoff_id DESC) = 1"""))
def _(b):
    return newest_per_group(b.handoffs, ["chat_id"], [F.desc("created_at"), F.desc("handoff_id")], 1).select("chat_id", "handoff_id", "reason")


@query("w20_due_turns", oracle("agent_turns", """
  SELECT turn_id, chat_id FROM agent_turns t WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-03-04 00:00:00'
    AND NOT EXISTS (SELECT 1 FROM agent_turns o WHERE o.chat_id = t.chat_id AND o.status = 'pending' AND o.created_at < t.created_at)"""))
def _(b):
    return S.due_turns(b.agent_turns, "2024-03-04 00:00:00").select("turn_id", "chat_id")


@query("w21_last_closed_message", oracle("messages resolution_events", """
  SELECT chat_id, message_id FROM messages m WHERE created_at <= (SELECT max(resolved_at) FROM resolution_events r WHERE r.chat_id = m.chat_id)
  QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, message_id DESC) = 1"""))
def _(b):
    return S.last_closed_message(b.messages, b.resolution_events)


RESOLUTION = f"""by_day AS (SELECT strftime({local('resolved_at')}, '%Y-%m-%d') AS day, use_case, count(*) AS total, count(*) FILTER (WHERE resolved_by = 'ai' AND NOT had_human) AS ai_contained,
  count(*) FILTER (WHERE resolved_by = 'human') AS human, count(*) FILTER (WHERE resolved_by = 'ai' AND had_human) AS assisted
  FROM resolution_events WHERE {INSIDE.format('resolved_at')} GROUP BY ALL)"""


@query("a19_resolution_metrics", oracle("resolution_events", f"WITH {RESOLUTION} SELECT * FROM by_day"))
def _(b):
    return S.resolution_metrics(b.resolution_events, ZONE, FIRST, LAST)


@query("c11_service_metrics", oracle("resolution_events", f"""WITH {RESOLUTION}
  SELECT coalesce(use_case, 'none') AS use_case, 0 AS is_total, sum(total)::BIGINT AS total, sum(ai_contained)::BIGINT AS ai_contained, sum(human)::BIGINT AS human, sum(assisted)::BIGINT AS assisted FROM by_day GROUP BY 1
  UNION ALL SELECT NULL, 1, sum(total)::BIGINT, sum(ai_contained)::BIGINT, sum(human)::BIGINT, sum(assisted)::BIGINT FROM by_day"""))
def _(b):
    return S.resolution_totals(S.resolution_metrics(b.resolution_events, ZONE, FIRST, LAST))


USED = "input_tokens IS NOT NULL AND output_tokens IS NOT NULL"
PRICE_IN, PRICE_OUT, PRICE_HOUR = "(2.143::DOUBLE * 0.07::DOUBLE)", "(17.143::DOUBLE * 0.07::DOUBLE)", "(0.5::DOUBLE * 0.75::DOUBLE)"


def cost(i, o, d):
    return f"(({i}) * {PRICE_IN} + ({o}) * {PRICE_OUT}) / 1000000 + ({d}) / 3600000 * {PRICE_HOUR}"


@query("a20_turn_metrics", oracle("turn_metrics", f"""
  WITH t AS (SELECT count(*) FILTER (WHERE source = 'live') AS live_turns, count(*) FILTER (WHERE {USED}) AS turns_with_usage,
    coalesce(sum(input_tokens) FILTER (WHERE {USED}), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (WHERE {USED}), 0)::BIGINT AS output_tokens,
    coalesce(sum(duration_ms) FILTER (WHERE {USED}), 0)::BIGINT AS duration_ms, count(DISTINCT chat_id) AS conversations,
    quantile_cont(duration_ms::DOUBLE, 0.5) FILTER (WHERE source = 'live') AS p50_ms, quantile_cont(duration_ms::DOUBLE, 0.95) FILTER (WHERE source = 'live') AS p95_ms
    FROM turn_metrics WHERE {INSIDE.format('created_at')})
  SELECT *, round(estimated_usd, 9) AS estimated_usd, round(estimated_usd / conversations, 9) AS per_conversation_usd FROM (
    SELECT *, {cost('input_tokens', 'output_tokens', 'duration_ms')} AS estimated_usd FROM t)""".replace("SELECT *, round(estimated_usd, 9) AS estimated_usd", "SELECT * REPLACE (round(estimated_usd, 9) AS estimated_usd)")))
def _(b):
    df = S.turn_metrics(b.turn_metrics, ZONE, FIRST, LAST)
    return df.select(*[F.round(c, 9).alias(c) if c.endswith("_usd") else c for c in df.columns])


@query("f33_cost_per_turn", oracle("turn_metrics", f"SELECT message_id, round(CASE WHEN {USED} THEN {cost('input_tokens', 'output_tokens', 'duration_ms')} END, 9) AS cost FROM turn_metrics"))
def _(b):
    return b.turn_metrics.select("message_id", F.round(cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("duration_ms")), 9).alias("cost"))


@query("f15_local_days", oracle("messages", f"SELECT strftime({local('created_at')}, '%Y-%m-%d') AS day, count(*) AS n FROM messages WHERE {INSIDE.format('created_at')} GROUP BY 1"))
def _(b):
    return b.messages.where(S.within_local_days(F.col("created_at"), ZONE, FIRST, LAST)).groupBy(local_day(F.col("created_at"), ZONE).alias("day")).agg(F.count(F.lit(1)).alias("n"))


ASSESSED = """assessed AS (SELECT handoff_id, created_at, resolved_at, reason, CASE WHEN json_extract_string(facts, '$.verified_data.complaint_type') IN ('not_recognized', 'duplicate_charge', 'different_amount')
      THEN json_extract_string(facts, '$.verified_data.complaint_type') ELSE 'other' END AS type,
    CASE WHEN json_type(facts, '$.fraud_assessment.risk_score') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract_string(facts, '$.fraud_assessment.risk_score') AS DECIMAL(18,6)) END AS score,
    json_extract_string(facts, '$.fraud_assessment.scope') AS scope, json_extract_string(facts, '$.fraud_assessment.fraud_prediction') = 'true' AS predicted FROM handoffs),
  classified AS (SELECT *, coalesce(scope = 'transaction_inference' AND score BETWEEN 0 AND 1, false) AS scored FROM assessed)"""


@query("f14_json_facts", oracle("handoffs", f"WITH {ASSESSED} SELECT handoff_id, type, resolved_at IS NOT NULL AS closed, CAST(score AS DOUBLE) AS score, scored, scored AND predicted AS alert FROM classified"))
def _(b):
    return S.complaint_facts(b.handoffs).drop("created_at").withColumn("score", F.col("score").cast("double"))


CUBE = f"""cube_ AS (SELECT strftime({local('created_at')}, '%Y-%m-%d') AS day, type, resolved_at IS NOT NULL AS closed, scored, scored AND predicted AS alert,
  CASE WHEN scored THEN least(9, CAST(floor(score * 10) AS INT)) ELSE -1 END AS score_bin, count(*) AS total FROM classified WHERE reason = 'complaint' AND {INSIDE.format('created_at')} GROUP BY ALL)"""


@query("a21_complaint_cube", oracle("handoffs", f"WITH {ASSESSED}, {CUBE} SELECT * FROM cube_"))
def _(b):
    return S.complaint_cube(b.handoffs, ZONE, FIRST, LAST)


@query("c10_complaint_operations", oracle("handoffs", f"""WITH {ASSESSED}, {CUBE}
  SELECT 'day' AS section, day AS label, sum(total)::BIGINT AS total FROM cube_ GROUP BY day UNION ALL SELECT 'type', type, sum(total)::BIGINT FROM cube_ GROUP BY type
  UNION ALL SELECT 'closed', CAST(closed AS VARCHAR), sum(total)::BIGINT FROM cube_ GROUP BY closed UNION ALL SELECT 'alert', CAST(alert AS VARCHAR), sum(total)::BIGINT FROM cube_ GROUP BY alert
  UNION ALL SELECT 'score_bin', CAST(i AS VARCHAR), coalesce((SELECT sum(total) FROM cube_ WHERE score_bin = i), 0)::BIGINT FROM range(10) r(i)"""))
def _(b):
    return S.complaint_summary(S.complaint_cube(b.handoffs, ZONE, FIRST, LAST))


@query("a28_run_summary", oracle("chats handoffs turn_metrics", f"""
  SELECT c.use_case, c.conversations, c.handed_off, c.resolved_by_ai, t.p50, t.p95, round(t.cost, 9) AS cost FROM (
    SELECT use_case, count(*) AS conversations, count(*) FILTER (WHERE h) AS handed_off, count(*) FILTER (WHERE closed_at IS NOT NULL AND NOT h) AS resolved_by_ai
    FROM (SELECT *, chat_id IN (SELECT chat_id FROM handoffs) AS h FROM chats) GROUP BY 1) c
  LEFT JOIN (SELECT use_case, quantile_cont(duration_ms::DOUBLE, 0.5) AS p50, quantile_cont(duration_ms::DOUBLE, 0.95) AS p95,
    sum({cost('input_tokens', 'output_tokens', 'duration_ms')}) FILTER (WHERE {USED}) AS cost FROM turn_metrics GROUP BY 1) t ON t.use_case IS NOT DISTINCT FROM c.use_case"""))
def _(b):
    return S.run_summary(b.turn_metrics, b.chats, b.handoffs).withColumn("cost", F.round("cost", 9))
