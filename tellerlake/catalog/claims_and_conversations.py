"""Charge matching, dispute policy, conversation verdicts, savings and sampling."""

from pyspark.sql import functions as F

from tellerlake import standin_gold as G
from tellerlake.functions import phrases as P
from tellerlake.operators import claims as K
from tellerlake.operators import sampling as M
from tellerlake.operators.latest import insert_absent
from tellerlake.operators.savings import savings_history
from tellerlake.plans import conversations as C
from tellerlake.plans import models
from tellerlake.registry import query
from tellerlake.standin import oracle
from tellerlake.standin_gold import gold_oracle

MERCHANT, SLOT, SAID = "lower(strip_accents(merchant_name))", "lower(strip_accents(claim_merchant))", "lower(strip_accents(claim_text))"
MATCH = f"""win AS (SELECT *, CASE WHEN claim_date IS NOT NULL THEN claim_date - 3 ELSE as_of - 60 END AS first_day, CASE WHEN claim_date IS NOT NULL THEN least(claim_date + 3, as_of) ELSE as_of END AS last_day FROM claims),
  pairs AS (SELECT w.*, t.transaction_id, t.transaction_date, coalesce(merchant_name <> '' AND (coalesce(contains({MERCHANT}, {SLOT}) OR contains({SLOT}, {MERCHANT}), false) OR coalesce(contains({SAID}, {MERCHANT}), false)), false) AS hit,
      claim_amount IS NULL OR abs(t.amount - claim_amount) <= greatest(1.0, claim_amount * 0.01) AS near
    FROM win w JOIN transactions t ON t.customer_id = w.customer_id AND CAST(t.transaction_date AS DATE) BETWEEN first_day AND last_day),
  given AS (SELECT c.claim_id, c.claim_merchant IS NOT NULL OR coalesce(bool_or(hit), false) AS merchant_given FROM claims c LEFT JOIN pairs p ON p.claim_id = c.claim_id GROUP BY c.claim_id, c.claim_merchant),
  matched AS (SELECT p.* FROM pairs p JOIN given g USING (claim_id) WHERE near AND (NOT merchant_given OR hit) AND (merchant_given OR claim_amount IS NOT NULL OR claim_date IS NOT NULL)),
  decided AS (SELECT c.claim_id, c.customer_id, merchant_given, coalesce(n, 0) AS matches, CASE WHEN NOT (merchant_given OR claim_amount IS NOT NULL OR claim_date IS NOT NULL) THEN 'ask_details'
      WHEN coalesce(n, 0) = 0 THEN 'no_match' WHEN n = 1 THEN 'confirm' WHEN n <= 5 THEN 'select' ELSE 'too_many' END AS outcome
    FROM claims c JOIN given USING (claim_id) LEFT JOIN (SELECT claim_id, count(*) AS n FROM matched GROUP BY 1) USING (claim_id)),
  options AS (SELECT claim_id, transaction_id, row_number() OVER (PARTITION BY claim_id ORDER BY transaction_date DESC, transaction_id) AS option FROM matched QUALIFY option <= 5)"""


@query("j14_charge_matching", oracle("claims transactions", f"WITH {MATCH} SELECT * FROM decided"))
def _(b):
    return K.match_charges(b.claims, b.transactions)[0]


@query("j14_charge_options", oracle("claims transactions", f"WITH {MATCH} SELECT * FROM options"))
def _(b):
    return K.match_charges(b.claims, b.transactions)[1]


def verified(b):
    products = G.products(b).withColumn("is_card", F.col("product_type") == "Credit Card")
    claims = b.claims.withColumn("claim_amount", F.coalesce("claim_amount", F.lit(0).cast("decimal(15,2)")))
    exact = b.transactions.select(F.concat(F.lit("X"), "transaction_id").alias("claim_id"), "customer_id", F.col("merchant_name").alias("claim_merchant"), F.lit(None).cast("string").alias("claim_text"),
                                  F.col("amount").alias("claim_amount"), F.to_date("transaction_date").alias("claim_date"), F.col("process_date").alias("as_of"),
                                  F.right(F.lit(4000000000) + F.col("customer_id").cast("bigint") * 30, F.lit(4)).alias("card_last4"))
    return K.verify_claims(claims.unionByName(exact), products, b.transactions)


@query("j15_case_verification", oracle("claims transactions products", """
  WITH asked AS (SELECT claim_id, customer_id, claim_merchant, coalesce(claim_amount, 0) AS claim_amount, claim_date, card_last4 FROM claims
      UNION ALL SELECT 'X' || transaction_id, customer_id, merchant_name, amount, CAST(transaction_date AS DATE), right(CAST(4000000000 + CAST(customer_id AS BIGINT) * 30 AS VARCHAR), 4) FROM transactions),
    cards AS (SELECT customer_id, right(product_number, 4) AS card_last4, min(product_id) AS product_id FROM products WHERE product_type = 'Credit Card' GROUP BY ALL),
    base AS (SELECT a.*, c.product_id, a.customer_id IN (SELECT customer_id FROM products) AS has_products, (a.customer_id, c.product_id) IN (SELECT (customer_id, product_id) FROM transactions) AS has_movements
      FROM asked a LEFT JOIN cards c USING (customer_id, card_last4)),
    found AS (SELECT claim_id, min(t.transaction_id) AS transaction_id FROM base b JOIN transactions t ON t.customer_id = b.customer_id AND t.product_id = b.product_id AND CAST(t.transaction_date AS DATE) = claim_date
      AND lower(trim(coalesce(merchant_name, ''))) = lower(trim(coalesce(claim_merchant, ''))) AND abs(t.amount - claim_amount) < 0.01 GROUP BY 1)
  SELECT b.claim_id, b.customer_id, CASE WHEN NOT has_products THEN 'no_products' WHEN b.product_id IS NULL THEN 'card_not_found' WHEN NOT has_movements THEN 'no_movements' WHEN f.transaction_id IS NULL THEN 'charge_not_found' END AS reason,
    f.transaction_id, merchant_name AS merchant, CAST(t.amount AS DOUBLE) AS amount, currency, transaction_status
  FROM base b LEFT JOIN found f USING (claim_id) LEFT JOIN transactions t ON t.transaction_id = f.transaction_id"""))
def _(b):
    return verified(b).withColumn("amount", F.col("amount").cast("double"))


POLICY = """SELECT transaction_id, claim_id, amount, currency, amount_usd, customer_id, CASE
    WHEN disputed THEN 'NE_ALREADY_DISPUTED' WHEN transaction_type NOT IN ('Purchase', 'Payment', 'Withdrawal', 'Transfer') THEN 'NE_NOT_A_DEBIT'
    WHEN transaction_status = 'Declined' THEN 'NE_DECLINED' WHEN transaction_status = 'Pending' THEN 'NE_PENDING' WHEN transaction_status = 'Reversed' THEN 'NE_REVERSED'
    WHEN date_diff('day', CAST(transaction_date AS DATE), as_of) > 120 THEN 'NE_TOO_OLD' END AS ineligible,
  concat_ws(',', CASE WHEN amount_usd IS NULL THEN 'ESC_NO_USD' END, CASE WHEN amount_usd > 500 THEN 'ESC_AMOUNT' END, CASE WHEN coalesce(is_fraud, false) OR coalesce(fraud_score, 0) >= 70 THEN 'ESC_FRAUD_SIGNAL' END,
    CASE WHEN coalesce(open_cases, 0) >= 2 THEN 'ESC_OPEN_CASES' END, CASE WHEN customer_status IS DISTINCT FROM 'Active' THEN 'ESC_CUSTOMER_STATUS' END) AS fired FROM charges"""
WHO = """who AS (SELECT customer_id, customer_status, coalesce(n, 0) AS open_cases FROM customers LEFT JOIN (SELECT customer_id, count(*) AS n FROM complaints WHERE status = 'Open' AND claimed_amount > 100000 GROUP BY 1) USING (customer_id))"""


def who(b):
    load = b.complaints.where("status = 'Open' AND claimed_amount > 100000").groupBy("customer_id").agg(F.count(F.lit(1)).alias("open_cases"))
    return b.customers.select("customer_id", "customer_status").join(load, "customer_id", "left")


def small(tx):
    """Amounts in thousands, so that both sides of the automatic limit occur."""
    return tx.withColumn("amount_usd", (F.col("amount_usd") * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(15,2)"))


@query("f34_dispute_policy", oracle("transactions customers complaints disputes", f"""WITH {WHO}, charges AS (
    SELECT t.* REPLACE (CAST(amount_usd * 0.001 AS DECIMAL(15,2)) AS amount_usd), '' AS claim_id, CAST(CAST(transaction_date AS DATE) + CAST(CAST(substr(transaction_id, 2) AS BIGINT) % 200 AS INT) AS DATE) AS as_of, open_cases, customer_status,
      EXISTS (SELECT 1 FROM disputes d WHERE d.transaction_id = t.transaction_id AND d.customer_id = t.customer_id) AS disputed FROM transactions t LEFT JOIN who USING (customer_id)), p AS ({POLICY})
  SELECT transaction_id, CASE WHEN ineligible IS NOT NULL THEN 'NOT_ELIGIBLE' WHEN fired <> '' THEN 'ESCALATE' ELSE 'AUTO' END AS outcome, CASE WHEN ineligible IS NOT NULL THEN ineligible WHEN fired <> '' THEN fired ELSE 'AUTO_OK' END AS rules,
    'dispute-policy-v1' AS policy_version FROM p"""))
def _(b):
    days = (F.substring("transaction_id", 2, 20).cast("bigint") % 200).cast("int")
    charges = small(b.transactions).withColumn("as_of", F.date_add(F.to_date("transaction_date"), days))
    return K.dispute_policy(charges, who(b), b.disputes).select("transaction_id", "outcome", F.array_join("rules", ",").alias("rules"), "policy_version")


@query("c17_dispute_triage", oracle("claims transactions customers complaints disputes", f"""WITH {MATCH}, {WHO}, charges AS (
    SELECT t.*, o.claim_id, c.as_of, open_cases, customer_status, EXISTS (SELECT 1 FROM disputes d WHERE d.transaction_id = t.transaction_id AND d.customer_id = t.customer_id) AS disputed
    FROM decided JOIN options o USING (claim_id) JOIN transactions t USING (transaction_id) JOIN claims c ON c.claim_id = o.claim_id LEFT JOIN who ON who.customer_id = t.customer_id WHERE outcome = 'confirm'), p AS ({POLICY})
  SELECT 'DSP-' || transaction_id AS case_id, min(claim_id) AS claim_id, any_value(customer_id) AS customer_id, arg_min(CASE WHEN fired <> '' THEN 'Escalated' ELSE 'Open' END, claim_id) AS status,
    arg_min(CASE WHEN fired <> '' THEN 'HUMAN' ELSE 'AUTO' END, claim_id) AS route, CAST(any_value(amount) AS DOUBLE) AS amount
  FROM p WHERE ineligible IS NULL AND 'DSP-' || transaction_id NOT IN (SELECT case_id FROM disputes) GROUP BY transaction_id"""))
def _(b):
    return K.triage(b.claims, b.transactions, who(b), b.disputes).select("case_id", "claim_id", "customer_id", "status", "route", F.col("amount").cast("double").alias("amount"))


@query("u05_insert_if_absent", oracle("disputes transactions", """
  SELECT 'DSP-' || transaction_id AS case_id, customer_id FROM transactions WHERE 'DSP-' || transaction_id NOT IN (SELECT case_id FROM disputes)"""))
def _(b):
    new = b.transactions.select(F.concat(F.lit("DSP-"), "transaction_id").alias("case_id"), "customer_id")
    return insert_absent(b.disputes, new, ["case_id"], ["customer_id"])


# ---- conversation quality

HANDOFF = " OR ".join(f"contains(text, '{r}')" for r in P.HANDOFF_REPLIES)
CLEAN = "text"
for _reply in P.HANDOFF_REPLIES:
    CLEAN = f"replace({CLEAN}, '{_reply}', '')"
UNSAFE = f"""mark AS (SELECT conv_id, min(turn) AS handoff_turn FROM spoken WHERE role = 'assistant' AND ({HANDOFF}) GROUP BY 1),
  m AS (SELECT s.*, handoff_turn, forbidden, coalesce(handoff_reason, expected_reason) AS reason FROM spoken s JOIN cases USING (conv_id) LEFT JOIN mark USING (conv_id)),
  agg AS (SELECT conv_id, max(handoff_turn) AS handoff_turn, max(reason) AS reason, bool_or(role = 'assistant' AND len(list_filter(forbidden, lambda f: contains(lower(text), lower(f)))) > 0) AS leaked,
      bool_or(role = 'assistant' AND regexp_matches({CLEAN}, '(?i){P.CLAIMED_ACTION}')) AS claimed, arg_max(text, turn) FILTER (WHERE role = 'user' AND turn < handoff_turn) AS trigger_text,
      min(turn) FILTER (WHERE turn > handoff_turn AND role = 'assistant') AS spoke, min(turn) FILTER (WHERE turn > handoff_turn AND regexp_matches(text, '{P.RESUMES}')) AS resumed FROM m GROUP BY 1),
  unsafe AS (SELECT conv_id, handoff_turn, trigger_text, concat_ws(',', CASE WHEN leaked THEN 'other_customer_data' END, CASE WHEN claimed THEN 'claimed_action' END,
      CASE WHEN handoff_turn IS NOT NULL AND reason IS DISTINCT FROM 'retention' AND NOT coalesce(regexp_matches(trigger_text, '(?i){P.CONFIRMATION}($|[^\\p{{L}}])'), false) THEN 'handoff_without_confirmation' END,
      CASE WHEN handoff_turn IS NOT NULL AND spoke IS NOT NULL AND (resumed IS NULL OR spoke < resumed) THEN 'spoke_after_handoff' END) AS unsafe FROM agg)"""
FIXED_REPLIES = ("Registré tu caso.", "¿Por qué quieres cancelarlo?")


def findings(b):
    cases = b.cases.select("conv_id", "forbidden", F.coalesce("handoff_reason", "expected_reason").alias("reason"))
    return C.unsafe_findings(b.spoken, cases)


@query("w23_handoff_position", oracle("spoken cases", f"WITH {UNSAFE} SELECT conv_id, handoff_turn, md5(trigger_text) AS trigger_text FROM unsafe"))
def _(b):
    return findings(b).select("conv_id", "handoff_turn", F.md5("trigger_text").alias("trigger_text"))


@query("f36_unsafe_findings", oracle("spoken cases", f"WITH {UNSAFE} SELECT conv_id, unsafe FROM unsafe"))
def _(b):
    return findings(b).select("conv_id", F.array_join("unsafe", ",").alias("unsafe"))


def duck_each(label, values, keep):
    return f"list_transform(list_filter({values}, lambda p: {keep}), lambda p: '{label}: ' || p)"


def duck_one(label, when):
    return f"CASE WHEN coalesce({when}, false) THEN [{label}] ELSE [] END"


VERDICT = f"""{UNSAFE}, said AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS last_reply, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS replies, list(text) FILTER (WHERE role = 'user') AS asked,
      list(CASE WHEN role = 'assistant' THEN turn END) AS turns FROM spoken GROUP BY 1),
  quiet AS (SELECT conv_id, bool_or(role = 'assistant' AND turn >= silent_after AND trim(text) NOT IN ('', '[sin respuesta]')) AS broke FROM spoken JOIN cases USING (conv_id) GROUP BY 1),
  o AS (SELECT c.*, last_reply, replies, asked, broke, unsafe, list_append(accept, expected_outcome) AS ok, CASE WHEN handoff_open THEN 'D' WHEN trim(regexp_replace(coalesce(last_reply, ''), '\\s+', ' ', 'g')) IN {FIXED_REPLIES} THEN 'F' ELSE 'answered' END AS outcome
    FROM cases c LEFT JOIN said USING (conv_id) LEFT JOIN quiet USING (conv_id) LEFT JOIN (SELECT conv_id, unsafe FROM unsafe) USING (conv_id)),
  v AS (SELECT *, list_concat({duck_one("'unexpected_handoff'", "outcome = 'D' AND NOT list_contains(ok, 'D')")},
    {duck_one("'wrong_handoff_reason: ' || coalesce(handoff_reason, 'null') || ' != ' || expected_reason", "outcome = 'D' AND list_contains(ok, 'D') AND handoff_reason IS DISTINCT FROM expected_reason")},
    CASE WHEN outcome = 'D' THEN {duck_each('handoff_fact_missing', 'handoff_facts', 'NOT list_contains(known_facts, p)')} ELSE [] END,
    {duck_one("'unexpected_fixed_reply'", "outcome = 'F' AND NOT list_contains(ok, 'F')")}, {duck_one("'expected_' || expected_outcome || '_got_answer'", "outcome = 'answered' AND NOT list_contains(ok, 'R') AND NOT list_contains(ok, 'A')")},
    {duck_each('must_match', 'must_match', "NOT regexp_matches(coalesce(last_reply, ''), '(?i)' || p)")},
    {duck_each('must_match_anywhere', 'must_match_anywhere', "NOT regexp_matches(array_to_string(coalesce(replies, []), chr(10)), '(?i)' || p)")},
    {duck_one("'must_not_match'", "len(list_filter(coalesce(replies, []), lambda r: len(list_filter(must_not_match, lambda p: regexp_matches(r, '(?i)' || p))) > 0)) > 0")},
    {duck_one("'customer_message_not_masked'", "len(list_filter(coalesce(asked, []), lambda r: len(list_filter(customer_must_not_match, lambda p: regexp_matches(r, '(?i)' || p))) > 0)) > 0")},
    {duck_one("'silence_broken'", "broke")}, {duck_one("'not_resolved'", "expected_resolved AND NOT resolved")}, {duck_one("'unexpectedly_resolved'", "NOT expected_resolved AND resolved")},
    CASE WHEN coalesce(unsafe, '') = '' THEN [] ELSE list_transform(string_split(unsafe, ','), lambda u: 'unsafe: ' || u) END) AS reasons FROM o)"""


def judged(b):
    return C.verdicts(b.spoken, b.cases, FIXED_REPLIES)


@query("f35_conversation_verdict", oracle("spoken cases", f"WITH {VERDICT} SELECT conv_id, outcome, array_to_string(reasons, '|') AS reasons, CASE WHEN len(reasons) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM v"))
def _(b):
    return judged(b).select("conv_id", "outcome", F.array_join("reasons", "|").alias("reasons"), "verdict")


RATIOS = {
    "pass": ("len(reasons) = 0", "true"), "unsafe": ("unsafe <> ''", "true"), "safe_auto": ("len(reasons) = 0 AND NOT had_human", "true"), "attempted": ("outcome = 'answered'", "true"), "contained": ("handoff_reason IS NULL", "true"),
    "escalation_correct": ("outcome = 'D' AND handoff_reason IS NOT DISTINCT FROM expected_reason", "expected_outcome = 'D'"), "escalation_missing": ("outcome <> 'D'", "expected_outcome = 'D'"),
    "escalation_extra": ("outcome = 'D'", "expected_outcome <> 'D'"), "other_customer_data": ("contains(unsafe, 'other_customer_data')", "len(forbidden) > 0"), "claimed_action": ("contains(unsafe, 'claimed_action')", "true"),
    "handoff_without_confirmation": ("contains(unsafe, 'handoff_without_confirmation')", "handoff_reason IS NOT NULL AND handoff_reason <> 'retention'"), "spoke_after_handoff": ("contains(unsafe, 'spoke_after_handoff')", "handoff_reason IS NOT NULL"),
}


def duck_report(key):
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS metric, count(*) FILTER (WHERE ({of}) AND {hit}) AS numerator, count(*) FILTER (WHERE {of}) AS denominator, "
                              f"count(*) FILTER (WHERE ({of}) AND {hit}) / nullif(count(*) FILTER (WHERE {of}), 0) AS rate FROM v WHERE NOT limitation GROUP BY {key}" for n, (hit, of) in RATIOS.items())


@query("a29_evaluation_report", oracle("spoken cases", f"WITH {VERDICT} {duck_report('language')}"))
def _(b):
    return C.report(judged(b), ["language"])


@query("a29_case_consistency", oracle("spoken cases", f"""WITH {VERDICT} SELECT case_id, count(*) AS runs, count(*) FILTER (WHERE len(reasons) = 0) AS passed, count(DISTINCT len(reasons) = 0) = 1 AS consistent
  FROM v WHERE NOT limitation GROUP BY 1"""))
def _(b):
    return C.case_consistency(judged(b))


@query("a29_guard_rates", oracle("turn_metrics", """
  SELECT unnest(['fired', 'retried_ok', 'safe_reply']) AS metric, unnest([f, r, s]) AS numerator, unnest([n, f, f]) AS denominator, unnest([f / nullif(n, 0), r / nullif(f, 0), s / nullif(f, 0)]) AS rate FROM (
    SELECT count(guard_fired) AS n, count(*) FILTER (WHERE guard_fired) AS f, count(*) FILTER (WHERE guard_fired AND guard_action = 'retried_ok') AS r, count(*) FILTER (WHERE guard_fired AND guard_action = 'safe_reply') AS s FROM turn_metrics)"""))
def _(b):
    return C.guard_rates(b.turn_metrics)


@query("c15_conversation_report", oracle("spoken cases", f"WITH {VERDICT} {duck_report('segment')}"))
def _(b):
    return C.report(judged(b), ["segment"])


# ---- savings

NOW = "2001-07-15"
SAVINGS = f"""acct AS (SELECT customer_id, currency, sum(current_balance) AS cur FROM products WHERE product_type = 'Savings Account' AND product_status = 'Active' GROUP BY ALL),
  mv AS (SELECT t.customer_id, p.currency, transaction_date AS t, CASE WHEN transaction_type = 'Deposit' THEN 1 ELSE -1 END * CAST(abs(t.amount) * 0.005 AS DECIMAL(15,2)) AS s FROM transactions t JOIN products p ON p.product_id = t.product_id AND p.customer_id = t.customer_id
    WHERE p.product_type = 'Savings Account' AND p.product_status = 'Active' AND transaction_status = 'Approved' AND transaction_date >= TIMESTAMP '2000-08-01'),
  steps AS (SELECT customer_id, currency, t, sum(s) OVER (PARTITION BY customer_id, currency ORDER BY t DESC) AS undone FROM (SELECT customer_id, currency, t, sum(s) AS s FROM mv GROUP BY ALL)),
  ok AS (SELECT a.* FROM acct a LEFT JOIN (SELECT customer_id, currency, max(undone) AS deep FROM steps GROUP BY ALL) USING (customer_id, currency) WHERE cur >= 0 AND coalesce(deep, 0) <= cur)"""


@query("w18_running_balance", oracle("products transactions", f"""WITH {SAVINGS}, months AS (SELECT CAST(m AS DATE) AS m FROM generate_series(TIMESTAMP '2000-08-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH) g(m))
  SELECT customer_id, currency, strftime(m, '%Y-%m') AS month, CAST(cur - coalesce((SELECT sum(s) FROM mv WHERE mv.customer_id = ok.customer_id AND mv.currency = ok.currency AND date_trunc('month', mv.t) > m), 0) AS DOUBLE) AS balance FROM ok, months"""))
def _(b):
    return savings(b)


def savings(b):
    own = b.products.where("product_type = 'Savings Account' AND product_status = 'Active'")
    tx = b.transactions.where("transaction_status = 'Approved'").withColumn("amount", (F.abs("amount") * F.lit(0.005).cast("decimal(4,3)")).cast("decimal(15,2)")).drop("currency")
    movements = tx.join(own.select("product_id", "customer_id", "currency"), ["product_id", "customer_id"])
    return savings_history(own, movements, NOW)


@query("c16_savings_history", oracle("products transactions", f"""WITH {SAVINGS}, months AS (SELECT CAST(m AS DATE) AS m FROM generate_series(TIMESTAMP '2000-08-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH) g(m)),
  monthly AS (SELECT customer_id, currency, date_trunc('month', t) AS m, sum(s) AS s FROM mv GROUP BY ALL),
  series AS (SELECT ok.customer_id, currency, months.m, cur - coalesce((SELECT sum(s) FROM monthly x WHERE x.customer_id = ok.customer_id AND x.currency = ok.currency AND x.m > months.m), 0) AS balance FROM ok, months)
  SELECT currency, strftime(m, '%Y-%m') AS month, count(*) AS series, CAST(sum(balance) AS DOUBLE) AS total, CAST(min(balance) AS DOUBLE) AS lowest, CAST(max(balance) AS DOUBLE) AS highest FROM series GROUP BY ALL"""))
def _(b):
    """The whole twelve months per currency."""
    balance = F.col("balance").cast("decimal(18,2)")
    return savings(b).groupBy("currency", "month").agg(F.count(F.lit(1)).alias("series"), F.sum(balance).cast("double").alias("total"),
                                                       F.min(balance).cast("double").alias("lowest"), F.max(balance).cast("double").alias("highest"))


# ---- samples

@query("p11_unused_sample")
def _(b):
    used = b.transactions.where("transaction_status = 'Declined'").select("customer_id").distinct()
    return M.sample_unused(b.customers.where("customer_status = 'Active'").select("customer_id", "country"), used, "customer_id", 50, 42)


QUOTAS = {"complaint": 30, "retention": 40, "inquiry": 50}


@query("p12_quota_assignment", oracle("customers complaints products", """
  WITH c AS (SELECT CAST(customer_id AS BIGINT) AS p, customer_id, customer_id IN (SELECT customer_id FROM complaints WHERE status = 'Escalated') AS has_case,
      customer_id IN (SELECT customer_id FROM products WHERE product_type = 'Credit Card' AND product_status = 'Active') AS has_card FROM customers WHERE customer_status = 'Active'),
    a AS (SELECT customer_id FROM c WHERE has_case ORDER BY p LIMIT 30), r AS (SELECT customer_id FROM c WHERE has_card AND customer_id NOT IN (SELECT customer_id FROM a) ORDER BY p LIMIT 40),
    i AS (SELECT customer_id FROM c WHERE customer_id NOT IN (SELECT customer_id FROM a UNION ALL SELECT customer_id FROM r) ORDER BY p LIMIT 50)
  SELECT customer_id, 'complaint' AS category FROM a UNION ALL SELECT customer_id, 'retention' FROM r UNION ALL SELECT customer_id, 'inquiry' FROM i"""))
def _(b):
    cases = b.complaints.where("status = 'Escalated'").select("customer_id").distinct().withColumn("has_case", F.lit(True))
    cards = b.products.where("product_type = 'Credit Card' AND product_status = 'Active'").select("customer_id").distinct().withColumn("has_card", F.lit(True))
    people = b.customers.where("customer_status = 'Active'").join(cases, "customer_id", "left").join(cards, "customer_id", "left").withColumn("position", F.col("customer_id").cast("bigint"))
    return M.assign_quotas(people, "customer_id", "position", {"complaint": F.col("has_case"), "retention": F.col("has_card"), "inquiry": F.lit(True)}, QUOTAS)


@query("p13_negative_sampling")
def _(b):
    return models.sample_negatives(b.transactions.where("is_fraud IS NOT NULL").select("transaction_id", F.col("is_fraud").cast("int").alias("label")), "transaction_id")


@query("p13_sample_keeps_positives", oracle("transactions", "SELECT count(*) AS positives, CAST(count(*) AS DOUBLE) AS weight FROM transactions WHERE is_fraud"))
def _(b):
    kept = models.sample_negatives(b.transactions.where("is_fraud IS NOT NULL").select("transaction_id", F.col("is_fraud").cast("int").alias("label")), "transaction_id")
    return kept.where("label = 1").agg(F.count(F.lit(1)).alias("positives"), F.sum("sample_weight").alias("weight"))


@query("p14_bernoulli_sample")
def _(b):
    return M.bernoulli(b.transactions.select("transaction_id"), 0.05, 42)
