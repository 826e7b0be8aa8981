"""Message rules over every message of the conversations (and documents where natural text matters)."""

from pyspark.sql import functions as F

from tellerlake.functions import phrases as P
from tellerlake.functions import text as T
from tellerlake.plans import conversations as C
from tellerlake.registry import query
from tellerlake.standin import oracle

N = "lower(strip_accents(text))"
BARE = f"trim({N}, ' .!?)')"


def lit(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def either(patterns):
    return " ".join(f"WHEN regexp_matches({{t}}, {lit(p)}) THEN '{label}'" for label, p in patterns)


def spoken(body, tables="spoken"):
    return oracle(tables, body)


IDS = ["conv_id", "turn"]


@query("f17_normalise", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents")
def _(b):
    return b.documents.select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


@query("x04_normalise_any_script", "SELECT conv_id, turn, md5(lower(strip_accents(text))) AS digest FROM conversations")
def _(b):
    return b.conversations.select(*IDS, F.md5(T.normalise_any(F.col("text"))).alias("digest"))


def counted(text, pattern):
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


LANGUAGE = f"CASE WHEN {counted(N, P.PT_MARKERS)} > {counted(N, P.ES_MARKERS)} THEN 'pt' WHEN {counted(N, P.ES_MARKERS)} > {counted(N, P.PT_MARKERS)} THEN 'es' ELSE 'other' END"


@query("f18_language", spoken(f"SELECT conv_id, turn, {LANGUAGE} AS language FROM spoken"))
def _(b):
    return b.spoken.select(*IDS, T.language(F.col("text")).alias("language"))


@query("f19_keyword_intent", spoken(f"SELECT conv_id, turn, CASE {either(P.INTENTS).format(t=N)} ELSE 'OUT_OF_SCOPE' END AS intent, "
       f"CASE WHEN regexp_matches({N}, {lit('|'.join('(?:' + p + ')' for _, p in P.INTENTS))}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM spoken"))
def _(b):
    intent = T.keyword_intent(F.col("text"))
    return b.spoken.select(*IDS, intent.alias("intent"), T.intent_confidence(intent).alias("confidence"))


@query("f20_baseline_intent", spoken(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i){P.CASE_MENTION}') AND regexp_matches(text, '(?i){P.STATUS_WORDS}') THEN 'CASE_STATUS'
  {either([(k, '(?i)' + p) for k, p in P.BASELINE_INTENTS]).format(t='text')} ELSE 'OUT_OF_SCOPE' END AS intent FROM spoken"""))
def _(b):
    return b.spoken.select(*IDS, T.baseline_intent(F.col("text")).alias("intent"))


@query("f21_prompt_injection", spoken(f"SELECT conv_id, turn, regexp_matches({N}, {lit(P.INJECTION)}) AS injection FROM spoken"))
def _(b):
    return b.spoken.select(*IDS, T.is_injection(F.col("text")).alias("injection"))


def luhn(m):
    d = f"regexp_replace({m}, '[ -]', '', 'g')"
    x = f"CAST(substr({d}, i::BIGINT, 1) AS INT)"
    return (f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN CASE WHEN 2 * {x} > 9 THEN 2 * {x} - 9 ELSE 2 * {x} END ELSE {x} END)) % 10 = 0")


def masked(text):
    cards = f"list_filter(regexp_extract_all({text}, {lit(P.CARD_RUN)}), lambda m: {luhn('m')})"
    return f"list_reduce(list_prepend({text}, list_transform({cards}, lambda c: rtrim(c, ' -'))), lambda acc, c: replace(acc, c, '{P.CARD_TOKEN}'))"


def hidden(text):
    return f"regexp_replace({text}, {lit('(?i)' + P.SECRET_VALUE)}, '{P.SECRET_TOKEN}', 'g')"


@query("f22_card_masking", oracle("spoken", f"""
  SELECT 'spoken' AS source, conv_id * 1000 + turn AS id, md5({masked('text')}) AS masked FROM spoken UNION ALL SELECT 'documents', doc_id, md5({masked('text')}) FROM documents"""))
def _(b):
    rows = b.spoken.select(F.lit("spoken").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").unionByName(
        b.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text"))
    return rows.select("source", "id", F.md5(T.mask_cards(F.col("text"))).alias("masked"))


@query("f23_secret_masking", spoken(f"SELECT conv_id, turn, {hidden('text')} AS masked FROM spoken"))
def _(b):
    return b.spoken.select(*IDS, T.mask_secrets(F.col("text")).alias("masked"))


CONTEXT = f"""ctx AS (SELECT *, CASE WHEN lag(role) OVER w = 'assistant' THEN lag(text) OVER w END AS previous,
    last_value(CASE WHEN role = 'user' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 3 AND {LANGUAGE} <> 'other' THEN {LANGUAGE} END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_language
  FROM spoken WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("w22_message_context", spoken(f"WITH {CONTEXT} SELECT conv_id, turn, md5(previous) AS previous, earlier_language FROM ctx"))
def _(b):
    return C.with_context(b.spoken).select(*IDS, F.md5(C.previous_reply()).alias("previous"), "earlier_language")


@query("j16_previous_reply", spoken(f"WITH {CONTEXT} SELECT conv_id, turn, previous IS NOT NULL AS has_reply, length(previous) AS reply_length FROM ctx WHERE role = 'user'"))
def _(b):
    reply = C.previous_reply()
    return C.with_context(b.spoken).where("role = 'user'").select(*IDS, reply.isNotNull().alias("has_reply"), F.length(reply).cast("bigint").alias("reply_length"))


PREV_N = "trim(lower(strip_accents(previous)), ' ' || chr(10) || chr(13) || chr(9))"
LAST_LINE = f"list_last(string_split({PREV_N}, chr(10)))"
OFFER = f"(contains({LAST_LINE}, '?') AND regexp_matches({LAST_LINE}, '{P.TO_ADVISOR}'))"
CONFIRMED = f"CASE WHEN regexp_full_match({BARE}, {lit(P.AFFIRMATIVE)}) AND {OFFER} THEN CASE {either(P.CONFIRMATIONS).format(t=LAST_LINE)} END END"
OWN = f"(regexp_full_match({BARE}, {lit(P.MENU_WORDS)}) OR regexp_full_match({BARE}, {lit(P.MENU_LETTER)}) OR regexp_matches({BARE}, {lit(P.CANCEL)}))"


def texts(values):
    return "(" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + ")"


MENU = f"""CASE WHEN regexp_full_match({BARE}, {lit(P.MENU_WORDS)}) THEN 'MENU'
  WHEN regexp_full_match({BARE}, {lit(P.MENU_LETTER)}) THEN CASE right({BARE}, 1) WHEN 'a' THEN 'CARD_OPTIONS' WHEN 'b' THEN 'SAVINGS_OPTIONS' WHEN 'c' THEN 'COMPLAINT' ELSE 'MORE_OPTIONS' END
  WHEN {CONFIRMED} IS NOT NULL THEN {CONFIRMED}
  WHEN regexp_full_match({BARE}, {lit(P.SUBMENU_DIGIT)}) AND trim(previous) IN {texts(P.MORE_OPTIONS)} THEN CASE right({BARE}, 1) WHEN '1' THEN 'RETENTION' ELSE 'CASE_STATUS' END
  WHEN regexp_full_match({BARE}, {lit(P.SUBMENU_DIGIT)}) AND trim(previous) IN {texts(P.CARD_OPTIONS + P.SAVINGS_OPTIONS)} THEN 'GENERAL_INQUIRY' END"""
ASKED_PRODUCT = " OR ".join(f"starts_with({PREV_N}, '{T._plain(q)}') OR contains({PREV_N}, chr(10) || chr(10) || '{T._plain(q)}')" for q in P.PRODUCT_QUESTIONS)
ASKED_REASON = f"coalesce({PREV_N} IN ({', '.join(repr(T._plain(q)) for q in P.REASON_QUESTIONS)}), false)"
FOLLOW_UP = f"coalesce(contains({LAST_LINE}, '?') AND regexp_matches({LAST_LINE}, '{P.ABOUT_COMPLAINT}') AND NOT regexp_matches({LAST_LINE}, '{P.TO_ADVISOR}') AND NOT {OWN}, false)"


@query("f24_menu_rules", spoken(f"""WITH {CONTEXT} SELECT conv_id, turn, {MENU} AS menu, {CONFIRMED} IS NOT NULL AS confirmation, {FOLLOW_UP} AS case_follow_up,
  coalesce(({ASKED_REASON} OR {ASKED_PRODUCT}) AND NOT {OWN}, false) AS in_retention, {ASKED_REASON} AS asked_reason FROM ctx WHERE role = 'user'"""))
def _(b):
    text, previous = F.col("text"), F.col("_reply")
    df = C.with_context(b.spoken).withColumn("_reply", C.previous_reply()).where("role = 'user'")
    return df.select(*IDS, T.menu_intent(text, previous).alias("menu"), T.confirmed_operation(text, previous).isNotNull().alias("confirmation"),
                     T.case_status_follow_up(text, previous).alias("case_follow_up"), T.retention_in_progress(text, previous).alias("in_retention"),
                     T.asked_for_reason(previous).alias("asked_reason"))


@query("f25_conversation_language", spoken(f"""WITH {CONTEXT} SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 3 THEN {LANGUAGE}
  WHEN conv_id % 10 = 0 THEN 'pt' ELSE coalesce(earlier_language, 'es') END AS language FROM ctx WHERE role = 'user'"""))
def _(b):
    df = C.with_context(b.spoken).where("role = 'user'")
    chosen = F.when(F.col("conv_id") % 10 == 0, "pt")
    return df.select(*IDS, C.conversation_language(T.language(F.col("text")), chosen, F.lit("es")).alias("language"))


def duck_amount(t):
    dots, commas = f"contains({t}, '.')", f"contains({t}, ',')"
    tail_c, tail_d = f"split_part({t}, ',', -1)", f"split_part({t}, '.', -1)"
    number = f"""CASE WHEN {dots} AND {commas} THEN CASE WHEN length({tail_c}) < length({tail_d}) THEN replace(replace({t}, '.', ''), ',', '.') ELSE replace({t}, ',', '') END
      WHEN {commas} THEN CASE WHEN length({tail_c}) <= 2 THEN replace(left({t}, length({t}) - length({tail_c}) - 1), ',', '') || '.' || {tail_c} ELSE replace({t}, ',', '') END
      WHEN {dots} THEN CASE WHEN length({tail_d}) <= 2 THEN {t} ELSE replace({t}, '.', '') END ELSE {t} END"""
    return f"TRY_CAST({number} AS DOUBLE)"


MONTHS = "|".join(T.MONTH_NUMBERS)
NO_DATES = f"regexp_replace(regexp_replace(regexp_replace({N}, {lit(P.DATE_DMY)}, ' ', 'g'), {lit(T.DAY_MONTH)}, ' ', 'g'), {lit(P.DAYS_AGO)}, ' ', 'g')"


@query("f26_amounts", spoken(f"""SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all({NO_DATES}, {lit(P.AMOUNT)}, 1), lambda a: {duck_amount('a')}), lambda v: v > 0)[1] AS amount FROM spoken"""))
def _(b):
    return b.spoken.select(*IDS, T.extract_amount(F.col("text")).alias("amount"))


@query("f26_amount_tokens", "SELECT o_orderkey, " + duck_amount("""(CASE o_orderkey % 5 WHEN 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), '.', ',')
  WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) WHEN 2 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.25' WHEN 3 THEN replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') || ',75'
  ELSE replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') END)""") + " AS amount FROM orders")
def _(b):
    exact, grouped = F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.format_number(F.floor("o_totalprice"), 0)
    dotted = F.replace(grouped, F.lit(","), F.lit("."))
    token = F.when(F.col("o_orderkey") % 5 == 0, F.replace(exact, F.lit("."), F.lit(","))).when(F.col("o_orderkey") % 5 == 1, exact).when(
        F.col("o_orderkey") % 5 == 2, F.concat(grouped, F.lit(".25"))).when(F.col("o_orderkey") % 5 == 3, F.concat(dotted, F.lit(",75"))).otherwise(dotted)
    return b.orders.select("o_orderkey", T.parse_amount(token).alias("amount"))


AS_OF = "DATE '2024-03-15'"
MONTH_NUMBER = "CASE regexp_extract(" + N + ", " + lit(T.DAY_MONTH) + ", 2) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.MONTH_NUMBERS.items()) + " END"


def duck_part(i):
    return f"TRY_CAST(nullif(regexp_extract({N}, {lit(P.DATE_DMY)}, {i}), '') AS INT)"


def duck_date(y, m, d):
    return f"TRY_CAST(printf('%04d-%02d-%02d', CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT)) AS DATE)"


def duck_recent(m, d):
    return f"CASE WHEN {duck_date(2024, m, d)} > {AS_OF} THEN {duck_date(2023, m, d)} ELSE {duck_date(2024, m, d)} END"


NAMED_DAY = f"TRY_CAST(nullif(regexp_extract({N}, {lit(T.DAY_MONTH)}, 1), '') AS INT)"
AGO = f"TRY_CAST(nullif(regexp_extract({N}, {lit(P.DAYS_AGO)}, 1), '') AS INT)"


@query("f27_dates", spoken(f"""SELECT conv_id, turn, CASE WHEN regexp_matches({N}, '\\b(anteayer|antier|anteontem)\\b') THEN {AS_OF} - 2 WHEN regexp_matches({N}, '\\b(ayer|ontem)\\b') THEN {AS_OF} - 1
  WHEN regexp_matches({N}, '\\b(hoy|hoje)\\b') THEN {AS_OF} WHEN {AGO} IS NOT NULL THEN {AS_OF} - {AGO} WHEN {NAMED_DAY} IS NOT NULL THEN {duck_recent(MONTH_NUMBER, NAMED_DAY)}
  WHEN {duck_part(1)} IS NOT NULL THEN CASE WHEN {duck_part(3)} IS NULL THEN {duck_recent(duck_part(2), duck_part(1))}
    ELSE {duck_date(f'CASE WHEN {duck_part(3)} < 100 THEN {duck_part(3)} + 2000 ELSE {duck_part(3)} END', duck_part(2), duck_part(1))} END END AS date FROM spoken"""))
def _(b):
    return b.spoken.select(*IDS, T.extract_date(F.col("text"), F.lit("2024-03-15").cast("date")).alias("date"))


def said(words):
    return f"list_has_any(regexp_extract_all({N}, '[a-z]+'), [{', '.join(repr(w) for w in words)}])"


SELECTED = f"TRY_CAST(nullif(regexp_extract(trim({N}), '^(?:{P.SELECTION})$', 1), '') AS INT)"


@query("f28_yes_no_selection", spoken(f"""SELECT conv_id, turn, CASE WHEN {said(P.YES)} AND NOT {said(P.NO)} THEN true WHEN {said(P.NO)} AND NOT {said(P.YES)} THEN false END AS yes_no,
  CASE WHEN regexp_matches({N}, {lit(P.NONE_OF_THEM)}) THEN 0 WHEN {SELECTED} IS NOT NULL THEN CASE WHEN {SELECTED} BETWEEN 1 AND 3 THEN {SELECTED} END
  {' '.join(f"WHEN regexp_matches({N}, '{chr(92)}b({'|'.join(w)}){chr(92)}b') AND {k} <= 3 THEN {k}" for k, w in enumerate(P.ORDINALS, 1))} END AS selection FROM spoken"""))
def _(b):
    return b.spoken.select(*IDS, T.yes_no(F.col("text")).alias("yes_no"), T.selection(F.col("text"), F.lit(3)).alias("selection"))


TOOLS = "CASE WHEN turn % 4 = 1 THEN ['get_products'] WHEN turn % 4 = 3 THEN ['list_transactions'] ELSE [] END"


def duck_asks(asks):
    return "regexp_matches(customer, '(?i)" + "|".join(asks) + "')"


KINDS = {k: (tool, duck_asks(asks), f"regexp_matches(text, {lit(shows)})") for k, tool, asks, shows in P.GROUNDING}
NEEDED = "CASE WHEN {m1} OR {b1} THEN list_filter([CASE WHEN {m1} THEN 'movements' END, CASE WHEN {b1} THEN 'balance' END], lambda x: x IS NOT NULL) WHEN {m2} THEN ['movements'] WHEN {b2} THEN ['balance'] ELSE [] END".format(
    m1=KINDS["movements"][1], b1=KINDS["balance"][1], m2=KINDS["movements"][2], b2=KINDS["balance"][2])


@query("f29_grounding", spoken(f"""WITH p AS (SELECT *, coalesce(CASE WHEN lag(role) OVER w = 'user' THEN lag(text) OVER w END, '') AS customer FROM spoken WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  n AS (SELECT *, {NEEDED} AS needed, {TOOLS} AS tools FROM p WHERE role = 'assistant')
  SELECT conv_id, turn, array_to_string(needed, ',') AS needed, CASE WHEN list_contains(needed, 'movements') AND NOT list_contains(tools, 'list_transactions') AND {KINDS['movements'][2]} THEN 'movements'
    WHEN list_contains(needed, 'balance') AND NOT list_contains(tools, 'get_products') AND {KINDS['balance'][2]} THEN 'balance' END AS ungrounded FROM n"""))
def _(b):
    df = C.with_context(b.spoken).where("role = 'assistant'")
    customer = F.coalesce(F.when(F.col("previous_role") == "user", F.col("previous_text")), F.lit(""))
    tools = F.when(F.col("turn") % 4 == 1, F.array(F.lit("get_products"))).when(F.col("turn") % 4 == 3, F.array(F.lit("list_transactions"))).otherwise(F.array().cast("array<string>"))
    return df.select(*IDS, F.array_join(T.required_kinds(customer, F.col("text")), ",").alias("needed"), T.ungrounded(customer, F.col("text"), tools).alias("ungrounded"))


def duck_cut(n):
    t = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({t}) > {n} THEN rtrim(left({t}, {n - 1})) || '…' ELSE {t} END"


@query("f30_preview_and_title", spoken(f"SELECT conv_id, turn, {duck_cut(140)} AS preview, {duck_cut(60)} AS title FROM spoken"))
def _(b):
    return b.spoken.select(*IDS, T.preview(F.col("text")).alias("preview"), T.title(F.col("text")).alias("title"))


def sensitive(text):
    return hidden(masked(text))


ADVISOR = "starts_with(ltrim(text), '[Asesor]')"
TRANSCRIPT = f"""r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS last_role FROM spoken),
  l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Cliente: ' || {sensitive('text')} WHEN role = 'assistant' AND {ADVISOR} THEN 'Asesor: ' || {sensitive("ltrim(substr(ltrim(text), 9))")}
    WHEN role = 'assistant' THEN 'David: ' || right({sensitive('text')}, 300) END AS line FROM r WHERE k BETWEEN CASE WHEN last_role = 'user' THEN 2 ELSE 1 END AND CASE WHEN last_role = 'user' THEN 13 ELSE 12 END)"""


@query("f31_transcript", spoken(f"WITH {TRANSCRIPT}, s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM l GROUP BY 1) SELECT c.conv_id, md5(transcript) AS transcript FROM (SELECT DISTINCT conv_id FROM spoken) c LEFT JOIN s USING (conv_id)"))
def _(b):
    return C.transcripts(b.spoken).select("conv_id", F.md5("transcript").alias("transcript"))


@query("f21_guardrail", spoken(f"""SELECT conv_id, turn, CASE WHEN regexp_matches({N}, {lit(P.INJECTION)}) THEN 'PROMPT_INJECTION' WHEN {sensitive('text')} <> text THEN 'SENSITIVE_DATA' END AS guardrail FROM spoken"""))
def _(b):
    return b.spoken.select(*IDS, T.guardrail(F.col("text")).alias("guardrail"))
