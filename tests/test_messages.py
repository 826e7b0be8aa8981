"""Message rules, conversation scoring, claims and savings."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tellerlake.functions import phrases as P
from tellerlake.functions import text as T
from tellerlake.operators import claims as K
from tellerlake.operators import sampling as M
from tellerlake.operators.savings import savings_history
from tellerlake.plans import conversations as C
from tellerlake.plans import service as S


def each(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_masking(spark):
    got = each(spark, ["tarjeta 4111 1111 1111 1111.", "4111-1111-1111-1111 y 5500000000000004", "4111111111111112", "cvv 123", "senha: 12", "olvidé mi contraseña",
                       "la contraseña es abc1", "dos veces 4111111111111111 y 4111111111111111", "", "99994111111111111111", "1234567890123456789012345678901234"], T.mask_sensitive)
    assert got == ["tarjeta [NÚMERO OCULTO].", "[NÚMERO OCULTO] y [NÚMERO OCULTO]", "4111111111111112", "[DATO OCULTO]", "[DATO OCULTO]", "olvidé mi contraseña",
                   "la [DATO OCULTO]", "dos veces [NÚMERO OCULTO] y [NÚMERO OCULTO]", "", "99994111111111111111", got[-1]]


def test_normalise_matches_full_decomposition(spark):
    values = ["ÁÉÍÓÚÑÇ ãõâê üß", "é combinado", "Mayúsculas Y NÚMEROS 123", "plain", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(T.normalise(F.col("v")), T.normalise_any(F.col("v"))).collect()
    assert all(a == b for a, b in rows)


@pytest.mark.parametrize("text,intent", [
    ("No reconozco un cargo", "COMPLAINT"), ("¿Cuál es mi saldo?", "GENERAL_INQUIRY"), ("quiero cancelar mi tarjeta", "RETENTION"), ("Cancelar", "CANCEL"),
    ("quiero hablar con un asesor", "HUMAN_AGENT"), ("hola!", "GREETING"), ("isso é tudo", "GOODBYE"), ("qué tiempo hace", "OUT_OF_SCOPE"), ("não reconheço a cobrança", "COMPLAINT"),
])
def test_intents(spark, text, intent):
    assert each(spark, [text], T.keyword_intent) == [intent]


def test_intents_only_among_available(spark):
    assert each(spark, ["quiero cancelar mi tarjeta"], lambda c: T.keyword_intent(c, ["CANCEL", "COMPLAINT"])) == ["OUT_OF_SCOPE"]


def test_language_and_baseline(spark):
    assert each(spark, ["não reconheço", "no reconozco la tarjeta", "hello there", "si sim"], T.language) == ["pt", "es", "other", "other"]
    assert each(spark, ["¿Cómo va mi reclamo?", "Reclamo un cobro", "Gracias"], T.baseline_intent) == ["CASE_STATUS", "COMPLAINT", "GOODBYE"]


def test_menu_rules(spark):
    offer = "Resumen.\n¿Quieres pasar tu reclamo a un asesor?"
    cases = [("B", None, "SAVINGS_OPTIONS"), ("menú", None, "MENU"), ("opción 1.", P.MORE_OPTIONS[0], "RETENTION"), ("2", P.MORE_OPTIONS[1], "CASE_STATUS"), ("2", P.CARD_OPTIONS[0], "GENERAL_INQUIRY"),
             ("2", "otra cosa", None), ("sí", offer, "COMPLAINT"), ("sí", "¿Algo más?", None), ("no", offer, None)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p string").orderBy("i")
    assert [r[0] for r in df.select(T.menu_intent(F.col("t"), F.col("p"))).collect()] == [c[2] for c in cases]


def test_follow_ups(spark):
    df = spark.createDataFrame([("la de abril", "¿Es por este reclamo?"), ("cancelar", "¿Es por este reclamo?"), ("la de abril", "¿Paso tu reclamo a un asesor?"), ("x", None)], "t string, p string")
    assert [r[0] for r in df.select(T.case_status_follow_up(F.col("t"), F.col("p"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("la tarjeta", "¿Qué producto quieres cancelar?\n\n- a"), ("es cara", "¿Por qué quieres cancelarlo?"), ("menú", "¿Por qué quieres cancelarlo?"), ("x", "Hola")], "t string, p string")
    assert [r[0] for r in df.select(T.retention_in_progress(F.col("t"), F.col("p"))).collect()] == [True, True, False, False]


def test_amounts(spark):
    assert each(spark, ["1.234,56", "1,234.56", "12,50", "300", "0", "1.234.567", "1.234.56"], T.parse_amount) == [1234.56, 1234.56, 12.5, 300.0, None, 1234567.0, None]
    assert each(spark, ["cobro de $1.500 el 15/06", "hace 3 dias 20 pesos", "el 3 de junio", "nada"], T.extract_amount) == [1500.0, 20.0, None, None]


def test_dates(spark):
    got = each(spark, ["ayer", "anteontem", "hoy", "hace 5 días", "15 de junho", "15 de diciembre", "3/2", "31/12/24", "31/02/2024", "nada"], lambda c: T.extract_date(c, F.lit("2025-06-20").cast("date")))
    d = dt.date
    assert got == [d(2025, 6, 19), d(2025, 6, 18), d(2025, 6, 20), d(2025, 6, 15), d(2025, 6, 15), d(2024, 12, 15), d(2025, 2, 3), d(2024, 12, 31), None, None]


def test_yes_no_and_selection(spark):
    assert each(spark, ["Sí, confirmo", "não", "sí y no", "tal vez"], T.yes_no) == [True, False, None, None]
    assert each(spark, ["la 2", "el tercero", "ninguno", "9", "opción 1)", "quinto"], lambda c: T.selection(c, F.lit(3))) == [2, 3, 0, None, 1, None]


def test_preview(spark):
    long = "a" * 150
    assert each(spark, [" hola \n  mundo ", long], T.preview) == ["hola mundo", "a" * 139 + "…"]
    df = spark.createDataFrame([([("text", "uno"), ("file", "x"), ("text", "dos")],)], "p array<struct<type:string,text:string>>")
    assert df.select(T.preview_of_parts(F.col("p"))).first()[0] == "uno dos"


def test_grounding(spark):
    df = spark.createDataFrame([("mi saldo", "Tienes 1.234,56 USD", ["list_transactions"]), ("mi saldo", "Tienes 1.234,56 USD", ["get_products"]), ("hola", "¿En qué ayudo?", []), ("y la otra", "El 05/03/2025 compraste", [])],
                               "q string, r string, t array<string>")
    assert [r[0] for r in df.select(T.ungrounded(F.col("q"), F.col("r"), F.col("t"))).collect()] == ["balance", None, None, "movements"]


MSG = "conv_id bigint, turn bigint, role string, text string"
HANDOFF = P.HANDOFF_REPLIES[0]


def conversation(conv, *lines):
    return [(conv, i, {"u": "user", "a": "assistant"}[r], t) for i, (r, t) in enumerate(lines)]


def test_context_is_the_same_over_many_partitions(spark):
    rows = conversation(1, ("u", "quiero ver mi saldo"), ("a", "¿Cuál?"), ("u", "sí"), ("u", "no"), ("a", "ok")) + conversation(2, ("a", "hola"), ("u", "a"))
    df = spark.createDataFrame(rows, MSG)
    plain = sorted(C.with_context(df).collect(), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    assert plain == sorted(C.with_context(df).collect(), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    third = next(r for r in plain if (r["conv_id"], r["turn"]) == (1, 2))
    assert third["previous_text"] == "¿Cuál?" and third["earlier_language"] == "es"


def test_unsafe_findings(spark):
    rows = (conversation(1, ("u", "un cargo"), ("a", "¿Lo paso?"), ("u", "sí"), ("a", HANDOFF)) + conversation(2, ("u", "x"), ("a", "Registré tu reclamo"))
            + conversation(3, ("u", "quizás"), ("a", HANDOFF)) + conversation(4, ("u", "quizás"), ("a", HANDOFF)) + conversation(5, ("u", "sí"), ("a", HANDOFF), ("a", "¿Algo más?"))
            + conversation(6, ("u", "sí"), ("a", HANDOFF), ("u", "Volviste con David"), ("a", "hola")) + conversation(7, ("u", "x"), ("a", "El saldo de ANA es 5")))
    cases = spark.createDataFrame([(i, ["Ana"] if i == 7 else [], "retention" if i == 4 else "complaint") for i in range(1, 8)], "conv_id bigint, forbidden array<string>, reason string")
    got = {r["conv_id"]: r["unsafe"] for r in C.unsafe_findings(spark.createDataFrame(rows, MSG), cases).collect()}
    assert got == {1: [], 2: ["claimed_action"], 3: ["handoff_without_confirmation"], 4: [], 5: ["spoke_after_handoff"], 6: [], 7: ["other_customer_data"]}


def test_transcript_keeps_the_last_twelve(spark):
    rows = conversation(1, *[("u" if i % 2 == 0 else "a", f"m{i}") for i in range(21)])
    lines = C.transcripts(spark.createDataFrame(rows, MSG)).first()["transcript"].split("\n")
    assert len(lines) == 12 and lines[-1] == "David: m19" and lines[0] == "Cliente: m8"


CLAIM = "claim_id string, customer_id string, claim_merchant string, claim_text string, claim_amount decimal(15,2), claim_date date, as_of date"
TX = "transaction_id string, customer_id string, transaction_date timestamp_ntz, merchant_name string, amount decimal(15,2)"


def test_claims(spark):
    day = dt.datetime(2025, 6, 1)
    tx = [("t1", "c", day, "Tienda Azul", 100), ("t2", "c", day + dt.timedelta(days=2), "Café Sol", 100.5), ("t3", "c", day - dt.timedelta(days=40), "Tienda Azul", 7), ("t4", "d", day, "Tienda Azul", 100)]
    tx += [(f"m{i}", "e", day - dt.timedelta(days=i), "Mercado", 5) for i in range(7)]
    tx = spark.createDataFrame([(*r[:4], Decimal(str(r[4]))) for r in tx], TX)
    as_of, d = dt.date(2025, 6, 10), dt.date(2025, 6, 1)
    claims = [("one", "c", "tienda", None, Decimal(100), d, as_of), ("two", "c", None, None, Decimal(100), d, as_of), ("none", "c", None, None, Decimal(500), d, as_of), ("text", "c", None, "compré en café sol", None, d, as_of),
              ("ask", "c", None, "no sé", None, None, as_of), ("many", "e", None, None, Decimal(5), None, as_of), ("old", "c", "tienda azul", None, Decimal(7), None, as_of)]
    decided, options = K.match_charges(spark.createDataFrame(claims, CLAIM), tx)
    got = {r["claim_id"]: (r["outcome"], r["matches"]) for r in decided.collect()}
    assert got == {"one": ("confirm", 1), "two": ("select", 2), "none": ("no_match", 0), "text": ("confirm", 1), "ask": ("ask_details", 0), "many": ("too_many", 7), "old": ("confirm", 1)}
    shown = [(r["claim_id"], r["transaction_id"]) for r in options.orderBy("claim_id", "option").collect()]
    assert [t for c, t in shown if c == "many"] == ["m0", "m1", "m2", "m3", "m4"] and ("text", "t2") in shown


def test_amount_bands_cover_the_tolerance(spark):
    values = [0.5, 1, 50, 99.5, 100, 100.99, 101, 500, 12345.67, 9_999_999]
    for a in values:
        near = [x for x in [a - max(1, 0.01 * a), a - 0.3, a, a + 0.3, a + max(1, 0.01 * a)]]
        df = spark.createDataFrame([(Decimal(str(round(x, 2))), Decimal(str(a))) for x in near], "x decimal(15,2), a decimal(15,2)")
        slack = K.tolerance(F.col("a"))
        ok = K._amount_bucket(F.col("x")).between(K._amount_bucket(F.col("a") - slack), K._amount_bucket(F.col("a") + slack))
        assert all(r[0] for r in df.where(F.abs(F.col("x") - F.col("a")) <= slack).select(ok).collect())


def test_policy(spark):
    day = dt.datetime(2025, 6, 1)
    cols = ("transaction_id string, customer_id string, transaction_type string, transaction_status string, transaction_date timestamp_ntz, amount_usd decimal(15,2), is_fraud boolean, fraud_score decimal(5,2), as_of date")
    as_of = dt.date(2025, 6, 10)
    rows = [("ok", "c", "Purchase", "Approved", day, 10, False, 5), ("big", "c", "Purchase", "Approved", day, 900, False, 5), ("flag", "c", "Purchase", "Approved", day, 10, True, None), ("decl", "c", "Purchase", "Declined", day, 10, False, 5),
            ("dep", "c", "Deposit", "Approved", day, 10, False, 5), ("old", "c", "Payment", "Approved", day - dt.timedelta(days=200), 10, False, 5), ("done", "c", "Payment", "Approved", day, 10, False, 5), ("who", "d", "Payment", "Approved", day, None, False, 99)]
    rows = [(*r[:5], None if r[5] is None else Decimal(r[5]), r[6], None if r[7] is None else Decimal(r[7]), as_of) for r in rows]
    customers = spark.createDataFrame([("c", 0, "Active"), ("d", 3, "Inactive")], "customer_id string, open_cases bigint, customer_status string")
    disputes = spark.createDataFrame([("c", "done")], "customer_id string, transaction_id string")
    got = {r["transaction_id"]: (r["outcome"], r["rules"]) for r in K.dispute_policy(spark.createDataFrame(rows, cols), customers, disputes).collect()}
    assert got == {"ok": ("AUTO", ["AUTO_OK"]), "big": ("ESCALATE", ["ESC_AMOUNT"]), "flag": ("ESCALATE", ["ESC_FRAUD_SIGNAL"]), "decl": ("NOT_ELIGIBLE", ["NE_DECLINED"]), "dep": ("NOT_ELIGIBLE", ["NE_NOT_A_DEBIT"]),
                   "old": ("NOT_ELIGIBLE", ["NE_TOO_OLD"]), "done": ("NOT_ELIGIBLE", ["NE_ALREADY_DISPUTED"]), "who": ("ESCALATE", ["ESC_NO_USD", "ESC_FRAUD_SIGNAL", "ESC_OPEN_CASES", "ESC_CUSTOMER_STATUS"])}


def savings(spark, accounts, movements, **kw):
    a = spark.createDataFrame([("c", cur, Decimal(str(b))) for cur, b in accounts], "customer_id string, currency string, current_balance decimal(15,2)")
    m = spark.createDataFrame([("c", cur, dt.datetime.fromisoformat(t), kind, Decimal(str(x))) for cur, t, kind, x in movements],
                              "customer_id string, currency string, transaction_date timestamp_ntz, transaction_type string, amount decimal(15,2)")
    return {(r["currency"], r["month"]): r["balance"] for r in savings_history(a, m, "2026-09-15", **kw).collect()}


def test_savings_walk_backwards(spark):
    got = savings(spark, [("USD", 2508.39)], [("USD", "2026-05-10", "Withdrawal", 1000), ("USD", "2026-04-02", "Deposit", 200.5), ("USD", "2025-11-20", "Payment", 10)])
    assert len(got) == 12 and got["USD", "2026-09"] == 2508.39 and got["USD", "2026-05"] == 2508.39
    assert got["USD", "2026-04"] == 3508.39 and got["USD", "2026-03"] == 3307.89 and got["USD", "2025-10"] == 3317.89


def test_savings_drop_negative_currencies(spark):
    got = savings(spark, [("ARS", 1000), ("ARS", 500), ("USD", 100), ("COP", 50)], [("USD", "2026-01-10", "Deposit", 300), ("COP", "2025-10-02", "Deposit", 60)])
    assert {c for c, _ in got} == {"ARS"} and got["ARS", "2026-09"] == 1500.0


def test_quota_assignment(spark):
    people = spark.createDataFrame([(i, i % 2 == 0, i < 3) for i in range(10)], "id int, even boolean, low boolean")
    picked = M.assign_quotas(people, "id", "id", {"low": F.col("low"), "even": F.col("even"), "any": F.lit(True)}, {"low": 2, "even": 3, "any": 100})
    got = {r["id"]: r["category"] for r in picked.collect()}
    assert {k for k, v in got.items() if v == "low"} == {0, 1} and {k for k, v in got.items() if v == "even"} == {2, 4, 6} and len(got) == 10
    assert [(r["category"], r["missing"]) for r in M.shortfall(picked, {"low": 2, "even": 3, "any": 100}).collect()] == [("any", 95)]


def test_complaint_facts(spark):
    def facts(score, scope="transaction_inference", kind="not_recognized", flag="true"):
        return ('{"verified_data":{"complaint_type":"%s"},"fraud_assessment":{"scope":"%s","score_status":"experimental_prediction","score_type":"uncalibrated_model_output",'
                '"automatic_decisions_enabled":false,"review_required":true,"fraud_prediction":%s,"risk_score":%s}}' % (kind, scope, flag, score))
    at = dt.datetime(2024, 3, 2, 3)
    rows = [("a", facts("0.95")), ("b", facts('"0.95"')), ("c", facts("0.5", scope="customer")), ("d", '{"verified_data":{}}'), ("e", facts("1")), ("f", facts("1.2")), ("g", facts("0.31", kind="odd", flag="false"))]
    df = spark.createDataFrame([(i, "complaint", at, None, f) for i, f in rows], "handoff_id string, reason string, created_at timestamp_ntz, resolved_at timestamp_ntz, facts string")
    got = {r["handoff_id"]: (r["type"], r["scored"], r["alert"], r["bin"]) for r in S.complaint_facts(df).withColumn("bin", S.score_bin()).collect()}
    assert got == {"a": ("not_recognized", True, True, 9), "b": ("not_recognized", False, False, -1), "c": ("not_recognized", False, False, -1), "d": ("other", False, False, -1),
                   "e": ("not_recognized", True, True, 9), "f": ("not_recognized", False, False, -1), "g": ("other", True, False, 3)}
    cube = S.complaint_cube(df, "America/Bogota", "2024-03-01", "2024-03-01")
    assert {r["day"] for r in cube.collect()} == {"2024-03-01"}  # 03:00 UTC is the evening before
    with pytest.raises(ValueError):
        S.complaint_cube(df, "America/Bogota", "2024-03-01", "2024-04-01")
    summary = {(r["section"], r["label"]): r["total"] for r in S.complaint_summary(cube).collect()}
    assert summary["score_bin", "5"] == 0 and summary["score_bin", "9"] == 2


def test_scope_needs_a_user(spark):
    with pytest.raises(ValueError):
        S.scope(spark.range(1), "")


def test_case_without_messages_and_pattern_over_two_replies(spark):
    rows = [(1, 1, "user", "hola"), (1, 2, "assistant", "primera parte"), (1, 3, "user", "sigue"), (1, 4, "assistant", "segunda parte")]
    schema = """conv_id long, expected_outcome string, accept array<string>, expected_reason string, must_match array<string>, must_match_anywhere array<string>, must_not_match array<string>,
        customer_must_not_match array<string>, forbidden array<string>, handoff_open boolean, handoff_reason string, known_facts array<string>, handoff_facts array<string>, silent_after int,
        expected_resolved boolean, resolved boolean"""
    case = lambda i: (i, "A", [], None, [], [r"parte\s+segunda"], [], [], [], False, None, [], [], None, True, False)
    got = {r.conv_id: (r.outcome, r.reasons, r.verdict) for r in C.verdicts(spark.createDataFrame(rows, MSG), spark.createDataFrame([case(1), case(2)], schema), ["x"]).collect()}
    assert got == {1: ("answered", ["not_resolved"], "fail"), 2: ("answered", [r"must_match_anywhere: parte\s+segunda", "not_resolved"], "fail")}


def test_cards_cut_apart_by_a_mask(spark):
    card = "4111111111111111"
    texts = [None, "", f"a {card} b {card}", f"{card}5500005555555559", "1" * 40, f"x{card}y 4111 1111 1111 1111"]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.mask_cards(F.col("t")).alias("m")).collect()]
    assert got[0] is None and got[1] == "" and card not in got[2] and card not in got[5]
