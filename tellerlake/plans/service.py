"""Chat inbox, resolution and turn metrics, complaint operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.functions.calendar import check_window, check_zone, local_day, within_local_days
from tellerlake.functions.money import cost_usd
from tellerlake.operators.latest import newest_per_group, page_after
from tellerlake.operators.quality import count_if
from tellerlake.operators.ordering import exact_percentiles
from tellerlake.operators.running import attach_one_row

HUMAN = ("human_queue", "human_agent")
HANDOFF_REASONS = ("complaint", "retention", "case_status")
COMPLAINT_TYPES = ("not_recognized", "duplicate_charge", "different_amount")


# ---- chats

def customer_key() -> Column:
    """A console row per bank customer: customer id, else email, else user id."""
    return F.coalesce("customer_id", "user_email", "user_id")


def scope(chats: DataFrame, user_id: str | None, everyone: bool = False) -> DataFrame:
    """A user's chats, or all of them when asked for explicitly; an empty user is an error."""
    if everyone:
        return chats
    if not user_id:
        raise ValueError("A user-scoped chat query needs a user id")
    return chats.where(F.col("user_id") == user_id)


def latest_reason(handoffs: DataFrame) -> DataFrame:
    """The reason of each chat's newest handoff, open or closed."""
    return handoffs.groupBy("chat_id").agg(F.max_by("reason", F.struct("created_at", "handoff_id")).alias("reason"))


def inbox(chats: DataFrame, handoffs: DataFrame, handled_by: Sequence[str] | None = None, intent: str | None = None, use_case: str | None = None,
          assigned_to: str | None = None, customer_id: str | None = None, status: str | None = None, handoff_reason: str | None = None) -> DataFrame:
    """Chats with their latest handoff reason; every criterion is applied only when given."""
    out = chats
    if handled_by:
        out = out.where(F.col("handled_by").isin(*handled_by))
    for column, value in (("intent", intent), ("use_case", use_case), ("assigned_to", assigned_to), ("customer_id", customer_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if status in ("open", "closed"):
        out = out.where(F.col("closed_at").isNull() if status == "open" else F.col("closed_at").isNotNull())
    out = out.join(latest_reason(handoffs), "chat_id", "left")
    return out if handoff_reason is None else out.where(F.col("reason") == handoff_reason)


def latest_per_customer(chats: DataFrame, closed: bool = False) -> DataFrame:
    """Each customer's newest open (or closed) chat."""
    state = F.col("closed_at").isNotNull() if closed else F.col("closed_at").isNull()
    keyed = chats.where(state).withColumn("customer_key", customer_key())
    return keyed.groupBy("customer_key").agg(F.max_by(F.struct(*chats.columns), F.struct("created_at", "chat_id")).alias("c")).select("customer_key", "c.*")


def customer_inbox(chats: DataFrame, messages: DataFrame, handoffs: DataFrame, closed: bool = False) -> DataFrame:
    """One row per customer: newest chat in the state, number of chats, last activity."""
    totals = chats.groupBy(customer_key().alias("customer_key")).agg(F.count(F.lit(1)).alias("conversation_count"))
    spoken = messages.groupBy("chat_id").agg(F.max("created_at").alias("_spoken"))
    return (latest_per_customer(chats, closed).join(totals, "customer_key").join(latest_reason(handoffs), "chat_id", "left").join(spoken, "chat_id", "left")
            .withColumn("updated_at", F.coalesce("_spoken", "created_at")).drop("_spoken"))


def inbox_page(rows: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    return page_after(rows, "updated_at", "customer_key", limit, after)


def _state_counts() -> dict[str, Column]:
    is_open = F.col("closed_at").isNull()
    return {
        "open_human": count_if(is_open & F.col("handled_by").isin(*HUMAN)), "ai_agent": count_if(is_open & (F.col("handled_by") == "ai_agent")),
        "with_advisor": count_if(is_open & (F.col("handled_by") == "human_agent")), "unattended": count_if(F.col("handled_by") == "human_queue"),
        "resolved": count_if(~is_open),
    }


def console_counts(chats: DataFrame, advisor: str, by_customer: bool = False) -> DataFrame:
    """Counts per use case over chats, or over each customer's newest open chat."""
    source = latest_per_customer(chats) if by_customer else chats
    mine = count_if((F.col("assigned_to") == advisor) & F.col("closed_at").isNull())
    return source.groupBy("use_case").agg(*[c.alias(n) for n, c in _state_counts().items()], mine.alias("mine"))


def open_reasons(chats: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Open chats with people, by latest handoff reason."""
    waiting = chats.where(F.col("closed_at").isNull() & F.col("handled_by").isin(*HUMAN))
    return waiting.join(latest_reason(handoffs), "chat_id").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def chat_owners(chats: DataFrame) -> DataFrame:
    return chats.groupBy("user_id").agg(F.max("user_email").alias("user_email"))


def last_customer_message(messages: DataFrame) -> DataFrame:
    """Newest customer message per chat; rows from before sender types existed count by role."""
    theirs = messages.where((F.col("sender_type") == "customer") | (F.col("sender_type").isNull() & (F.col("role") == "user")))
    return newest_per_group(theirs, ["chat_id"], [F.desc("created_at"), F.desc("message_id")], 1)


def due_turns(turns: DataFrame, now: str) -> DataFrame:
    """Each chat's oldest pending turn, when it is due."""
    pending = turns.where("status = 'pending'")
    first = pending.groupBy("chat_id").agg(F.min("created_at").alias("created_at"))
    return pending.join(first, ["chat_id", "created_at"], "left_semi").where(F.col("next_attempt_at") <= F.lit(now).cast("timestamp_ntz"))


def last_closed_message(messages: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The newest message saved at or before a chat's latest close."""
    closes = resolutions.groupBy("chat_id").agg(F.max("resolved_at").alias("_closed"))
    return (messages.join(closes, "chat_id").where(F.col("created_at") <= F.col("_closed"))
            .groupBy("chat_id").agg(F.max_by("message_id", F.struct("created_at", "message_id")).alias("message_id")))


# ---- metrics

def resolution_metrics(events: DataFrame, zone: str, first: str, last: str) -> DataFrame:
    """Closes by local day and use case: contained by the assistant, by people, or assisted."""
    check_zone(zone)
    contained, by_ai = ~F.col("had_human"), F.col("resolved_by") == "ai"
    return (events.where(within_local_days(F.col("resolved_at"), zone, first, last))
            .groupBy(local_day(F.col("resolved_at"), zone).alias("day"), "use_case").agg(
                F.count(F.lit(1)).alias("total"), count_if(by_ai & contained).alias("ai_contained"),
                count_if(F.col("resolved_by") == "human").alias("human"), count_if(by_ai & F.col("had_human")).alias("assisted")))


def resolution_totals(by_day: DataFrame) -> DataFrame:
    """The same counts by use case and over everything; a missing use case gets a name."""
    named = by_day.withColumn("use_case", F.coalesce("use_case", F.lit("none")))
    sums = [F.sum(c).alias(c) for c in ("total", "ai_contained", "human", "assisted")]
    return named.rollup("use_case").agg(F.grouping("use_case").alias("is_total"), *sums)


def turn_metrics(turns: DataFrame, zone: str, first: str, last: str) -> DataFrame:
    """Latency of live turns, tokens of turns with known usage, conversations and estimated cost: one row."""
    inside = turns.where(within_local_days(F.col("created_at"), zone, first, last))
    used = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0)).alias(c)
    usage = inside.agg(count_if(F.col("source") == "live").alias("live_turns"), count_if(used).alias("turns_with_usage"),
                       total("input_tokens"), total("output_tokens"), total("duration_ms"))
    chats = inside.agg(F.count_distinct("chat_id").alias("conversations"))
    latency = exact_percentiles(inside.where("source = 'live'"), [], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).drop("n_values")
    out = attach_one_row(attach_one_row(usage, chats), latency)
    known = F.col("turns_with_usage") > 0
    cost = cost_usd(F.when(known, F.col("input_tokens")), F.when(known, F.col("output_tokens")), F.col("duration_ms"))
    return out.withColumn("estimated_usd", cost).withColumn(
        "per_conversation_usd", F.when(F.col("conversations") > 0, F.col("estimated_usd") / F.col("conversations")))


# ---- complaint operations

ASSESSMENT = ("scope STRING, score_status STRING, score_type STRING, automatic_decisions_enabled VARIANT, review_required VARIANT, "
              "fraud_prediction VARIANT, risk_score VARIANT")


def complaint_facts(handoffs: DataFrame) -> DataFrame:
    """Type, score, validity and alert of each complaint, read from its JSON facts with type tests."""
    facts = F.from_json("facts", f"STRUCT<verified_data: STRUCT<complaint_type: STRING>, fraud_assessment: STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in ASSESSMENT.split(', '))}>>")
    a = F.col("_facts.fraud_assessment")

    def flag(name: str, value: bool) -> Column:
        return F.schema_of_variant(a[name]).eqNullSafe("BOOLEAN") & (F.try_variant_get(a[name], "$", "boolean") == F.lit(value))
    kind = F.schema_of_variant(a["risk_score"])
    numeric = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    score = F.when(numeric, F.try_variant_get(a["risk_score"], "$", "decimal(18,6)"))
    valid = ((a["scope"] == "transaction_inference") & (a["score_status"] == "experimental_prediction") & (a["score_type"] == "uncalibrated_model_output")
             & flag("automatic_decisions_enabled", False) & flag("review_required", True)
             & F.schema_of_variant(a["fraud_prediction"]).eqNullSafe("BOOLEAN") & score.between(0, 1))
    named = F.col("_facts.verified_data.complaint_type")
    return handoffs.withColumn("_facts", facts).select(
        "handoff_id", "created_at", F.when(named.isin(*COMPLAINT_TYPES), named).otherwise("other").alias("type"), F.col("resolved_at").isNotNull().alias("closed"),
        score.alias("score"), F.coalesce(valid, F.lit(False)).alias("scored"), F.coalesce(valid & flag("fraud_prediction", True), F.lit(False)).alias("alert"))


def score_bin() -> Column:
    return F.when(F.col("scored"), F.least(F.lit(9), F.floor(F.col("score") * 10).cast("int"))).otherwise(-1)


def complaint_cube(handoffs: DataFrame, zone: str, first: str, last: str) -> DataFrame:
    """Complaints by local day, type, state and score decile; at most 31 days."""
    check_zone(zone)
    check_window(first, last)
    inside = handoffs.where("reason = 'complaint'").where(within_local_days(F.col("created_at"), zone, first, last))
    day = local_day(F.col("created_at"), zone)
    return complaint_facts(inside).groupBy(day.alias("day"), "type", "closed", "scored", "alert", score_bin().alias("score_bin")).agg(F.count(F.lit(1)).alias("total"))


def complaint_summary(cube: DataFrame) -> DataFrame:
    """Totals by day, type and zero-filled score decile, long form."""
    n = F.sum("total").alias("total")
    parts = {
        "day": cube.groupBy(F.col("day").alias("label")).agg(n), "type": cube.groupBy(F.col("type").alias("label")).agg(n),
        "closed": cube.groupBy(F.col("closed").cast("string").alias("label")).agg(n), "alert": cube.groupBy(F.col("alert").cast("string").alias("label")).agg(n),
    }
    bins = cube.sparkSession.range(10).select(F.col("id").cast("string").alias("label"))
    found = cube.where("score_bin >= 0").groupBy(F.col("score_bin").cast("string").alias("label")).agg(n)
    parts["score_bin"] = bins.join(found, "label", "left").select("label", F.coalesce("total", F.lit(0)).alias("total"))
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("section"), "label", "total")
        out = part if out is None else out.unionByName(part)
    return out


def run_summary(turns: DataFrame, chats: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Conversations per use case with handoffs, closes without people, latency and cost."""
    handed = handoffs.select("chat_id").distinct().withColumn("_handed", F.lit(True))
    state = chats.join(handed, "chat_id", "left").groupBy("use_case").agg(
        F.count(F.lit(1)).alias("conversations"), count_if(F.col("_handed")).alias("handed_off"),
        count_if(F.col("closed_at").isNotNull() & F.col("_handed").isNull()).alias("resolved_by_ai"))
    latency = exact_percentiles(turns, ["use_case"], "duration_ms", {"p50": 0.5, "p95": 0.95}).drop("n_values")
    # Integer sums first: the cost of the summed usage is the same whatever the order of the rows.
    used = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    usage = turns.groupBy("use_case").agg(*[F.sum(F.when(used, F.col(c))).alias(f"_{c}") for c in ("input_tokens", "output_tokens", "duration_ms")])
    usage = usage.select("use_case", cost_usd(F.col("_input_tokens"), F.col("_output_tokens"), F.col("_duration_ms")).alias("cost"))
    for part in (latency, usage):
        names = [c for c in part.columns if c != "use_case"]
        part = part.withColumnRenamed("use_case", "_u")
        state = state.join(part, F.col("use_case").eqNullSafe(F.col("_u")), "left").select(*state.columns, *names)
    return state
