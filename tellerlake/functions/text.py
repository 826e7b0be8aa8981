"""Message rules as column expressions: normalising, language, intents, masking, menus, amounts and dates."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tellerlake.functions import phrases as P

EDGE_MARKS = " .!?)"


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and the letter each one decomposes to, by Unicode decomposition."""
    source, target = [], []
    for code in range(0xA0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _plain_letters()


def normalise(c: Column) -> Column:
    """Lower case without marks; stays in generated code, exact for Latin letters and combining marks."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[\u0300-\u036f]", "")


@F.pandas_udf(StringType())
def normalise_any(texts: pd.Series) -> pd.Series:
    """Full compatibility decomposition for scripts `normalise` does not cover."""
    def plain(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return texts.map(plain)


def whole(c: Column, pattern: str) -> Column:
    return c.rlike(rf"^(?:{pattern})\z")


def bare(c: Column) -> Column:
    """Normalised text without surrounding spaces and end marks."""
    return F.btrim(normalise(c), F.lit(EDGE_MARKS))


def language(c: Column) -> Column:
    """`es`, `pt`, or `other` on equal marker counts."""
    t = normalise(c)
    pt, es = F.regexp_count(t, F.lit(P.PT_MARKERS)), F.regexp_count(t, F.lit(P.ES_MARKERS))
    return F.when(pt > es, "pt").when(es > pt, "es").otherwise("other")


def first_rule(t: Column, rules: Sequence[tuple[str, str]], otherwise: str, prefix: str = "") -> Column:
    """Label of the first matching rule."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for label, pattern in rules:
        out = out.when(t.rlike(prefix + pattern), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def keyword_intent(c: Column, available: Sequence[str] | None = None) -> Column:
    """Intent by ordered keyword rules; only the available intents take part."""
    rules = [r for r in P.INTENTS if available is None or r[0] in available]
    return first_rule(normalise(c), rules, "OUT_OF_SCOPE")


def intent_confidence(intent: Column) -> Column:
    return F.when(intent == "OUT_OF_SCOPE", 0.0).otherwise(1.0)


def baseline_intent(c: Column) -> Column:
    """The comparison rules; a claim with a status word asks about an existing case."""
    status = c.rlike("(?iu)" + P.CASE_MENTION) & c.rlike("(?iu)" + P.STATUS_WORDS)
    return F.when(status, "CASE_STATUS").otherwise(first_rule(c, P.BASELINE_INTENTS, "OUT_OF_SCOPE", "(?iu)"))


def is_injection(c: Column) -> Column:
    return normalise(c).rlike(P.INJECTION)


# ---- masking

def passes_luhn(digits: Column) -> Column:
    """Checksum of a string of digits."""
    size = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((size - i) % 2 == 1, doubled).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) % 10 == 0


def _cards(t: Column) -> Column:
    """Card numbers in a text: runs of 13 to 19 digits, each tested as a whole."""
    runs = F.transform(F.regexp_extract_all(t, F.lit(P.CARD_RUN), 0), lambda m: F.rtrim(m, F.lit(" -")))
    return F.filter(F.array_distinct(runs), lambda m: passes_luhn(F.regexp_replace(m, "[ -]", "")))


def mask_cards(c: Column) -> Column:
    """Find all cards in one scan and mask every copy of each; scan again only after a scan that found some, as what a mask cuts apart may hold
    another. Each such scan removes at least 13 digits, which bounds their number."""
    passes = F.floor(F.length(F.regexp_replace(c, "[^0-9]", "")) / 13).cast("int")

    def scan(state: Column, _: Column) -> Column:
        cards = _cards(state["text"])
        masked = F.aggregate(cards, state["text"], lambda t, card: F.replace(t, card, F.lit(P.CARD_TOKEN)))
        return F.when(state["more"], F.struct(masked.alias("text"), (F.size(cards) > 0).alias("more"))).otherwise(state)

    repeated = F.aggregate(F.sequence(F.lit(1), passes), F.struct(c.alias("text"), F.lit(True).alias("more")), scan)["text"]
    return F.when(passes < 1, c).otherwise(repeated)


def mask_secrets(c: Column) -> Column:
    return F.regexp_replace(c, "(?iU)" + P.SECRET_VALUE, P.SECRET_TOKEN)


def mask_sensitive(c: Column) -> Column:
    return mask_secrets(mask_cards(c))


def guardrail(c: Column) -> Column:
    """`PROMPT_INJECTION`, `SENSITIVE_DATA` or NULL."""
    return F.when(is_injection(c), "PROMPT_INJECTION").when(mask_sensitive(c) != c, "SENSITIVE_DATA")


# ---- rules that read the previous reply

def last_line(c: Column) -> Column:
    lines = F.split(F.regexp_replace(normalise(c), r"(?U)^\s+|\s+\z", ""), r"\r\n|\r|\n")
    return F.element_at(lines, -1)


def confirmed_operation(text: Column, previous: Column) -> Column:
    """The operation a yes keeps, when the previous reply's last line offers to pass it to an advisor."""
    line = last_line(previous)
    offered = F.contains(line, F.lit("?")) & line.rlike(P.TO_ADVISOR)
    out = F.when(F.lit(False), F.lit(""))
    for label, pattern in P.CONFIRMATIONS:
        out = out.when(line.rlike(pattern), F.lit(label))
    return F.when(whole(bare(text), P.AFFIRMATIVE) & offered, out)


def menu_intent(text: Column, previous: Column) -> Column:
    """What a letter, "menú", a confirmation or a submenu digit stands for; NULL when none applies."""
    t, reply = bare(text), F.regexp_replace(previous, r"(?U)^\s+|\s+\z", "")
    letter = F.regexp_extract(t, rf"^(?:{P.MENU_LETTER})\z", 1)
    digit = F.regexp_extract(t, rf"^(?:{P.SUBMENU_DIGIT})\z", 1)
    by_letter = F.when(F.lit(False), F.lit(""))
    for k, v in P.LETTER_INTENTS.items():
        by_letter = by_letter.when(letter == k, F.lit(v))
    more = F.when(digit == "1", "RETENTION").otherwise("CASE_STATUS")
    confirmed = confirmed_operation(text, previous)
    return (F.when(whole(t, P.MENU_WORDS), "MENU").when(letter != "", by_letter).when(confirmed.isNotNull(), confirmed)
            .when((digit != "") & reply.isin(*P.MORE_OPTIONS), more)
            .when((digit != "") & reply.isin(*P.CARD_OPTIONS, *P.SAVINGS_OPTIONS), "GENERAL_INQUIRY"))


def own_rule(text: Column) -> Column:
    """A menu word, a menu letter or a cancel, which no follow-up rule may take over."""
    t = bare(text)
    return whole(t, P.MENU_WORDS) | whole(t, P.MENU_LETTER) | t.rlike(P.CANCEL)


def case_status_follow_up(text: Column, previous: Column) -> Column:
    """An answer to a question about the customer's complaint that offers no advisor."""
    line = last_line(previous)
    asked = F.contains(line, F.lit("?")) & line.rlike(P.ABOUT_COMPLAINT) & ~line.rlike(P.TO_ADVISOR)
    return F.coalesce(asked & ~own_rule(text), F.lit(False))


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def asked_for_reason(previous: Column) -> Column:
    said = F.regexp_replace(normalise(previous), r"(?U)^\s+|\s+\z", "")
    return F.coalesce(said.isin(*[_plain(q) for q in P.REASON_QUESTIONS]), F.lit(False))


def retention_in_progress(text: Column, previous: Column) -> Column:
    """An answer to one of the cancellation's own questions."""
    said = F.regexp_replace(normalise(previous), r"(?U)^\s+|\s+\z", "")
    asked = asked_for_reason(previous)
    for question in P.PRODUCT_QUESTIONS:
        asked = asked | said.startswith(_plain(question)) | F.contains(said, F.lit("\n\n" + _plain(question)))
    return F.coalesce(asked & ~own_rule(text), F.lit(False))


# ---- amounts, dates, selections

def _after_last(t: Column, mark: str) -> Column:
    return F.substring_index(t, mark, -1)


def parse_amount(token: Column) -> Column:
    """'1.234,56', '1,234.56', '12,50', '300' to a positive double, else NULL."""
    t = F.trim(token)
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))

    def without(mark: str) -> Column:
        return F.replace(t, F.lit(mark), F.lit(""))
    comma_is_last = F.length(_after_last(t, ",")) < F.length(_after_last(t, "."))
    both = F.when(comma_is_last, F.replace(without("."), F.lit(","), F.lit("."))).otherwise(without(","))
    tail = _after_last(t, ",")
    head = F.replace(F.substring(t, F.lit(1), F.length(t) - F.length(tail) - 1), F.lit(","), F.lit(""))
    only_comma = F.when(F.length(tail) <= 2, F.concat(head, F.lit("."), tail)).otherwise(without(","))
    only_dot = F.when(F.length(_after_last(t, ".")) <= 2, t).otherwise(without("."))
    number = F.when(comma & dot, both).when(comma, only_comma).when(dot, only_dot).otherwise(t).try_cast("double")
    return F.when(number > 0, number)


MONTH_NUMBERS = {name: i for i, names in enumerate(P.MONTH_NAMES, 1) for name in names}
DAY_MONTH = r"\b(\d{1,2})\s+de\s+(" + "|".join(MONTH_NUMBERS) + r")\b"


def extract_amount(c: Column) -> Column:
    """First positive amount once dates are taken out."""
    t = normalise(c)
    for pattern in (P.DATE_DMY, DAY_MONTH, P.DAYS_AGO):
        t = F.regexp_replace(t, pattern, " ")
    amounts = F.transform(F.regexp_extract_all(t, F.lit(P.AMOUNT), 1), parse_amount)
    return F.get(F.filter(amounts, lambda a: a.isNotNull()), 0)


def _checked_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _this_or_last_year(month: Column, day: Column, as_of: Column) -> Column:
    date = _checked_date(F.year(as_of), month, day)
    return F.when(date > as_of, _checked_date(F.year(as_of) - 1, month, day)).otherwise(date)


def extract_date(c: Column, as_of: Column) -> Column:
    """Relative day, 'hace N dias', '15 de junio' or d/m[/y]; without a year a future date means last year's."""
    t = normalise(c)
    ago = F.regexp_extract(t, P.DAYS_AGO, 1)
    named_day, named_month = F.regexp_extract(t, DAY_MONTH, 1), F.regexp_extract(t, DAY_MONTH, 2)
    number = F.when(F.lit(False), F.lit(0))
    for name, i in MONTH_NUMBERS.items():
        number = number.when(named_month == name, F.lit(i))
    day, month, year = (F.regexp_extract(t, P.DATE_DMY, i).try_cast("int") for i in (1, 2, 3))
    full_year = F.when(year < 100, year + 2000).otherwise(year)
    numeric = F.when(year.isNull(), _this_or_last_year(month, day, as_of)).otherwise(_checked_date(full_year, month, day))
    return (F.when(t.rlike(r"\b(anteayer|antier|anteontem)\b"), F.date_sub(as_of, 2)).when(t.rlike(r"\b(ayer|ontem)\b"), F.date_sub(as_of, 1))
            .when(t.rlike(r"\b(hoy|hoje)\b"), as_of).when(ago != "", F.date_sub(as_of, ago.try_cast("int")))
            .when(named_day != "", _this_or_last_year(number, named_day.try_cast("int"), as_of)).when(day.isNotNull(), numeric))


def yes_no(c: Column) -> Column:
    """true, false, or NULL when neither or both are said."""
    words = F.regexp_extract_all(normalise(c), F.lit("[a-z]+"), 0)

    def said(vocabulary: Sequence[str]) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))
    yes, no = said(P.YES), said(P.NO)
    return F.when(yes & ~no, True).when(no & ~yes, False)


def selection(c: Column, options: Column) -> Column:
    """1-based option, 0 for none of them, NULL when it is not a selection."""
    t = F.regexp_replace(normalise(c), r"(?U)^\s+|\s+\z", "")
    number = F.regexp_extract(t, rf"^(?:{P.SELECTION})\z", 1).try_cast("int")
    out = F.when(t.rlike(P.NONE_OF_THEM), 0).when(number.isNotNull(), F.when(number.between(1, options), number))
    for k, words in enumerate(P.ORDINALS, 1):
        out = out.when(t.rlike(rf"\b({'|'.join(words)})\b") & (F.lit(k) <= options), k)
    return out


# ---- display

def one_line(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def cut(c: Column, limit: int) -> Column:
    """Collapsed text, cut with an ellipsis when longer than `limit`."""
    t = one_line(c)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))).otherwise(t)


def preview(c: Column) -> Column:
    return cut(c, 140)


def preview_of_parts(parts: Column) -> Column:
    """Preview of a message stored as an array of (type, text) parts."""
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return cut(F.array_join(texts, " "), 140)


def title(c: Column) -> Column:
    return cut(c, 60)


def transcript_line(role: Column, text: Column) -> Column:
    """One line of the classifier's transcript; the assistant's is cut to its last 300 characters."""
    body = F.regexp_replace(text, r"(?U)^\s+", "")
    advisor = body.startswith(P.ADVISOR_PREFIX)
    said = F.regexp_replace(F.substring(body, F.lit(len(P.ADVISOR_PREFIX) + 1), F.length(body)), r"(?U)^\s+", "")
    return (F.when(role == "user", F.concat(F.lit("Cliente: "), mask_sensitive(text)))
            .when((role == "assistant") & advisor, F.concat(F.lit("Asesor: "), mask_sensitive(said)))
            .when(role == "assistant", F.concat(F.lit("David: "), F.right(mask_sensitive(text), F.lit(300)))))


# ---- grounding

def required_kinds(customer: Column, reply: Column, kinds=P.GROUNDING) -> Column:
    """Kinds of account data the turn needs: those asked for, else the first the reply shows."""
    def any_of(patterns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [customer.rlike("(?iu)" + p) for p in patterns])
    asked = F.array_compact(F.array(*[F.when(any_of(asks), F.lit(kind)) for kind, _, asks, _ in kinds]))
    shown = F.array_compact(F.array(*[F.when(reply.rlike("(?mU)" + shows), F.lit(kind)) for kind, _, _, shows in kinds]))
    return F.when(F.size(asked) > 0, asked).otherwise(F.slice(shown, 1, 1))


def ungrounded(customer: Column, reply: Column, tools: Column, kinds=P.GROUNDING) -> Column:
    """First required kind shown in the reply whose tool did not run; NULL when the reply is grounded."""
    needed = required_kinds(customer, reply, kinds)
    broken = [F.when(F.array_contains(needed, kind) & ~F.array_contains(tools, tool) & reply.rlike("(?mU)" + shows), F.lit(kind))
              for kind, tool, _, shows in kinds]
    return F.coalesce(*broken)
