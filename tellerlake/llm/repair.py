"""Repair of conversation structure by iterative-deepening A*.

The rows of a conversation are edited, at least cost, into an optional system row and then pairs of a user and an assistant row: a row is deleted, kept
or given another role, and empty rows are inserted. The search goes depth first in the order of the edits' initials under a cost bound; states that
failed are remembered with the cost they need at least, and when nothing is found the bound rises to the least cost that passed it. The first accepting
path is therefore the cheapest, and of equally cheap ones the first by its initials.

A long conversation is cut into blocks of rows, which are searched on their own, in any task, for each pair of a state before and a state after; the
cheapest chain of blocks is put together afterwards. Every block's edits end with that of a row, so the first chain by initials takes the first block's
least path that some cheapest chain continues, then the next one's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellerlake.llm.common import written

SPACE = "\t\n\x0b\x0c\r "
BLOCK_ROWS = 64
DELETE, INSERT, RETOLD, TRUNCATED = 2, 5, 1, 5

#: States: nothing yet, after the system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (BEGIN, ASSISTANT)
#: The role that an inserted row or one with a new role gets in each state, and the state it leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id`, `turn`, `role`, `text`, `gone`, `copy`: the rows after damage by crc32(`conv:turn`) mod 20 (nulls: one space).

    0 drops the row (it stays here as `gone`, without text), 1 empties the text, 2 takes out its `.`, `!` and `?`, 3 repeats the row (`copy` 0 and 1),
    4 makes the role user."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(c(conv), F.lit(":"), c(turn))) % 20
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), c(role).alias("role"), c(text).alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (F.col("kind") == 0).alias("gone"), "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with `place` (from 1 within the conversation; those that are gone come last), `code` and `illegal`.

    Order: turn (nulls first), role, text. `code` is `x` for blank rows (`b` in `fault`) and repeated ones (`d`), else the role's initial if it is s, u
    or a, else `o`, in capitals for truncated rows (`t`). `illegal` marks a row whose initial may not follow the one before."""
    within = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text", "copy")
    initial = F.substring("role", 1, 1)
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    rows = rows.withColumn("place", F.row_number().over(within)).withColumn("before", F.lag(initial).over(within))
    rows = rows.withColumn("illegal", ~F.col("gone") & F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au"))
    earlier = Window.partitionBy("conv_id", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).orderBy("place")
    fault = F.when(F.col("gone"), "g").when(end == "", "b").when(F.row_number().over(earlier) > 1, "d").when(~end.isin(".", "!", "?"), "t").otherwise("")
    rows = rows.withColumn("fault", fault).withColumn("initial", F.when(initial.isin(*INITIALS), initial).otherwise("o"))
    code = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return rows.select("conv_id", "turn", "place", "role", "text", "gone", "fault", "illegal", code.alias("code"))


def least_costs(codes: str) -> list[int]:
    """What no way through the rest of the codes can save, from each row on: deletions and new roles that are due, and an edit for every second row in a
    run of equal roles (rows marked x stand between no others; truncated ones end a run)."""
    out, run, role = [0], 0, ""
    for code in reversed(codes):
        due = DELETE if code == "x" else RETOLD if code == "o" else DELETE if code.isupper() else 0
        if code in "ua":
            run, role = (run + 1, role) if code == role else (1, code)
            due = RETOLD * (run % 2 == 0)
        elif code != "x":
            role = ""
        out.append(out[-1] + due)
    return out[::-1]


def search(codes: str, entry: int, goals: tuple[int, ...], trailing: bool) -> tuple[int, str, int] | None:
    """Cost, audit and last state of the first cheapest way through the codes from `entry` to one of the goals, or None. Rows are inserted before rows,
    and after the last one only if `trailing`."""
    n, rest = len(codes), least_costs(codes)
    most = DELETE * n + 3 * INSERT + 1  # all rows deleted and any state reached by insertions costs less
    path: list[str] = []
    needed: dict[int, int] = {}  # what a failed state needs at least

    def go(i: int, state: int, left: int) -> int:
        """0 if a goal is reached at no more than `left` (the path then holds the edits), else what is missing at least."""
        nonlocal end
        need = needed.get(i << 2 | state, rest[i])
        if left < need:
            return need - left
        if i == n and state in goals:
            end = state
            return 0
        if i == n and not trailing:
            return most
        code = codes[i] if i < n else "x"
        extra = TRUNCATED if code.isupper() else 0
        own = INITIALS.get(code.lower(), BEGIN)
        steps = [("D", i + 1, state, DELETE)] if i < n else []
        steps.append(("I", i, NEXT[state], INSERT))
        if code != "x":
            if own == NEXT[state] or own == SYSTEM and state == BEGIN:
                steps.append(("K", i + 1, own, extra))
            steps.append(("R", i + 1, NEXT[state], RETOLD + extra))
        missing = most
        for edit, at, to, cost in steps:
            path.append(edit)
            short = go(at, to, left - cost)
            if not short:
                return 0
            path.pop()
            missing = min(missing, short)
        needed[i << 2 | state] = left + missing
        return missing

    bound, end = rest[0], entry
    while bound < most:
        missing = go(0, entry, bound)
        if not missing:
            return bound, "".join(path), end
        bound += missing
    return None


def ways(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block. The last block's ways end in an accepting state, all as BEGIN."""
    n, out = len(codes), []
    for entry in (BEGIN,) if first else (BEGIN, SYSTEM, USER, ASSISTANT):
        for goal in (BEGIN,) if last else (USER, ASSISTANT):
            found = search(codes, entry, ACCEPTED if last else (goal,), last)
            if found:
                out.append((entry, goal, *found[:2]))
        if not last and entry in (BEGIN, SYSTEM):
            out.append((entry, entry, DELETE * n, "D" * n))  # no other way stays there
    kept = [(DELETE * (n - 1) + TRUNCATED * code.isupper(), "D" * i + "K" + "D" * (n - i - 1)) for i, code in enumerate(codes) if code in "sS"]
    if kept and not last:
        out.append((BEGIN, SYSTEM, *min(kept)))  # nor leads there
    return out


def chained(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of the first cheapest chain of the blocks' ways."""
    left = {BEGIN: 0}  # cost from the state to the end, after the block
    costs = [left]
    for block in reversed(blocks):
        here: dict[int, int] = {}
        for entry, goal, cost, _ in block:
            if goal in left:
                here[entry] = min(here.get(entry, cost + left[goal]), cost + left[goal])
        costs.append(left := here)
    costs.reverse()
    state, audits = BEGIN, []
    for block, after, total in zip(blocks, costs[1:], costs[:-1], strict=True):
        audit, state = min((audit, goal) for entry, goal, cost, audit in block if entry == state and goal in after and cost + after[goal] == total[state])
        audits.append(audit)
    return costs[0][BEGIN], "".join(audits)


def report(rows: DataFrame) -> DataFrame:
    """`conv_id`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit` of every conversation of `ordered` rows."""
    alive = ~F.col("gone")
    count = lambda c: F.count(F.when(c, 1))
    turn = F.when(alive, F.col("turn"))
    stats = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault") == k).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        count(F.col("illegal")).alias("illegal"), count(alive).alias("n"))
    cut = rows.where(alive).groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK_ROWS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("codes"))  # BLOCK_ROWS at most
    stats = written(stats, "report")
    cut = cut.join(stats.select(F.col("conv_id").alias("of"), "n"), F.col("conv_id").eqNullSafe(F.col("of")))
    cut = cut.select("conv_id", "block", F.concat_ws("", "codes.code").alias("codes"), (F.col("block") == F.floor((F.col("n") - 1) / BLOCK_ROWS)).alias("last"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ways(codes, block == 0, last) for block, codes, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            lists = [pa.array([[w[i] for w in m] for m in made], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *lists], names=["conv_id", "block", "entry", "goal", "cost", "audit"])

    found = cut.mapInArrow(find, f"conv_id {kind}, block long, entry array<int>, goal array<int>, cost array<long>, audit array<string>")
    found = found.select("conv_id", "block", F.arrays_zip("entry", "goal", "cost", "audit").alias("ways")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "ways"))).alias("blocks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chained([[tuple(w[k] for k in ("entry", "goal", "cost", "audit")) for w in b["ways"]] for b in blocks]) for blocks in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([c for c, _ in made], pa.int64()), pa.array([a for _, a in made], pa.string())], names=["of", "cost", "audit"])

    chains = found.mapInArrow(join, f"of {kind}, cost long, audit string")
    return stats.join(chains, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*(c for c in stats.columns if c != "n"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))


def in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit (place 0) and rows, together and in order in one partition."""
    heads = found.select("conv_id", F.lit(0).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return heads.unionByName(rows.where("not gone").select("conv_id", "place", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str] | tuple[object]]:
    """(conv_id) at the begin of each conversation, then (conv_id, role, text) of its repaired rows. One row and one audit are held at a time."""
    audit, at, state, conv = "", 0, BEGIN, None

    def inserted() -> Iterator[tuple[object, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, NAMES[state], ""

    for batch in batches:
        for key, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                yield from inserted()
                audit, at, state, conv = text, 0, BEGIN, key
                yield (conv,)
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = INITIALS[role[0]]
                yield conv, role, text
            elif edit == "R":
                state = NEXT[state]
                yield conv, NAMES[state], text
    yield from inserted()


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`conv_id`, `place` (from 1), `role`, `text` of the repaired conversations, by `ordered` rows and their `report`."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        key, out, place = to_arrow_type(kind), [], 0
        pack = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (key, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])
        for row in edited(batches):
            if len(row) == 1:
                place = 0
                continue
            place += 1
            out.append((row[0], place, row[1], row[2]))
            if len(out) >= 1024:
                yield pack()
                out = []
        if out:
            yield pack()

    return in_order(rows, found).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`conv_id`, `repaired_sha256`: SHA-256 of the repaired `role:text` lines, joined by line feeds, of every conversation; texts are streamed."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        key, out, digest, any_row = to_arrow_type(kind), [], None, False
        for row in edited(batches):
            if len(row) == 1:
                if digest is not None:
                    out[-1] = (out[-1][0], digest.hexdigest())
                out.append((row[0], ""))
                digest, any_row = hashlib.sha256(), False
                continue
            digest.update(f"{chr(10) if any_row else ''}{row[1]}:{row[2]}".encode())
            any_row = True
            if len(out) > 4096:
                yield pa.record_batch([pa.array([k for k, _ in out[:-1]], key), pa.array([d for _, d in out[:-1]], pa.string())], names=["conv_id", "repaired_sha256"])
                del out[:-1]
        if out:
            out[-1] = (out[-1][0], digest.hexdigest())
            yield pa.record_batch([pa.array([k for k, _ in out], key), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])

    return in_order(rows, found).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")
