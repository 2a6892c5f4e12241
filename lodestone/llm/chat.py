"""Chat formatting into budgeted windows.

Prefix sums of turn tokens place every turn on a line; a conversation's line is cut at multiples of a stride, half of
what the system turn leaves of the budget, and a turn belongs to the span in which it starts, so spans are turn-aligned
and each can be built without the others. A turn longer than the stride, which only the last of a span can be, has a
window of its own, so no window of several turns exceeds the budget. A window is the system turn (if the conversation begins with one), as much of the preceding span's
tail as the budget leaves (the history), then the span itself. Only assistant turns of the span itself are under
the loss mask: repeated targets are masked, so each assistant text is trained on once.

Turns are dealt by range of (conversation, turn), so that one huge conversation is spread over many tasks; only
the small (conversation, partition) totals are put in sequence.

Template: ``<opening marker>text</s>`` per turn, with ``[SYS]``, ``[INST]``, ``[ASST]`` for the known roles and
``[ROLE:name]`` for others. Inside texts and role names a backslash stands before each ``\\``, ``[``, ``]`` and
``<``, so no control string can arise there and every text is recovered exactly.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import buckets_for, materialise, table, text_or_empty
from lodestone.llm.token_files import byte_tokens

MARKERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[ASST]"}
END = "</s>"
ESCAPED = re.compile(r"[\\\[\]<]")
TURN = re.compile(r"\[(SYS|INST|ASST|ROLE:((?:[^\\\]]|\\.)*))\]((?:[^\\<]|\\.)*)</s>", re.S)


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int]:
    """A formatted turn and where its text begins in it."""
    head = MARKERS.get(role) or f"[ROLE:{escape(role)}]"
    return f"{head}{escape(text)}{END}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn in a formatted window."""
    names, out, at = {v[1:-1]: k for k, v in MARKERS.items()}, [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted window")
        out.append((names[m[1]] if m[2] is None else unescape(m[2]), unescape(m[3])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted window")
    return out


def turn_tokens(texts: list[str]) -> list[int]:
    """Tokens of each formatted turn, by the public byte-level vocabulary; at least one."""
    return [len(raw) // 4 for raw in byte_tokens(texts)]


def chat_windows(
    turns: DataFrame, budget: int = 2048, history: int = 512, count_tokens=turn_tokens,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Rows (conv, window, text, loss array<struct<start,end>>, repeated, n_tokens): the formatted windows.

    Windows of a conversation are numbered upwards, not always in steps of one. ``loss`` holds code-point ranges
    of ``text`` under the mask; the first ``repeated`` turns of a window repeat earlier ones. No turn is cut, so only
    a turn that doesn't fit with the system turn makes its window exceed the budget. A system turn of over half the
    budget is not repeated: it is a turn like others.
    Null text and role count as empty; turns go by (turn, role, text), nulls first; equal turns are kept each;
    null conversations form one conversation. No turns give no windows.
    """
    t = turns.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text")
    )
    kind, turn_kind = t.schema["c"].dataType.simpleString(), t.schema["t"].dataType.simpleString()

    def lay(batches):
        part, last, at, pos = TaskContext.get().partitionId(), object(), 0, 0
        for rows in batches:
            made = [render(r, x)[0] for r, x in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
            n, before, place = count_tokens(made), [], []
            for c, k in zip(rows.column(0).to_pylist(), n, strict=True):
                if c != last:
                    last, at, pos = c, 0, 0
                before.append(at), place.append(pos)
                at, pos = at + k, pos + 1
            extra = [pa.array(np.full(rows.num_rows, part)), pa.array(place, pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=["c", "t", "role", "text", "part", "pos", "before", "n"])

    parts = buckets_for(t, "text", 4 << 20)
    laid = materialise(
        t.repartitionByRange(parts, "c", "t", "role").sortWithinPartitions("c", "t", "role", "text").mapInArrow(
            lay, f"c {kind}, t {turn_kind}, role string, text string, part long, pos long, before long, n long"
        ),
        "turns",
    )
    first = F.col("pos") == 0
    totals = laid.groupBy("c", "part").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"),
        F.max(F.when(first, F.struct("role", "text", "n"))).alias("head"),
    )
    by = Window.partitionBy("c").orderBy("part")  # a row per conversation and partition
    totals = totals.select(
        F.col("c").alias("c2"), F.col("part").alias("part2"),
        (F.sum("total").over(by) - F.col("total")).alias("skip"), (F.sum("rows").over(by) - F.col("rows")).alias("above"),
        F.first("head").over(by).alias("head"),
    )
    system = (F.col("head.role") == "system") & (2 * F.col("head.n") <= budget)
    placed = (
        laid.join(totals, laid.c.eqNullSafe(totals.c2) & (laid.part == totals.part2))
        .withColumn("pos", F.col("pos") + F.col("above"))
        .withColumn("sys_n", F.when(system, F.col("head.n")).otherwise(F.lit(0)))
        .withColumn("is_head", system & (F.col("pos") == 0))
        .withColumn("at", F.when(F.col("is_head"), F.lit(0)).otherwise(F.col("before") + F.col("skip") - F.col("sys_n")))
        .withColumn("stride", F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("sys_n")) / 2)).cast("long"))
        .withColumn("span", F.expr("at div stride"))
        .withColumn("tail", ~F.col("is_head") & (F.col("n") <= history) & (F.col("at") >= (F.col("span") + 1) * F.col("stride") - history))
        .withColumn("own", F.when(~F.col("is_head") & (F.col("n") > F.col("stride")), F.expr("2 * span + 1")).otherwise(F.expr("2 * span")))
        .withColumn("window", F.explode(F.when(F.col("tail") & (F.col("own") == 2 * F.col("span")), F.expr("array(own, own + 1, own + 2)")).otherwise(F.expr("array(own)"))))
    )
    item = F.struct("pos", "role", "text", "n", (F.col("window") == F.col("own")).alias("own"))
    grouped = placed.groupBy("c", "window").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.max(F.when(system, F.struct("head.text", "head.n"))).alias("sys"),
    ).filter(F.exists("items", lambda x: x["own"]))

    def build(batches):
        for rows in batches:
            out = []
            for c, window, items, head in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                own = [x for x in items if x["own"]]
                past, left = [], budget - (head["n"] if head else 0) - sum(x["n"] for x in own)
                for x in reversed([x for x in items if not x["own"]]):
                    if x["n"] > left or len(past) and past[0]["pos"] != x["pos"] + 1:
                        break
                    past.insert(0, x)
                    left -= x["n"]
                if past and past[-1]["pos"] != own[0]["pos"] - 1:  # history adjoins the span
                    past = []
                lead = [{"role": "system", "text": head["text"], "n": head["n"], "own": False}] if head and own[0]["pos"] else []
                text, at, loss, size = [], 0, [], 0
                for x in [*lead, *past, *own]:
                    made, begins = render(x["role"], x["text"])
                    if x["own"] and x["role"] == "assistant":
                        loss.append({"start": at + begins, "end": at + len(made) - len(END)})
                    text.append(made)
                    at, size = at + len(made), size + x["n"]
                out.append((c, window, "".join(text), loss, len(lead) + len(past), size))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [rows.schema.field(0).type, pa.int64(), pa.string(), span, pa.int32(), pa.int64()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[conv_col, "window", "text", "loss", "repeated", "n_tokens"])

    return grouped.mapInArrow(
        build, f"`{conv_col}` {kind}, window long, text string, loss array<struct<start: long, end: long>>, repeated int, n_tokens long"
    )


def chat_digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted windows, per conversation, as counts and SHA-256 digests.

    A digest of a whole conversation takes its windows in sequence, so one conversation's windows pass through
    one task, but as a stream: memory holds a batch of windows and the running digests.
    """
    kind = windows.schema[conv_col].dataType.simpleString()

    def run(batches):
        current, state = None, None
        names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        done: list[tuple] = []

        def close():
            done.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def flush(of):
            kinds = [of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

        for rows in batches:
            for c, text, loss, repeated in zip(*(rows.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if current != (c,):
                    if current:
                        close()
                    current, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, x in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{x}\n".encode())
                for s in loss:
                    x = unescape(text[s["start"] : s["end"]])
                    state[2] += len(x)
                    state[3].update(x.encode())
                state[4] += len(text)
                state[5] += 1
            of = rows.schema.field(0).type
            yield flush(of)
            done.clear()
        if current:
            close()
            yield flush(of)

    parts = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return windows.repartition(parts, conv_col).sortWithinPartitions(conv_col, "window").mapInArrow(
        run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    )


def op7_chat(spark, sf_dir):
    """All conversations, and one made of control strings, formatted and read back.

    Nulls, empty and long turns, repeated rows and empty tables as in ``chat_windows``.
    """
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(chat_windows(turns))
