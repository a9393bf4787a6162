"""Conversations as training windows: a template, spans of turns within a budget of tokens, and a mask of what is learned.

A turn is written `### role: text</turn>` and a line feed. Inside texts a backslash stands before every backslash, before
every `#` that follows a `#` and before `/turn>` after `<`; inside roles also before a space that follows a colon. So
neither `##` nor `</turn>` ever stands in a text, and taking a character for each backslash and the one after it gives the
text back.

A window holds the conversation's system turn (its first turn, if that is one), repeated where the window doesn't begin
with it, then at most `history` tokens of the turns before, repeated, then new turns: as many as fit `budget`, one at
least. Turns are never cut, so a turn that is longer than the budget makes a window that exceeds it. A system turn of more
than half the budget isn't repeated, so that what is written stays in proportion to what is read. Each turn is new in one
window; only texts of new assistant turns are targets, given as spans of code points of the window's text.

Spans of turns are chosen by prefix sums of tokens. These are taken over conversations of any length; each conversation is
cut where its sum passes a multiple of `segment` tokens, windows begin anew at a cut, and a segment (of bounded length) is
cut into windows where its rows lie, with the history before it. No task holds a whole conversation.

Null texts and roles are empty; rows of a null conversation are one conversation; turns stand in the order of `turn`, nulls
first, then of role and text; repeated rows are turns of their own. Other columns are left out; no rows, no windows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.bpe import batches
from muster.llm.hf_tokens import MemoTokenizer, read_tokenizer
from muster.llm.places import matched, placed
from muster.llm.tables import load, written

END, SYSTEM, TARGET = "</turn>\n", "system", "assistant"
WINDOWS = "conv_id bigint, first_turn bigint, repeated int, tokens bigint, text string, loss array<struct<first:int,last:int>>"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"\\|(?<=#)#|(?<=<)/turn>" + (r"|(?<=:) " if role else ""), r"\\$0")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a window's turns, as they were before escaping."""
    for piece in text.split(END)[:-1]:
        role, _, body = piece[len("### ") :].partition(": ")
        yield unescape(role), unescape(body)


def _counted(tokenizer: MemoTokenizer, rows: DataFrame) -> DataFrame:
    """`rows` with the number of tokens of the formatted turn."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            text, counts = batch.schema.get_field_index("piece"), []
            for _, texts in batches(iter([pa.RecordBatch.from_arrays([batch.column(text), batch.column(text)], names=["k", "v"])])):
                counts += [len(ids) for ids in shared.value.encode_batch(texts)]
            yield batch.append_column("tokens", pa.array(counts, pa.int64()))

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", tokens bigint")


def windows_of(turns: list[tuple[int, int, str, str]], first_new: int, system: tuple[int, str] | None, budget: int, history: int) -> Iterator[tuple]:
    """Windows (first new turn, repeated pieces, tokens, text, loss) over consecutive turns (place, tokens, role, piece), of
    which those from `first_new` on are new; `system`: tokens and piece of the conversation's system turn."""
    sums = [0]
    for _, tokens, _, _ in turns:
        sums.append(sums[-1] + tokens)
    at = first_new
    while at < len(turns):
        kept = [] if system is None or turns[at][0] == 0 or 2 * system[0] > budget else [system]
        room = budget - sum(t for t, _ in kept) - turns[at][1]
        # as far back as history and the first new turn allow, but not to the system turn, which is there already
        back = bisect.bisect_left(sums, sums[at] - max(0, min(history, room)), 0, at)
        while back < at and system is not None and turns[back][0] == 0:
            back += 1
        room = budget - sum(t for t, _ in kept) - (sums[at] - sums[back])
        end = max(at + 1, bisect.bisect_right(sums, sums[at] + room) - 1)
        pieces, loss, length = [p for _, p in kept] + [t[3] for t in turns[back:at]], [], 0
        repeated, length = len(pieces), sum(map(len, pieces))
        for _, _, role, piece in turns[at:end]:
            if role == TARGET:
                loss.append({"first": length + len("### ") + len(role) + len(": "), "last": length + len(piece) - len(END)})
            pieces.append(piece)
            length += len(piece)
        yield turns[at][0], repeated, sum(t for t, _ in kept) + sums[end] - sums[back], "".join(pieces), loss
        at = end


def _windows(budget: int, history: int):
    names = [f.split(" ")[0] for f in WINDOWS.replace("struct<first:int,last:int>", "").split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, key, turns, first_new, system, size = [], None, [], 0, None, 0
        for batch in parts:
            for conv, segment, place, tokens, role, piece, new, s_tokens, s_piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, segment):
                    found += [(key[0], *w) for w in windows_of(turns, first_new, system, budget, history)] if turns else []
                    key, turns, first_new, system = (conv, segment), [], 0, None if s_piece is None else (s_tokens, s_piece)
                turns.append((place, tokens, role, piece))
                first_new += not new
                size += len(piece)
                if size > 4_000_000:
                    if found:
                        yield table(found)
                    found, size = [], 0
        found += [(key[0], *w) for w in windows_of(turns, first_new, system, budget, history)] if turns else []
        if found:
            yield table(found)

    return run


def windows(rows: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512, segment: int = 131_072, special_as_text: bool = True) -> DataFrame:
    """The windows of all conversations (conv_id, turn, role, text): conv_id, first_turn (the place of the first new turn),
    repeated (turns that stand before it), tokens, text, loss."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("plain_role"), escape(role, True).alias("role"), escape(text).alias("body"))
    turns = turns.select("conv_id", "turn", "plain_role", "role", F.concat(F.lit("### "), "role", F.lit(": "), "body", F.lit(END)).alias("piece"))
    counted = _counted(MemoTokenizer(tokenizer, "byte", special_as_text=special_as_text), turns)
    at = placed(counted, ["conv_id"], ["turn", "role", "piece"], ["tokens"]).withColumn("segment", F.floor(F.col("tokens_before") / segment).cast("bigint"))
    at = written(at.select("conv_id", "segment", "place", "tokens", "tokens_before", "role", "plain_role", "piece"), "turns")
    # the last turns of a segment are the history of the next one, where there is one
    goes_on = at.where("segment > 0").select("conv_id", (F.col("segment") - 1).alias("segment")).distinct().withColumn("goes_on", F.lit(True))
    tail = matched(at.where((F.col("segment") + 1) * segment - F.col("tokens_before") <= history), goes_on, ["conv_id", "segment"])
    both = at.withColumn("new", F.lit(True)).unionByName(tail.drop("goes_on").withColumns({"segment": F.col("segment") + 1, "new": F.lit(False)}))
    system = at.where((F.col("place") == 0) & (F.col("plain_role") == SYSTEM)).select("conv_id", F.col("tokens").alias("system_tokens"), F.col("piece").alias("system_piece"))
    with_system = _left(both, system).select("conv_id", "segment", "place", "tokens", "role", "piece", "new", "system_tokens", "system_piece")
    sorted_rows = with_system.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    return sorted_rows.mapInArrow(_windows(budget, history), WINDOWS)


def _left(rows: DataFrame, system: DataFrame) -> DataFrame:
    other = system.withColumnRenamed("conv_id", "_conv")
    return rows.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation from its windows in order: number and digest of turns, length and digest of targets."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    key, state, out = None, None, []
    for batch in parts:
        for conv, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != key:
                if state is not None:
                    out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in list(parse(text))[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in loss:
                target = unescape(text[span["first"] : span["last"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        if len(out) > 10_000:
            yield table(out)
            out = []
    if state is not None:
        out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
    if out:
        yield table(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say of each conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest
    over a conversation is taken in one task, window by window, without holding the conversation."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn").select("conv_id", "repeated", "text", "loss")
    return rows.mapInArrow(_read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one (-7) that holds the template's own marks."""
    import public_tokenizers

    said = r"\### Assistant: </turn> ok"
    marks = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marks)
    return read_back(written(windows(rows, read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))), "windows"))
