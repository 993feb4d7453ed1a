"""Chat formatting by prefix-target expansion.

Each assistant turn is an example of its own: all turns before it are the context, its text alone is trainable. A conversation is a row of
pieces, one for each turn; an example is the range of pieces up to its target and the span of the target in its piece. ``examples`` lists these
ranges; ``parts`` writes whole texts out, those of long conversations in several rows; ``expanded`` gives each in one row, for conversations short enough.

A piece is ``<|role|>`` + text + ``<|end|>``. In texts and roles ``\\``, ``<``, ``[`` and ``|`` are escaped as ``\\\\``, ``\\l``, ``\\b`` and ``\\p``,
so no control string of this template or of others, such as ``</s>`` or ``[INST]``, survives, and the text can be had back.

Defined results: turns go by ``turn`` (NULL first), then role and text, so ties and repeated rows have one order and all stay; NULL text and role are empty; NULL
conversation ids are one conversation; a conversation without assistant turns has no example and nothing to train on; an empty table gives an empty
result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import stored

# The template.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ASSISTANT = "assistant"
#: Characters of a conversation after which an example's text goes on in another part.
PART_CHARS = 65_536
#: Kinds of rows that are read back.
PIECE, TARGET, CONTEXT = 0, 1, 2
_PIECE = re.compile(r"<\|([^<\[|]*)\|>([^<\[|]*)<\|end\|>", re.S)
_BACK = re.compile(r"\\(.)", re.S)
_CODES = {"\\": "\\", "l": "<", "b": "[", "p": "|"}


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for raw, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _CODES[m[1]], text)


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, piece, loss_start, loss_end) of ``turns`` (conv_id, turn, role, text). The loss span is in characters of the piece; empty but in targets."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    start = F.length(head)
    target = F.col("role") == ASSISTANT
    return turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(head, text, F.lit(END)).alias("piece"),
        F.when(target, start).otherwise(0).alias("loss_start"),
        F.when(target, start + F.length(text)).otherwise(0).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: its context is the first ``n_context`` pieces of the conversation, ``context_chars`` characters."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = formatted.withColumn("n_context", F.row_number().over(before) - 1).withColumn("context_chars", F.sum(F.length("piece")).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.filter(F.col("role") == ASSISTANT).select("conv_id", "turn", "n_context", F.coalesce("context_chars", F.lit(0)).cast("long").alias("context_chars"), F.col("piece").alias("target"), "loss_start", "loss_end")


def expanded(formatted: DataFrame) -> DataFrame:
    """Whole examples: (conv_id, turn, text, loss_start, loss_end). The contexts are copied, so size grows with the square of a conversation's turns."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = formatted.withColumn("context", F.array_join(F.collect_list("piece").over(before), ""))
    at = F.length("context")
    return rows.filter(F.col("role") == ASSISTANT).select("conv_id", "turn", F.concat("context", "piece").alias("text"), (at + F.col("loss_start")).alias("loss_start"), (at + F.col("loss_end")).alias("loss_end"))


def numbered(formatted: DataFrame) -> DataFrame:
    """``formatted`` with each piece's number in its conversation, and the block of ``PART_CHARS`` characters in which it starts."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = formatted.withColumn("n_before", F.row_number().over(order) - 1).withColumn("block", F.floor(before / PART_CHARS).cast("long"))
    rows = rows.withColumn("last_block", F.max("block").over(Window.partitionBy("conv_id")))
    return rows.select("conv_id", "turn", "n_before", "block", "last_block", "piece", "loss_start", "loss_end", (F.col("role") == ASSISTANT).alias("target"))


def parts(rows: DataFrame) -> DataFrame:
    """Whole examples of ``rows`` (as ``numbered`` gives them) in parts: (conv_id, turn, n_context, part, text, context_end, loss_start, loss_end).

    An example's parts, in order, are its text as ``expanded`` has it. All but the last are whole blocks of the conversation, context alone; the last holds
    the target, from ``context_end`` on, and the loss span. Contexts are copied, but no row is longer than a block and two pieces.
    """
    own = Window.partitionBy("conv_id", "block").orderBy("n_before").rowsBetween(Window.unboundedPreceding, -1)
    at = F.length("context")
    last = rows.withColumn("context", F.array_join(F.collect_list("piece").over(own), "")).filter("target")
    last = last.select("conv_id", "turn", F.col("n_before").alias("n_context"), F.col("block").alias("part"), F.concat("context", "piece").alias("text"), at.alias("context_end"), (at + F.col("loss_start")).alias("loss_start"), (at + F.col("loss_end")).alias("loss_end"))
    long = rows.filter("last_block > 0")
    texts = long.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_before", "piece"))), lambda x: x["piece"]), "").alias("block_text"))
    wanted = long.filter("target and block > 0").select("conv_id", "turn", F.col("n_before").alias("n_context"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("part"))
    # An example meets a block by both keys, so that a long conversation's copies are dealt over as many tasks as it has blocks.
    whole = wanted.join(texts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_b")))
    return last.unionByName(whole.select("conv_id", "turn", "n_context", "part", F.col("block_text").alias("text"), F.length("block_text").alias("context_end"), F.lit(0).alias("loss_start"), F.lit(0).alias("loss_end")))


def digests(formatted: DataFrame) -> DataFrame:
    """Write pieces and whole examples, read both back: turns and digests of all texts from the pieces; digests of what is under the loss spans, number and characters of context from the examples' rows.

    A conversation's rows are hashed in one stream: its pieces, then its targets.
    """
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("context_chars", pa.int64())])
    types = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, context_chars long"

    def run(batches):
        now, state = None, None
        out: list[dict] = []

        def done():
            n, turns, chars, loss, size, targets, context = state
            return {"conv_id": now[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size, "n_examples": targets, "context_chars": context}

        for b in batches:
            for conv, kind, said, chars in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    if state:
                        out.append(done())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                said = said.as_py()
                if kind == PIECE:
                    role, text = _PIECE.fullmatch(said).groups()
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    state[4] += len(said)
                    continue
                state[6] += chars
                if kind == TARGET:
                    trained = unescape(said)
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                    state[5] += 1
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
        if state:
            yield pa.RecordBatch.from_pylist([done()], kinds)

    rows = stored(numbered(formatted.withColumn("conv_id", F.col("conv_id").cast("long"))))
    made = stored(parts(rows), compression="zstd")
    pieces_ = rows.select("conv_id", F.lit(PIECE).alias("kind"), F.col("n_before").alias("at"), F.col("piece").alias("said"), F.lit(0).cast("long").alias("chars"))
    ends = made.filter("loss_start > 0")
    targets = ends.select("conv_id", F.lit(TARGET).alias("kind"), F.col("n_context").alias("at"), F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")).alias("said"), F.col("context_end").cast("long").alias("chars"))
    contexts = made.filter("loss_start = 0").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("chars")).select("conv_id", F.lit(CONTEXT).alias("kind"), F.lit(0).alias("at"), F.lit("").alias("said"), "chars")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = pieces_.unionByName(targets).unionByName(contexts)
    return back.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "at").select("conv_id", "kind", "said", "chars").mapInArrow(run, types)
