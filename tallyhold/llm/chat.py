r"""Chat formatting with prefix targets.

Every turn becomes one segment ``### role: text </turn>\n`` whose role and text are escaped: a backslash
goes before every backslash, ``#``, ``<`` and (in a role) ``:``, so a template mark can't occur inside.

Every assistant turn becomes an example of its own: all turns before it as context, and only its reply
trainable. The examples are a table with a row for each: where its context ends in the conversation's string,
that context's digest, and the bounds of its reply. So what is stored grows with the turns, not with their
square, also in a conversation of any length; ``render_examples`` writes the texts out. ``read_back`` parses
the segments, holds each example's context against its digest, and takes the replies by the examples' bounds.

Rows of a conversation are ordered by turn (null first), then role and text; a null role or text counts
as empty, a null conv_id is a conversation like any other, repeated rows are turns like any other, and
other columns are dropped. Ids are exact over the whole range of 64 bits; empty tables give empty ones. One pass
over sorted rows keeps a few counters and digests, never a conversation, so one of any length, or a table of null
ids alone, needs time in one task but no memory: a digest over a conversation's turns can't be split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
TARGET = "assistant"
SEGMENT = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#<:])" if role else r"([\\#<])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def parse(segment: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    found = SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    return unescape(found[1]), unescape(found[2])


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, segment), sorted by conversation and turn within partitions."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    segment = F.concat(F.lit(OPEN), escape(role, True), F.lit(BETWEEN), escape(text), F.lit(CLOSE))
    ordered = df.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", (role == TARGET).alias("trainable"), segment.alias("segment"))


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """Each batch's rows as tuples of Python's own values."""
    for b in batches:
        yield list(zip(*(b.column(c).to_pylist() for c in columns), strict=True))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


#: No conversation: a null id is one of its own.
NONE = object()


def expand_prefix_targets(segments: DataFrame) -> DataFrame:
    """format_turns' rows, each with its place in the conversation's string, and after an assistant turn's the row of its example.

    (conv_id, at, segment, example, context_sha256, target_start, target_end): a segment's row has no example, an example's
    row has no segment and at is where its context ends. Its text is the conversation's string up to target_end and the mark that closes the turn.
    """
    kinds = {"conv_id": pa.int64(), "at": pa.int64(), "segment": pa.string(), "example": pa.int64(), "context_sha256": pa.string(), "target_start": pa.int64(), "target_end": pa.int64()}

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, n, context = NONE, 0, 0, None
        for rows in _rows(batches, "conv_id", "segment", "trainable"):
            out = []
            for conv, segment, trainable in rows:
                if now is NONE or conv != now:
                    now, at, n, context = conv, 0, 0, hashlib.sha256()
                if trainable:
                    begin = at + len(OPEN) + len(TARGET) + len(BETWEEN)
                    out.append((conv, at, None, n, context.hexdigest(), begin, at + len(segment) - len(CLOSE)))
                    n += 1
                out.append((conv, at, segment, None, None, None, None))
                context.update(segment.encode("utf-8", "surrogatepass"))
                at += len(segment)
            yield _batch(out, kinds)

    return segments.mapInArrow(expand, "conv_id long, at long, segment string, example long, context_sha256 string, target_start long, target_end long")


def segments_of(expanded: DataFrame) -> DataFrame:
    return expanded.filter("segment IS NOT NULL").select("conv_id", "at", "segment")


def examples_of(expanded: DataFrame) -> DataFrame:
    """One row for each assistant turn: (conv_id, example, context_chars, context_sha256, target_start, target_end)."""
    return expanded.filter("example IS NOT NULL").select("conv_id", "example", F.col("at").alias("context_chars"), "context_sha256", "target_start", "target_end")


def render_examples(segments: DataFrame) -> DataFrame:
    """The examples of format_turns' rows written out, for training files: (conv_id, example, text, target_start, target_end). Holds one conversation's prefix at a time."""
    kinds = {"conv_id": pa.int64(), "example": pa.int64(), "text": pa.string(), "target_start": pa.int64(), "target_end": pa.int64()}

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, n = NONE, "", 0
        for rows in _rows(batches, "conv_id", "segment", "trainable"):
            for conv, segment, trainable in rows:
                if now is NONE or conv != now:
                    now, text, n = conv, "", 0
                begin = len(text) + len(OPEN) + len(TARGET) + len(BETWEEN)
                text += segment
                if trainable:
                    yield _batch([(conv, n, text, begin, len(text) - len(CLOSE))], kinds)
                    n += 1

    return segments.mapInArrow(render, "conv_id long, example long, text string, target_start long, target_end long")


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Parses segments_of's rows, and digests each conversation's turns and what the examples' loss masks cover."""
    none = lambda kind: F.lit(None).cast(kind)
    both = segments.select("conv_id", "at", F.lit(1).alias("tag"), "segment", none("string").alias("context_sha256"), none("long").alias("target_start"), none("long").alias("target_end"))
    both = both.unionByName(examples.select("conv_id", F.col("context_chars").alias("at"), F.lit(0).alias("tag"), none("string").alias("segment"), "context_sha256", "target_start", "target_end"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "tag")
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_examples": pa.int64(), "expanded_chars": pa.int64()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = NONE
        close = lambda: (now, turns, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), size, examples, expanded)
        for rows in _rows(batches, "conv_id", "at", "tag", "segment", "context_sha256", "target_start", "target_end"):
            out = []
            for conv, at, tag, segment, context, start, end in rows:
                if now is NONE or conv != now:
                    if now is not NONE:
                        out.append(close())
                    now, turns, loss, size, examples, expanded, target = conv, 0, 0, 0, 0, 0, None
                    turns_hash, loss_hash, string = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                if tag == 0:
                    if at != size or context != string.hexdigest():
                        raise ValueError(f"an example's context is not what comes before it in conversation {conv}")
                    target = (start, end)
                    continue
                role, text = parse(segment)
                turns += 1
                turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                string.update(segment.encode("utf-8", "surrogatepass"))
                size += len(segment)
                if target is not None:
                    reply = unescape(segment[target[0] - at : target[1] - at])
                    loss += len(reply)
                    loss_hash.update(reply.encode("utf-8", "surrogatepass"))
                    examples, expanded, target = examples + 1, expanded + size, None
            yield _batch(out, kinds)
        if now is not NONE:
            yield _batch([close()], kinds)

    return ordered.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long")


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, TARGET, hard)], "conv_id long, turn long, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    expanded = common.written(expand_prefix_targets(format_turns(turns)), "chat")
    return read_back(segments_of(expanded), examples_of(expanded))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(role) + length(text) + 15
    + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars FROM t
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_examples,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM r GROUP BY conv_id
"""
