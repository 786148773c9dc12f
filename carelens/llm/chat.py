"""Chat formatting by grammar round trip (operator 4).

Grammar:  conversation = { turn } ;  turn = "### " role ": " body " </turn>" LF.
A control string in a body ("###" or "</turn>") carries one more backslash than
in its text; a role escapes backslash, colon and line feed.  Every turn is
rendered plainly, reparsed by the deterministic parser and compared with its
source; where they differ the conflicting content is escaped, until identical.

Scale: turns are rendered and verified one by one before anything is grouped.
The order within a conversation comes from one shuffle on conv_id and a sort;
digests are then taken turn by turn in a stream, so the largest conversation
costs memory for one turn, not for its whole text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HEAD, COLON, END = "### ", ": ", " </turn>\n"
CONTROL = re.compile(r"(\\*)(###|</turn>)")
ROLE = re.compile(r"((?:[^\\:\n]|\\[\\cn])*): ")
ROLE_ESCAPES = {"\\": "\\\\", ":": "\\c", "\n": "\\n"}
TRAINED = "assistant"
EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def _role(role: str) -> str:
    return re.sub(r"[\\:\n]", lambda m: ROLE_ESCAPES[m[0]], role)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, body start, body end) of every turn; ValueError on text that
    the grammar does not produce."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at) or not (m := ROLE.match(formatted, at + len(HEAD))):
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\([\\cn])", lambda x: {"\\": "\\", "c": ":", "n": "\n"}[x[1]], m[1])
        start = m.end()
        for c in CONTROL.finditer(formatted, start):
            if not c[1]:  # a control string without a backslash: only the end may be one
                if not formatted.startswith(END, c.start() - 1) or c.start() - 1 < start:
                    raise ValueError(f"unescaped control string at {c.start()}")
                end = c.start() - 1
                break
        else:
            raise ValueError("turn without end")
        out.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(END)
    return out


def render(role: str | None, text: str | None) -> str:
    """One turn, plain if it reads back as its source, else escaped."""
    role, text = role or "", text or ""
    for body in (text, escape(text)):
        turn = HEAD + _role(role) + COLON + body + END
        try:
            back = parse(turn)
        except ValueError:
            continue
        if len(back) == 1 and back[0][:2] == (role, text):
            return turn
    raise AssertionError("an escaped turn reads back as its source")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, body_start, body_end (code points within the
    turn), trained (the body is under the loss mask) of every row.

    A conversation's text is its rows' ``formatted`` in order of turn, then role
    and text (ties).  Null text or role is empty; a null turn comes first and a
    null conv_id is a conversation; repeated rows are turns of their own; other
    columns are not read; an empty table gives no rows.
    """
    src = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                               F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType(src.schema.fields[:4] + T.StructType.fromDDL(
        "formatted string, body_start int, body_end int, trained boolean").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            made = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            read = [parse(m)[0] for m in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(i).cast(arrow.field(i).type) for i in range(4)]
                + [pa.array(made, pa.string()), pa.array([r[2] for r in read], pa.int32()),
                   pa.array([r[3] for r in read], pa.int32()), pa.array([r[0] == TRAINED for r in read])], schema=arrow)

    return src.mapInArrow(run, schema)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Digest:
    """Running digests of one conversation, fed with formatted turns in order."""

    def __init__(self):
        self.turns = self.chars = self.loss = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str):
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8"))
            if role == TRAINED:
                self.loss += len(text)
                self.masked.update(text.encode("utf-8"))
        self.chars += len(formatted)

    def row(self):
        return self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_turns`` output."""
    schema = T.StructType.fromDDL(DIGESTS)
    arrow = to_arrow_schema(schema)
    ordered = (turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text", "formatted")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
               .select("conv_id", "formatted"))

    def run(batches):
        key, digest = None, None
        for b in batches:
            done = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest is None or k != key:
                    if digest:
                        done.append((key, *digest.row()))
                    key, digest = k, _Digest()
                digest.add(t)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if digest:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((key, *digest.row()), arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts look like markup."""
    spark = conversations.sparkSession
    cols = conversations.select("conv_id", "turn", "role", "text")
    return cols.union(spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string"))
