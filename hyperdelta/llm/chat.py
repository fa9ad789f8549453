"""Chat formatting of turns made of typed content parts.

A visitor walks a turn's parts and flattens them: text is escaped, an image, a sound or a document becomes a placeholder with
a running number; what it refers to is recorded beside, with the number of tokens that a model expands it to. A turn is
`<turn ROLE>`, a line feed, its content, `</turn>` and a line feed. Inside texts a backslash stands before each backslash
and before each control string, and before <, > and backslash inside roles, so every output reads back to what went in.

Turns are formatted where they are read. Only what needs a conversation in order, such as digests, deals rows by
conversation, and then streams over sorted turns: memory holds one turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: What the template marks.
CONTROL = re.compile(r"(\\|</?turn|<(?:image|audio|document):)")
ROLE = re.compile(r"([\\<>])")
CLOSE = "</turn>\n"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass(frozen=True)
class Costs:
    """Tokens that attachments expand to: a tile of an image's pixels, a second of sound, a page of a document."""

    tile: int = 512
    tile_tokens: int = 256
    second_tokens: float = 25.0
    page_tokens: int = 1024


TYPES = ("text", "image", "audio", "document")


def _size(part: dict[str, Any], name: str) -> float:
    value = part.get(name)
    return value if value is not None and 0 < value < math.inf else 0


@dataclass
class Flattener:
    """Visits parts in order. A null part is empty. An unknown type is refused, or, given a list for them, put there: nothing goes
    missing in silence. Sizes that are missing, negative or no numbers count as 0, an image without a size as one tile."""

    costs: Costs = Costs()
    refused: list[str] | None = None
    out: list[str] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def visit(self, part: dict[str, Any] | None) -> None:
        if part is None:
            return
        method = getattr(self, f"visit_{part.get('type')}", None) if part.get("type") in TYPES else None
        if method is not None:
            method(part)
        elif self.refused is not None:
            self.refused.append(str(part.get("type")))
        else:
            raise ValueError(f"not a content part: {part!r}")

    def visit_text(self, part: dict[str, Any]) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict[str, Any]) -> None:
        tiles = -(-max(1, int(_size(part, "width"))) // self.costs.tile) * -(-max(1, int(_size(part, "height"))) // self.costs.tile)
        self._attach(part, tiles * self.costs.tile_tokens)

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach(part, -int(-_size(part, "seconds") * self.costs.second_tokens // 1))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._attach(part, int(_size(part, "pages")) * self.costs.page_tokens)

    def _attach(self, part: dict[str, Any], tokens: int) -> None:
        self.out.append(f"<{part['type']}:{len(self.attachments)}>")
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict[str, Any]] | None, trained: frozenset[str], costs: Costs = Costs(), refused: list[str] | None = None) -> tuple[str, int, int, list[dict[str, Any]]]:
    """(output, start and end of the loss mask in it, attachments). The mask covers the content of trained roles, and is empty else."""
    visitor = Flattener(costs, refused)
    for part in parts or []:
        visitor.visit(part)
    head, content = f"<turn {ROLE.sub(r'\\\1', role or '')}>\n", "".join(visitor.out)
    start = len(head)
    return head + content + CLOSE, start, start + (len(content) if role in trained else 0), visitor.attachments


def formatted(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), costs: Costs = Costs()) -> DataFrame:
    """(conv_id, turn, output, loss_start, loss_end, attachments, expanded_tokens, refused) of each row of turns (conv_id, turn, role, parts).

    A conversation's output is its turns' outputs side by side, by turn. Null parts, roles and texts are empty; sizes that are
    missing, negative or no numbers are 0. Parts of an unknown type are left out of the output and their types listed in refused.
    """
    prepare(turns.sparkSession)
    roles = frozenset(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refused: list[list[str]] = [[] for _ in range(batch.num_rows)]
            rows = [format_turn(r, p, roles, costs, out) for r, p, out in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), refused)]
            kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], kind), pa.array([sum(a["tokens"] for a in r[3]) for r in rows], pa.int64()), pa.array(refused, pa.list_(pa.string()))],
                ["conv_id", "turn", "output", "loss_start", "loss_end", "attachments", "expanded_tokens", "refused"],
            )

    schema = "conv_id long, turn long, output string, loss_start long, loss_end long, attachments array<struct<type:string,ref:string,tokens:long>>, expanded_tokens long, refused array<string>"
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART}>")).mapInArrow(run, schema)


class Reader:
    """Reads one conversation's output back, piece by piece, holding at most an open turn."""

    HEAD = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n", re.S)

    def __init__(self) -> None:
        self.held, self.turns, self.all, self.loss, self.loss_chars, self.chars = "", 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def feed(self, output: str, loss_start: int, loss_end: int) -> None:
        masked = unescape(output[loss_start:loss_end])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(output)
        self.held += output
        while head := self.HEAD.match(self.held):
            end = self.held.find(CLOSE, head.end())
            while end >= 0 and self._escaped(end):
                end = self.held.find(CLOSE, end + 1)
            if end < 0:
                return
            self.all.update(f"{unescape(head[1])}\n{unescape(self.held[head.end() : end])}\n".encode())
            self.turns += 1
            self.held = self.held[end + len(CLOSE) :]

    def _escaped(self, at: int) -> bool:
        n = at
        while n and self.held[n - 1] == "\\":
            n -= 1
        return (at - n) % 2 == 1

    def row(self) -> tuple[int, str, int, str, int]:
        if self.held:
            raise ValueError("the output ends inside a turn")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted() rows.

    Equal turns of a conversation go by their output. A null conv_id is a conversation of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        reader: Reader | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        for batch in batches:
            done = []
            for conv, output, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if reader is None or conv != now:
                    if reader:
                        done.append((now, *reader.row()))
                    now, reader = conv, Reader()
                reader.feed(output, start, end)
            if done:
                yield batch_of(done)
        if reader:
            yield batch_of([(now, *reader.row())])

    columns = rows.select("conv_id", "turn", "output", "loss_start", "loss_end")
    dealt = columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "output")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def text_parts(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the text as their only part."""
    return rows.select("conv_id", "turn", "role", F.array(F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).alias("parts"))


#: Fixed value: the query's own conversation, whose texts look like marks.
PROBE = (-7, r"\### Assistant: </turn> ok")
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE[0]}, 0, 'user', '{PROBE[1]}' UNION ALL SELECT {PROBE[0]}, 1, 'assistant', '{PROBE[1]}'),
e AS (SELECT *, length('<turn >' || regexp_replace(role, '([\\<>])', '\\\1', 'g') || '_'
  || regexp_replace(text, '(\\|</?turn|<(?:image|audio|document):)', '\\\1', 'g') || '</turn>_') AS n FROM c),
a AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
