"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows of a conversation arrive in turn order and are formatted one after the
other, so that a task holds one row at a time whatever a conversation's
length.  Each turn becomes segments of text, each with a loss flag: the marks
of the template are never trained on, the texts of assistants are.  Control
strings inside texts are escaped, and read_back() undoes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn and the order of roles.

    Marks and controls start with a guarded character.  In texts and roles the
    escape follows each guarded character and each escape, so that a control
    string is broken after its first character and occurs nowhere in them.
    """

    begin: str = "<|{role}|>"
    end: str = "<|end|>"
    escape: str = "\\"
    controls: tuple[str, ...] = ("</s>", "<s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for c in (self.begin, self.end, *self.controls):
            if len(c) < 2 or c[1] == self.escape or self.escape in self.guarded():
                raise ValueError(f"the escape does not break {c!r}")

    def guarded(self) -> str:
        """First characters of marks and controls."""
        return "".join(dict.fromkeys(c[0] for c in (self.begin, self.end, *self.controls)))

    def escaped(self, text: str) -> str:
        for c in self.escape + self.guarded():  # the escape itself comes first
            text = text.replace(c, c + self.escape)
        return text

    def unescaped(self, text: str) -> str:
        """Take out the escape that follows each guarded character and each escape."""
        parts, at = text.split(self.escape), 0
        if len(parts) == 1:
            return text
        out = []
        while at < len(parts):
            x = parts[at]
            if at + 1 < len(parts) and not (x and x[-1] in self.guarded()):
                x, at = x + self.escape, at + 1  # two escapes stand for one
                if parts[at]:
                    raise ValueError("a lone escape")
            out.append(x)
            at += 1
        return "".join(out)


SEGMENTS = "conv_id long, position long, turn_number long, kind string, role string, text string, loss boolean, valid boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn_number", pa.int64()), ("kind", pa.string()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_BATCH = 2000


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments of every conversation, in order within a partition.

    Rows are ordered by turn, then role and text, so that ties and repeated
    rows have one order.  A null text is an empty text, a null role the role
    "".  A null conv_id is a conversation of its own.  `valid` says whether
    the turns so far follow the template's moves; rows that do not are
    formatted all the same.  Other columns are not read.
    """
    template = template or ChatTemplate()
    spark = conversations.sparkSession
    small_batches(spark)

    def machine(batches) -> Iterator[pa.RecordBatch]:
        now, state, valid, turns, position, rows = object(), "", True, 0, 0, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, state, valid, turns, position = conv, template.start, True, 0, 0
                moved = template.moves.get((state, role))
                valid = valid and moved is not None
                state = moved if moved is not None else role
                mark = template.begin.format(role=template.escaped(role))
                for kind, x, loss in (("begin", mark, False), ("text", template.escaped(text), role in template.trained), ("end", template.end, False)):
                    rows.append((conv, position, turns, kind, role, x, loss, valid))
                    position += len(x)
                turns += 1
            if len(rows) >= _BATCH:
                yield _out(rows, _ARROW)
                rows = []
        if rows:
            yield _out(rows, _ARROW)

    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(machine, SEGMENTS)


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
)


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests of each conversation, read from the formatted text and its loss mask.

    Roles come from the marks, texts from what stands between them; segments
    must come in the order that format_conversations() gives.
    """
    template = template or ChatTemplate()
    head, tail = template.begin.split("{role}")

    def parse(batches) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        rows.append(now[1].row(now[0]))
                    now = (conv, _Reader(template, head, tail))
                now[1].segment(text, loss, valid)
            if len(rows) >= _BATCH:
                yield _out(rows, _DIGEST)
                rows = []
        if now is not None:
            rows.append(now[1].row(now[0]))
        if rows:
            yield _out(rows, _DIGEST)

    return segments.mapInArrow(parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


class _Reader:
    """Reads the segments of one conversation."""

    def __init__(self, template: ChatTemplate, head: str, tail: str):
        self.template, self.head, self.tail = template, head, tail
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()
        self.inside, self.valid, self.state = False, True, template.start

    def segment(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        if not self.inside:
            if not (text.startswith(self.head) and text.endswith(self.tail)):
                raise ValueError("a turn has no opening mark")
            role = self.template.unescaped(text[len(self.head) : len(text) - len(self.tail)])
            self.all.update(f"{role}\n".encode())
            self.inside, self.turns, self.state = True, self.turns + 1, role
        elif text == self.template.end:
            self.all.update(b"\n")
            self.inside = False
        else:
            plain = self.template.unescaped(text)
            self.all.update(plain.encode())
            if loss:
                self.loss_chars += len(plain)
                self.trained.update(plain.encode())
        self.valid = valid

    def row(self, conv) -> tuple:
        if self.inside:
            raise ValueError("a turn has no closing mark")
        complete = self.valid and self.state in self.template.final
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.trained.hexdigest(), self.chars, complete
