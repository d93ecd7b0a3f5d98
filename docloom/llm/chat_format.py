"""Chat formatting with a grammar round trip.

Turns are rendered under the template below, the rendered text is parsed again, and a turn that does not come back as
it was is escaped until it does. The grammar, with control strings in quotes::

    conversation = turn*
    user         = "<s>" "[INST]" " " body " " "[/INST]"
    assistant    = " " body " " "</s>"
    other        = "<<SYS>>" role "\\n" body "\\n" "<</SYS>>"

A body holds no control string unless backslashes stand before it; one of them is taken off when it is read. The
loss mask covers the bodies of assistant turns.

Edge cases: a null text or role counts as empty; a null conversation id is a conversation of its own; turns of equal
number go by role, then by their rendered text; repeated rows are repeated turns; an empty table gives no rows. A
conversation may hold any number of rows: they are sorted by Spark and streamed, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_batches

#: The control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
_ESCAPED = re.compile(r"\\(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
_USER, _SYSTEM = "<s>[INST] ", "<<SYS>>"
_CLOSE = {"user": " [/INST]", "assistant": " </s>"}
_OTHER_CLOSE = "\n<</SYS>>"


class GrammarError(ValueError):
    """The text is not one that the template makes."""


def escape(text: str) -> str:
    """One more backslash before each control string and the backslashes that stand there."""
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, body: str) -> str:
    if role == "user":
        return _USER + body + _CLOSE["user"]
    if role == "assistant":
        return " " + body + _CLOSE["assistant"]
    name = role.replace("\\", "\\\\").replace("\n", "\\n")
    return _SYSTEM + name + "\n" + body + _OTHER_CLOSE


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn; reads from left to right, never back."""
    at = 0
    while at < len(text):
        if text.startswith(_USER, at):
            role, start = "user", at + len(_USER)
        elif text.startswith(_SYSTEM, at):
            line = text.find("\n", at)
            if line < 0:
                raise GrammarError("a role does not end")
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text[at + len(_SYSTEM) : line])
            start = line + 1
        elif text[at] == " ":
            role, start = "assistant", at + 1
        else:
            raise GrammarError(f"no turn starts at {at}")
        close = _CLOSE.get(role, _OTHER_CLOSE)
        bare = next((m for m in _CONTROL.finditer(text, start) if not m[1]), None)
        end = -1 if bare is None else bare.start() - 1
        if end < start or not text.startswith(close, end) or bare.end() != end + len(close):
            raise GrammarError(f"the turn at {at} does not end as it should")
        yield role, unescape(text[start:end]), start, end
        at = bare.end()


def format_turn(role: str | None, text: str | None) -> str:
    """The rendered turn, escaped as often as it takes for it to come back identical."""
    role, text = role or "", text or ""
    body = text
    for _ in range(3):
        out = render(role, body)
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except GrammarError:
            pass
        body = escape(body)
    raise GrammarError("a turn does not come back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role and ``rendered``; rendered turns in order are the formatted text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string())], names=["conv_id", "turn", "role", "rendered"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_batches(rows, run, f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, rendered string")


class _Digest:
    """What is read back from one conversation's formatted text, turn by turn."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def read(self, rendered: str) -> None:
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode())
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


_NAMES = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from rendered turns: counts and digests of the turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: _Digest | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(_NAMES))
        for batch in batches:
            done = []
            for conv_id, rendered in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist(), strict=True):
                if open_one is None or open_one.conv_id != conv_id:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Digest(conv_id)
                open_one.read(rendered)
            if done:
                yield pack(done)
        if open_one is not None:
            yield pack([open_one.row()])

    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return map_batches(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
