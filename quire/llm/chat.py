r"""Chat formatting with a grammar round trip.

A turn renders as  <|im_start|>ROLE \n TEXT <|im_end|> \n  and a conversation is its turns in order.
The grammar is deterministic: a turn begins with the start marker, its role ends at the first line
feed, its text at the first end marker, and a line feed follows. Each turn is first rendered as it
is, then parsed again; if the parse is not exactly the one source turn, its content is escaped and
checked again, until both are equal. Escaping puts a backslash more into each control string
(<|im_end|> becomes <\|im_end|>, <\|im_end|> becomes <\\|im_end|>), the parser takes one away, so
escaping is reversible and ordinary texts stay as they are. Since each rendered turn parses to one turn
and uses up all its characters, a concatenation of turns parses to exactly these turns.

Null role or text: empty. Null conv_id: a conversation of its own. Null turns come first. Equal turn
numbers: ordered by what they render to. Repeated rows are repeated turns. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    return CONTROL.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, where the text begins, where it ends) of each turn, or None if it is no conversation."""
    at, out = 0, []
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(END, line + 1) if line >= 0 else -1
        if end < 0 or not rendered.startswith("\n", end + len(END)):
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in role or END in role or START in text:
            return None
        out.append((unescape_role(role), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return out


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and how often its content had to be escaped (0: as it was)."""
    for level, (r, t) in enumerate(((role, text), (role, escape(text)), (escape_role(role), escape(text)))):
        rendered = f"{START}{r}\n{t}{END}\n"
        found = parse(rendered)
        if found is not None and [x[:2] for x in found] == [(role, text)]:
            return rendered, level
    raise AssertionError("an escaped turn always parses to itself")


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, rendered, escapes, loss_start, loss_end (code points in `rendered`; null: no loss).
    A conversation's formatted text is `rendered` of its turns joined in order. Row by row, no shuffle."""
    kind = dict(turns.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rendered, levels, starts, ends = [], [], [], []
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                out, level = render_turn(role or "", text or "")
                (_, _, a, b), masked = parse(out)[0], (role or "") in loss_roles
                rendered.append(out)
                levels.append(level)
                starts.append(a if masked else None)
                ends.append(b if masked else None)
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], pa.array(rendered, pa.string()), pa.array(levels, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "turn", "rendered", "escapes", "loss_start", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(
        run, f"conv_id {kind['conv_id']}, turn {kind['turn']}, rendered string, escapes int, loss_start long, loss_end long")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Turns are sorted by conversation and streamed: a digest keeps a hash state, never a conversation.
    A SHA-256 is a chain over its input, so the turns of one conversation pass through one task, in
    bounded memory; formatting and checking them does not."""
    kind = dict(formatted.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None

        def row() -> dict:
            return {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for conv, rendered, start in zip(batch["conv_id"].to_pylist(), batch["rendered"].to_pylist(), batch["loss_start"].to_pylist(), strict=True):
                if now != (conv,):
                    if now:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if start is not None:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(rendered)
            if out:
                yield table(out, kind)
        if now:
            yield table([row()], kind)

    def table(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.select("conv_id", "turn", "rendered", "loss_start").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "rendered").mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
