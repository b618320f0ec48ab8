"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<<SYS>>" text "<</SYS>>"            role system
                  | "[INST]" text "[/INST]"              role user
                  | "<s>" text "</s>"                    role assistant
                  | "<|role|>" role "<|text|>" text "<|end|>"   any other role

A control string inside a text is escaped by a backslash: a run of n backslashes before it becomes one of 2n + 1, and a run
at the end of a text, before its closing mark, one of 2n. Every turn is rendered plain first, parsed again by the
deterministic parser and compared with its source; conflicting content is escaped until both are identical.

A segment's loss mask is the range of its characters that hold an assistant's text, as it stands there, escaped; readers
learn from the mask, not from the role, what is trained on.

Cases: a null text or role is an empty one; null conversation ids form one conversation; rows of equal (conv_id, turn) are
taken in the order of role and text; a long text is one turn, held in memory whole; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import pick, prepare

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OPEN = {o: (role, c) for role, (o, c) in MARKS.items()}
OTHER, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROLS = [*(m for pair in MARKS.values() for m in pair), OTHER, TEXT, END]
_CONTROL = "|".join(map(re.escape, CONTROLS))
_ANY = re.compile(_CONTROL)
_HIDDEN = re.compile(rf"(\\*)({_CONTROL}|\Z)")


class GrammarError(ValueError):
    """The text is not a conversation of this grammar."""


def escape(text: str) -> str:
    return _HIDDEN.sub(lambda m: "\\" * (2 * len(m[1]) + bool(m[2])) + m[2], text) if "\\" in text or _ANY.search(text) else text


class Parser:
    """Reads a formatted conversation piece by piece and yields its turns; it holds one turn at a time."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        text, at = self.rest + piece, 0
        while at < len(text):
            m = _ANY.match(text, at)
            if not m or m[0] != OTHER and m[0] not in OPEN:
                raise GrammarError(f"no turn begins at {text[at : at + 20]!r}")
            if m[0] == OTHER:
                role, stop = self._text(text, m.end(), TEXT)
                body, stop = self._text(text, stop, END) if role is not None else (None, 0)
            else:
                role, mark = OPEN[m[0]]
                body, stop = self._text(text, m.end(), mark)
            if body is None:
                break
            yield role, body
            at = stop
        self.rest = text[at:]

    @staticmethod
    def _text(text: str, at: int, mark: str) -> tuple[str | None, int]:
        """The text up to its closing mark, its escapes undone, and where it ends."""
        out, start = [], at
        for m in _ANY.finditer(text, at):
            n, k = 0, m.start()
            while k > start and text[k - 1] == "\\":
                n, k = n + 1, k - 1
            out += [text[start:k], "\\" * (n // 2)]
            start = m.end()
            if n % 2:
                out.append(m[0])
            elif m[0] == mark:
                return "".join(out), m.end()
            else:
                raise GrammarError(f"{m[0]!r} inside a text that {mark!r} closes")
        return None, 0

    def close(self) -> None:
        if self.rest:
            raise GrammarError("the last turn does not end")


def parse(formatted: str) -> list[tuple[str, str]]:
    p = Parser()
    turns = list(p.feed(formatted))
    p.close()
    return turns


def render_turn(role: str | None, text: str | None) -> str:
    """One turn, its content escaped only as far as the round trip needs it."""
    role, text = role or "", text or ""
    shown_role, shown = role, text
    for _ in range(2):
        if role in MARKS:
            out = MARKS[role][0] + shown + MARKS[role][1]
        else:
            out = OTHER + shown_role + TEXT + shown + END
        try:
            if parse(out) == [(role, text)]:
                return out
        except GrammarError:
            pass
        shown_role, shown = escape(role), escape(text)
    raise GrammarError("a turn does not survive its round trip")


def loss_range(role: str | None, formatted: str) -> tuple[int, int]:
    """The characters of a rendered turn that a model is trained on: an assistant's text between its marks, else none."""
    if role != "assistant":
        return 0, 0
    before, after = MARKS["assistant"]
    return len(before), len(formatted) - len(after)


def unescape(shown: str) -> str:
    """The text of a rendered turn's content."""
    return _HIDDEN.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], shown)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roles = b.column("role").to_pylist()
        out = [render_turn(r, t) for r, t in zip(roles, b.column("text").to_pylist())]
        loss = list(zip(*(loss_range(r, f) for r, f in zip(roles, out)))) or [[], []]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text"), pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in loss)], names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start and loss_end: the segments of each conversation's formatted text and
    their loss masks.

    A formatted conversation is its segments one after the other in the order of turn, role and text. Segments are made
    and checked where their rows are, before anything is grouped.
    """
    prepare(conversations.sparkSession)
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(_render, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, rows = None, None, []

    def done():
        p, n, turns, loss, chars, size = state
        p.close()
        rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows.clear()
        return out

    for b in batches:
        for conv, piece, begin, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if state is None or conv != now:
                if state is not None:
                    done()
                now, state = conv, [Parser(), 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            state[5] += len(piece)
            if end > begin:
                learned = unescape(piece[begin:end])
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(learned)
            for role, text in state[0].feed(piece):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if rows:
            yield flush()
    if state is not None:
        done()
        yield flush()


def read_chats(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation holds, by the parser and the loss masks alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Segments stream through one task in order, one turn in memory at a time."""
    rows = pick(formatted, "conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end")
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    return sorted_.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
