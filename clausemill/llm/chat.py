"""Chat formatting by incremental rendering of a template that is known only by what it renders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import small

Turn = tuple[str, str]

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED, _TURN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|"), re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ROLE = {"\\\\": "\\", "\\n": "\n", "\\p": "|"}


def escape(text: str) -> str:
    """One more backslash between < and | wherever only backslashes part them: no control string is left in a text."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "\\" in text else text


def render_marked(turns: list[Turn]) -> str:
    """<|im_start|>role, text and <|im_end|> of each turn; a role takes no line feed and no bar."""
    role = lambda x: x.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")
    return "".join(f"{START}{role(r)}\n{escape(t)}{END}\n" for r, t in turns)


def parse_marked(text: str) -> list[Turn]:
    """The turns of a rendered text; whatever is not a whole turn is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((re.sub(r"\\[\\np]", lambda x: _ROLE[x[0]], m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a rendered turn at {at}")
    return turns


@dataclass(frozen=True)
class Template:
    """A template as the operator sees it: turns in, text out; and, to read its output back, the two inverses."""

    render: Callable[[list[Turn]], str] = render_marked
    parse: Callable[[str], list[Turn]] = parse_marked
    unescape: Callable[[str], str] = unescape


MARKED = Template()


def shared(a: str, b: str) -> int:
    """Length of the common start of two texts, by halving: comparing slices is a memory comparison."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Incremental:
    """The turns of one conversation, rendered prefix by prefix.

    At most `window` turns are held. When there are more, the older half goes, and the turns that stay are rendered
    again without it: a template whose later pieces then differ looks further back than the window, and all that follows
    is told as rewritten.
    """

    def __init__(self, template: Template, masked: frozenset[str], window: int):
        self.render, self.unescape, self.masked, self.window = template.render, template.unescape, masked, max(2, window)
        self.turns: list[Turn] = []
        self.pieces: list[str] = []
        self.last, self.base, self.far = template.render([]), 0, False

    def _content(self, head: list[Turn], role: str, text: str, now: str) -> tuple[int, int] | None:
        """Where the newest text lies: two renderings that differ in this text alone part where it begins and meet where
        it ends. None if what is around it depends on the text, or what is between is not the text again."""
        a, b = self.render([*head, (role, "a")]), self.render([*head, (role, "b")])
        at = shared(a, b)
        after = len(a) - at - 1
        if len(a) != len(b) or a[at + 1 :] != b[at + 1 :] or now[:at] != a[:at] or len(now) < at + after or now[len(now) - after :] != a[at + 1 :]:
            return None
        return (at, len(now) - after) if self.unescape(now[at : len(now) - after]) == text else None

    def add(self, role: str, text: str) -> tuple[str, int, int, int | None, int | None, bool]:
        """piece, start, end, loss start, loss end, rewritten of the next turn, in code points of the whole output."""
        head = self.turns
        now = self.render([*head, (role, text)])
        same = shared(self.last, now)
        rewritten = self.far or same < len(self.last)
        loss = self._content(head, role, text, now) if role in self.masked else None
        out = now[same:], self.base + same, self.base + len(now), loss and self.base + loss[0], loss and self.base + loss[1], rewritten or (role in self.masked and loss is None)
        self.turns, self.last = [*head, (role, text)], now
        self.pieces.append(now[same:])
        if len(self.turns) > self.window:
            self._slide()
        return out

    def _slide(self) -> None:
        keep = self.window // 2
        turns, pieces, end = self.turns[-keep:], self.pieces[-keep:], self.base + len(self.last)
        before = self.render(turns[:1])
        for k in range(2, keep + 1):
            now = self.render(turns[:k])
            self.far |= not now.startswith(before) or now[len(before) :] != pieces[k - 1]
            before = now
        self.turns, self.pieces, self.last, self.base = turns, pieces, before, end - len(before)


_SPANS = "pos long, role string, piece string, start_offset long, end_offset long, loss_start long, loss_end long, rewritten boolean"


def format_chats(conversations: DataFrame, template: Template = MARKED, masked: tuple[str, ...] = ("assistant",), window: int = 256) -> DataFrame:
    """One row a turn: conv_id, turn, pos (from 0), role, piece, start_offset, end_offset, loss_start, loss_end, rewritten.

    Each prefix of a conversation's turns is rendered and compared with the rendering before it: what is new is the
    turn's piece, and the pieces of a conversation, in order, are its formatted text. Texts of `masked` roles lie under
    the loss mask, from loss_start to loss_end (null for other roles). rewritten: this turn changed what was rendered
    before it (the piece then starts where the change does), or its text cannot be told from what is around it. At most
    `window` turns are rendered at once; conversations of more are checked as Incremental says. Offsets are code points.

    Rows of a conversation come together and in order, in one partition; turns are streamed past, never gathered, so a
    conversation may be of any length. Order is by turn (null first), then role and text; repeated rows are turns of
    their own. A null role or text is empty; rows with a null conv_id are one conversation; other columns are left out;
    empty tables give no rows.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    hidden = frozenset(masked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, pos = object(), None, 0
        for batch in small(batches):
            rows = []
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or c != conv:
                    conv, state, pos = c, Incremental(template, hidden, window), 0
                rows.append((c, turn, pos, role, *state.add(role, text)))
                pos += 1
            if rows:
                columns = zip(*rows, strict=True)
                types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
                names = ["conv_id", "turn", *[x.split()[0] for x in _SPANS.split(", ")]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    kinds = dict(turns.dtypes)
    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {_SPANS}")


def rewriting(spans: DataFrame) -> DataFrame:
    """conv_id, first_pos, n_rewritten of the conversations whose history the template rewrites."""
    return spans.where("rewritten").groupBy("conv_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_rewritten"))


def read_back(spans: DataFrame, template: Template = MARKED) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the rows of format_chats, as they come.

    Everything is read from the formatted text: turns by the template's parser, the text under the mask by the spans.
    The digests are carried from piece to piece, so no conversation is gathered. A conversation with rewritten turns has
    no text that its pieces make up; its digests and counts but n_turns are null.
    """
    kind = dict(spans.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> tuple:
            whole = (turns.hexdigest(), n_loss, loss.hexdigest(), chars) if ok else (None,) * 4
            return conv, n, *whole

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        conv, n, ok, rows, id_type = None, 0, True, [], pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            columns = [batch.column(x).to_pylist() for x in ("conv_id", "pos", "piece", "start_offset", "loss_start", "loss_end", "rewritten")]
            for c, pos, piece, start, low, high, rewritten in zip(*columns, strict=True):
                if pos == 0:
                    if n:
                        rows.append(told())
                    conv, n, ok, n_loss, chars, turns, loss = c, 0, True, 0, 0, hashlib.sha256(), hashlib.sha256()
                n, ok = n + 1, ok and not rewritten
                if not ok:
                    continue
                chars += len(piece)
                for role, text in template.parse(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                if low is not None:
                    text = template.unescape(piece[low - start : high - start])
                    n_loss += len(text)
                    loss.update(text.encode())
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if n:
            rows.append(told())
        if rows:
            yield batch_of(rows)

    return spans.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
