r"""Chat formatting by a declarative template and a finite-state machine (operator 9).

The template gives each role a prefix and a suffix and says whose text carries loss.  Turns
of a conversation stream through one task in order (a shuffle by conversation and a sort,
never a collected group), the machine checks each role against the state that the turn
before left, and each turn becomes segments: control text without loss, the escaped text
with the role's flag.  Control strings inside texts are broken up by a backslash after their
first character, a backslash becomes two, so that ``\x`` always reads back as ``x``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (prefix, suffix, loss).  ``next_roles``: state -> roles that may follow;
    the state is the last role, ``start`` before the first.  ``other`` serves roles without an entry:
    its prefix holds the (escaped) role in the place of ``{role}``.  ``controls`` are the strings that
    texts must not contain unescaped."""
    turns: dict = field(default_factory=lambda: {
        "system": ("<s><<SYS>>\n", "\n<</SYS>></s>", False),
        "user": ("<s>[INST] ", " [/INST]", False),
        "assistant": ("[OUT] ", " </s>", True),
    })
    other: tuple = ("<s>[ROLE:{role}] ", " [/ROLE]", False)
    next_roles: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final_roles: tuple = ("assistant",)
    controls: tuple = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[ROLE:", "[/ROLE]")

    def escape(self, text: str) -> str:
        found = "|".join(map(re.escape, self.controls))
        return re.sub(rf"\\|(?=(?:{found}))(.)", lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text, flags=re.S)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """``(text, loss)`` of one turn.  A null role is the empty one, a null text the empty text."""
        role, text = role or "", text or ""
        if role in self.turns:
            prefix, suffix, loss = self.turns[role]
        else:
            prefix, suffix, loss = self.other
            prefix = prefix.replace("{role}", self.escape(role).replace("]", "\\]"))
        return [(prefix, False), (self.escape(text), loss), (suffix, False)]

    def step(self, state: str, role: str | None) -> tuple[str, bool]:
        """The next state and whether ``role`` may follow ``state``."""
        return role or "", (role or "") in self.next_roles.get(state, ())

    def parse(self, turn: str) -> tuple[str, str, bool]:
        """``(role, text, loss)`` of one formatted turn."""
        for role, (prefix, suffix, loss) in self.turns.items():
            if turn.startswith(prefix) and turn.endswith(suffix):
                return role, self.unescape(turn[len(prefix):len(turn) - len(suffix)]), loss
        before, after = self.other[0].split("{role}")
        m = re.match(rf"{re.escape(before)}((?:\\.|[^\]\\])*){re.escape(after)}(.*){re.escape(self.other[1])}\Z", turn, re.S)
        if not m:
            raise ValueError(f"not a turn of this template: {turn[:80]!r}")
        return self.unescape(m[1]), self.unescape(m[2]), self.other[2]


def _in_order(df: DataFrame, *cols: str) -> DataFrame:
    return df.repartition(F.col(cols[0])).sortWithinPartitions(*cols)


def format_chats(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, pos, turn, role, ok, segments``.

    ``pos`` counts the turns of a conversation from 0, in order of turn (null first), role and text, so that
    ties and repeated rows have a fixed order; each repeated row is a turn.  ``segments`` is an array of
    ``(text, loss)``; joined, their texts are the formatted turn.  ``ok`` is false for a turn whose role
    may not follow the one before; such turns are formatted like others.  Rows without a conversation id
    form one conversation."""
    src = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                               F.col(role_col).alias("role"), F.col(text_col).alias("text"))

    def run(batches):
        conv, pos, state = object(), 0, "start"
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(4)]
            poss, oks, segs = [], [], []
            for c, role, text in zip(cols[0], cols[2], cols[3]):
                if c != conv:
                    conv, pos, state = c, 0, "start"
                state, ok = template.step(state, role)
                poss.append(pos)
                oks.append(ok)
                segs.append([{"text": t, "loss": f} for t, f in template.segments(role, text)])
                pos += 1
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(poss, pa.int64()), b.column(1), b.column(2), pa.array(oks, pa.bool_()),
                pa.array(segs, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))],
                names=["conv_id", "pos", "turn", "role", "ok", "segments"])

    return _in_order(src, "conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, pos long, turn long, role string, ok boolean, segments array<struct<text:string,loss:boolean>>")


def digest_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What formatted turns say, read back from their text: one row per conversation.

    ``n_turns``; ``turns_sha256`` over role, \\n, text, \\n of each turn; ``loss_chars`` and ``loss_sha256``
    over the unescaped text under the loss mask; ``formatted_chars``; ``valid``: every turn follows the
    machine and the last may end a conversation.  Turns stream in order with a running hash."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    src = formatted.select("conv_id", "pos", "ok", F.expr("transform(segments, s -> s.text)").alias("texts"),
                           F.expr("transform(segments, s -> s.loss)").alias("loss"))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        at, have = None, False
        rows: list = []

        def close():
            rows.append((at[0], at[1], at[2].hexdigest(), at[3], at[4].hexdigest(), at[5], at[6] and at[7] in template.final_roles))

        for b in batches:
            conv, _, ok, texts, loss = (b.column(k).to_pylist() for k in range(5))
            for c, o, parts, flags in zip(conv, ok, texts, loss):
                if not have or c != at[0]:
                    if have:
                        close()
                    at, have = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""], True
                role, text, _ = template.parse("".join(parts))
                at[1] += 1
                at[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for p, f in zip(parts, flags):
                    at[5] += len(p)
                    if f:
                        p = template.unescape(p)
                        at[3] += len(p)
                        at[4].update(p.encode("utf-8", "surrogatepass"))
                at[6], at[7] = at[6] and o, role
            if len(rows) >= 10_000:
                yield batch(rows)
                rows.clear()
        if have:
            close()
        if rows:
            yield batch(rows)

    return _in_order(src, "conv_id", "pos").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
