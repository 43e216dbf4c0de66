"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to a string. Successive prefixes of the
conversation are rendered, and each output is compared with the one before: what a turn
adds behind the common prefix is its span. If the earlier output isn't a prefix of the
later one, the template rewrote history: the conversation is marked, and the spans are
those of the final output's last comparison that agrees with it.

`MarkedTurns` marks every turn by its role and escapes control strings inside texts
reversibly: backslashes double, and a backslash breaks each control string after its
first character. `read_back` recovers roles, texts and loss spans from the output alone.
The loss mask is each assistant turn's incremental span without its marks and role;
`read_back` has to give the same.

Defined results: NULL texts and roles are empty; a turn that is NULL sorts first, ties and
repeated rows sort by role and text and all stay. Input columns other than the four named
ones are ignored. A NULL conv_id is a conversation of its own. Empty tables give no rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[Sequence[Turn]], str]

#: Strings that open or close something for common chat models; fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\([\\n]?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    """For a role: line breaks as well, since the first one ends the role."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """No control string has n as its second character, so \\n can only be a line break."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class MarkedTurns:
    """<|im_start|>role, a line break, the text, <|im_end|> and a line break for each turn."""

    open, close = "<|im_start|>", "<|im_end|>\n"

    def __call__(self, turns: Sequence[Turn]) -> str:
        return "".join(
            f"{self.open}{escape_line(role)}\n{escape(text)}{self.close}" for role, text in turns
        )


@dataclass
class Formatted:
    text: str
    spans: list[tuple[int, int]]  # of each turn, code points, end exclusive
    rewrites: bool


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over string comparisons."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def render(turns: Sequence[Turn], template: Template) -> Formatted:
    """Render all prefixes; the last output with each turn's span in it.

    A turn's span ends where the next comparison says that history ends: for a template
    that rewrites, a later prefix can shorten or move an earlier turn's span."""
    last = ""
    spans: list[tuple[int, int]] = []
    rewrites = False
    for n in range(1, len(turns) + 1):
        out = template(turns[:n])
        same = common_prefix(last, out)
        if same < len(last):
            rewrites = True
            spans = [(min(a, same), min(b, same)) for a, b in spans]
        spans.append((same, len(out)))
        last = out
    return Formatted(last, spans, rewrites)


@dataclass
class ReadBack:
    turns: list[Turn]
    loss: list[tuple[int, int]]  # spans of the escaped assistant texts in the output


def read_back(output: str, template: MarkedTurns = MarkedTurns(), learn: Sequence[str] = ("assistant",)) -> ReadBack:
    """Roles, texts and loss mask of an output of MarkedTurns. An unbroken control string
    can only be a mark, as texts hold broken ones only."""
    turns, loss, at = [], [], 0
    while at < len(output):
        start = at + len(template.open)
        line = output.index("\n", start)
        end = output.index(template.close, line + 1)
        role = unescape(output[start:line])
        turns.append((role, unescape(output[line + 1 : end])))
        if role in learn:
            loss.append((line + 1, end))
        at = end + len(template.close)
    return ReadBack(turns, loss)


def loss_spans(done: Formatted, turns: Sequence[Turn], template: MarkedTurns, learn: Sequence[str] = ("assistant",)) -> list[tuple[int, int]]:
    """The incremental spans of the turns to learn without their marks and roles, checked against what is read back."""
    back = read_back(done.text, template, learn).loss
    if done.rewrites:
        return back  # turns and spans no longer correspond
    loss = [
        (a + len(template.open) + len(escape_line(role)) + 1, b - len(template.close))
        for (a, b), (role, _) in zip(done.spans, turns, strict=True) if role in learn
    ]
    if loss != back:
        raise ValueError("the spans of the prefixes are not those that the marks give")
    return loss


SCHEMA = (
    "conv_id bigint, formatted string, spans array<struct<start: bigint, end: bigint>>, "
    "loss array<struct<start: bigint, end: bigint>>, rewrites boolean"
)


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: the output, the span of each turn, the loss mask (spans of
    assistant turns, for MarkedTurns without marks and roles) and `rewrites`."""
    style = template or MarkedTurns()
    order = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(
        F.array_sort(F.collect_list(order)).alias("turns")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for conv, turns in zip(f["conv_id"], f["turns"], strict=True):
                pairs = [(t["role"], t["text"]) for t in turns]
                done = render(pairs, style)
                if isinstance(style, MarkedTurns):
                    loss = loss_spans(done, pairs, style)
                else:
                    loss = [s for s, (role, _) in zip(done.spans, pairs, strict=True) if role == "assistant"]
                rows.append(
                    (conv, done.text, [{"start": a, "end": b} for a, b in done.spans],
                     [{"start": a, "end": b} for a, b in loss], done.rewrites)
                )
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "spans", "loss", "rewrites"])
            yield out.astype({"conv_id": "Int64"})

    return whole.mapInPandas(run, SCHEMA)


def digests(rows: DataFrame) -> DataFrame:
    """Read the outputs back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for conv, text, loss, rewrites in zip(f["conv_id"], f["formatted"], f["loss"], f["rewrites"], strict=True):
                back = read_back(text)
                seen = "".join(f"{role}\n{said}\n" for role, said in back.turns)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv, len(back.turns), _sha(seen), len(learnt), _sha(learnt), len(text), rewrites))
            yield pd.DataFrame(
                out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            ).astype({"conv_id": "Int64"})

    return rows.mapInPandas(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, rewrites boolean",
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
