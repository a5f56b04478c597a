"""Chat formatting by incremental black-box rendering.

The template is any function from a list of turns to a string. Successive prefixes of a conversation are rendered and
compared: what a turn appends is its span. A template whose output for a longer prefix does not begin with that for the
shorter one has rewritten history; such conversations are marked, and their spans hold for the prefix that ends there.
Within a turn's span its text is located by rendering the prefix with two probe texts: what both outputs share in front
and behind is the template's own.

Defined cases: a null text is empty, a null role is the role ""; turns of equal number keep the order of role and text;
a conversation without turns does not occur; a null conv_id is one conversation of its own; repeated rows are turns of their own; an
empty table gives no rows; very long texts are whole. Only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
#: Control strings of the default template, and the mark that breaks them where a text holds them.
BEGIN, END, SEP, ESC = "<|turn|>", "<|end|>", "\n", "\\"
CONTROL = re.compile(r"\\|(?<=<)\||(?<=<)/(?=s>)|(?<=\[)(?=/?INST\])")
ESCAPED = re.compile(r"\\([\\|/In])")
#: Two texts of one character each that no template treats apart.
PROBES = "\ue000", "\ue001"


def escape(text: str) -> str:
    """Control strings broken by a mark, marks doubled; `unescape` gives the text back."""
    if ESC not in text and "<|" not in text and "</s>" not in text and "INST]" not in text:
        return text
    return CONTROL.sub(lambda m: ESC + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: SEP if m[1] == "n" else m[1], text)


def template(turns: Turns) -> str:
    """The default template: role line, text, end mark."""
    return "".join(f"{BEGIN}{escape(role).replace(SEP, ESC + "n")}{SEP}{escape(text)}{END}{SEP}" for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns of a string that `template` made."""
    out = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, text = part.removesuffix(END + SEP).partition(SEP)
        out.append((unescape(role), unescape(text)))
    return out


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving: comparing slices is one memory comparison each."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def spans(turns: Turns, render: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendered conversation; start, text start, text end and end of every turn; whether history was rewritten."""
    before, out, rewritten = render([]), [], False
    for k, (role, text) in enumerate(turns):
        after = render(turns[: k + 1])
        if not after.startswith(before):
            rewritten = True
            at = _shared(before, after)
        else:
            at = len(before)
        own = after[at:]
        one, two = (render([*turns[:k], (role, p)]) for p in PROBES)
        front, back = _shared(one, two), _shared(one[::-1], two[::-1])
        text_at, text_to = (front, len(after) - back) if len(after) >= front + back else (len(after), len(after))
        out.append((at, text_at, text_to, at + len(own)))
        before = after
    return before, out, rewritten


FORMATTED = "conv_id long, formatted string, roles array<string>, spans array<array<long>>, rewritten boolean"


def formatted(conversations: DataFrame, render: Callable[[Turns], str] = template) -> DataFrame:
    """conv_id, formatted, roles, spans (start, text start, text end, end; code points), rewritten: a row a conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch["conv_id"], batch["turns"], strict=True):
                pairs = [(t["role"] or "", t["text"] or "") for t in turns]
                text, at, rewritten = spans(pairs, render)
                rows.append((conv_id, text, [r for r, _ in pairs], [list(x) for x in at], rewritten))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "roles", "spans", "rewritten"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns")).select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInPandas(run, FORMATTED)


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(conversations: DataFrame, read: Callable[[str], Turns] = read_back, trained: str = "assistant") -> DataFrame:
    """Digests of formatted(): of the turns read back from the output, and of the unescaped text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv_id, text, roles, at in zip(batch["conv_id"], batch["formatted"], batch["roles"], batch["spans"], strict=True):
                turns = read(text)
                loss = "".join(unescape(text[a:b]) for role, (_, a, b, _) in zip(roles, at, strict=True) if role == trained)
                rows.append((conv_id, len(turns), hexdigest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexdigest(loss), len(text)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGESTS.split(", ")])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return conversations.mapInPandas(run, DIGESTS)
