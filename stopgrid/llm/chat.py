"""Chat formatting by incremental black-box rendering.

A template is any function of a list of (role, text) to one string. Nothing is assumed about it: the turns' spans come from
rendering successive prefixes of the conversation and comparing consecutive outputs.

* A turn's span is what its prefix's output has beyond the output of the prefix before.
* An output that does not begin with the one before shows a template that rewrites history; such conversations are flagged
  (``rewrites``), and no position in them counts as stable: spans and loss mask are empty.
* Inside a span, the text's own place is where two renderings differ whose last text is one probe or another; the same
  comparison gives head and tail of the turn, whatever they hold.

Null roles and texts count as empty. Repeated turns are kept, in the order of turn, role and text. Conversations with a null
conv_id form one conversation. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that steer a model or this format; each begins with < or [, and is longer than that.
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
PROBES = ("x", "y")


def escape(text: str, role: bool = False) -> str:
    r"""No control string is left: a backslash becomes \\, and < and [ are followed by \; (in roles, a line end becomes \n)."""
    out = text.replace("\\", "\\\\").replace("<", "<\\;").replace("[", "[\\;")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {";": "", "n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def turn_template(turns: list[Turn]) -> str:
    """<|turn|>role, a line end, the escaped text, <|end|>, a line end."""
    return "".join(f"<|turn|>{escape(role, True)}\n{escape(text)}<|end|>\n" for role, text in turns)


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The whole output and, for each turn, start and end of its span and of its text; None if history is rewritten."""
    found, before = [], ""
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return template(turns), None
        a, b = (template([*turns[:k], (role, p)]) for p in PROBES)
        head = len(os.path.commonprefix([a, b]))
        tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
        found.append((len(before), len(now), head, len(now) - tail))
        before = now
    return before, found


def read_back(formatted: str, places: list[tuple[int, int, int, int]]) -> list[Turn]:
    """The turns as the output holds them: the role is the head without the marker that all turns' heads begin with."""
    out = []
    for start, end, a, b in places:
        head = formatted[start:a]
        role = head[len("<|turn|>") : -1] if head.startswith("<|turn|>") else head.strip()
        out.append((unescape(role), unescape(formatted[a:b])))
    return out


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, formatted string, loss_starts array<long>, loss_ends array<long>"


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def format_one(conv_id: int | None, turns: list[Turn], template: Template, learn: str) -> tuple:
    formatted, places = spans(turns, template)
    back = read_back(formatted, places) if places is not None else []
    mask = [(a, b) for (_, _, a, b), (role, _) in zip(places or [], back, strict=True) if role == learn]
    loss = "".join(unescape(formatted[a:b]) for a, b in mask)
    return (conv_id, len(back) if places is not None else len(turns), _digest(*(f"{r}\n{t}\n" for r, t in back)), len(loss), _digest(loss), len(formatted), places is None, formatted, [a for a, _ in mask], [b for _, b in mask])


def format_conversations(df: DataFrame, template: Template = turn_template, learn: str = "assistant") -> DataFrame:
    """One row for each conversation: the formatted text, the loss mask over the turns of role ``learn``, and digests read back.

    Rows are dealt by conversation and sorted there, so a task holds one conversation at a time.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, out, held = None, [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != now:
                    out.append(format_one(now, turns, template, learn))
                    held += out[-1][5]
                    turns = []
                    if held > 4_000_000:
                        yield batch()
                        out, held = [], 0
                now = conv
                turns.append((role, text))
        if turns:
            out.append(format_one(now, turns, template, learn))
        if out:
            yield batch()

    return dealt.mapInArrow(run, SCHEMA)
