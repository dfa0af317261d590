"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of messages to one string.  Successive
prefixes of the turns are rendered and consecutive outputs compared: what they
have in common stays, and what is new is the last turn's span.  Where a longer
prefix changes what stands before the last turn, the template rewrites history.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernel import with_fields

Message = tuple[str, str]  # role, text
Template = Callable[[list[Message]], str]

#: Control strings of common templates, none of which may come from inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"


def escape(text: str) -> str:
    """Put a backslash after the first character of each control string, after doubling backslashes."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for control in CONTROL:
        if control in text:
            text = text.replace(control, control[0] + ESCAPE + control[1:])
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    parts = text.split(ESCAPE)
    out, k = [parts[0]], 1
    while k < len(parts):
        if parts[k] == "" and k + 1 < len(parts):  # a doubled backslash
            out.append(ESCAPE + parts[k + 1])
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return "".join(out)


def marked(messages: list[Message]) -> str:
    """The template used here: role line, escaped text, end mark, for each turn."""
    return "".join("<|im_start|>" + escape(role).replace("\n", ESCAPE + "\n") + f"\n{escape(text)}<|im_end|>\n" for role, text in messages)


def parse_marked(span: str) -> tuple[str, int, int]:
    """The role of the turn that a span of `marked` holds, and where its text is: the role ends at the first line end that isn't escaped."""
    start = span.index("<|im_start|>") + len("<|im_start|>")
    at = span.index("\n", start)
    while (at - len(span[start:at].rstrip(ESCAPE)) - start) % 2:
        at = span.index("\n", at + 1)
    return unescape(span[start:at]), at + 1, len(span) - len("<|im_end|>\n")


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


@dataclass
class Turn:
    span: str  # what the turn added
    rewrote: bool  # whether it changed what earlier turns had added


def spans(messages: Iterable[Message], template: Template = marked, block: int | None = None, context: int = 2) -> Iterator[Turn]:
    """The span of each turn, in order.

    All prefixes of one turn or more are rendered from the start, which is right
    for any template and takes time in the square of the turns.  With `block`, prefixes are
    rendered from the start of a block of so many turns; the last `context` turns
    of the block before stand in front of it, so a conversation of any length
    takes linear time and bounded memory.  That is only for templates that look
    at no more earlier turns than that.
    """
    seen: list[Message] = []
    before = first = ""  # first: a short rendering, which ends like any other where the template closes with a mark
    last = 0  # where the newest turn's span starts
    for message in messages:
        if block is not None and len(seen) >= block + context:
            seen = seen[-context:]
            shorter = template(seen[:-1]) if len(seen) > 1 else ""
            before = template(seen)
            last, first = common(shorter, before), shorter
        seen.append(message)
        now = template(seen)
        kept = common(before, now)
        first = first if len(seen) > 1 else now
        gone = before[kept:]  # a closing mark at most, if history stays
        yield Turn(now[kept:], len(seen) > 1 and (kept < last or not (now.endswith(gone) and first.endswith(gone))))
        before, last = now, kept


def formatted(
    conversations: DataFrame,
    template: Template = marked,
    parse: Callable[[str], tuple[str, int, int]] = parse_marked,
    plain: Callable[[str], str] = unescape,
    masked: tuple[str, ...] = ("assistant",),
    texts: bool = True,
    block: int | None = None,
    context: int = 2,
) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, spans, rewrites_history, and digests read back from the output.

    `parse` gives a span's role and where its text is; `plain` turns what stands
    there into the text.  spans has start, end, role, text_start, text_end and
    loss of each turn: what is under the loss mask is from text_start to text_end
    where loss holds.  Turns are ordered by turn, then role, then text; a null
    turn comes first and a null role or text is empty.  Rows with a null conv_id
    make one conversation.  Repeated rows are turns of their own, texts are of
    any length, other columns don't matter, and an empty table gives an empty one.

    For `block` and `context` see `spans`.  With them the whole output is
    rendered once more, and where it isn't what the spans make, all prefixes
    are.  With texts=False `formatted` and `spans` are left out; with `block` a
    conversation is then streamed, without that comparison.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ddl = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    if texts:
        ddl += ", formatted string, spans array<struct<start: long, end: long, role: string, text_start: long, text_end: long, loss: boolean>>"
    schema = with_fields(dealt.select("conv_id").schema, ddl)
    id_type = to_arrow_type(dealt.schema["conv_id"].dataType)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("role", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))

    def turns_of(messages: Iterable[Message]) -> Iterator[Turn]:
        if block is None or not texts:
            return spans(messages, template, block, context)
        messages = list(messages)
        try:
            quick = list(spans(messages, template, block, context))
        except Exception:  # the template doesn't take what starts in the middle
            return spans(messages, template)
        return iter(quick) if "".join(t.span for t in quick) == template(messages) else spans(messages, template)

    def conversation(conv_id, messages: Iterable[Message]) -> tuple:
        n = loss = chars = 0
        turns, under_mask, rewrites, out, where = hashlib.sha256(), hashlib.sha256(), False, [], []
        for turn in turns_of(messages):
            role, start, end = parse(turn.span)
            text = plain(turn.span[start:end])
            turns.update(f"{role}\n{text}\n".encode())
            if role in masked:
                under_mask.update(text.encode())
                loss += len(text)
            if texts:
                out.append(turn.span)
                where.append({"start": chars, "end": chars + len(turn.span), "role": role, "text_start": chars + start, "text_end": chars + end, "loss": role in masked})
            n, chars, rewrites = n + 1, chars + len(turn.span), rewrites or turn.rewrote
        return (conv_id, n, turns.hexdigest(), loss, under_mask.hexdigest(), chars, rewrites, *(("".join(out), where) if texts else ()))

    def run(batches):
        import itertools

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)

        found, names, size = [], [f.name for f in schema], 0

        def packed():
            columns = [pa.array(list(c)) if names[k] != "spans" else pa.array(list(c), span) for k, c in enumerate(zip(*found, strict=True))]
            columns[0] = pa.array([r[0] for r in found], id_type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        for conv_id, own in itertools.groupby(rows(), key=lambda r: r[0]):
            found.append(conversation(conv_id, ((r[1], r[2]) for r in own)))
            size += found[-1][5] if texts else 200
            if len(found) >= 1024 or size > 1 << 23:
                yield packed()
                found.clear()
                size = 0
        if found:
            yield packed()

    return dealt.mapInArrow(run, schema)
