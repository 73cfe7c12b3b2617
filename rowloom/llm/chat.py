"""Chat formatting by prefix-target expansion.

A conversation is formatted turn by turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.
Backslashes and ``<|`` in roles and texts (and line feeds in roles) are escaped by
a backslash, so no text can forge a control string and ``parse`` gets it back.

Every assistant turn is an example of its own: all preceding turns are its
context, and only the reply's text is trainable. ``expand`` writes each example
out: a row for each turn, and that of an assistant turn holds its whole context
and the place of its loss span in the example's text, which is context and turn.
Rows of other turns hold the turn alone; they are no examples, and keep what no
reply follows. So the output grows with the square of a conversation's length.
``materialize`` returns the examples alone. ``digest`` reads all back example by
example: it hashes each one's whole text, applies the loss mask to that text, and
raises ``ValueError`` where a text is not that of the turns up to its own.

Turns stream through a task in order: a task holds the text of one conversation,
to repeat it, and writes some WRITTEN bytes of contexts at a time. A
conversation is read by one task, as the digest of its turns demands, with a
memory of one batch. Reading back takes no exchange of its own; that of stored
rows takes one, in which examples travel as the digests of their texts.

Defined results: a null role or text is empty; turns come by turn (null first),
then role, then text, and repeated rows are turns of their own; rows with a null
conv_id are one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import tasks

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Bytes of contexts that are written at a time.
WRITTEN = 1 << 24


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (segment.startswith(START) and segment.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, text = segment[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, segment, loss_start, loss_end); the loss span is null but for a reply's text."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    trained = F.col("role") == TRAINED_ROLE
    return rows.select(
        "conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(trained, F.length(head)).alias("loss_start"), F.when(trained, F.length(head) + F.length(body)).alias("loss_end"),
    )


def _turns(batch: pa.RecordBatch, first: int, rows: list[tuple]) -> pa.RecordBatch:
    """The expanded rows of a batch's turns from the first."""
    kinds = {"place": pa.int64(), "begin": pa.int64(), "context": pa.string(), "example": pa.int64(), "loss_start": pa.int64(), "loss_end": pa.int64()}
    made = {n: pa.array(x, k) for x, (n, k) in zip(zip(*rows, strict=True), kinds.items(), strict=True)}
    made |= {n: batch.column(n).slice(first, len(rows)) for n in ("conv_id", "segment")}
    names = ["conv_id", "place", "begin", "context", "segment", "example", "loss_start", "loss_end"]
    return pa.RecordBatch.from_arrays([made[n] for n in names], names=names)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = object()
    place = begin = example = 0
    before = bytearray()
    for batch in batches:
        rows: list[tuple] = []
        first = held = 0
        lengths = pc.utf8_length(batch.column("segment")).to_pylist()
        plain = (batch.column(n).to_pylist() for n in ("conv_id", "loss_start", "loss_end"))
        for segment, length, c, low, high in zip(batch.column("segment"), lengths, *plain, strict=True):
            if c != conv:
                conv, place, begin, example, before = c, 0, 0, 0, bytearray()
            if low is None:
                rows.append((place, begin, None, None, None, None))
            else:
                rows.append((place, begin, bytes(before), example, begin + low, begin + high))
                held += len(before)
                example += 1
            before += segment.as_buffer()
            place, begin = place + 1, begin + length
            if held >= WRITTEN:
                yield _turns(batch, first, rows)
                first, held, rows = first + len(rows), 0, []
        if rows:
            yield _turns(batch, first, rows)


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, begin, context, segment, example, loss_start, loss_end): the turns, and of each assistant turn its example.

    place counts a conversation's turns, example its assistant turns. An example's
    text is context, which is that of all turns before it, and segment; begin and
    the loss span count its code points. context, example and the loss span are
    null in rows of other turns. Each conversation's rows come in order, in one partition.
    """
    rows = segments(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition(tasks(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        _streamed, f"conv_id {kind}, place long, begin long, context string, segment string, example long, loss_start long, loss_end long"
    )


def materialize(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with each example's whole text."""
    text = F.concat("context", "segment").alias("text")
    return expanded.where(F.col("example").isNotNull()).select("conv_id", "example", text, "loss_start", "loss_end")


READ = "place long, segment string, loss_start long, loss_end long, chars long, sha256 string, reply string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example read by itself: its whole text's length and digest, and what the mask covers of it."""
    for batch in batches:
        chars: list[int | None] = []
        digests: list[str | None] = []
        replies: list[str | None] = []
        lengths = pc.utf8_length(batch.column("context")).to_pylist()
        spans = (batch.column(n).to_pylist() for n in ("loss_start", "loss_end"))
        for context, segment, length, low, high in zip(batch.column("context"), batch.column("segment"), lengths, *spans, strict=True):
            n = whole = reply = None
            if low is not None:
                turn = segment.as_py()
                n = length + len(turn)
                if not length <= low <= high <= n:
                    raise ValueError("a loss mask reaches beyond its reply")
                text = hashlib.sha256(context.as_buffer())
                text.update(segment.as_buffer())
                whole = text.hexdigest()
                reply = re.sub(r"\\(.)", r"\1", turn[low - length : high - length], flags=re.DOTALL)
            chars.append(n)
            digests.append(whole)
            replies.append(reply)
        kept = ["conv_id", "place", "segment", "loss_start", "loss_end"]
        arrays = [pa.array(chars, pa.int64()), pa.array(digests, pa.string()), pa.array(replies, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *arrays], names=[*kept, "chars", "sha256", "reply"])


class _Conversation:
    """What has been read of a conversation's turns and examples."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss = self.examples = self.example_chars = 0
        self.text, self.said, self.trained, self.listed = (hashlib.sha256() for _ in range(4))

    def read(self, segment: str, low: int | None, high: int | None, chars: int, whole: str, reply: str) -> None:
        role, text = parse(segment)
        self.turns += 1
        self.chars += len(segment)
        self.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.text.update(segment.encode("utf-8", "surrogatepass"))
        if low is not None:
            if whole != self.text.hexdigest():
                raise ValueError("an example's text is not that of the turns up to its own")
            self.loss += len(reply)
            self.trained.update(reply.encode("utf-8", "surrogatepass"))
            self.examples += 1
            self.example_chars += chars
            self.listed.update(f"{whole}:{low}:{high}\n".encode())

    def row(self, conv: object) -> tuple:
        return conv, self.turns, self.said.hexdigest(), self.loss, self.trained.hexdigest(), self.chars, self.examples, self.example_chars, self.listed.hexdigest()


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long, examples_sha256 string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *(f.split()[0] for f in DIGEST.split(", "))]
    conv, state = None, None
    done: list[tuple] = []
    kind = pa.int64()

    def made() -> pa.RecordBatch:
        columns = [pa.array(list(x)) for x in zip(*done, strict=True)]
        columns[0] = columns[0].cast(kind)
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        kind = batch.column("conv_id").type
        for c, *turn in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end", "chars", "sha256", "reply")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    done.append(state.row(conv))
                conv, state = c, _Conversation()
            state.read(*turn)
        if done:
            yield made()
            done.clear()
    if state is not None:
        done.append(state.row(conv))
        yield made()


def _read_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _read_back(_read(batches))


def digest(expanded: DataFrame, placed: bool = False) -> DataFrame:
    """A row for each conversation, all of it read back from expanded rows.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars):
    formatted_chars counts each turn once. n_examples, example_chars (of whole
    examples) and examples_sha256, of a line ``digest of the whole text:loss
    start:loss end`` for each example. placed: the rows come as ``expand`` gives
    them; else, as from storage, they are dealt and put in order again once read.
    """
    kind = expanded.schema["conv_id"].dataType.simpleString()
    if placed:
        return expanded.mapInArrow(_read_in_order, f"conv_id {kind}, {DIGEST}")
    read = expanded.mapInArrow(_read, f"conv_id {kind}, {READ}")
    return read.repartition(tasks(read), "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_read_back, f"conv_id {kind}, {DIGEST}")
