"""Chat formatting on the token level.

A turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Role, text and newline are encoded separately and
the two reserved ids are spliced between them, so nothing in a text can become a control token; control strings in a
text are escaped as well, reversibly. Loss falls on the assistant's text alone: edges of +1 and -1, summed up.

Turns are encoded where they are read; a conversation's turns, in order, are then rows of the output (its tokens are
the rows' ids end to end), so that a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BatchEncoder, id_bytes
from .common import filled, map_batches, slices

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
TURNS = "conv_id long, turn_no long, token_start long, ids array<int>, loss array<boolean>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""``<|`` as ``<\|``, and one backslash more wherever some stand between the two."""
    return _OPEN.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reserved(tokenizer_path: str) -> tuple[int, int]:
    """Ids of ``START`` and ``END``, past the vocabulary."""
    n = len(id_bytes(tokenizer_path))
    return n, n + 1


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows ``conv_id, turn_no, token_start, ids, loss`` of ``turns`` (``conv_id, turn, role, text``; others ignored).

    Turns are in the order of (turn, role, text), nulls first, numbered from 0; repeated ones are kept. Null texts and
    roles are empty. Rows with a null conv_id are one conversation. An empty table gives no row.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(tokenizer_path)
        start, end = reserved(tokenizer_path)
        newline = encoder.encode(pa.array(["\n"]))[0]
        for batch in batches:
            for a, b in slices(filled(batch.column("text"))):
                part = batch.slice(a, b - a)
                roles = filled(part.column("role")).to_pylist()
                heads, head_at = encoder.encode(pa.array([f"{escape_role(r)}\n" for r in roles], pa.string()))
                flat, at = encoder.encode(pa.array([escape(t) for t in filled(part.column("text")).to_pylist()], pa.string()))
                ids, loss = [], []
                for k, role in enumerate(roles):
                    head, body = heads[head_at[k] : head_at[k + 1]], flat[at[k] : at[k + 1]]
                    own = np.concatenate([[start], head, body, [end], newline]).astype(np.int32)
                    edges = np.zeros(len(own) + 1, np.int8)
                    if role == LOSS_ROLE:
                        edges[1 + len(head)] += 1
                        edges[1 + len(head) + len(body)] -= 1
                    ids.append(own)
                    loss.append(np.cumsum(edges[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], ["conv_id", "turn", "role", "text", "ids", "loss"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, place, any_yet = None, 0, 0, False
        for batch in batches:
            turn_no, starts = [], []
            for conv, n in zip(batch.column("conv_id").to_pylist(), batch.column("ids").value_lengths().to_pylist(), strict=True):
                if conv != now or not any_yet:
                    now, turn, place, any_yet = conv, 0, 0, True
                turn_no.append(turn)
                starts.append(place)
                turn, place = turn + 1, place + n
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turn_no, pa.int64()), pa.array(starts, pa.int64()), batch.column("ids"), batch.column("loss")], ["conv_id", "turn_no", "token_start", "ids", "loss"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    coded = map_batches(rows, encode, "conv_id long, turn long, role string, text string, ids array<int>, loss array<boolean>")
    # the ids of equal turns are equal, so only what decides the order goes along
    ordered = coded.select("conv_id", "turn", "role", "text", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(ordered.select("conv_id", "ids", "loss"), number, TURNS)


def digest_conversations(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, decoded from the tokens and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (start, end) = id_bytes(tokenizer_path), reserved(tokenizer_path)
        text_of = lambda ids: b"".join(map(table.__getitem__, ids)).decode()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, any_yet, state = None, False, None

        def row():
            turns, loss = state["turns"], state["loss"]
            return [now, state["n"], turns.hexdigest(), state["loss_chars"], loss.hexdigest(), state["chars"]]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            out = []
            for conv, ids, loss in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if conv != now or not any_yet:
                    if any_yet:
                        out.append(row())
                    now, any_yet, state = conv, True, {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0}
                stop = ids.index(end)
                if ids[0] != start or start in ids[1:] or end in ids[stop + 1 :]:
                    raise ValueError(f"conversation {conv} has a turn out of shape")
                inside, behind = text_of(ids[1:stop]), text_of(ids[stop + 1 :])
                role, _, text = inside.partition("\n")
                state["turns"].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                lost = unescape(text_of(itertools.compress(ids, loss)))
                state["loss"].update(lost.encode())
                state["loss_chars"] += len(lost)
                state["n"] += 1
                state["chars"] += len(START) + len(inside) + len(END) + len(behind)
            if out:
                yield batch_of(out)
        if any_yet:
            yield batch_of([row()])

    ordered = formatted.select("conv_id", "turn_no", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return map_batches(ordered.select("conv_id", "ids", "loss"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
