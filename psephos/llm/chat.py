"""Chat formatting by token-level assembly.

Each segment (a turn's text) is encoded by itself with an ordinary byte-level vocabulary, so content can't give a
reserved id whatever it says. Turn marks are ids beyond the vocabulary, spliced in between: a turn is
``<start> role-id text ids <end>``. The loss mask covers the text of assistant turns and the end mark after it; offsets
in tokens, characters and loss characters are prefix sums over the turns.

The rendered string has the same marks as visible control strings. Where a text itself holds something that reads as a
control string, an escape sign is put behind its first character (and one more where such signs already stand), so that
the string can be read back turn by turn.

Turns are encoded where they lie, before any shuffle. A conversation is then streamed in the order of its turns through
one task, a turn at a time, so a long conversation needs no more memory than its longest turn there; only its digests
and lengths are kept. ``formatted_conversations`` instead returns whole strings and token lists for training.

Cases: null text is empty; null role is an empty role; null turns come first, ties are ordered by role and text, so
repeated rows stay as repeated turns; null conv_id is a conversation of its own kind; no rows give no conversation;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that belongs to the vocabulary file (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

START, END, ROLE_END = "<s>", "</s>", "[/ROLE]"
ROLE = "[ROLE]"
#: What reads as a control string in the rendered form, this template's and other common ones'.
CONTROL = (START, END, ROLE, ROLE_END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\u001a"
_HIDE = re.compile("|".join(f"{re.escape(c[0])}(?={ESCAPE}*{re.escape(c[1:])})" for c in CONTROL))
_SHOW = re.compile("|".join(f"({re.escape(c[0])}){ESCAPE}(?={ESCAPE}*{re.escape(c[1:])})" for c in CONTROL))


def escaped(text: str) -> str:
    """The text without a control string: each gets an escape sign behind its first character."""
    return _HIDE.sub(lambda m: m[0] + ESCAPE, text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return _SHOW.sub(lambda m: m[0][:-1], text) if ESCAPE in text else text


def rendered(role: str, text: str) -> str:
    return f"{START}{ROLE}{escaped(role)}{ROLE_END}{escaped(text)}{END}"


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation; all of the string must be turns."""
    turns, at, opening = [], 0, START + ROLE
    while at < len(formatted):
        middle = formatted.find(ROLE_END, at)
        end = formatted.find(END, middle)
        if not formatted.startswith(opening, at) or middle < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(formatted[at + len(opening) : middle]), unescaped(formatted[middle + len(ROLE_END) : end])))
        at = end + len(END)
    return turns


class Tokens:
    """A byte-level vocabulary with reserved ids behind it: start, end, and one per role."""

    def __init__(self, path: str = TOKENIZER, roles: tuple[str, ...] = ("system", "user", "assistant", "tool")):
        if not os.path.exists(path):
            raise FileNotFoundError(f"{path}: every executor needs this vocabulary file; name its place by the parameter tokenizer")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("segments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        free = max(ranks.values()) + 1
        self.start, self.end, self.text = free, free + 1, free + 2
        self.roles = {r: free + 3 + k for k, r in enumerate(roles)}

    def turn(self, role: str, text: str) -> tuple[list[int], int]:
        """The turn's ids, and how many of them stand before the text. A role without an id is spelled out."""
        head = [self.start, self.roles[role]] if role in self.roles else [self.start, *self.encoding.encode_ordinary(role), self.text]
        return [*head, *self.encoding.encode_ordinary(text), self.end], len(head)

    def read(self, ids: list[int]) -> tuple[str, str, str]:
        """role, text and the rest of the ids as read back from one turn's ids."""
        names = {v: k for k, v in self.roles.items()}
        if ids[1] in names:
            return names[ids[1]], self.encoding.decode(ids[2:-1]), ""
        cut = ids.index(self.text)
        return self.encoding.decode(ids[1:cut]), self.encoding.decode(ids[cut + 1 : -1]), ""


TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, ids array<int>, head int, loss boolean"


def formatted_turns(conversations: DataFrame, tokenizer: str = TOKENIZER, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each row of (conv_id, turn, role, text) with its rendered form, token ids, how many ids stand before its text, and whether it is learned."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            turns = [tokens.turn(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.record_batch(
                {
                    "conv_id": batch.column("conv_id"),
                    "turn": batch.column("turn"),
                    "role": pa.array(roles, pa.string()),
                    "text": pa.array(texts, pa.string()),
                    "formatted": pa.array(list(map(rendered, roles, texts)), pa.string()),
                    "ids": pa.array([ids for ids, _ in turns], pa.list_(pa.int32())),
                    "head": pa.array([n for _, n in turns], pa.int32()),
                    "loss": pa.array([r in learn for r in roles], pa.bool_()),
                }
            )

    rows = conversations.select("conv_id", F.col("turn").cast("bigint"), "role", "text")
    return rows.mapInArrow(encode, TURN_SCHEMA)


def turn_offsets(turns: DataFrame) -> DataFrame:
    """The turns with their place: n_before turns, and the tokens and characters before them, by prefix sums."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0)).cast("bigint")
    return turns.withColumns({"n_before": before(F.lit(1)), "token_start": before(F.size("ids")), "char_start": before(F.length("formatted"))})


def loss_mask(ids: Column, head: Column, loss: Column) -> Column:
    """1 for the text's ids and the end mark of a learned turn."""
    return F.transform(ids, lambda _, k: F.when(loss & (k >= head), F.lit(1)).otherwise(F.lit(0)).cast("byte"))


def formatted_conversations(conversations: DataFrame, **options) -> DataFrame:
    """conv_id, formatted, ids and mask of whole conversations, for conversations that fit in a row."""
    turns = turn_offsets(formatted_turns(conversations, **options)).withColumn("mask", loss_mask(F.col("ids"), F.col("head"), F.col("loss")))
    parts = F.array_sort(F.collect_list(F.struct("n_before", "formatted", "ids", "mask")))
    return turns.groupBy("conv_id").agg(parts.alias("p")).select(
        "conv_id",
        F.array_join("p.formatted", "").alias("formatted"),
        F.flatten("p.ids").alias("ids"),
        F.flatten("p.mask").alias("mask"),
    )


DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"


def digests(conversations: DataFrame, tokenizer: str = TOKENIZER, **options) -> DataFrame:
    """A row per conversation, all read back from the output: turns from the rendered string, the loss text from the masked ids.

    loss_chars and loss_sha256 are of the learned texts without marks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        key, state = None, None

        def row():
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            return pa.record_batch(
                {
                    "conv_id": pa.array([key[0]], pa.int64()),
                    "n_turns": pa.array([state["n"]], pa.int64()),
                    "turns_sha256": pa.array([turns]),
                    "loss_chars": pa.array([state["loss_chars"]], pa.int64()),
                    "loss_sha256": pa.array([loss]),
                    "formatted_chars": pa.array([state["chars"]], pa.int64()),
                    "n_tokens": pa.array([state["tokens"]], pa.int64()),
                    "loss_tokens": pa.array([state["loss_tokens"]], pa.int64()),
                }
            )

        for batch in batches:
            convs, texts, loss, head = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "head"))
            ends = batch.column("ids").offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, starts, stops = batch.column("ids").flatten().to_numpy(), ends[:-1] - ends[0], ends[1:] - ends[0]
            # The mask by prefix sums: it rises where the text of a learned turn begins and falls behind the turn's last id.
            learned = np.array(loss, bool)
            steps = np.zeros(len(ids) + 1, np.int64)
            np.add.at(steps, (starts + np.array(head, np.int64))[learned], 1)
            np.add.at(steps, stops[learned], -1)
            mask = np.cumsum(steps)[:-1] > 0
            spoken = mask & (ids != tokens.end)
            done = []
            for k, (conv, formatted) in enumerate(zip(convs, texts, strict=True)):
                if key != (conv,):
                    if key is not None:
                        done.append(row())
                    key, state = (conv,), {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "loss_chars": 0, "tokens": 0, "loss_tokens": 0}
                for role, text in parsed(formatted):
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                part = slice(starts[k], stops[k])
                text = tokens.encoding.decode(ids[part][spoken[part]].tolist())
                state["loss"].update(text.encode())
                state["loss_chars"] += len(text)
                state["chars"] += len(formatted)
                state["tokens"] += int(stops[k] - starts[k])
                state["loss_tokens"] += int(np.count_nonzero(mask[part]))
            yield from done
        if key is not None:
            yield row()

    turns = formatted_turns(conversations, tokenizer, **options)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "ids", "head", "loss")
    return ordered.mapInArrow(read, DIGEST_SCHEMA)
