"""Conversations as one text each, with a loss mask that follows token offsets.

A turn is `<|turn|>role<|says|>text</s>`. The markers are tokens of their own,
so no token crosses the border of a text. A control string inside a role or a
text gets a backslash after its first character (one more, if there are some
already), which reading back takes away.

Conversations are dealt by id and sorted within each task; a very long one
comes in parts of whole turns, so memory is bounded by a part. Null roles and
texts count as empty. Repeated turn numbers are ordered by role, then text.
Rows without a conversation id form one conversation without id.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, STOP = "<|turn|>", "<|says|>", "</s>"
#: Strings that some template or tokenizer gives a meaning.
CONTROL = (TURN, SAYS, STOP, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|startoftext|>")
#: Characters of formatted text in a part, about.
PART = 1 << 20

_CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
_READ = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(STOP)}", re.S)
PARTS = "conv_id long, part int, formatted string, ids binary, starts binary, stops binary, loss binary"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and where the texts of the assistant stand in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + SAYS, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, STOP]
        at += len(head) + len(body) + len(STOP)
    return "".join(out), spans


def loss_mask(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens inside the spans, which are found in the sorted tokens by binary search."""
    mask = np.zeros(len(starts), np.uint8)
    if spans:
        begin, end = np.array(spans).T
        for a, b in zip(np.searchsorted(starts, begin), np.searchsorted(stops, end, "right")):
            mask[a:b] = 1
    return mask


def load_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets with the blank before a word
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, SAYS, STOP)])
    return tokenizer


_loaded: dict[str, object] = {}


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Formatted text, token ids, their character offsets and loss mask (32-bit numbers; one byte a token), by part."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def encoded(tokens, pending):
        texts, spans = zip(*(render(turns) for _, _, turns in pending))
        columns = [[] for _ in range(4)]
        for found, span in zip(tokens.encode_batch(list(texts), add_special_tokens=False), spans):
            offsets = np.array(found.offsets, "<u4").reshape(-1, 2)
            starts, stops = offsets[:, 0].copy(), offsets[:, 1].copy()
            for c, x in zip(columns, (np.array(found.ids, "<u4"), starts, stops, loss_mask(starts, stops, span))):
                c.append(x.tobytes())
        return pa.record_batch(
            [pa.array([k for k, _, _ in pending], pa.int64()), pa.array([p for _, p, _ in pending], pa.int32()),
             pa.array(texts, pa.string()), *(pa.array(c, pa.binary()) for c in columns)],
            names=["conv_id", "part", "formatted", "ids", "starts", "stops", "loss"])

    def run(batches):
        tokens = _loaded.get(tokenizer) or load_tokenizer(tokenizer)
        _loaded[tokenizer] = tokens
        pending, size, total = [], 0, 0
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not pending or pending[-1][0] != key:
                    if total > PART:
                        yield encoded(tokens, pending)
                        pending, total = [], 0
                    pending.append((key, 0, []))
                    size = 0
                elif size > PART:  # the next part of a long conversation
                    part = pending[-1][1]
                    yield encoded(tokens, pending)
                    pending, size, total = [(key, part + 1, [])], 0, 0
                pending[-1][2].append((role, text))
                size, total = size + len(text), total + len(text)
        if pending:
            yield encoded(tokens, pending)

    return dealt.mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns, and the text under the loss mask. Parts must come in order."""
    columns = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
               "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_tokens": pa.int64()}
    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in columns.items())

    def run(batches):
        open_ = False
        state: list = []

        def closed(states):
            rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in s] for s in states]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), columns.values())], names=list(columns))

        for batch in batches:
            done = []
            names = ("conv_id", "part", "formatted", "starts", "stops", "loss")
            for key, part, text, starts, stops, loss in zip(*(batch.column(c).to_pylist() for c in names)):
                if part == 0:
                    if open_:
                        done.append(state)
                    state, open_ = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
                for m in _READ.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                mask = np.frombuffer(loss, np.uint8)
                begin, end = np.frombuffer(starts, "<u4"), np.frombuffer(stops, "<u4")
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2]):
                    said = unescape(text[begin[a] : end[b - 1]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += len(mask)
            if done:
                yield closed(done)
        if open_:
            yield closed([state])

    return parts.mapInArrow(run, schema)
