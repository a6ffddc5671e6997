"""Chat formatting at token level.

A turn is five segments, encoded separately and joined by reserved ids: START, role, ROLE
END, text, END.  Lengths of segments give offsets and the loss mask by prefix sums.  The
string form is ``### role: text</turn>\\n``; control strings inside roles and texts are
escaped with a backslash, so that what reads like a turn inside a text never is one.

Encoding runs on turns wherever they lie; only then are turns brought together, and a
conversation streams through its task turn by turn, never held as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tidy

#: Reserved ids, behind the tokenizer's own.
START, ROLE_END, END = 50257, 50258, 50259
HEAD, COLON, CLOSE = "### ", ": ", "</turn>\n"
LEARNT_ROLE = "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def loss_mask(lengths: list[int], learnt: list[bool]) -> np.ndarray:
    """1 where a segment is learnt: prefix sums of +1 at its start and -1 at its end."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    steps = np.zeros(bounds[-1] + 1, np.int8)
    on = np.array(learnt, np.int8)
    np.add.at(steps, bounds[:-1], on)
    np.add.at(steps, bounds[1:], -on)
    return np.cumsum(steps[:-1], dtype=np.int8)


def formatted_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(conv_id, position, formatted, ids, mask, char_start, token_start)`` per turn.

    Turns are by number (null first), ties by role, then text; a null role or text is
    empty; a null conversation id is a conversation of its own.  ``ids`` are little-endian
    32-bit numbers, ``mask`` has a byte for each.  Within a partition, conversations come
    one after another and their turns in order; joined, they are the conversation.
    """
    path = path or tokenizer_path()
    kind = dict(conversations.dtypes)[conv_col]

    def encode(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            for i in range(0, len(texts), 500):
                role = [escape_role(x) for x in roles[i : i + 500]]
                text = [escape(x) for x in texts[i : i + 500]]
                codes = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch(role + text, add_special_tokens=False)]
                ids, masks, strings = [], [], []
                for k, (r, t) in enumerate(zip(role, text, strict=True)):
                    segments = [[START], codes[k], [ROLE_END], codes[len(role) + k], [END]]
                    ids.append(np.concatenate(segments).astype("<u4").tobytes())
                    learnt = roles[i + k] == LEARNT_ROLE
                    masks.append(loss_mask([len(s) for s in segments], [False, False, False, learnt, False]).tobytes())
                    strings.append(HEAD + r + COLON + t + CLOSE)
                part = batch.slice(i, len(text))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(strings), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=["conv_id", "turn", "role", "formatted", "ids", "mask"])

    def assemble(batches):
        conv, place = None, [0, 0, 0]
        for batch in batches:
            out = [[], [], []]
            names = batch.column(0).to_pylist()
            sizes = zip(names, batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
            for name, string, mask in sizes:
                if name != conv or place is None:
                    conv, place = name, [0, 0, 0]
                for column, value in zip(out, place, strict=True):
                    column.append(value)
                place = [place[0] + 1, place[1] + len(string), place[2] + len(mask)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), batch.column(3), batch.column(4), batch.column(5), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["conv_id", "position", "formatted", "ids", "mask", "char_start", "token_start"])

    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turns = rows.mapInArrow(tidy(encode), f"conv_id {kind}, turn long, role string, formatted string, ids binary, mask binary")
    turns = turns.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return turns.mapInArrow(tidy(assemble), f"conv_id {kind}, position long, formatted string, ids binary, mask binary, char_start long, token_start long")


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    Roles and texts are parsed from the strings, learnt texts decoded from the ids under
    the mask; a hash runs along each conversation.  Ids may have any type; rows with a null
    id are one conversation; no rows give none.
    """
    path = path or tokenizer_path()
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches):
        tokenizer = _tokenizer(path)
        conv, state, id_type = None, None, pa.null()
        for batch in batches:
            done, id_type = [], batch.schema.field("conv_id").type
            names, strings, ids, masks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "ids", "mask"))
            learnt = [np.frombuffer(i, "<u4")[np.frombuffer(m, np.int8) > 0] for i, m in zip(ids, masks, strict=True)]
            decoded = tokenizer.decode_batch([x.tolist() for x in learnt], skip_special_tokens=False)
            for name, string, tokens in zip(names, strings, decoded, strict=True):
                if state is None or name != conv:
                    if state is not None:
                        done.append((conv, state))
                    conv, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                parts = TURN.fullmatch(string)
                for x in (unescape(parts[1]), "\n", unescape(parts[2]), "\n"):
                    state[1].update(x.encode())
                text = unescape(tokens)
                state[3].update(text.encode())
                state[0], state[2], state[4] = state[0] + 1, state[2] + len(text), state[4] + len(string)
            if done:
                yield table(done, id_type)
        if state is not None:
            yield table([(conv, state)], id_type)

    def table(done, id_type):
        rows = [(c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for c, s in done]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = [pa.array(c) if i else pa.array(c, id_type) for i, c in enumerate(zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return turns.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
