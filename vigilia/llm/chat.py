"""Chat formatting with loss masks aligned by offsets.

A whole conversation is rendered once and encoded once. The tokenizer's offsets
are then intersected with the sorted spans of the assistant's texts by binary
search, so the mask needs no second tokenization of parts.

The template is ``<|turn|>role<|says|>text<|end|>`` for each turn. The three
markers are special tokens, hence no token straddles a marker and a text. Within
roles and texts every ``<``, backslashes, ``|`` gets one backslash more, so no
marker can appear there; taking that backslash away restores them exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")
_PARSE = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)

SCHEMA = ("formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, "
          "loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m.group(1)[1:]}|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts to be learnt."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns a formatted conversation was made from."""
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


def intersect(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list]:
    """(mask, pieces): which tokens overlap a span, and the text they cover in
    it. Tokens and spans are sorted; each span finds its tokens by bisection."""
    mask, pieces = np.zeros(len(starts), dtype=bool), []
    for a, b in spans:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if j > i:
            mask[i:j] = ends[i:j] > starts[i:j]
            pieces.append((max(int(starts[i]), a), min(int(ends[j - 1]), b)))
    return mask, pieces


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, SAYS, END)])
    return tokenizer


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n_turns and, for each conversation, its formatted text, token
    ids, token offsets (code points), loss mask and the spans under the mask.

    ``rows`` has conv_id, turn, role, text; null roles and texts are empty, rows
    of a null conv_id are one conversation, equal turn numbers go by role and
    text, repeated rows are turns of their own. A conversation is one value, so
    one task holds it; nothing larger is gathered.
    """
    turns = F.transform(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rendered = [render([(t["role"], t["text"]) for t in c]) for c in batch.column("turns").to_pylist()]
                out = []
                for (text, spans), got in zip(rendered, tokenizer.encode_batch(
                        [t for t, _ in rendered], add_special_tokens=False)):
                    offsets = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
                    # Bytes of one character share its offsets; running maxima keep both ends sorted.
                    starts, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
                    mask, pieces = intersect(starts, ends, spans)
                    out.append((text, got.ids, starts, ends, mask, pieces))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("n_turns"), pa.array(columns[0], pa.string()),
                     *(pa.array([np.asarray(x, dtype=np.int32) for x in c], pa.list_(pa.int32())) for c in columns[1:4]),
                     pa.array(list(columns[4]), pa.list_(pa.bool_())),
                     pa.array([[{"start": a, "end": b} for a, b in c] for c in columns[5]],
                              pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    ["conv_id", "n_turns", "formatted", "ids", "token_starts", "token_ends", "loss_mask", "loss_spans"])

    return (grouped.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "turns")
            .mapInArrow(run, "conv_id bigint, n_turns bigint, " + SCHEMA))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = read_back(text)
                said = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                out.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), said, len(text)))
            sha = [[hashlib.sha256(o[k].encode()).hexdigest() for o in out] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([o[0] for o in out], pa.int64()), pa.array(sha[0], pa.string()),
                 pa.array([len(o[2]) for o in out], pa.int64()), pa.array(sha[1], pa.string()),
                 pa.array([o[3] for o in out], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
             "loss_sha256 string, formatted_chars bigint")
