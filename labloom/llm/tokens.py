"""Encoding of texts with a public byte-level BPE vocabulary, by tree concatenation.

Texts of up to ``piece_chars`` characters are encoded where they are read. Longer ones are cut into pieces which are
encoded in parallel on all executors; pieces are then joined pairwise, as a tree, and around each join a window is
encoded again. The window grows until both sides agree with the encoding of the whole: until it begins and ends at a
place where the pre-tokenizer is bound to break whatever stands before or after (between a character that is no white
space and one that is). Beyond such a place either side's ids are those of the whole text, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value of the public vocabulary: its pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 32_768
#: Rows are handed to the tokenizer in slices of about so many characters, so that memory doesn't follow the batch.
SLICE_CHARS = 1_000_000


def load_encoder(tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The encoder of a ``.tiktoken`` rank file; kept in the Python worker between tasks."""
    import base64
    import sys
    import types

    import tiktoken

    kept = sys.modules.setdefault("_labloom_encoders", types.ModuleType("_labloom_encoders")).__dict__
    if (tokenizer, folder) not in kept:
        with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[tokenizer, folder] = tiktoken.Encoding(tokenizer, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[tokenizer, folder]


def _break_before(text: str, start: int, stop: int) -> int:
    """The last place p in [start, stop) with white space at p and none at p - 1, or -1."""
    for p in range(stop - 1, max(start, 1) - 1, -1):
        if text[p].isspace() and not text[p - 1].isspace():
            return p
    return -1


def _break_after(text: str) -> int:
    """The first place p >= 1 with white space at p and none at p - 1, or -1."""
    for p in range(1, len(text)):
        if text[p].isspace() and not text[p - 1].isspace():
            return p
    return -1


def join_encoded(encoder, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The exact encoding of left text + right text from the encodings of both.

    The window around the join doubles until it ends at sure breaks on both sides, at the outer ends if there are none.
    """
    (lt, li), (rt, ri) = left, right
    if not lt or not rt:
        return lt + rt, li + ri
    width, a, b = 64, -1, -1
    while True:
        if a < 0:
            a = _break_before(lt, len(lt) - width, len(lt))
        if b < 0:
            b = _break_after(rt[:width])
        if (a >= 0 or width >= len(lt)) and (b >= 0 or width >= len(rt)):
            break
        width *= 2
    a, b = max(a, 0), len(rt) if b < 0 else b

    def tokens_over(ids: Iterator[int], n_bytes: int) -> int:
        n = 0
        for t in ids:
            if n_bytes <= 0:
                break
            n_bytes -= len(encoder.decode_single_token_bytes(t))
            n += 1
        assert n_bytes == 0, "a sure break must be the edge of a token"
        return n

    drop = tokens_over(reversed(li), len(lt[a:].encode()))
    skip = tokens_over(iter(ri), len(rt[:b].encode()))
    return lt + rt, li[: len(li) - drop] + encoder.encode_ordinary(lt[a:] + rt[:b]) + ri[skip:]


def join_tree(encoder, parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
    """Pieces joined pairwise until one is left."""
    while len(parts) > 1:
        parts = [join_encoded(encoder, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode_batches(tokenizer: str, folder: str, counts: bool):
    """For mapInArrow: the last column is the text; it becomes ids, or their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = load_encoder(tokenizer, folder)
        for batch in batches:
            names = batch.schema.names[:-1] + ["n_tokens" if counts else "ids"]
            for start, end in _slices(texts := batch.column(batch.num_columns - 1).to_pylist()):
                ids = [encoder.encode_ordinary(t) if t else [] for t in texts[start:end]]
                lens = np.fromiter(map(len, ids), np.int32, len(ids))
                if counts:
                    out = pa.array(lens.astype(np.int64))
                else:
                    flat = np.fromiter((x for i in ids for x in i), np.int32, int(lens.sum()))
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat))
                kept = [batch.column(i).slice(start, end - start) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, out], names)

    return run


def _join_groups(tokenizer: str, folder: str, counts: bool):
    """For applyInArrow: all pieces of one text (several times, if its row is repeated) become its row or rows."""

    def run(key, pieces):
        encoder = load_encoder(tokenizer, folder)
        first, parts = {}, pieces.select(["k", "piece", "ids"]).to_pylist()
        for p in parts:
            first.setdefault(p["k"], (p["piece"], p["ids"]))
        times = sum(p["k"] == 0 for p in parts)
        ids = join_tree(encoder, [first[k] for k in sorted(first)])[1]
        kept = [pa.array([key[0].as_py()] * times, pieces.schema.field(0).type), pa.array([key[1].as_py()] * times, pa.string())]
        if counts:
            return pa.Table.from_arrays([*kept, pa.array([len(ids)] * times, pa.int64())], ["_id", "_extra", "n_tokens"])
        return pa.Table.from_arrays([*kept, pa.array([ids] * times, pa.list_(pa.int32()))], ["_id", "_extra", "ids"])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extra_col: str | None = None, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR, piece_chars: int = PIECE_CHARS, counts: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id, ``extra_col`` (a string column) if asked for, and ``ids`` array<int> (or ``n_tokens``).

    Null and empty texts give an empty list (0 tokens). Null ids are kept. Repeated rows give repeated rows. Strings that
    look like special tokens are ordinary text. Other columns are ignored, whatever their names.
    Only texts longer than ``piece_chars`` are shuffled, in pieces; texts go through whole.
    """
    cols = [F.col(id_col).alias("_id"), (F.col(extra_col) if extra_col else F.lit(None)).cast("string").alias("_extra"), F.col(text_col).alias("_text")]
    docs = docs.select(*cols)
    id_type, out = docs.schema["_id"].dataType.simpleString(), "n_tokens bigint" if counts else "ids array<int>"
    short = docs.where(F.col("_text").isNull() | (F.length("_text") <= piece_chars)).mapInArrow(_encode_batches(tokenizer, folder, counts), f"_id {id_type}, _extra string, {out}")
    last = F.floor((F.length("_text") - 1) / piece_chars).cast("int")
    pieces = docs.where(F.length("_text") > piece_chars).select("_id", "_extra", F.xxhash64("_text").alias("_h"), "_text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    pieces = pieces.select("_id", "_extra", "_h", "k", F.expr(f"substring(_text, k * {piece_chars} + 1, {piece_chars})").alias("piece")).repartition("_h", "k")
    done = pieces.select("_id", "_extra", "_h", "k", "piece", F.col("piece").alias("_text")).mapInArrow(_encode_batches(tokenizer, folder, False), f"_id {id_type}, _extra string, _h bigint, k int, piece string, ids array<int>")
    long = done.groupBy("_id", "_extra", "_h").applyInArrow(_join_groups(tokenizer, folder, counts), f"_id {id_type}, _extra string, {out}")
    both = short.unionByName(long)
    named = [F.col("_id").alias(id_col), *([F.col("_extra").alias(extra_col)] if extra_col else []), F.col(out.split()[0])]
    return both.select(*named)
