"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut into pieces by the tokenizer's pattern. The pairs of neighbouring parts of a piece stand at the byte position
where their left part begins; a segment tree over these positions holds the pair's rank and its position in one number, so
the root is the leftmost pair of least rank. A merge writes three leaves (its own, its live left neighbour's and the one
that it swallows) and the paths above them: O(n log n) for a piece of n bytes, however long.

Pieces recur, so a task keeps the ids of pieces it has met; the store is bounded by CACHE_PIECES entries of at most
CACHE_BYTES letters and starts anew when full and with each task, which never changes a result.

Defined cases: a null text counts as empty and has no ids (sha256 of nothing); texts are encoded whole, without special
tokens; repeated rows give repeated rows; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidy

CACHE_PIECES = 450_000
CACHE_BYTES = 48
ENCODE_ROWS = 500
NEVER = 1 << 62
POSITION_BITS = 32
POSITION_MASK = (1 << POSITION_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NEVER] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r << POSITION_BITS | i
    for k in range(width - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after = list(range(1, n + 2))  # where the part that begins here ends
    before = list(range(-1, n))
    while (top := tree[1]) < NEVER:
        i = top & POSITION_MASK
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        at = below = above = width + i
        if end < n:
            r = get(piece[i : after[end]])
            tree[at] = NEVER if r is None else r << POSITION_BITS | i
        else:
            tree[at] = NEVER
        if j < n - 1:
            above = width + j
            tree[above] = NEVER
        p = before[i]
        if p >= 0:
            below = width + p
            r = get(piece[p:end])
            tree[below] = NEVER if r is None else r << POSITION_BITS | p
        while above > 1:  # the paths of the three leaves, which soon meet
            above >>= 1
            x, y = tree[2 * above], tree[2 * above + 1]
            tree[above] = x if x < y else y
            at >>= 1
            if at != above:
                x, y = tree[2 * at], tree[2 * at + 1]
                tree[at] = x if x < y else y
            below >>= 1
            if below != at:
                x, y = tree[2 * below], tree[2 * below + 1]
                tree[below] = x if x < y else y
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, bytes]] = {}

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in merge_piece(piece.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _meet(self, piece: str) -> tuple[str, bytes]:
        ids = merge_piece(piece.encode(), self.ranks)
        found = ",".join(map(str, ids)), self.decode(ids)
        if len(piece) <= CACHE_BYTES:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the decimal ids joined by commas, the decoded bytes."""
        known, meet = self.known.get, self._meet
        found = [known(p) or meet(p) for p in self.split(text)]
        ids = ",".join([x[0] for x in found])
        return (ids.count(",") + 1 if ids else 0), ids, b"".join([x[1] for x in found])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, with an empty store; ranks are read where the worker runs."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    _codecs[path, pattern].known.clear()
    return _codecs[path, pattern]


def _by_text(docs: DataFrame, text_col: str, schema: str, types: list[pa.DataType], row: Callable[[Codec, str], tuple], path: str, pattern: str) -> DataFrame:
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made = [row(own, t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
            arrays |= {f: pa.array([m[k] for m in made], t) for k, (f, t) in enumerate(zip(fields, types, strict=True))}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
        own.known.clear()

    rest = docs.select([c for c in docs.columns if c not in fields])
    from pyspark.sql import types as T

    out = T.StructType([*rest.schema.fields, *T._parse_datatype_string(schema).fields])
    return rest.mapInArrow(tidy(run), out)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, token_ids array<int>, and decoded_sha256 of the bytes that the ids decode to."""
    from pyspark.sql import types as T

    ours = ("n_tokens", "token_ids", "decoded_sha256")
    rest = docs.select([c for c in docs.columns if c not in ours])
    schema = T.StructType([*rest.schema.fields, *T._parse_datatype_string("n_tokens long, token_ids array<int>, decoded_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(start, ENCODE_ROWS)
                made = [own.digest(t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([n for n, _, _ in made])]).astype(np.int32)
                flat = np.array(",".join(ids for n, ids, _ in made if n).split(","), dtype=np.int32) if offsets[-1] else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array([sha256(d).hexdigest() for _, _, d in made])], names=[*batch.schema.names, *ours])
        own.known.clear()

    return rest.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """encoded with decoded, the bytes of its ids; null ids give empty bytes."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield batch.append_column("decoded", pa.array([own.decode(x or []) for x in ids], pa.binary()))

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids are encoded and decoded in one pass."""

    def row(own: Codec, text: str) -> tuple[int, str, str]:
        n, ids, decoded = own.digest(text)
        return n, sha256(ids.encode()).hexdigest(), sha256(decoded).hexdigest()

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = _by_text(slim, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], row, path, pattern)
    return out.drop("text")
