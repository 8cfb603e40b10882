"""Byte-level BPE encoding and decoding (operator 9).

``encode`` cuts each text with the vocabulary's pattern and encodes every
distinct piece once per worker with the ``tokenizers`` library: bytes are
mapped to printable characters, the merges are derived from the rank file
(every split of a token whose halves are tokens, in rank order), and a piece
that is itself a token is taken whole, as the rank files are meant to be read.
``decode`` maps ids back through the reversed byte table; ids that end inside
a character are joined before UTF-8 is decoded.

Defined results: a null or empty text has no ids; null ids decode to no
bytes; an id outside the vocabulary raises.  Equal rows give equal rows, extra
columns are kept, and an added column replaces an input column of its name.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tickwise.llm.common import appended, text_slices, with_columns

#: Fixed value: the pattern of the published rank files, for which there is a fast splitter; others run as they are.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pieces kept per worker; the cache starts anew beyond this many
CACHE_PIECES = 200_000


def byte_table() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: 1 letter, 2 number, 3 white space, 0 any other."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for value, name in ((1, "L"), (2, "N"), (3, "White_Space")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 <= b:
                out[a:0xD800], out[0xE000 : b + 1] = value, value
            else:
                out[a : b + 1] = value
    return out


def split_pieces(text: str, classes: np.ndarray) -> list[str]:
    """The matches of KNOWN_PATTERN, found with array operations instead of a match per piece.

    A piece is a run of one class, led by a space (U+0020) if one stands right
    before it; of a longer run of white space only the last character is left
    to what follows; an apostrophe that does not continue a run takes the
    endings s t m d re ve ll as its own piece.
    """
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[code]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    change = kind[1:] != kind[:-1]
    start[1:n] = change
    last = np.flatnonzero(change & (kind[:-1] == 3))  # last white space before something else
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    marks = np.flatnonzero(code == 0x27)
    marks = marks[marks + 1 < n]
    if len(marks):
        marks = marks[(kind[marks + 1] == 1) & ((marks == 0) | (start[marks] & (code[marks - 1] != 0x20)))]
        one = np.isin(code[marks + 1], [ord(c) for c in "stmd"])
        rest = marks[~one & (marks + 2 < n)]
        pair = code[rest + 1].astype(np.uint64) << np.uint64(32) | code[rest + 2]
        two = rest[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
        one = marks[one]
        start[one + 1] = False
        start[one + 2] = True
        start[two + 1] = False
        start[two + 3] = True
    cuts = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class ByteBpe:
    """One vocabulary inside a Python worker."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = load_ranks(path)
        chars = byte_table()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [
            (shown[token[:i]], shown[token[i:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocab = {shown[token]: rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # white space as Unicode defines it; the information separators are not part of it
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.classes = char_classes() if pattern == KNOWN_PATTERN else None
        self.pieces: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return split_pieces(text, self.classes) if self.classes is not None else self.pattern.findall(text)

    def learn(self, pieces: list[list[str]]) -> None:
        """Make every piece of a slice known, encoding the new ones in few calls; ids are kept as packed int32."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        known = self.pieces
        new = list(set().union(*pieces).difference(known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            enc = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(enc.ids, np.int32)
            cuts = np.searchsorted(np.array(enc.word_ids, np.int64), np.arange(len(some) + 1)) * 4
            packed = ids.tobytes()
            cuts = cuts.tolist()
            known.update((p, packed[a:b]) for p, a, b in zip(some, cuts, cuts[1:]))

    def packed(self, found: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, found))

    def ids(self, text: str) -> list[int]:
        found = self.split(text)
        self.learn([found])
        return np.frombuffer(self.packed(found), np.int32).tolist()

    def offsets(self, found: list[str]) -> tuple[list[int], list[int]]:
        """Character span of each token; the parts of one character all carry that character."""
        starts, ends, at = [], [], 0
        for piece, enc in zip(found, self.tokenizer.encode_batch(found, add_special_tokens=False)):
            starts += [at + a for a, _ in enc.offsets]
            ends += [at + b for _, b in enc.offsets]
            at += len(piece)
        return starts, ends

@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes | None]:
    """Bytes of each id: the token's printable characters back through the byte table."""
    chars = byte_table()
    back = {c: b for b, c in enumerate(chars)}
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = bytes(back[c] for c in "".join(chars[b] for b in token))
    return out


@lru_cache(maxsize=2)
def token_column(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.binary())


def decode_lists(ids: pa.ListArray, path: str, rows: int = 256) -> pa.Array:
    """The bytes of every list of ids, ``rows`` lists at a time; no bytes for a missing list."""
    out = []
    for i in range(0, len(ids), rows):
        some = ids.slice(i, rows)
        first, last = some.offsets[0].as_py(), some.offsets[-1].as_py()
        tokens = token_column(path).take(some.values.slice(first, last - first))
        if tokens.null_count:
            raise ValueError("id outside the vocabulary")
        joined = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(some.offsets, first), tokens), b"")
        out.append(pc.if_else(some.is_valid(), joined, pa.scalar(b"", pa.binary())))
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def decode_ids(ids, path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, ids))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """All columns of ``df`` and ``ids``; with ``offsets`` also the character ``starts`` and ``ends`` of the tokens."""
    ints = pa.list_(pa.int32())
    added = [("ids", ints, "array<int>")] + ([("starts", ints, "array<int>"), ("ends", ints, "array<int>")] if offsets else [])
    kept, schema = appended(df, added)

    def run(batches):
        bpe = codec(path, pattern)
        for batch in text_slices(batches, text):
            pieces = [bpe.split(t) if t else [] for t in batch.column(text).to_pylist()]
            bpe.learn(pieces)
            out = [lists([bpe.packed(p) for p in pieces])]
            if offsets:
                out += [pa.array(v, ints) for v in zip(*(bpe.offsets(p) for p in pieces))]
            yield with_columns(batch, kept, [(n, v) for (n, _, _), v in zip(added, out)])

    return df.mapInArrow(run, schema)


def lists(packed: list[bytes]) -> pa.Array:
    """An Arrow list column from packed int32 values."""
    ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
    values = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes of ``ids`` as ``out`` (binary; UTF-8 where the ids cover whole characters)."""
    kept, schema = appended(df, [(out, pa.binary(), "binary")])

    def run(batches):
        for batch in batches:
            yield with_columns(batch, kept, [(out, decode_lists(batch.column(ids), path))])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``df``, ``ids`` and ``decoded``, the bytes that they decode to: both in one Python worker."""
    kept, schema = appended(df, [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.binary(), "binary")])

    def run(batches):
        bpe = codec(path, pattern)
        for batch in text_slices(batches, text):
            pieces = [bpe.split(t) if t else [] for t in batch.column(text).to_pylist()]
            bpe.learn(pieces)
            ids = lists([bpe.packed(p) for p in pieces])
            yield with_columns(batch, kept, [("ids", ids), ("decoded", decode_lists(ids, path))])

    return df.mapInArrow(run, schema)


def to_text(raw: bytes) -> str:
    """Decoded bytes as text; a character cut at either end becomes U+FFFD."""
    return raw.decode("utf-8", "replace")
