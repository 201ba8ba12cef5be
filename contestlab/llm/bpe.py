"""Byte-level BPE encoding and decoding (operator 12).

A text is cut into pieces by the tokenizer's pattern. For each start in a piece an Aho-Corasick automaton over all token strings
gives the longest token there. The encoder goes from left to right: it takes the longest token whose pair with the one before is compatible,
else the next shorter one (each token knows the longest token that is its proper prefix), else it steps back over the last token and
forbids that boundary for good. So each boundary fails at most once, and the work is linear in the piece. Two tokens are compatible if
merging their joined bytes gives these two again; that is decided from the merge table by undoing merges on both sides of the
boundary, and kept in a table of pairs. The only chain of compatible pairs over a piece is what the merges give (van Antwerpen and Neubeck,
"So many tokens, so little time", 2024). Decoding copies byte ranges of one flat array by an offset table.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's tables of pieces and of pairs, and the longest piece that is kept. Of pieces there are two such tables: when the newer is full the
#: older goes, and what is met in the older moves to the newer, so that frequent pieces stay.
CACHED, CACHED_CHARS = 1 << 17, 48
#: Ids decoded at a time.
RUN = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """The tables of a byte-level BPE file, as plain values: token bytes by id, merges in order as (left id, right id, joined id), special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    vocab = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for word, k in vocab.items():
        tokens[k] = bytes(letters[c] for c in word)
    for word, k in special.items():
        tokens[k] = word.encode()
    return {"tokens": tokens, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], "special": special}


class Encoder:
    """Encoder over the tables of `read_tokenizer`.

    Inside, tokens are numbered by age: the 256 bytes, then the merges in order, so that an older token is one merged earlier.
    """

    def __init__(self, tables: dict):
        tokens, merges = tables["tokens"], tables["merges"]
        of_byte = {t: k for k, t in enumerate(tokens) if len(t) == 1}
        self.ids = [of_byte[bytes([b])] for b in range(256)]
        age = {k: b for b, k in enumerate(self.ids)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right, joined in merges:
            pair = (age[left], age[right])
            if joined in age:  # a second way to a token that exists: it keeps its first age
                self.merged.setdefault(pair, age[joined])
                continue
            age[joined] = self.merged[pair] = len(self.ids)
            self.parts.append(pair)
            self.ids.append(joined)
        self.lengths = [len(tokens[k]) for k in self.ids]
        self.found = ahocorasick.Automaton()
        names = [tokens[k].decode("latin-1") for k in self.ids]
        for k, name in enumerate(names[256:], 256):  # a byte alone is its own number
            self.found.add_word(name, k)
        self.shorter = [-1] * len(names)
        for k, name in enumerate(names[256:], 256):
            self.shorter[k] = next(t for j in range(len(name) - 1, 0, -1) if (t := self.found.get(name[:j], ord(name[0]) if j == 1 else -1)) >= 0)
        self.found.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = tables["special"]
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of `left` and `right`, joined, gives these two tokens."""
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, limit, good = left, right, len(self.ids), True
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < limit:  # a merge across the boundary comes before the one undone last
                good = False
                break
            # undo the newer of the two tokens at the boundary; a merge across must then come before it (on the left, of equals, first)
            if a > b:
                if a < 256:
                    break
                limit, a = a, self.parts[a][1]
            elif b >= 256:
                limit, b = b + 1, self.parts[b][0]
            elif a >= 256:
                limit, a = a, self.parts[a][1]
            else:
                break
        if len(self.compatible) >= CACHED:
            self.compatible.clear()
        self.compatible[left, right] = good
        return good

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one piece's tokens."""
        n, lengths, shorter, compatible = len(data), self.lengths, self.shorter, self.compatible
        longest = list(data)
        for end, token in self.found.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # longer ones end later
        token = longest[0]
        if lengths[token] == n:
            return [self.ids[token]]
        closed, out, last, at = set(), [], -1, 0
        while True:
            end = at + lengths[token]
            if end not in closed:
                fits = True if last < 0 else compatible.get((last, token))
                if fits is None:
                    fits = self.may_follow(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return [self.ids[t] for t in out]
                    last, at, token = token, end, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:  # no token can follow the last one here
                closed.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= lengths[token]

    def _met(self, piece: str) -> bytes:
        """The ids of a piece that is not in the newer table."""
        code = self.older.get(piece)
        if code is None:
            code = array("i", self.encode_piece(piece.encode())).tobytes()
            if len(piece) > CACHED_CHARS:
                return code
        if len(self.pieces) >= CACHED:
            self.older = dict(self.pieces)
            self.pieces.clear()
        self.pieces[piece] = code
        return code

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; special strings in it are their tokens."""
        parts = self.split.split(text) if self.split and text else [text or ""]
        out, known, met = [], self.pieces.get, self._met
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += [known(piece) or met(piece) for piece in self.pattern.findall(part)]
        return np.frombuffer(b"".join(out), np.int32)


class Decoder:
    """All tokens' bytes in one flat array, and where each id's begin."""

    def __init__(self, tables: dict):
        self.flat = np.frombuffer(b"".join(tables["tokens"]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tables["tokens"]])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids; ids that the tokenizer doesn't have are nothing."""
        out = []
        for k in range(0, len(ids), RUN):
            run = ids[k: k + RUN].astype(np.int64)
            run = run[(run >= 0) & (run < len(self.offsets) - 1)]
            first, size = self.offsets[run], self.offsets[run + 1] - self.offsets[run]
            before = np.cumsum(size) - size
            out.append(self.flat[np.arange(int(size.sum())) + np.repeat(first - before, size)].tobytes())
        return b"".join(out)


def _own(held, kind: type):
    """One encoder or decoder a worker, kept beside the tables that were sent."""
    if kind.__name__ not in held.value:
        held.value[kind.__name__] = kind(held.value)
    return held.value[kind.__name__]


def _replaced(batch: pa.RecordBatch, made: dict[str, pa.Array], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], names=columns)


def encode_texts(docs: DataFrame, tables: dict, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the column `ids` (array of int; replaced if there): the token ids of the whole text, special strings in it included.

    Null and empty texts have no ids. Repeated rows come back repeated, an empty table gives an empty result, other columns come
    through as they are. A tokenizer's tables (a few MB, by its vocabulary alone) are broadcast. Each worker keeps at most CACHED pieces.
    """
    held = docs.sparkSession.sparkContext.broadcast(dict(tables))
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != ids], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _own(held, Encoder)
        for frame in frames:
            found = [encoder.encode(x.as_py()) for x in frame.column(text)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            yield _replaced(frame, {ids: pa.ListArray.from_arrays(pa.array(ends), values)}, schema.names)

    return docs.mapInArrow(batch, schema)


def decode_ids(tokens: DataFrame, tables: dict, ids: str = "ids", text: str = "text") -> DataFrame:
    """`tokens` with the column `text` (replaced if there) decoded from `ids`; bytes that are no UTF-8 become U+FFFD. No ids: empty; null ids: null."""
    held = tokens.sparkSession.sparkContext.broadcast(dict(tables))
    schema = T.StructType([*[f for f in tokens.schema.fields if f.name != text], T.StructField(text, T.StringType())])

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _own(held, Decoder)
        for frame in frames:
            rows = [None if x.as_py() is None else decoder.decode(x.values.drop_null().to_numpy().astype(np.int32)).decode("utf-8", "replace") for x in frame.column(ids)]
            yield _replaced(frame, {text: pa.array(rows, pa.string())}, schema.names)

    return tokens.mapInArrow(batch, schema)
