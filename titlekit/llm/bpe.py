"""Byte-level BPE by dynamic programming over prefixes, and back.

For every prefix of a piece there is exactly one last token in its encoding. It is found among the tokens that end at the
prefix (one pass of an Aho-Corasick automaton over the bytes gives them all): the token whose start leaves a prefix whose
own last token is compatible with it. Two tokens are compatible if encoding their joined bytes gives the two back, that
is, if no merge across their border ever comes before the merges that use up its two sides. Following the stored tokens
from the end gives the ids. The work is linear in a piece's bytes, whatever it holds.

A text is first cut at the special tokens' strings, then into pieces by the vocabulary's pattern, as the file says. Pieces
recur, so each worker keeps the ids of recent ones. Long texts are cut into pieces in stretches. The vocabulary
file is read on the driver, measured, and broadcast.

Null and empty texts have no tokens. Repeated rows are encoded each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import as_text, by_slice, col
from titlekit.session import spread

VOCABULARY_BYTES = 64 << 20
CACHE = 150_000
PAIRS = 400_000
LONG_PIECE = 100
STRETCH = 1 << 20
#: Fixed value: the pattern of this kind of vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Ids of recent pieces: at most ``CACHE`` here and as many in the generation before."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece) or self.make(piece)
        if len(piece) < LONG_PIECE:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Tokens:
    """A vocabulary and its merges."""

    def __init__(self, file: str):
        read = json.loads(file)
        model, before = read["model"], read["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or read["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        letters = byte_letters()
        self.ids: dict[str, int] = model["vocab"]
        own = {i: bytes(letters[c] for c in t) for t, i in self.ids.items()}
        extra = {t["id"]: t["content"] for t in read["added_tokens"]}
        self.bytes = own | {i: bytes(letters.get(c, 0) for c in t) if all(c in letters for c in t) else t.encode() for i, t in extra.items()}
        self.special = {t: i for i, t in extra.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if extra else None
        self.pieces = regex.compile(PIECES)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: its two parts and their rank
        for r, (a, b) in enumerate(pairs):
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = r
            self.made.setdefault(whole, (left, right, r))
        self.automaton = ahocorasick.Automaton()
        for i, raw in own.items():
            if len(raw) == 1 or i in self.made:
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.never = len(pairs)
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.compatible: dict[int, bool] = {}
        self.known = Known(self.piece)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of a token as it grows, and the rank of the merge that uses each up."""
        edge = self.edges[side].get(token)
        if edge is None:
            part = token
            edge = self.edges[side][token] = [(token, self.never)]
            while part in self.made:
                used = self.made[part][2]
                part = self.made[part][side]
                edge.append((part, used))
        return edge

    def fits(self, a: int, b: int) -> bool:
        """The bytes of a and b together are encoded as a, b."""
        rank = self.rank
        left = self._edge(b, 0)
        for x, x_used in self._edge(a, 1):
            for y, y_used in left:
                r = rank.get((x, y))
                # of equal merges that overlap, the left one comes first
                if r is not None and r < x_used and r <= y_used:
                    return False
        return True

    def encode_piece(self, raw: bytes) -> list[int]:
        last = [-1] * (len(raw) + 1)
        sizes = [0] * (len(raw) + 1)
        known = self.compatible
        if len(known) > PAIRS:
            known.clear()
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    pair = before << 24 | token
                    fit = known.get(pair)
                    if fit is None:
                        fit = known[pair] = self.fits(before, token)
                    if not fit:
                        continue
                last[end], sizes[end] = token, size
        out = []
        at = len(raw)
        while at:
            out.append(last[at])
            at -= sizes[at]
        return out[::-1]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece as little-endian 32-bit numbers."""
        return np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of a text whose pieces are the pieces of the text: cut before a blank between two letters."""
        while len(text) > STRETCH:
            found = regex.compile(r"(?<=\p{L}) (?=\p{L})").search(text, STRETCH)
            if not found:
                break
            yield text[: found.start()]
            text = text[found.start() :]
        yield text

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of the text, part by part."""
        for part in self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                for some in self.stretches(part):
                    yield b"".join(map(self.known.__getitem__, self.pieces.findall(some)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; ids outside the vocabulary have none."""
        raw = self.bytes
        try:
            return b"".join([raw[i] for i in ids.tolist()])
        except KeyError:
            return b"".join([raw.get(i, b"") for i in ids.tolist()])


def vocabulary(path: str) -> str:
    """The file's content, measured before it is sent anywhere."""
    file = Path(path)
    if file.stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return file.read_text(encoding="utf-8")


_loaded: dict[int, Tokens] = {}


def _tokens(sent) -> Tokens:
    """The vocabulary of a broadcast, prepared once in each Python worker."""
    key = hash(sent.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokens(sent.value)
    return _loaded[key]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def encode(texts: list[bytes]) -> list:
        tokens = _tokens(sent)
        ids = [np.frombuffer(b"".join(tokens.encode(as_text(t))), dtype="<u4").astype(np.int32) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32()))]

    rows = spread(docs.select(col(id_col).alias(id_col), col(text_col).alias("text")))
    return by_slice(rows, encode, "ids array<int>")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every list of ids; bytes that are not UTF-8 become U+FFFD, null ids an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = tokens.select(col(id_col).alias(id_col), col(ids_col).alias("ids"))

    def batches(batch_rows):
        for batch in batch_rows:
            own = _tokens(sent)
            texts = [own.decode(np.array(x if x is not None else [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(batches, f"`{id_col}` {rows.dtypes[0][1]}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: its tokens, and what decoding them gives back."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def digests(texts: list[bytes]) -> list:
        tokens = _tokens(sent)
        counts, ids_digests, text_digests = [], [], []
        for text in texts:
            of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
            for part in tokens.encode(as_text(text)):
                of_ids.update(part)
                n += len(part) // 4
                # a part ends where a piece ends, so its bytes are whole characters
                of_text.update(tokens.decode(np.frombuffer(part, dtype="<u4")).decode("utf-8", "replace").encode())
            counts.append(n)
            ids_digests.append(of_ids.hexdigest())
            text_digests.append(of_text.hexdigest())
        return [np.array(counts, dtype=np.int64), ids_digests, text_digests]

    rows = spread(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))
    out = by_slice(rows, digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
