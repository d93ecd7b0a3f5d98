"""SentencePiece encoding and decoding by a forward pass over a trie of distinct words.

The distinct marked words of a batch are sorted, which lays out their trie depth first: each word keeps the forward
table of the prefix that it shares with the word before, and only its own tail is worked out.

A unigram vocabulary keeps at each position the best score (Viterbi). In a byte-pair vocabulary scores are merge
ranks, and their sum does not rank segmentations; the same table then keeps at each position the last piece of the
prefix's encoding, which is the one piece whose merges leave the border to the piece before it alone. Either way the
ids equal those of the vocabulary's own library.

Edge cases: null and empty texts have no pieces; characters outside the vocabulary become byte pieces; a text that
holds U+2581 decodes with spaces in its place, as in the library; texts are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from docloom.llm.common import map_batches, with_text_columns

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A marked word: marks, then anything but marks. No piece has a mark after another character.
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MARKED_LINES = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_UNIGRAM, _NORMAL, _BYTE = 1, 1, 6


class PieceCodec:
    """Encoder and decoder of one model file.

    It remembers words it has met, up to ``most_words`` and until ``forget``, and which pieces can meet, up to
    ``most_borders``. Ids stand as little-endian 32-bit integers.
    """

    def __init__(self, path: str, most_words: int = 400_000, most_borders: int = 400_000) -> None:
        model = proto.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep the text as it is can be decoded to it")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.unigram = model.trainer_spec.model_type == _UNIGRAM
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans two words")
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.unknown_score = min(self.score.values()) - 10
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        byte_of = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        # a line feed that no piece holds stands alone, so words end there as well
        self.marked = _MARKED if any("\n" in p for p in self.ids) else _MARKED_LINES
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}  # a piece, or what a longer one ends in
        self.most_words, self.most_borders = most_words, most_borders
        self.known: dict[str, bytes] = {}
        self.known_borders: dict[str, dict[str, bool]] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text, best score first, leftmost first among equals."""
        none, get = float("-inf"), self.score.get
        parts = list(text)
        gains = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (top := max(gains)) > none:
            i = gains.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def borders(self, right: str) -> dict[str, bool]:
        """By the piece to its left: whether merges of the two pieces' characters end in just these pieces."""
        known = self.known_borders.get(right)
        if known is None:
            known = self.known_borders[right] = {"": self.merged(right) == [right]}
        return known

    def forward(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each of the distinct words, by one walk through their trie."""
        out: dict[str, bytes] = {}
        last, best = [""], [0.0]  # at each position of the word: the last piece up to there, the best score
        before = ""
        ids, score, tails, unigram = self.ids, self.score, self.tails, self.unigram
        known_borders, merged = self.known_borders, self.merged
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found, top = "", float("-inf")
                start = end - 1
                piece = word[start:end]
                while True:
                    # a single character can always stand alone, as itself or as bytes
                    if piece in ids or start == end - 1:
                        left = last[start]
                        if unigram:
                            total = best[start] + score.get(piece, self.unknown_score)
                            if total > top:
                                found, top = piece, total
                        else:
                            fits = (known_borders.get(piece) or self.borders(piece)).get(left)
                            if fits is None:
                                fits = known_borders[piece][left] = merged(left + piece) == [left, piece]
                            if fits:
                                found, top = piece, 0.0
                                break
                    start -= 1
                    if start < 0 or (piece := word[start:end]) not in tails:
                        break
                last.append(found)
                best.append(top)
            got: list[int] = []  # from the last piece back
            end = len(word)
            while end:
                piece = last[end]
                if piece in ids:
                    got.append(ids[piece])
                else:
                    got += [self.byte.get(b, self.unknown) for b in reversed(piece.encode())]
                end -= len(piece)
            got.reverse()
            out[word] = array("i", got).tobytes()
            before = word
        return out

    def words(self, text: str | None) -> list[str]:
        return self.marked.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        split = [self.words(t) for t in texts]
        missing = set().union(*split) - self.known.keys()
        if len(self.known) + len(missing) > self.most_words:
            self.known = {}
            missing = set().union(*split)
        if sum(map(len, self.known_borders.values())) > self.most_borders:
            self.known_borders.clear()
        self.known |= self.forward(missing)
        known = self.known.__getitem__
        return [b"".join(map(known, ws)) for ws in split]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.encode_bytes(texts)]

    def encode_column(self, texts: list[str | None]) -> pa.ListArray:
        made = self.encode_bytes(texts)
        ends = np.cumsum([0, *(len(x) // 4 for x in made)], dtype="i4")
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(made))])
        return pa.ListArray.from_arrays(pa.array(ends), values)

    def forget(self) -> None:
        """Words are kept for one task, so that a worker that goes on to other work holds none."""
        self.known = {}

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text[len(self.prefix) :] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """``ids``: the pieces of each whole text. ``model``: a file at the same path on every executor."""
    kind = T.ArrayType(T.IntegerType())

    def make(batch: pa.RecordBatch) -> list:
        return [codec(model).encode_column(batch.column("text").to_pylist())]

    return with_text_columns(docs, [T.StructField("ids", kind)], make, keep, end=lambda: codec(model).forget())


def decode_documents(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``text`` in place of ``ids``."""
    keep = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else codec(model).decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_batches(encoded, run, T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())]))
