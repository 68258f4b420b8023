"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The automaton of all pieces reads a text once. At each position its output links give every
piece that ends there; each relaxes the best score of that end. A character no piece covers
becomes its UTF-8 bytes, as byte pieces. The vocabulary and the scores come from a model
file; nothing is trained.

No piece of the model holds the space mark after another character, so the best path of a
text is that of its stretches, each from a run of spaces to the next. Stretches repeat, and
a bounded cache keeps their paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_runs

SPACE = "▁"
_KNOWN_STRETCHES = 400_000
_LONGEST_KNOWN = 64
# Runs of spaces with what follows; any text is their concatenation.
_STRETCH = re.compile(r" *[^ ]+| +\Z")
# Below the lowest score, so that bytes are a last resort.
_UNCOVERED = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and the ids of the 256 byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[int, ...]
    byte_ids: tuple[int, ...]

    @staticmethod
    def read(model_file: str) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        pieces = tuple(sp.id_to_piece(i) for i in ids)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in ids]
        normal = tuple(i for i in ids if not special[i])
        byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces, texts could not be restored")
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a space after another character")
        return Vocabulary(pieces, tuple(sp.get_score(i) for i in ids), normal, byte_ids)


class Encoder:
    """Encodes and decodes; built once per task from a Vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        scores = [vocabulary.scores[i] for i in vocabulary.normal]
        self.uncovered = min(scores, default=0.0) - _UNCOVERED
        self.known: dict[str, tuple[int, ...]] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i in self.vocabulary.normal:
            piece = self.vocabulary.pieces[i]
            out.add_word(piece, (len(piece), self.vocabulary.scores[i], i))
        out.make_automaton()
        return out

    def best_path(self, marked: str) -> tuple[int, ...]:
        """Ids of the best segmentation; among equal ones the longest last piece wins."""
        n = len(marked)
        best = [0.0] + [-np.inf] * n
        back = [(0, 0)] * (n + 1)
        uncovered = self.uncovered
        settled = 0
        for last, (size, score, i) in self.automaton.iter(marked):
            while settled < last:
                settled += 1
                if best[settled - 1] + uncovered > best[settled]:
                    best[settled], back[settled] = best[settled - 1] + uncovered, (1, -1)
            value = best[last + 1 - size] + score
            if value > best[last + 1]:
                best[last + 1], back[last + 1] = value, (size, i)
        while settled < n:
            settled += 1
            if best[settled - 1] + uncovered > best[settled]:
                best[settled], back[settled] = best[settled - 1] + uncovered, (1, -1)
        out: list[int] = []
        while n:
            size, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in reversed(marked[n - 1].encode()))
            n -= size
        out.reverse()
        return tuple(out)

    def stretch(self, stretch: str) -> tuple[int, ...]:
        found = self.known.get(stretch)
        if found is None:
            # A mark that stands in the text itself is spelled in bytes.
            mark = tuple(self.vocabulary.byte_ids[b] for b in SPACE.encode())
            parts = [self.best_path(p.replace(" ", SPACE)) for p in stretch.split(SPACE)]
            found = parts[0]
            for part in parts[1:]:
                found += mark + part
            if len(self.known) < _KNOWN_STRETCHES and len(stretch) <= _LONGEST_KNOWN:
                self.known[stretch] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; one space is put before it, as the model's own normalizer does."""
        out: list[int] = []
        if text:
            for stretch in _STRETCH.findall(" " + text):
                out += self.stretch(stretch)
        return out

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id stands for. Ids of special pieces stand for nothing."""
        out = [b""] * len(self.vocabulary.pieces)
        for i in self.vocabulary.normal:
            out[i] = self.vocabulary.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.vocabulary.byte_ids):
            out[i] = bytes([b])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (all columns) with ``ids``: null for a null text, empty for an empty one."""
    # Bounded by the model file.
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in text_runs(batches, "text"):
            flat: list[int] = []
            ends = [0]
            texts = part.column("text").to_pylist()
            for text in texts:
                if text:
                    flat += encoder.encode(text)
                ends.append(len(flat))
            offsets = pa.array(ends, pa.int32())
            if any(t is None for t in texts):
                valid = np.array([t is not None for t in texts])
                offsets = pa.array(np.array(ends, dtype=np.int32), mask=np.append(~valid, False))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    plain = docs.drop("ids").withColumn("text", docs["text"].cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (all columns) with ``decoded``, the text that ``ids`` stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column("ids")
            ends, flat = column.offsets.to_pylist(), column.values.to_numpy()
            texts = [
                encoder.decode(flat[lo:hi].tolist()) if there else None
                for lo, hi, there in zip(ends, ends[1:], column.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    plain = encoded.drop("decoded")
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())])
    return plain.mapInArrow(run, schema)
