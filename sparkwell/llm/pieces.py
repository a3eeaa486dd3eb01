"""Operator 5: SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

All pieces of a model stand in one Aho-Corasick automaton. A text is read once: at each position the
automaton's output links give every piece that ends there, and each of them relaxes the best score
of that position. Where no piece covers a character, it costs less than any piece and is written by
its bytes. No piece of the models in use has a word mark behind another character, so the best
segmentation of a text is that of its words one after the other, and a worker remembers those of
words it has seen; models with such pieces are segmented whole.

Defined cases: null or empty text has no ids; every other text decodes to itself exactly (a word mark
in the text is written by its bytes); of segmentations with equal scores the one with the longest last
piece wins; a null doc_id is kept; repeated rows are encoded each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import table, text_of, vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Added to the lowest score for a character that no piece covers.
UNKNOWN = -10.0
#: Words whose ids a worker remembers, and their code points at most: some 100 MB. From LONG code points a word's tables are arrays.
MEMORY, LONGEST, LONG = 400_000, 40, 4096

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """pieces: (piece, score) by id for pieces to match; byte_ids: ids of the 256 bytes."""

    def __init__(self, pieces: dict[int, tuple[str, float]], byte_ids: list[int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in pieces.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces.values()), default=0.0) + UNKNOWN
        self.byte_ids = byte_ids
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces.values())
        self.raw = {i: p.replace(MARK, " ").encode() for i, (p, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.memory: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = {i: (sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        return cls(plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def best(self, text: str) -> Sequence[int]:
        """Ids of the best segmentation of a marked text."""
        n = len(text)
        if n < LONG:
            score, lengths, back, out = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1), []
        else:  # 16 bytes for each character
            score, lengths, back, out = array("d", [-math.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1), array("I")
        score[0] = 0.0
        done = 0  # positions whose score is final

        def fill(upto: int) -> None:
            # a position that no piece reaches is reached from the one before by an unknown character
            nonlocal done
            while done < upto:
                done += 1
                if score[done - 1] + self.unknown > score[done]:
                    score[done], lengths[done], back[done] = score[done - 1] + self.unknown, 1, -1

        for last, (length, i, s) in self.automaton.iter(text):
            end = last + 1
            fill(end - 1)
            if score[end - length] + s > score[end]:
                score[end], lengths[end], back[end] = score[end - length] + s, length, i
        fill(n)
        while n:
            if back[n] >= 0:
                out.append(back[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
            n -= lengths[n]
        out.reverse()
        return out

    def _ids(self, unit: str) -> bytes:
        got = self.memory.get(unit)
        if got is None:
            got = np.array(self.best(unit), "<u4").tobytes()
            if len(unit) <= LONGEST:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        # a mark of the text itself is written by its bytes; what lies between such marks is encoded apart
        first, *rest = text.split(MARK)
        own = b"".join(self.byte_ids[b].to_bytes(4, "little") for b in MARK.encode())
        return own.join([self._marked(MARK + first.replace(" ", MARK)), *(self._marked(x.replace(" ", MARK)) for x in rest)])

    def _marked(self, marked: str) -> bytes:
        return b"".join(map(self._ids, _UNIT.findall(marked))) if self.apart else self._ids(marked)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()[1:]


@lru_cache(maxsize=2)
def pieces(name: str = MODEL) -> Pieces:
    return Pieces.load(vocabulary_path(name))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            ids = [np.frombuffer(p.encode(t.as_py()), "<i4") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = [p.decode(np.array(i.as_py() or [], "<u4").tobytes()) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def coded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_bytes (ids that stand for single bytes), ids_crc32 and round_trip (the ids decode to the text) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        is_byte = np.zeros(max(p.raw) + 1, bool)
        is_byte[p.byte_ids] = True
        for b in batches:
            rows = []
            for t in b.column("text"):
                ids = p.encode(text := t.as_py())
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), p.decode(ids) == text))
            n, k, crc, ok = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))
