"""SentencePiece encoding with byte offsets, and decoding.

The model's normaliser is run with a record of where each normalised byte came from: at each
place the longest key of the compiled character map is replaced, and all bytes of the
replacement point at the bytes that they replace. A piece then covers a range of normalised
bytes, and that record projects it to a range of the original text's bytes. The ids are the
sentencepiece library's own.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, steps, text_bytes
from .segments import SegmentEncoder

_MARK = "▁".encode()


class CharacterMap:
    """The compiled character map of a model: a double-array trie and its replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self._texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, found = self._units, None
        node = self._child(0)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._step(units[node])
            if leaf:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self._texts[start : self._texts.index(b"\0", start)]
        return found

    def _step(self, unit: int) -> int:
        return unit >> 10 << (8 if unit & 0x200 else 0)

    def _child(self, node: int) -> int:
        return node ^ self._step(self._units[node])


class PieceModel:
    """A SentencePiece model with what offsets need."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.escape, self.squeeze = spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces
        kinds = [p.type for p in proto.pieces]
        self.sizes = np.array([1 if kind == 6 else len(p.piece.encode()) for p, kind in zip(proto.pieces, kinds)], np.int64)
        # No piece has a space after another character and none is a user's: words are then encoded apart from each other.
        plain = not self.map and self.prefix and self.escape and not self.squeeze and proto.trainer_spec.model_type == 2
        self.by_word = plain and 4 not in kinds and not any("▁" in p.piece.lstrip("▁") for p in proto.pieces)
        self.mark_id = self.processor.piece_to_id("▁")
        self.memory = SegmentEncoder(self._encode, 300_000, 3_000_000)

    def _encode(self, segments: list[str]) -> list[list[int]]:
        return [x or [self.mark_id] for x in self.processor.encode(segments, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's ``encode`` gives them."""
        if not self.by_word:
            return [np.array(x, np.int32) for x in self.processor.encode(texts, num_threads=1)]
        segments: list[str] = []
        ends = []
        # The mark itself in a text would join words; such texts are encoded whole.
        whole = {k: np.array(self.processor.encode(x), np.int32) for k, x in enumerate(texts) if "▁" in x}
        for k, text in enumerate(texts):
            if text and k not in whole:
                # Each word with the spaces before it, less the one that encoding puts there again.
                found = text.split(" ")
                segments += [x[1:] for x in re.findall(" +[^ ]*", f" {text}")] if "" in found else found
            ends.append(len(segments))
        ids, counts = self.memory.ids(segments)
        cuts = np.concatenate(([0], np.cumsum(counts)))[np.array(ends, np.int64)]
        found = np.split(ids, cuts[:-1])
        return [whole.get(k, x) for k, x in enumerate(found)] if whole else found

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the source offset."""
        if self.map or self.squeeze:
            return self._normalize_by_map(text)
        source = np.arange(len(text) + 1)
        if self.escape:
            widths = np.where(np.frombuffer(text, np.uint8) == 32, len(_MARK), 1)
            source = np.concatenate((np.repeat(source[:-1], widths), source[-1:]))
            text = text.replace(b" ", _MARK)
        if self.prefix and text:
            text = (_MARK if self.escape else b" ") + text
            source = np.concatenate((np.zeros(len(text) - len(source) + 1, np.int64), source))
        return text, source

    def _normalize_by_map(self, text: bytes) -> tuple[bytes, np.ndarray]:
        units: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            found = self.map.longest(text, at) if self.map else None
            if not found:
                width = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
                found = width, text[at : at + width]
            units += [(found[1][k : k + 1], at) for k in range(len(found[1]))]
            at += found[0]
        end = len(text)
        if self.squeeze:
            # Of neighbouring spaces the first stays; none at the start, none at the end.
            kept: list[tuple[bytes, int]] = []
            kept += (u for u in units if u[0] != b" " or kept and kept[-1][0] != b" ")
            if kept and kept[-1][0] == b" ":
                end = kept.pop()[1]
            units = kept
        if self.prefix and units:
            units.insert(0, (b" ", units[0][1]))
        out, source = [], []
        for byte, place in units:
            byte = _MARK if byte == b" " and self.escape else byte
            out.append(byte)
            source += [place] * len(byte)
        return b"".join(out), np.array([*source, end], np.int64)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of the original bytes that each piece covers."""
        normal, source = self.normalize(text)
        edges = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        if edges[-1] != len(normal):
            raise ValueError(f"pieces cover {edges[-1]} of {len(normal)} normalised bytes")
        return source[edges[:-1]], source[edges[1:]]


@lru_cache(2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def _rows(path: str, digests: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        gc.disable()  # millions of small lists, none in a cycle
        for batch in steps(batches, limit=STEP_BYTES // 2):
            raw = text_bytes(batch.column("text"))
            ids = model.encode([x.decode() for x in raw])
            listed = [x.tolist() for x in ids]
            decoded = [model.processor.decode(x) if x else "" for x in listed]
            spans = [model.spans(t, x) for t, x in zip(raw, ids)]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(map(len, listed), pa.int64())}
            if digests:
                out["ids_sha256"] = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in listed]
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                out["n_covered_bytes"] = pa.array([int((b - a).sum()) for a, b in spans], pa.int64())
            else:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                out["starts"], out["ends"] = (pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1))
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.record_batch(out)

    return rows


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids.

    Returns doc_id, n_tokens and ``ids``, ``starts``, ``ends`` (byte range of each piece in the
    original text) and ``decoded``; with ``digests`` instead ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 and n_covered_bytes (bytes inside the pieces' ranges).
    A null text counts as empty and has no ids; null ids and repeated rows come back as they
    are, one row for each row; other columns are ignored. It is one pass without a shuffle.
    """
    outs = "ids_sha256 string, decoded_sha256 string, n_covered_bytes long" if digests else "ids array<int>, starts array<long>, ends array<long>, decoded string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows(model_path, digests), f"doc_id long, n_tokens long, {outs}")
