"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model protobuf is parsed and rebuilt: its normaliser (a compiled character map where there is
one, the dummy prefix, surplus blanks, which are blanks only: tabs and line ends stay), the metaspace
marker, and its pieces, as a unigram model with scores or as a merge model whose merges follow from the
scores, both with byte fallback.  User-defined pieces are cut out of the marked text first, the longest
where several begin, and are never merged.

Texts are encoded whole, in multithreaded batches of bounded size.  A text beyond ``UNIT`` characters
is cut before runs of markers: a piece never holds the marker after another character (checked when a
model is loaded, else texts stay whole), so the parts don't influence each other.  What has no blank
for longer than that stays in one part.  Every original text is also encoded, whole and unnormalised, by
the ``sentencepiece`` library, and ``parity`` tells whether all ids are the same.

Decoding maps ids to bytes and markers to blanks; a text that itself holds the marker, or that its
normaliser changes, doesn't come back as it was, which ``roundtrip`` says.

Defined cases: a null text encodes to no ids and decodes to empty text, roundtrip is then true;
empty texts likewise; repeated rows each get their ids; an empty table gives no rows; extra columns
are left alone.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .words import pieces

MARK = "▁"
#: Characters of one part of a long text, and bytes of text taken together: encodings are far larger than the ids.
UNIT, CALL = 1 << 15, 500_000
#: Threads of a batch; executors run several tasks.
THREADS = 2
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


class Codec:
    """A SentencePiece model on both libraries."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Regex, Tokenizer, models, normalizers

        self.proto = proto.ModelProto()
        self.proto.ParseFromString(model)
        self.reference = SentencePieceProcessor(model_proto=model)
        pieces, spec, trained = self.proto.pieces, self.proto.normalizer_spec, self.proto.trainer_spec
        self.prefix = spec.add_dummy_prefix
        number = {p.piece: i for i, p in enumerate(pieces)}
        if trained.model_type == trained.UNIGRAM:
            body = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=trained.unk_id, byte_fallback=trained.byte_fallback)
        elif trained.model_type == trained.BPE:
            body = models.BPE(vocab=number, merges=self._merges(number), unk_token=pieces[trained.unk_id].piece, byte_fallback=trained.byte_fallback, fuse_unk=True, cache_capacity=0)
        else:
            raise ValueError(f"model type {trained.model_type} isn't supported")
        self.tokenizer = Tokenizer(body)
        steps = []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        self.clean = normalizers.Sequence(steps) if steps else None
        self.spelt = [self._bytes_of(p, trained.unk_surface) for p in pieces]
        self.is_byte = np.array([p.type == _BYTE for p in pieces])
        self.user = {p.piece: i for i, p in enumerate(pieces) if p.type == _USER}
        self.user_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        self.separable = not any(MARK in p.piece.lstrip(MARK) for p in pieces if p.type != _USER)

    def _merges(self, number: dict[str, int]) -> list[tuple[str, str]]:
        """All splits of pieces into two pieces, best score of the joined piece first.

        Where scores are equal the reference library joins what stands leftmost, so a run of one character grows
        from its beginning: longer left parts go first.
        """
        found = []
        for p in self.proto.pieces:
            if p.type == _NORMAL:
                for cut in range(1, len(p.piece)):
                    a, b = p.piece[:cut], p.piece[cut:]
                    if a in number and b in number:
                        found.append((-p.score, -len(a), number[a], number[b], a, b))
        found.sort()
        return [x[-2:] for x in found]

    @staticmethod
    def _bytes_of(piece, unknown: str) -> bytes:
        if piece.type == _BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        if piece.type == _UNKNOWN:
            return unknown.encode()
        return b"" if piece.type == _CONTROL else piece.piece.replace(MARK, " ").encode()

    def marked(self, text: str) -> str:
        """The normalised text, with markers for blanks."""
        if self.clean:
            text = self.clean.normalize_str(text)
        return (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""

    def _cut(self, marked: str) -> list[str]:
        if len(marked) <= UNIT or not self.separable:
            return [marked] if marked else []
        parts, start = [], 0
        while len(marked) - start > UNIT:
            at = marked.rfind(MARK, start + 1, start + UNIT)
            while at > start and marked[at - 1] == MARK:
                at -= 1
            if at <= start:  # no blank in reach
                at = marked.find(MARK, start + UNIT)
                while at > 0 and marked[at - 1] == MARK:
                    at = marked.find(MARK, at + 1)
                if at < 0:
                    break
            parts.append(marked[start:at])
            start = at
        return [*parts, marked[start:]]

    def parts(self, text: str) -> list[str]:
        """What is encoded by itself; every other part is a user-defined piece where the model has such."""
        marked = self.marked(text)
        if not self.user_cut:
            return self._cut(marked)
        return [y for x in self.user_cut.split(marked) for y in ([x] if x in self.user else self._cut(x))]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        cut = [self.parts(t) for t in texts]
        todo = [x for parts in cut for x in parts if x not in self.user]
        ids = iter([e.ids for e in self.tokenizer.encode_batch_fast(todo, add_special_tokens=False)])
        out = []
        for parts in cut:
            own = [[self.user[x]] if x in self.user else next(ids) for x in parts]
            out.append(own[0] if len(own) == 1 else [i for x in own for i in x])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.spelt.__getitem__, ids))
        return raw[1:] if self.prefix and raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_ENCODED = "ids array<int>, n_tokens bigint, n_bytes bigint, n_fallback bigint, parity boolean, roundtrip boolean"


@functools.lru_cache(maxsize=1)
def _codec(model: bytes) -> Codec:
    """One a worker: building it takes as long as encoding a megabyte."""
    return Codec(model)


def _encoder(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        codec = _codec(model)
        for batch in pieces(batches, "text", CALL):
            texts = batch.column("text").fill_null("").to_pylist()
            ours, theirs = codec.encode_texts(texts), codec.reference.encode(texts, num_threads=1)
            parity = [a == b for a, b in zip(ours, theirs, strict=True)]
            plain = [t.encode() for t in texts]
            back = [codec.decode_bytes(x) == y for x, y in zip(ours, plain, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ours])]).astype(np.int32)
            # Flat and by way of arrays: far quicker than from lists of lists.
            ids = np.frombuffer(b"".join(array("i", x).tobytes() for x in ours), dtype=np.int32)
            del ours, theirs
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            fallback = np.concatenate([[0], np.cumsum(codec.is_byte[ids])])[offsets]
            columns = [lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array([len(x) for x in plain], pa.int64()), pa.array(np.diff(fallback).astype(np.int64)), pa.array(parity), pa.array(back)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "ids", "n_tokens", "n_bytes", "n_fallback", "parity", "roundtrip"])

    return lean(run)


def read_model(path: str = MODEL) -> bytes:
    """The model file; read once on the driver and sent with the tasks (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, n_fallback, parity, roundtrip for every row of ``documents``."""
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(model), f"doc_id {kind}, {_ENCODED}")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text for rows of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("ids_sha256", F.sha2(F.array_join("ids", ","), 256))
