"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker, scores (unigram) or merges
(BPE) and byte fallback are rebuilt from it. Parity with the sentencepiece library is a column of the result.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHES, begin_task, small_batches

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_CHUNKS = 400_000
#: Threads of the library in one worker; one for each core of the machine only contend when tasks fill the cores.
THREADS = 2
#: What an unknown piece is decoded to (fixed by the format).
UNKNOWN_TEXT = " \u2047 "
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_ONE_MARK = re.compile(rf"{SPACE}[^{SPACE}\s]+").fullmatch
_BYTE = re.compile("<0x[0-9A-F]{2}>")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class SentencePieceModel:
    pieces: list[tuple[str, float, int]]  # text, score, type
    kind: int
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    single_spaces: bool
    byte_fallback: bool
    user: list[str] = field(default_factory=list)  # user-defined pieces: never changed, never cut

    @classmethod
    def read(cls, path: str) -> SentencePieceModel:
        with open(path, "rb") as f:
            top = list(fields(f.read()))
        messages = lambda n: [dict(fields(v)) for k, v in top if k == n]
        pieces = [(p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)) for p in messages(1)]
        trainer, normaliser = (messages(2) or [{}])[0], (messages(3) or [{}])[0]
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or not normaliser.get(5, 1) or trainer.get(24, 0) or any(kind == UNUSED for *_, kind in pieces):
            raise ValueError("only unigram and BPE models with escaped white space before words and without unused pieces are supported")
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        user = [p for p, _, kind in pieces if kind == USER]
        return cls(pieces, trainer.get(3, UNIGRAM), unknown, normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(trainer.get(35, 0)), user)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, best result first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for piece, i in ids.items():
            found += [(-self.pieces[i][1], i, ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def names(self, hide: tuple[int, ...]) -> list[str]:
        """Pieces as a tokenizer's vocabulary: those of a hidden type hold a blank, which no normalised text has."""
        return [UNKNOWN_TEXT if i == self.unknown else f" {p}" if kind in hide else p for i, (p, _, kind) in enumerate(self.pieces)]

    def tokenizer(self, literal_bytes: bool = False):  # noqa: ANN201
        """A tokenizers Tokenizer over normalised texts without user-defined pieces (it has no normaliser itself).

        With ``literal_bytes`` the names of byte pieces are ordinary text in the input and what is unknown stays one
        unknown piece.
        """
        from tokenizers import Tokenizer, decoders, models

        names = self.names((CONTROL, BYTE) if literal_bytes else (CONTROL,))
        fallback = self.byte_fallback and not literal_bytes
        if self.kind == UNIGRAM:
            model = models.Unigram([(n, s) for n, (_, s, _) in zip(names, self.pieces, strict=True)], unk_id=self.unknown, byte_fallback=fallback)
        else:
            model = models.BPE({n: i for i, n in enumerate(names)}, self.merges(), unk_token=UNKNOWN_TEXT, fuse_unk=True, byte_fallback=fallback)
        made = Tokenizer(model)
        made.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        return made

    def normalizer(self):  # noqa: ANN201
        """Character map and white space rules, without the marker before a text."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.single_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])


class Codec:
    """Encodes and decodes batches with one model.

    Where no piece holds a marker after another character (BPE models, checked at start), merges never cross the
    start of a run of markers, so a normalised text's ids are those of its chunks, each some markers and what
    follows. Chunks are encoded once while the cache holds them, many at a time, and so is the other library's answer
    on them.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model = SentencePieceModel.read(path)
        self.tokenizer, self.normalizer = model.tokenizer(), model.normalizer()
        self.charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        self.joined = Tokenizer(self.tokenizer.model)
        self.joined.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.user_ids = {p: np.array([i], "<u4").tobytes() for i, (p, _, kind) in enumerate(model.pieces) if kind == USER}
        self.user = re.compile("|".join(map(re.escape, sorted(model.user, key=lambda p: (-len(p), p))))) if model.user else None
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.control = np.array([kind == CONTROL for *_, kind in model.pieces])
        self.starts = np.array([p.startswith(SPACE) and kind == NORMAL for p, _, kind in model.pieces])
        inner = [p for p, _, kind in model.pieces if kind == NORMAL and SPACE in p.lstrip(SPACE)]
        self.chunked = not inner and model.kind == BPE and any(p == SPACE and kind == NORMAL for p, _, kind in model.pieces)
        #: Whether the other library, too, may be asked chunk by chunk: it then sees each chunk as it would within a text.
        self.parity_by_chunk = self.chunked and model.dummy_prefix and not (model.single_spaces or model.charsmap or model.user)
        self.literal = None  # made when a text first needs it
        self.cache: dict[str, bytes] = {}
        self.odd: set[str] = set()  # chunks on which the libraries differ
        written = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else UNKNOWN_TEXT.encode() if i == model.unknown else p.replace(SPACE, " ").encode() for i, (p, _, kind) in enumerate(model.pieces)]
        self.piece_bytes = np.frombuffer(b"".join(written), np.uint8)
        self.piece_sizes = np.array([len(w) for w in written])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def _raw(self, chunks: list[str]) -> list[bytes]:
        """Ids of normalised texts or chunks without user-defined pieces."""
        found = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        if self.model.kind == UNIGRAM and self.byte_ids:
            found = [self._with_literal_bytes(c) if _BYTE.search(c) else x for c, x in zip(chunks, found, strict=True)]
        return found

    def _with_literal_bytes(self, text: str) -> bytes:
        """Ids of a text that spells the name of a byte piece, which is then text like any other."""
        self.literal = self.literal or self.model.tokenizer(literal_bytes=True)
        found = self.literal.encode(text, add_special_tokens=False)
        out: list[int] = []
        for i, (a, b) in zip(found.ids, found.offsets, strict=True):
            out += [self.byte_ids[x] for x in text[a:b].encode()] if i == self.model.unknown and self.model.byte_fallback else [i]
        return np.array(out, "<u4").tobytes()

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; those of one marker and no other white space go as one text, cut where a marker starts."""
        simple = [c for c in chunks if _ONE_MARK(c)]
        ids = np.array(self.joined.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.starts[ids]) * 4).tolist() if len(ids) else []
        if len(cuts) != len(simple):
            return self._raw(chunks)
        raw = ids.tobytes()
        found = dict(zip(simple, (raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)), strict=True)) if simple else {}
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._raw(rest), strict=True))
        return [found[c] for c in chunks]

    def normalise(self, texts: list[str]) -> list[str]:
        """Texts after the model's normaliser, with markers for spaces and the marker in front if the model has one."""
        plain = not self.model.charsmap and not self.model.single_spaces
        made = [t.replace(" ", SPACE) if plain else self._normal(t) for t in texts]
        return [SPACE + t if t else t for t in made] if self.model.dummy_prefix else made

    def _normal(self, text: str) -> str:
        if not (self.user and self.charsmap and self.user.search(text)):
            return self.normalizer.normalize_str(text)
        at, parts = 0, []
        for m in self.user.finditer(text):
            parts += [self.charsmap.normalize_str(text[at : m.start()]), m.group()]
            at = m.end()
        whole = "".join([*parts, self.charsmap.normalize_str(text[at:])])
        return (re.sub(" {2,}", " ", whole.strip(" ")) if self.model.single_spaces else whole).replace(" ", SPACE)

    def _segments(self, text: str) -> list[str]:
        """A normalised text cut at user-defined pieces, which are segments of their own at odd places."""
        return re.split(f"({self.user.pattern})", text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encode_normalised(self.normalise(texts))[0]]

    def encode_normalised(self, normal: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of normalised texts, and whether a text holds a chunk on which the libraries are known to differ."""
        if self.user:
            with_user = {i: self._segments(t) for i, t in enumerate(normal) if self.user.search(t)}
            parts = [p for s in with_user.values() for p in s[::2]]
            plain = iter(self._plain(["" if i in with_user else t for i, t in enumerate(normal)] + parts)[0])
            ids = [next(plain) for _ in normal]
            for i, s in with_user.items():
                ids[i] = b"".join(next(plain) if j % 2 == 0 else self.user_ids[p] for j, p in enumerate(s))
            return ids, [False] * len(ids)
        return self._plain(normal)

    def _plain(self, normal: list[str]) -> tuple[list[bytes], list[bool]]:
        if not self.chunked:
            return self._raw(normal), [False] * len(normal)
        split = [_CHUNK.findall(t) for t in normal]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
            self.odd.clear()
        missing = list(set().union(*split).difference(self.cache))
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            ids = self._chunks(part)
            self.cache.update(zip(part, ids, strict=True))
            if self.parity_by_chunk:
                self.odd.update(self._unlike(part, ids))
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split], [not self.odd.isdisjoint(c) if self.odd else False for c in split]

    def _unlike(self, chunks: list[str], ids: list[bytes]) -> list[str]:
        """Chunks of which the sentencepiece library gives other ids."""
        theirs = self.other.encode([c[1:].replace(SPACE, " ") for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if not c.strip(SPACE):  # markers alone end a text; the library sees them so behind a word
                theirs[i] = self.other.encode("a" + " " * len(c))[len(self.other.encode("a")) :]
        sizes = list(map(len, theirs))
        flat = np.fromiter(chain.from_iterable(theirs), "<u4", sum(sizes)).tobytes()
        if flat == b"".join(ids) and [4 * n for n in sizes] == list(map(len, ids)) and all(c[0] == SPACE for c in chunks):
            return []
        return [c for c, a, b in zip(chunks, ids, theirs, strict=True) if c[0] != SPACE or a != np.array(b, "<u4").tobytes()]

    def parity(self, texts: list[str], ids: list[bytes], odd: list[bool]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids of each text."""
        if self.parity_by_chunk:
            return [not x for x in odd]
        return [a == np.array(b, "<u4").tobytes() for a, b in zip(ids, self.other.encode(texts, num_threads=1), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; control pieces have none, unknown ones a sign of their own.

        The bytes of all pieces are put together at once; the library decodes texts with byte pieces that are no UTF-8.
        """
        flat = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
        size = self.piece_sizes[flat]
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.piece_starts[flat] - (ends - size), size)
        raw = self.piece_bytes[at].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]].tolist()
        return [self._text(raw[a:b], x) for a, b, x in zip(cuts[:-1], cuts[1:], ids, strict=True)]

    def _text(self, raw: bytes, ids: np.ndarray) -> str:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self.tokenizer.decode(ids[~self.control[ids]].tolist(), skip_special_tokens=False)
        return text.removeprefix(" ") if self.model.dummy_prefix else text


_codecs: dict[str, Codec] = WORKER_CACHES.setdefault("spm", {})


def codec(path: str) -> Codec:
    """This worker's codec for a model file."""
    if path not in _codecs:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32 bit), ``parity, round_trip`` of every whole text.

    ``parity``: the sentencepiece library gives the same ids. ``round_trip``: decoding gives the normalised text
    back (for a model without a character map the text itself). Null texts count as empty and have no ids; null ids and
    repeated rows stay; texts are never cut; an empty table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("spm")
        own = codec(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            normal = own.normalise(texts)
            ids, odd = own.encode_normalised(normal)
            back = own.decode([np.frombuffer(x, "<u4") for x in ids])
            drop = int(own.model.dummy_prefix)
            trip = [a == b[drop:].replace(SPACE, " ") for a, b in zip(back, normal, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(own.parity(texts, ids, odd)), pa.array(trip)], names=["doc_id", "ids", "parity", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, ids binary, parity boolean, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows of ids (binary, little-endian unsigned 32 bit).

    Null ids of pieces count as none and give an empty text; rows and null document ids stay; an empty table gives none.
    An id that the model does not have is an error.
    """
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("spm")
        own = codec(path)
        for batch in batches:
            texts = own.decode([np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")
