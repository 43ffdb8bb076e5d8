"""Whole-text encoding with a public word-end BPE vocabulary, through a cache of words.

The vocabulary's pre-tokenizer never joins characters across white space and its normaliser works
character by character, so a text's ids are its words' ids in order; every word is encoded by the
tokenizers library, once for as long as the cache holds it. Words of printable ASCII and lower-case Latin-1
letters are unchanged by the normaliser; they are split as the vocabulary's pattern splits them and go to the
library's model many at a time, without its normaliser. Tests compare with whole-text encoding.
"""

from __future__ import annotations

import re

import numpy as np

from .common import WORKER_CACHES

#: Words held by a worker's cache before it starts anew (about 200 bytes each).
CACHE_WORDS = 600_000
_encoders: dict[str, WordEncoder] = WORKER_CACHES.setdefault("wordbpe", {})
#: Bytes of the words that the normaliser leaves alone, and the parts that the vocabulary's pattern cuts such words into.
_PLAIN = bytes([*range(33, 65), *range(91, 127), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
_PARTS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+|\n").findall


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b if b in own else next(other)) for b in range(256))


class WordEncoder:
    """Encodes texts with a vocabulary file whose words end in ``</w>`` (:func:`vocabulary`)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.letters = np.array([ord(c) for c in byte_letters()], "<u2")
        self.letters[[10, 32]] = 10, 32

    def _ids(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _plain_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of ``_PLAIN`` bytes: all their parts in one text, cut again where a word's last part ends."""
        text = np.frombuffer(b" ".join(_PARTS(b"\n".join([*words, b""]))) + b" ", np.uint8)
        ids = np.array(self.parts.encode_batch_fast([self.letters[text].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, self.dtype)
        parts = np.cumsum(text == 32)[text == 10] - np.arange(len(words))  # up to each word's end
        cuts = ((np.flatnonzero(self.ends[ids])[parts - 1] + 1) * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def encode_bytes(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        """Ids of each UTF-8 text (little-endian, of ``dtype``), without special tokens, and ``end`` after each."""
        # special tokens are looked for before lower-casing, so texts that may hold one are encoded whole
        whole = {i: x for i, t in enumerate(texts) if b"<|" in t for x in self._ids([t])}
        split = [() if i in whole else t.lower().split() for i, t in enumerate(texts)]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        missing = set().union(*split).difference(cache)
        plain = [w for w in missing if not w.translate(None, _PLAIN)]
        for words, ids_of in ((plain, self._plain_ids), (list(missing.difference(plain)), self._ids)):
            for i in range(0, len(words), 4096):
                part = words[i : i + 4096]
                cache.update(zip(part, ids_of(part), strict=True))
        get = cache.__getitem__
        return [(whole[i] if i in whole else b"".join(map(get, words))) + end for i, words in enumerate(split)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text, without special tokens."""
        return [np.frombuffer(x, self.dtype) for x in self.encode_bytes(texts)]
