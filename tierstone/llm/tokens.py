"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer of word_bpe_49k.json drops white space and never looks across it, so a text's ids are those of its
white-space separated chunks, one after the other. Lower-casing A-Z first changes nothing, because the tokenizer does so itself, except
in the names of special tokens; chunks that hold one's opening go through unchanged.
"""

from __future__ import annotations

import re

import numpy as np

from .util import cache

TOKENIZER = "word_bpe_49k.json"
#: A cache that has grown to this many entries becomes the old generation; entries used again move on from it.
CACHE_WORDS = 200_000
#: Chunks over this many bytes are not kept beyond the call that met them.
LONG = 64
#: Printable ASCII and the letters of Latin-1, for which the quick path below is exact.
_UNPLAIN = re.compile(r"[^ !-~À-ÖØ-öø-ÿ]|<\|")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\s]+| ")
#: No token has this id; it marks the end of a chunk.
_GAP = b"\xff\xff\xff\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    free = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(free)) for b in range(256)]


class WordTokens:
    """ids(text) as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.full.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.full.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.letters = _byte_letters()
        self.chunks, self.words = Generations(), Generations()
        self.words.now[" "] = _GAP

    def ids(self, text: bytes) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; unknown chunks of all of them are learnt together."""
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        new = self.chunks.lacking(set().union(*split))
        long = [c for c in new if len(c) > LONG]
        self._learn(list(new))
        known = self.chunks.now.__getitem__
        out = [b"".join(map(known, chunks)) for chunks in split]
        for c in long:
            del self.chunks.now[c]
        return out

    def _learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            text = b" ".join(part).decode("utf-8")
            if _UNPLAIN.search(text):
                plain = []
                for c in part:
                    s = c.decode("utf-8")
                    if _UNPLAIN.search(s):
                        self.chunks.now[c] = np.array(self.full.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
                    else:
                        plain.append(c)
                part, text = plain, b" ".join(plain).decode("utf-8")
            if part:
                self._learn_plain(part, text)

    def _learn_plain(self, part: list[bytes], text: str) -> None:
        """``text`` is the chunks of ``part``, parted by single spaces. Its words are looked up in turn, and a mark stands for each space."""
        pieces = _PIECES.findall(text.lower())
        words = list(self.words.lacking(set(pieces)))
        for i in range(0, len(words), 2000):
            self._learn_words(words[i : i + 2000])
        raw = b"".join(map(self.words.now.__getitem__, pieces))
        gaps = np.flatnonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF) * 4
        starts, ends = [0, *(gaps + 4).tolist()], [*gaps.tolist(), len(raw)]
        self.chunks.now.update(zip(part, [raw[a:b] for a, b in zip(starts, ends)]))

    def _learn_words(self, words: list[str]) -> None:
        spelled = [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        ids = np.array(self.bare.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        assert len(last) == len(words), "a word has no end token"
        raw = ids.tobytes()
        stops = (last * 4).tolist()
        self.words.now.update(zip(words, [raw[a:b] for a, b in zip([0, *stops], stops)]))


class Generations:
    """A bounded cache. When it is full, what it holds becomes the old generation, from which entries that are used again come back."""

    def __init__(self) -> None:
        self.now: dict = {}
        self.old: dict = {}

    def lacking(self, wanted: set) -> set:
        """What of ``wanted`` is not known; all the rest is in ``now`` after the call."""
        if len(self.now) > CACHE_WORDS:
            self.old, self.now = self.now, {" ": _GAP}
        new = wanted.difference(self.now)
        back = new.intersection(self.old) if self.old else ()
        for x in back:
            self.now[x] = self.old[x]
        return new.difference(back) if back else new


def load(path: str) -> WordTokens:
    """One per Python worker."""
    loaded = cache("tokens")
    if path not in loaded:
        loaded[path] = WordTokens(path)
    return loaded[path]
