"""Token ids of whole texts by a word-level BPE vocabulary of the tokenizers library.

``Encoder.encode`` gives the bytes of little-endian 32-bit ids, exactly those that the vocabulary's own
tokenizer gives. That tokenizer lower-cases, drops white space and cuts words by a pattern that
never crosses white space. Texts of Latin letters and signs are cut into words by numpy, many texts at once; the distinct words are
encoded once and kept. Texts with characters for which this is not plainly so (combining marks,
unusual spaces, special tokens) go through the tokenizer itself.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import regex

#: Words that a worker keeps, at most twice: those used last, and those before them.
KEPT = 300_000
#: Characters that are cut into words at once; longer texts are cut at white space.
SEGMENT = 1 << 20

_plain = re.compile(r"[\t\n\r -~¡-¬®-ÿĀ-įıĲ-ňŊ-ſ]*")
_white = re.compile(r"[\t\n\r ]")
#: How the vocabulary cuts words (fixed by its file): '(?:s|t|re|ve|m|ll|d), letters, one number, or other signs.
WHITE, LETTER, NUMBER, OTHER = range(4)
_kind = np.array([WHITE if chr(c).isspace() else LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER for c in range(0x180)], "u1")


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Places in lower-case plain text where a word or a run of white space starts."""
    kind = _kind[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # an apostrophe alone between other kinds takes one or two letters after it
    at = np.flatnonzero(codes[:-1] == ord("'"))
    at = at[start[at] & (kind[at + 1] == LETTER)]
    first, second = codes[at + 1], np.append(codes, 0)[at + 2]
    is_ = lambda a, letter: a == ord(letter)
    one = is_(first, "s") | is_(first, "t") | is_(first, "m") | is_(first, "d")
    two = ((is_(first, "r") | is_(first, "v")) & is_(second, "e")) | (is_(first, "l") & is_(second, "l"))
    start[at[one | two] + 1] = False
    end = np.concatenate([at[one] + 2, at[two] + 3])
    start[end[end < len(codes)]] = True
    return np.flatnonzero(start)


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others for letters from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # the same merges on words that are cut already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        suffix = self.whole.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.letters = _byte_letters()
        #: Ids by words in UTF-16, those used last and those before them.
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        text = b"\n\0".join(new).decode("utf-16-le").split("\n")  # words hold no white space
        seen = [w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w in text]
        lines = [" ".join(seen[i : i + 200]) for i in range(0, len(seen), 200)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
        end = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(end) != len(new):
            raise ValueError("the vocabulary does not mark the ends of words")
        data, end = ids.tobytes(), end.tolist()
        self.words.update(zip(new, [data[i:j] for i, j in zip([0, *end], end)]))

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; white space has none."""
        if len(self.words) > KEPT:
            self.words, self.before = {}, self.words
        own, before, new = self.words, self.before, []
        for w in [w for w in words if w not in own]:
            if w in before:
                own[w] = before[w]
            elif _kind[w[0] + 256 * w[1]] == WHITE:
                own[w] = b""
            else:
                new.append(w)
        if new:
            self._learn(new)
        return list(map(own.__getitem__, words))

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        if not any(texts):
            return [b""] * len(texts)
        # texts stand apart by white space; a plain character is one UTF-16 unit, in lower case too
        data = "\n".join(texts).lower().encode("utf-16-le")
        codes = np.frombuffer(data, "<u2")
        begin = word_starts(codes)
        offsets = np.append(2 * begin, len(data)).astype("i8")
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), "i8", len(known)) // 4
        which = words.indices.to_numpy()
        n = size[which]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - place[:-1], n) + np.arange(place[-1])].tobytes()
        length = np.fromiter(map(len, texts), "i8", len(texts)) + 1
        cut = (4 * place[np.searchsorted(begin, np.concatenate([[0], np.cumsum(length)]))]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null is empty."""
        out = [b""] * len(texts)
        group: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            for (i, _), ids in zip(group, self._plain_ids([t for _, t in group]), strict=True):
                out[i] += ids
            group, held = [], 0

        for i, t in enumerate(texts):
            t = t or ""
            if "<|" in t or not _plain.fullmatch(t):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            at = 0
            while len(t) - at > SEGMENT and (white := _white.search(t, at + SEGMENT)):
                group.append((i, t[at : white.start()]))
                at = white.start()
                flush()
            group.append((i, t[at:]))
            held += len(t) - at
            if held > SEGMENT:
                flush()
        flush()
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a process, so that the tasks of a worker share its words."""
    return Encoder(path)
