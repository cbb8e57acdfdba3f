"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks already encoded.

Two kinds of tokenizers, told by the rules that their file states, cut a text before they look for merges, so the ids
of a text are those of its chunks in order.  A chunk is a plain word before a mark or white space, else a run of
non-space; at the byte level with at most one space before it, and runs of white space are chunks, too (the other kind
drops white space).  Each distinct chunk is encoded by the library, plain words by its model alone.  A text that holds the mark of a special token is encoded whole, and so is every
text if the tokenizer's rules are others.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Iterable

from .common import worker_cache

#: Chunks kept by a worker, about 200 bytes each.
CACHE = 600_000

#: Unicode's White_Space property, which the byte-level tokenizer cuts at.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Normalizer and pre-tokenizer of the two kinds, as the library writes them.
BYTE_LEVEL_RULES = ("None", "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)")
WORD_RULES = (
    'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
    "Sequence(pretokenizers=[Split(pattern=Regex(\"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+\"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])",
)
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
#: A word of letters whose class, case and composed form no version of Unicode has changed, before marks or white space.
_MARKS = "!-&(-/:-@[-`{-~"
_BYTE_LEVEL = re.compile(f" ?[{_LETTERS}]+(?=[{_MARKS}{WHITE_SPACE}]|\\Z)| ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
_BETWEEN_SPACES = re.compile(f"[{_LETTERS}]+(?=[{_MARKS} \\n]|\\Z)|[^ \\n]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: The rule of byte-level tokenizers: a visible Latin-1 character stands for itself, the other bytes follow from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = "".join(chr(b if b in _VISIBLE else 256 + sum(x not in _VISIBLE for x in range(b))) for b in range(256))


class Encoder(dict):
    """Ids by chunk as little-endian unsigned 32-bit integers in bytes; ``encode`` for whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        self.byte_level = rules == BYTE_LEVEL_RULES
        self.known = rules in (BYTE_LEVEL_RULES, WORD_RULES) and type(self.model).__name__ == "BPE" and not self.model.dropout
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = (_BYTE_LEVEL if self.byte_level else _BETWEEN_SPACES).findall

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE // 2:  # the younger half becomes the older one
            self.older = self.copy()
            self.clear()
        if (ids := self.older.get(chunk)) is None:
            ids = self._encoded(chunk)
        self[chunk] = ids
        return ids

    def _encoded(self, chunk: str) -> bytes:
        if not _WORD.fullmatch(chunk):
            return whole_ids(self, chunk)
        # One word for the tokenizer: the library's model is all that is needed.
        if not self.byte_level:
            chunk = chunk.lower()
        if chunk.isascii():
            spelt = "Ġ" + chunk[1:] if chunk[0] == " " else chunk
        else:
            spelt = codecs.charmap_decode(chunk.encode(), "strict", _BYTES)[0]
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, self.chunks(t))) if self.known and not any(s in t for s in self.special) else whole_ids(self, t) for t in texts]


def whole_ids(encoder: Encoder, text: str) -> bytes:
    return array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    return worker_cache(f"encoder {path}", lambda: Encoder(path))


def slices(lengths: Iterable[int], most: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` characters together, so that memory is bounded."""
    begin = total = n = 0
    for n, x in enumerate(lengths, 1):
        total += x
        if total >= most:
            yield begin, n
            begin, total = n, 0
    if begin < n:
        yield begin, n
