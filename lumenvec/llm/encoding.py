"""Token ids of whole texts, as the tokenizers library gives them.

Byte-level BPE splits a text by a pattern and merges inside each part, so the
ids of a part depend on the part alone. A run of white space always begins a
new part if no white space stands before it: parts that hold anything else
stop there. A text whose white space is single spaces and newlines between
words therefore falls into units, a word with the space or newline before it,
and the ids of the text are the ids of its units in order. Words come back all
the time; the library encodes each unit once for each worker's cache.

Every other text (other white space, or two in a row, or at an end; an added
token's string in it) goes to the library as a whole.
"""

from __future__ import annotations

import functools
import re
import struct

#: A worker keeps the ids of this many units of each kind at most.
UNIT_CACHE = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
# White space beyond the space and newline (Unicode White_Space, and U+001C-U+001F).
OTHER_WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer without truncation or padding, one for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: A word of the Latin letters that every version of Unicode has, and the ASCII signs after it
#: (all but the apostrophe, which can begin a part with letters).
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]*)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Units(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a word with ``before`` in front."""

    def __init__(self, tokenizer, before: str) -> None:
        super().__init__()
        self.tokenizer, self.before = tokenizer, before
        self.letters, self.tails = byte_letters(), {"": b""}

    def whole(self, text: str) -> bytes:
        return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        """A Latin word is one part and the signs after it another; signs alone are
        one part. The library's model merges a part by itself; other words go
        through the library's whole way."""
        if len(self) >= UNIT_CACHE:
            self.clear()
        if not (m := LATIN.fullmatch(word)):
            found = self.whole(self.before + word)
        elif m[1] and m[2]:
            if m[2] not in self.tails:
                if len(self.tails) >= UNIT_CACHE:
                    self.tails = {"": b""}
                self.tails[m[2]] = self.whole(m[2])
            found = self[m[1]] + self.tails[m[2]]
        else:
            part = (self.before + word).encode().decode("latin-1").translate(self.letters)
            found = ids_bytes([x.id for x in self.tokenizer.model.tokenize(part)])
        self[word] = found
        return found


def ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        import json

        self.tokenizer = library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        plain = byte_level and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"]["add_prefix_space"]
        # Only a byte-level tokenizer of this kind, without a normalizer, falls into units.
        self.by_units = bool(plain and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.first, self.spaced = Units(self.tokenizer, ""), Units(self.tokenizer, " ")
        self.newline = self.first.whole("\n")

    def units(self, text: str) -> list[list[str]] | None:
        """The words of each line; None if the text doesn't fall into units."""
        if not self.by_units or any(c in text for c in OTHER_WHITE) or any(a in text for a in self.added):
            return None
        lines = [x.split(" ") for x in text.split("\n")]
        return None if any("" in x for x in lines) else lines

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if (lines := self.units(text)) is None:
            return self.first.whole(text)
        parts, first, spaced = [], self.first, self.spaced
        for words in lines:
            parts.append(self.newline)
            parts.append(first[words[0]])
            parts += [spaced[w] for w in words[1:]]
        return b"".join(parts[1:])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so its cache lasts from batch to batch and task to task."""
    return Encoder(path)
