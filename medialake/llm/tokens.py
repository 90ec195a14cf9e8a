"""Token ids of a byte-level BPE vocabulary, chunk by chunk."""

from __future__ import annotations

import base64
import re
from array import array
from itertools import repeat

import numpy as np
import tiktoken
from tokenizers import Tokenizer


class ByteBpe:
    """batch(texts): little-endian unsigned 32-bit bytes of the ids that tokenizers gives with add_special_tokens=False.

    The vocabulary's pre-tokenizer has a boundary wherever white space follows something else, so a text is cut there, each distinct chunk is encoded once, in batches, and the ids are
    kept. Texts with white space other than blanks, line ends and tabs in runs, where such a cut could differ, and texts with a special token's string are encoded whole, by tokenizers.

    ranks, pattern: a named option, the same vocabulary as a file of merge ranks and the pattern of its words. Chunks then go through these, five times as fast as tokenizers, whose encodings hold
    more than ids; of every batch one text, up to CHECKED characters of it, is held against tokenizers, and a difference is an error.
    """

    RUNS, ODD, CHUNK = re.compile(r" \s"), re.compile(r"[^\S \n\t]"), re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
    CHECKED = 2000

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, keep: int = 200_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = None
        if ranks:
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.known.update(zip(part, self.whole(part) if self.ranks is None else [array("I", ids).tobytes() for ids in map(self.ranks.encode_ordinary, part)]))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in order."""
        out = []
        if self.ranks is not None and texts:
            start = min(texts[0][: self.CHECKED].split("\n"), key=len)
            if self.ids(start) != self.whole([start])[0]:
                raise ValueError("the ranks and the tokenizers file are not of one vocabulary")
        for text in texts:
            out.append(self.ids(text))
        return out

    def ids(self, text: str) -> bytes:
        chunks = self.chunks(text)
        if chunks is None:
            return self.whole([text])[0]
        if len(self.known) > self.keep:  # what is used again comes back from the older ones, so common words stay
            self.known, self.older = {}, self.known
        missing = set(chunks).difference(self.known)
        self.known.update((c, self.older[c]) for c in missing & self.older.keys())
        self.learn([c for c in missing if c not in self.known])
        return b"".join(map(self.known.__getitem__, chunks))

    def chunks(self, text: str) -> list[str] | None:
        """The text in pieces that no token spans, or None where it must be encoded whole."""
        if any(s in text for s in self.special):
            return None
        if self.RUNS.search(text):
            return None if self.ODD.search(text) else self.CHUNK.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(str.__add__, repeat(" "), rest)] if first else [*map(str.__add__, repeat(" "), rest)]
