"""Token ids of whole texts as little-endian unsigned 32-bit bytes, on executors.

A tokenizer file may add special tokens. Their strings in a text are ordinary text here, as the
files' description uses the library (``encode_special_tokens = True``), so that a document can't
end another one. With ``specials`` they give the special ids, as by the library's default.

Encoders are built once per Python worker and kept between tasks. The memo tables hold a
bounded number of entries, so memory does not grow with the corpus.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Entries a generation of a memo table may hold; a table has two.
MEMO = 220_000


def byte_decoder() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, computed by rank merging.

    The file's merges are in id order and every entry is reached by them (``check`` verifies
    both), so merging by lowest id gives the library's ids several times faster.
    """

    def __init__(self, path: str, specials: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.specials = spec["model"], specials
        dec = byte_decoder()
        ranks = {}
        for token, i in model["vocab"].items():
            if all(c in dec for c in token):
                ranks[bytes(dec[c] for c in token)] = i
        self.model = model
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in added:  # as ordinary text it is spelled by other pieces
            ranks.pop(t.encode(), None)
        self.ranks = ranks
        self.lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for raw, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.lengths[i] = len(raw)
        self.enc = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added if specials else {})

    def check(self) -> bool:
        vocab = self.model["vocab"]
        joined = [m if isinstance(m, list) else m.split(" ") for m in self.model["merges"]]
        return [vocab[a + b] for a, b in joined] == list(range(256, 256 + len(joined)))

    def inside(self, raw: bytes, size: int) -> int:
        """How many ids at the beginning of a text's lie wholly inside its first ``size`` bytes."""
        ids = np.frombuffer(raw, "<u4", min(size, len(raw) // 4))
        return int(np.searchsorted(np.cumsum(self.lengths[ids]), size, "right"))

    def encode(self, texts: list[str]) -> list[bytes]:
        allowed = "all" if self.specials else set()
        return [self.enc.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]


class _Memo(dict):
    """Word -> ids, by ``learn`` where it is missing. ``turn`` lets go of what was not asked for lately."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.old[word] if word in self.old else self.learn(word)
        return ids

    def turn(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class WordBpe:
    """Ids of a lower-casing word BPE of the tokenizers library, with a memo of words.

    Its normalizer and pre-tokenizer never look across white space, so a text's ids are those
    of its words in turn. A word of letters with trailing punctuation is two pre-tokens, which
    the library's model merges by themselves; other words go through the pre-tokenizer. Texts
    with characters beyond Latin Extended-B, where case rules depend on the neighbours or
    composition matters, go to the library whole.
    """

    _word = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
    _far = re.compile("[^\u0000-\u024f]").search

    def __init__(self, path: str, dtype: str = "<u4", specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        self.full.encode_special_tokens, self.bare.encode_special_tokens = not specials, True
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search if specials else None
        self.model = self.bare.model
        self.table = {b: ord(c) for c, b in byte_decoder().items()}
        self.dtype = dtype
        self.words, self.parts = _Memo(self._learn), _Memo(self._merge)

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _merge(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if not piece:
            return b""
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return self._raw([t.id for t in self.model.tokenize(mapped)])

    def _learn(self, word: str) -> bytes:
        m = self._word(word)
        if m and m[1].isalpha():
            return self.parts[m[1]] + self.parts[m[2]]
        return self._raw(self.bare.encode(word, add_special_tokens=False).ids)

    def _beyond(self, t: str) -> bool:
        """Whether a text must go to the library whole."""
        if self.added and self.added(t):
            return True
        if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t:  # white space for Python, not for the library
            return True
        try:
            t.encode("latin-1")  # fails at the first character beyond, faster than a search
            return False
        except UnicodeEncodeError:
            return bool(self._far(t))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self._beyond(t):
                out.append(self._raw(self.full.encode(t, add_special_tokens=False).ids))
                continue
            for memo in (self.words, self.parts):
                memo.turn()
            out.append(b"".join(map(self.words.__getitem__, t.lower().replace("\n", " ").split(" "))))
        return out


@lru_cache(maxsize=4)
def encoder(kind: str, path: str, dtype: str = "<u4", specials: bool = False):
    return ByteBpe(path, specials) if kind == "byte" else WordBpe(path, dtype, specials)
