"""Token ids of whole texts with a public tokenizer, in bounded memory.

Byte-level BPE never merges across the start of " x" where x and the character
before the space are no white space, nor across a lone line break. So such texts
fall apart at their spaces and line breaks, the ids of each piece are looked up
in a bounded table, and the tokenizer encodes new pieces only. Other texts
(doubled white space, special tokens, another kind of tokenizer) go to the
tokenizer whole. Results are the same.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Pieces in each of the two generations that a worker remembers (some 100 MB each).
REMEMBERED = 500_000
_LONG = 1 << 20
_MARKS = ".,;:!?"
#: White space but the space and the line break, and what some libraries take for it.
_RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_RARE_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    _encoders.clear()


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in made.get("added_tokens") or []]
        self.apart = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not made.get("normalizer") and not any(" " in t or "\n" in t for t in self.specials)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.remembered, self.known, self.older, self.marks = remembered, {}, {}, {}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # a piece starts with its only space or line break, so with a token that does
        self.opens = np.array([x.startswith("Ġ") for x in names]), np.array([x == "Ċ" for x in names])

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _whole(self, text: str) -> bool:
        """Whether the text may not be cut: at spaces only single ones between
        other characters keep pieces apart, at line breaks one or two."""
        if any(t in text for t in self.specials) or text[-1] == " " or text.endswith("\n\n") or "\n\n\n" in text or "\n\n " in text:
            return True
        return any(c in text for c in _RARE_ASCII) if text.isascii() else bool(_RARE.search(text))

    def _learn(self, pieces: list[str]) -> None:
        known, older, ended, spaced, broken = self.known, self.older, [], set(), set()
        for p in pieces:
            if p in older:
                known[p] = older[p]
            elif p[0] == "\n":
                broken.add(p)
            elif p[-1] in _MARKS and (base := p.rstrip(_MARKS)) and base[-1].isalnum():
                ended.append((p, base))
                if base in older:
                    known[base] = older[base]
                elif base not in known:
                    spaced.add(base)
            else:
                spaced.add(p)
        self._encode_new([*spaced], " ", self.opens[0])
        self._encode_new([*broken], "", self.opens[1])
        for p, base in ended:
            mark = p[len(base) :]
            if mark not in self.marks:
                self.marks[mark] = self._ids(mark)
            known[p] = known[base] + self.marks[mark]

    def _encode_new(self, new: list[str], before: str, opens: np.ndarray) -> None:
        if new:
            ids = self._ids(before + before.join(new))
            cut = (np.flatnonzero(opens[np.frombuffer(ids, self.kind)]) * self.kind.itemsize).tolist()
            if len(cut) != len(new):
                raise ValueError("the tokenizer does not keep pieces apart")
            self.known.update(zip(new, map(ids.__getitem__, map(slice, cut, [*cut[1:], len(ids)]))))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian integers of ``kind``."""
        if not self.apart:
            return self._ids(text)
        if len(text) <= _LONG:
            return self._short(text)
        out, at = [], 0
        while at < len(text):  # cut a very long text where a piece starts
            cut = at + _LONG
            while 0 <= (cut := text.find(" ", cut, len(text) - 1)):
                if text[cut - 1].isalnum() and text[cut + 1].isalnum():
                    break
                cut += 1
            cut = cut if cut > 0 else len(text)
            out.append(self._short(text[at:cut]))
            at = cut
        return b"".join(out)

    def _short(self, text: str) -> bytes:
        if not text:
            return b""
        lines = text.replace("\n", " \n")
        if self._whole(text) or "  " in lines:
            return self._ids(text)
        pieces = lines.split(" ")
        # the first word has nothing before it: look it up behind a line break, which goes
        skip = 0
        if pieces[0]:
            pieces[0], skip = "\n" + pieces[0], self.kind.itemsize
        else:
            del pieces[0]
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known = self.known
        parts = list(map(known.get, pieces))
        if None in parts:
            at = [i for i, ids in enumerate(parts) if ids is None]
            self._learn([pieces[i] for i in at])
            for i in at:
                parts[i] = known[pieces[i]]
        return b"".join(parts)[skip:]
