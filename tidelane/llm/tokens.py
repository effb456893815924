"""Token ids by a public tokenizer file, with bounded caches.

Where a tokenizer's own settings say that its normaliser and splitter act on each white-space-free stretch of a text alone, ids of a text are
the ids of its stretches in order, and those of a stretch are the ids of the pieces that the tokenizer's pattern finds in it. Workers keep the ids of
stretches and pieces that they have seen, and the tokenizers library encodes the new pieces. Texts outside a conservative set of characters, and all texts of other tokenizers, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import regex

from tidelane.llm import textops

#: Stretches and pieces that a task keeps; when there would be more, it begins anew. Between tasks a worker keeps the first KEPT stretches and KEPT_PIECES pieces.
STRETCHES, PIECES, KEPT, KEPT_PIECES = 500_000, 600_000, 60_000, 240_000

#: Latin-1 without its odd white space, case and number forms: normal forms and lower case act on each of these characters alone.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
_PROBES = ["Two words", " it's  WE'LL\tnever\n\r'd ", "a1b22 c_d -- e.f!? \xe9t\xc9 \xa7\xb7x\xdf", "x" * 99 + " <|y|> \xc0\xff'"]

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _piece_pattern(spec: dict) -> regex.Pattern | None:
    """The pattern of a tokenizer whose settings lower-case and normalise character by character and keep just its matches, if it has no white space in
    them and doesn't look around: then what it finds in a piece alone is that piece."""
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    fine = all(x.get("type") in ("NFC", "Lowercase") or x.get("type") == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps)
    cuts = splitter.get("pretokenizers", [splitter])
    first, rest = cuts[0], cuts[1:]
    fine &= any(x.get("type") == "Lowercase" for x in steps) and spec.get("post_processor") is None
    fine &= first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and all(x.get("type") == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
    if not fine or any(x in first["pattern"].get("Regex", "(?") for x in ("(?", "\\b", "\\B", "$", "\\A", "\\Z", "\\G", "\\K")):
        return None
    pattern = regex.compile(first["pattern"]["Regex"])
    found = [m[0] for text in [*_PROBES, "a \t\n\r b"] for m in pattern.finditer(text.lower())]
    return None if pattern.groups or any(c.isspace() for x in found for c in x) else pattern


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.stretches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.loads(f.read())
        spec.pop("model")
        self.pattern = _piece_pattern(spec)
        self.by_stretches = self.pattern is not None and [b"".join(self._stretched(x.lower().split())) for x in _PROBES] == self._whole(_PROBES)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of a list of pieces, many to a text: the library tells which piece an id is of."""
        out: list[bytes] = []
        lines = [pieces[a : a + 512] for a in range(0, len(pieces), 512)]
        for line, found in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids, word = np.array(found.ids, "<u4"), np.array(found.word_ids)
            cuts = np.searchsorted(word, np.arange(len(line) + 1))
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] if len(word) and word[-1] == len(line) - 1 else self._whole(line)
        return out

    def _stretched(self, stretches: list[str]) -> list[bytes]:
        """Ids of each of a list of lower-case stretches, by pieces."""
        cut = list(map(self.pattern.findall, stretches))
        new = set().union(*cut).difference(self.pieces)
        if len(self.pieces) + len(new) > PIECES:
            self.pieces = {}
            new = set().union(*cut)
        new = list(new)
        self.pieces.update(zip(new, self._each(new), strict=True))
        get = self.pieces.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        split = [x.lower().split() if self.by_stretches and PLAIN.fullmatch(x) and not any(t in x for t in self.special) else None for x in texts]
        new = list(set().union(*(x for x in split if x)).difference(self.stretches))
        if len(self.stretches) + len(new) > STRETCHES:
            self.stretches = {}
            new = list(set().union(*(x for x in split if x)))
        if new:
            self.stretches.update(zip(new, self._stretched(new), strict=True))
        get = self.stretches.__getitem__
        out = [None if x is None else b"".join(map(get, x)) for x in split]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def trimmed(batches):
    """The same batches; at their end, encoders keep only what they saw first, as idle workers stay for later tasks."""
    try:
        yield from batches
    finally:
        for enc in _ENCODERS.values():
            if len(enc.stretches) > KEPT:
                enc.stretches = dict(islice(enc.stretches.items(), KEPT))
            if len(enc.pieces) > KEPT_PIECES:
                enc.pieces = dict(islice(enc.pieces.items(), KEPT_PIECES))


def forget() -> None:
    """Drops this process's encoders and all they keep."""
    _ENCODERS.clear()


textops.on_release(forget)


def groups(texts: list, limit: int = 1 << 20):
    """Slices of a list of about ``limit`` characters."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
