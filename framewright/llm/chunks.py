"""Exact tokenization by distinct chunks, for tokenizers that never merge across white space.

A text is cut before every single white-space character that stands between two other characters.
Pre-tokenizers that end a piece at white space give the pieces of each chunk in turn the same as
those of the whole text, so a worker encodes each distinct chunk once and reuses its ids.  Chunks are made of pieces in turn, so distinct words are encoded once whatever mark
follows them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

CHUNK = re.compile(r"\s*\S+(?:\s{2,}\S+)*(?:\s+\Z)?|\s+")
SAFE = re.compile(r"(?<=\S)(?=\s\S)")
#: White space for Python alone: pre-tokenizers take it as any other mark.
SEPARATOR = re.compile(r"[\x1c-\x1f]")
#: Characters of a text that are cut into chunks at once; more is taken piece by piece.
PIECE = 1 << 20
#: Distinct chunks, and runs within them, that a worker remembers, and the longest one.
MEMO, LONGEST = 600_000, 80


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters that end where a chunk ends."""
    start = 0
    while len(text) - start > PIECE:
        found = SAFE.search(text, start + PIECE)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


#: Runs of which each is one piece of either pre-tokenizer, if nothing else stands in a chunk.
RUN = re.compile(r"\n|[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-&(-/:-@\[-`{-~]+|[0-9]+")
#: The same runs with the space before them, or without white space and with single digits; what a
#: text has besides (marks of its own language, apostrophes, doubled spaces) leaves a gap.
TILE_SPACED = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[!-&(-/:-@\[-`{-~]+| ?[0-9]+|\n(?=\S|\Z)")
TILE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-&(-/:-@\[-`{-~]+|[0-9]")
DOUBLE = re.compile(r"\s\s|\A\s")


def _alphabet() -> dict[int, str]:
    """Byte-level tokenizers' letter for each byte: itself if printable, else the next one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class ChunkMemo:
    """``of(text)``: the values of the text's chunks, each distinct one having been encoded once.

    Plain letters, digits and marks go to the library's model run by run; any other chunk is encoded
    whole.  ``value`` makes the value of a list of ids, ``join`` that of several values.
    """

    def __init__(self, tokenizer, value: Callable[[list[int]], object], join: Callable, spaces: bool, special: str = "<|"):
        self.tokenizer, self.value, self.join, self.spaces, self.special = tokenizer, value, join, spaces, special
        self.bytes, self.chunks, self.runs, self.tile = _alphabet(), {}, {}, TILE_SPACED if spaces else TILE
        self.pieces, self.normal = tokenizer.model.tokenize, None if spaces else tokenizer.normalizer.normalize_str  # each look-up copies

    def whole(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def run(self, run: str):
        """The value of one piece of the pre-tokenizer."""
        plain = run if self.normal is None else run.lower() if run.isascii() else self.normal(run)
        if plain.isascii() and plain != "\n":
            plain = self.bytes[32] + plain[1:] if plain[0] == " " else plain
        else:
            plain = plain.encode().decode("latin-1").translate(self.bytes)
        return self.value([t.id for t in self.pieces(plain)])

    def chunk(self, chunk: str):
        """The value of a chunk that stands in a text between single white-space characters."""
        found, lead = RUN.findall(chunk), ""
        if chunk[0] == " ":
            lead = " " if self.spaces else ""
        if sum(map(len, found)) + (chunk[0] == " ") != len(chunk):
            return self.whole(chunk)
        values = []
        for run in found:
            if run == "\n" and not self.spaces:
                continue
            for one in run if run.isdigit() and not self.spaces else (run,):
                values.append(self.runs.get(lead + one) or self._one(lead + one))
                lead = ""
        return self.join(values)

    def _one(self, run: str):
        value = self.run(run)
        if len(run) <= LONGEST:
            if len(self.runs) >= MEMO:
                self.runs.clear()
            self.runs[run] = value
        return value

    def _piece(self, piece: str) -> list:
        """The values of a part of a text that starts and ends where a chunk does."""
        runs = self.tile.findall(piece)
        gaps = 0 if self.spaces else sum(map(piece.count, " \n\t\r"))
        if sum(map(len, runs)) + gaps == len(piece):  # nothing but plain runs, each a piece of its own
            out = list(map(self.runs.get, runs))
            if None in out:
                for i in [i for i, value in enumerate(out) if value is None]:
                    out[i] = self.runs.get(runs[i]) or self._one(runs[i])
            return out
        out = []
        for c in CHUNK.findall(piece):
            value = self.chunks.get(c)
            if value is None:
                value = self.whole(c) if DOUBLE.search(c) or c[-1].isspace() else self.chunk(c)
                if len(c) <= LONGEST:
                    if len(self.chunks) >= MEMO:
                        self.chunks.clear()
                    self.chunks[c] = value
            out.append(value)
        return out

    def of(self, text: str) -> list:
        if self.special in text or SEPARATOR.search(text):  # special strings are found before chunks, so such a text stays whole
            return [self.whole(text)]
        return [value for piece in pieces(text) for value in self._piece(piece)] if text else []


_memos: dict = {}


def memo_of(path: str, kind: str, make: Callable):
    """``make()`` once per worker for a tokenizer file and kind of value."""
    if (path, kind) not in _memos:
        _memos[path, kind] = make()
    return _memos[path, kind]


def load(path: str):
    """The tokenizers library's tokenizer of a file, on one thread."""
    import gc
    import os

    gc.freeze()  # what a worker remembers has no cycles

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_chunks(path: str) -> bool:
    """Whether a tokenizer file is of a kind for which chunks are known to be exact.

    True for the byte-level pre-tokenizer with its own pattern and no normalizer, and for a removing
    split on a pattern without white space after normalizers that act on either side of it alone.
    """
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    added = made.get("added_tokens") or []
    if any(not x["content"].startswith("<|") or re.search(r"\s", x["content"]) or x["normalized"] or x["single_word"] for x in added) or made.get("truncation") or made.get("padding"):
        return False
    pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
    if pre.get("type") == "ByteLevel":
        return norm is None and pre.get("use_regex") is True and not pre.get("add_prefix_space")
    steps = pre.get("pretokenizers") or [{}]
    first, kinds = steps[0], [x["type"] for x in (norm or {}).get("normalizers", [])]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s" in pattern and " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    return apart and set(kinds) <= {"NFC", "Replace", "Lowercase"} and all(x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in steps[1:])
