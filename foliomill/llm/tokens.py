"""Encode texts with a public tokenizer through a bounded cache of text segments.

Encoding a whole text costs about a microsecond a byte. The pre-tokens of a
segment that begins at a single space or line break don't depend on what stands
around it, so each distinct segment is cut into pre-tokens once, those go through
the merges of the library, and a text's ids are its segments' ids joined. Texts
where white space runs could reach over a cut are given to the library whole.
Byte-level files whose ids are ranks go through the ranks library, text by text.
Tests compare with whole-text encoding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Python's \s is a superset of the tokenizers' white space, so this errs on the slow side.
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
_CACHED_LENGTH = 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the characters
    from 256 on in their order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


BYTE_CHARACTERS = byte_characters()
_TRANSLATION = {b: c for b, c in enumerate(BYTE_CHARACTERS)}


def byte_mapped(text: str) -> str:
    return text.encode().decode("latin-1").translate(_TRANSLATION)


class _Segments(dict):
    """Ids by segment in two generations: the older one is dropped when the younger is full."""

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self._compute, self._half, self._old = compute, limit // 2, {}

    def __missing__(self, part: str) -> bytes:
        ids = self._old.get(part)
        if ids is None:
            ids = self._compute(part)
        if len(part) <= _CACHED_LENGTH:
            if len(self) >= self._half:
                self._old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class SegmentEncoder:
    """``encode(text) -> bytes`` of little-endian ids, equal to encoding the text whole.

    ``split`` cuts a segment into pre-tokens, ``merge`` gives one pre-token's ids,
    ``whole`` encodes a text without cuts. With ``spaced``, a space belongs to the
    segment that follows it; else white space is dropped.
    """

    def __init__(
        self,
        split: Callable[[str], list[str]],
        merge: Callable[[str], list[int]],
        whole: Callable[[str], list[int]],
        dtype: str = "<u2",
        spaced: bool = True,
        limit: int = 1_000_000,
    ) -> None:
        self._split, self._merge, self._whole = split, merge, whole
        self._dtype, self._spaced = dtype, spaced
        self._cache = _Segments(self._segment, limit)  # by segment, without its leading space
        self._inner = _Segments(self._merged, limit // 10)  # by pre-token inside a segment

    def _merged(self, pre_token: str) -> bytes:
        return np.array(self._merge(pre_token), self._dtype).tobytes()

    def _segment(self, part: str) -> bytes:
        """The ids of a segment; ``part`` lacks the space it begins with."""
        if not self._spaced:
            tokens = self._split(part)
        elif part.isalpha():
            return self._merged(" " + part)
        else:
            tokens = self._split(part if part[:1] == "\n" else " " + part)
        if len(tokens) == 1:
            return self._merged(tokens[0])
        return b"".join(map(self._inner.__getitem__, tokens))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        head = b""
        if self._spaced:
            if _LONG_RUN.search(text):
                return np.array(self._whole(text), self._dtype).tobytes()
            # The first part begins the text; the rest lack their space or begin with a line
            # break. Of a run of two, the first character stands alone, as in the pattern.
            parts = text.replace("\n", " \n").split(" ")
            if parts[0]:
                head = b"".join([self._merged(t) for t in self._split(parts[0])])
            del parts[0]
        else:
            parts = text.replace("\n", " ").split(" ")
        return head + b"".join(map(self._cache.__getitem__, parts))


class WholeTexts:
    """``encode(text) -> bytes`` of little-endian ids, by an encoder of whole texts."""

    def __init__(self, encode: Callable[[str], list[int]], dtype: str) -> None:
        self._encode, self._dtype = encode, dtype

    def encode(self, text: str | None) -> bytes:
        return np.array(self._encode(text), self._dtype).tobytes() if text else b""


_LOADED: dict[tuple[str, str], SegmentEncoder | WholeTexts] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizers file of byte-level BPE; special tokens are their text."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    special = {t["id"]: t["content"] for t in parts["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
    known = {i: bytes(map(byte_of.__getitem__, piece)) for piece, i in parts["model"]["vocab"].items() if i not in special}
    known |= {i: content.encode() for i, content in special.items()}
    return [known.get(i, b"") for i in range(max(known) + 1)]


def _ranks(path: str) -> dict[bytes, int] | None:
    """Ids as ranks, if merging the pair with the lowest id is what the file's merges say: ids rise with
    the merges, and nothing but plain byte-level pre-tokens stands before them. None otherwise."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    before, model = parts["pre_tokenizer"], parts["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    special = {t["id"] for t in parts["added_tokens"]}
    plain = parts["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    whole = len(made) + 256 + len(special - set(made)) >= len(model["vocab"])
    if not (plain and whole and model["type"] == "BPE" and all(a < b for a, b in zip(made, made[1:], strict=False))):
        return None
    return {t: i for i, t in enumerate(token_bytes(path)) if i not in special}


def byte_level_encoder(path: str, pattern: str, dtype: str = "<u2") -> SegmentEncoder | WholeTexts:
    """For a tokenizers file of byte-level BPE whose pre-tokens ``pattern`` cuts.

    Where the file's ids are ranks, the ranks library gives the same ids in half the time.
    """
    if (path, dtype) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = _ranks(path)
        if ranks is not None:
            import tiktoken

            fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path, dtype] = WholeTexts(fast.encode_ordinary, dtype)
            return _LOADED[path, dtype]
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        tokenize = tokenizer.model.tokenize
        _LOADED[path, dtype] = SegmentEncoder(
            regex.compile(pattern).findall,
            lambda token: [t.id for t in tokenize(byte_mapped(token))],
            lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
            dtype,
        )
    return _LOADED[path, dtype]


def word_end_encoder(path: str, dtype: str = "<u2") -> SegmentEncoder:
    """For a tokenizers file that drops white space, normalises words and marks their ends."""
    if (path, dtype) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        pattern = json.loads(tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        cut, normal, tokenize = regex.compile(pattern).findall, tokenizer.normalizer.normalize_str, tokenizer.model.tokenize
        _LOADED[path, dtype] = SegmentEncoder(
            lambda segment: cut(segment.lower() if segment.isascii() else normal(segment)),
            lambda token: [t.id for t in tokenize(byte_mapped(token))],
            lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
            dtype,
            spaced=False,
        )
    return _LOADED[path, dtype]
