"""Whole-text encoding with a tokenizers file, fast for texts whose words repeat.

A vocabulary with the rules ``_KNOWN`` splits at white space first and encodes each pre-token on its own, so a text's
ids are the ids of its white-space-bounded segments in order.  Arrow splits a batch of whole texts and numbers its
distinct segments; each distinct segment is encoded by the tokenizers library and remembered in a bounded table.  The
result equals encoding each whole text in one call (a test holds them together).  Whole-text calls encode for any
other vocabulary, and for whoever needs spans.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: White space of the vocabulary's rule outside of ASCII; each is one character, as the blank put in its place.
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters that NFC leaves as they are beside any of them, and whose lower case is one character; as RE2 has classes.
_PLAIN = (
    r"\x{0}-\x{12f}\x{131}-\x{2ff}\x{386}\x{388}-\x{38a}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{482}\x{48a}-\x{4ff}\x{5d0}-\x{5ea}"
    r"\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{2190}-\x{21ff}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30a1}-\x{30ff}"
    r"\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}\x{ff01}-\x{ff60}"
)
#: Whether a byte is none of ASCII's white space.
_SOLID = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SIGNS = r"[(\[{\"#$%&*+,\-./:;=>?@!~^_`|\])}]*"
_WORD = re.compile(rf"({_SIGNS})([^\W\d_]*)({_SIGNS})")


# fixed values: the rules of the vocabulary file under which segments can be encoded on their own
_KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


@functools.cache
def by_segments(path: str) -> bool:
    """Whether the vocabulary file has the rules under which a text's ids are those of its segments."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    return all(rules.get(k) == v for k, v in _KNOWN.items())


def greatest_id(path: str) -> int:
    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@dataclass
class Encoded:
    """Ids of many texts end to end; text k has ids[starts[k]:starts[k + 1]] and segments[k]:segments[k + 1]."""

    ids: np.ndarray
    starts: np.ndarray
    codes: np.ndarray  # of each segment, its place in words
    segments: np.ndarray
    words: list[str]
    counts: np.ndarray  # ids of each word

    def ends_of_segments(self) -> np.ndarray:
        return np.cumsum(self.counts[self.codes])


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the white-space-bounded segments, where each text's begin, and the distinct segments."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring_regex(texts, _WIDE_SPACE)).as_py():
        texts = pc.replace_substring_regex(texts, _WIDE_SPACE, " ")
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(full)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    numbered = flat.filter(pa.array(full)).dictionary_encode()
    words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
    return numbered.indices.to_numpy(zero_copy_only=False), at, words


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the runs starts[k]:starts[k] + lengths[k], end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class SegmentEncoder(dict):
    """segment -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 350_000):
        super().__init__()
        self._library = Tokenizer.from_file(path)
        self._model, self._most, self._parts = self._library.model, most, {}
        self._letters = _byte_letters()

    def _by_library(self, segment: str) -> bytes:
        return np.array(self._library.encode(segment, add_special_tokens=False).ids, np.uint32).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token: a run of Latin letters, or a run of signs."""
        got = self._parts.get(part)
        if got is None:
            if part.isascii() and part.isalpha():
                got = array("I", [t.id for t in self._model.tokenize(part)]).tobytes()
            elif part.isalpha() and max(part) < "ɐ" and unicodedata.is_normalized("NFC", part):
                letters = "".join(map(self._letters.__getitem__, part.encode()))
                got = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
            else:
                got = self._by_library(part)
            if len(self._parts) >= self._most:
                self._parts.clear()
            self._parts[part] = got
        return got

    def __missing__(self, segment: str) -> bytes:
        m = _WORD.fullmatch(segment) if len(segment) < 60 else None
        # lower() looks at a letter's neighbours for these two only; the library lowers each letter alone
        core = m[2].lower() if m and "Σ" not in segment and "İ" not in segment else ""
        if core.isalpha():
            ids = (self._part(m[1]) if m[1] else b"") + self._part(core) + (self._part(m[3]) if m[3] else b"")
        else:
            ids = self._by_library(segment)
        if len(segment) < 60:
            if len(self) >= self._most:
                self.clear()
            self[segment] = ids
        return ids

    def encode_many(self, texts: pa.Array) -> Encoded:
        codes, segments, words = split_texts(texts)
        found = [self[w] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(counts) - counts
        pool = np.frombuffer(b"".join(found), np.uint32)
        each = counts[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        return Encoded(pool[ragged(begins[codes], each)], ends[segments], codes, segments, words, counts)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text])).ids


class WholeEncoder:
    """Whole texts by the library itself, about ``most`` characters at a time."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs side by side
        self._library, self._most = Tokenizer.from_file(path), most

    def _encoded(self, texts: pa.Array, encode: Callable | None = None) -> Iterator:
        encode, held, size = encode or self._library.encode_batch, [], 0
        for text in texts.to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= self._most:
                yield from encode(held, add_special_tokens=False)
                held, size = [], 0
        yield from encode(held, add_special_tokens=False)

    def encode_many(self, texts: pa.Array) -> Encoded:
        """Each token stands for a segment: what it ends in says whether a sentence ends there."""
        known: dict[str, int] = {}
        ids, codes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for e in self._encoded(texts):
            ids.append(np.array(e.ids, np.uint32))
            codes.append(np.array([known.setdefault(t, len(known)) for t in e.tokens], np.int64))
        starts = np.cumsum([0, *(len(x) for x in ids[1:])])
        return Encoded(np.concatenate(ids), starts, np.concatenate(codes), starts, list(known), np.ones(len(known), np.int64))

    def spans_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Character spans of all tokens end to end (two columns), and where each text's tokens begin."""
        spans = [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self._encoded(texts)]
        starts = np.cumsum([0, *(len(x) for x in spans)])
        return np.concatenate([np.empty((0, 2), np.int64), *spans]), starts


class SpanEncoder(WholeEncoder):
    """Spans of whole texts' tokens, by arithmetic on their ids where a text allows it.

    Under the rules ``_KNOWN`` a text of ``_PLAIN`` characters is only lowered, each character to one, which Arrow does
    in place of the library's normalizer.  Of its bytes the pre-tokenizer drops white space alone, so the tokens of the
    whole text lie end to end on all others, and their lengths say where each begins.  Texts with other characters or
    with an added token's content, and any that the lengths don't fit, get the library's own offsets.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__(path, most)
        model = self._library.model
        self._known = by_segments(path) and isinstance(model, BPE) and not (model.unk_token or model.continuing_subword_prefix)
        if not self._known:
            return
        added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._other = "|".join([f"[^{_PLAIN}]", *(f"(?i:{re.escape(t)})" for t in added)])
        suffix, vocab = model.end_of_word_suffix or "", self._library.get_vocab(with_added_tokens=True)
        self._lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        self._lengths[list(vocab.values())] = [len(t.removesuffix(suffix)) for t in vocab]
        # both share the library's model; printable ASCII stands for itself in the byte-level letters
        self._plain, self._ascii = Tokenizer(model), Tokenizer(model)
        self._plain.pre_tokenizer = self._library.pre_tokenizer
        self._ascii.pre_tokenizer = self._library.pre_tokenizer[0]

    def spans_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self._known:
            return super().spans_many(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        other = pc.match_substring_regex(texts, self._other).to_numpy(zero_copy_only=False)
        ascii_ = pc.match_substring_regex(texts, r"\A[\t-\r -~]*\z").to_numpy(zero_copy_only=False)
        lowered = pc.utf8_lower(texts)
        if not ascii_.all():
            lowered = pc.replace_substring_regex(lowered, _WIDE_SPACE, " ")
        ids = [np.empty(0, np.uint32)] * len(texts)
        for rows, library in ((ascii_ & ~other, self._ascii), (~ascii_ & ~other, self._plain)):
            at = np.flatnonzero(rows)
            for k, e in zip(at.tolist(), self._encoded(lowered.take(pa.array(at)), library.encode_batch_fast), strict=True):
                ids[k] = np.array(e.ids, np.uint32)

        raw, at = flat_bytes(lowered)
        solid = np.concatenate([[0], np.cumsum(_SOLID[raw])])[at]  # bytes that tokens lie on, before each text
        begins = np.cumsum([0, *map(len, ids)])
        ends = np.concatenate([[0], np.cumsum(self._lengths[np.concatenate([np.empty(0, np.uint32), *ids])])])
        other |= np.diff(ends[begins]) != np.diff(solid)
        own = ~other
        counts = np.where(own, np.diff(begins), 0)
        token = ragged(begins[:-1], counts)
        moved = np.repeat(solid[:-1] - ends[begins[:-1]], counts)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        of_solid = chars[1:][_SOLID[raw]]  # characters up to each such byte's own, over all texts
        before = np.repeat(chars[at[:-1]], counts)
        spans = np.stack([of_solid[ends[token] + moved] - 1, of_solid[ends[token + 1] + moved - 1]], 1) - before[:, None]
        if own.all():
            return spans, begins

        rest, rest_at = super().spans_many(texts.filter(pa.array(other)))
        starts = np.cumsum(counts) - counts
        starts[other] = len(spans) + rest_at[:-1]
        counts[other] = np.diff(rest_at)
        return np.concatenate([spans, rest])[ragged(starts, counts)], np.cumsum([0, *counts])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more entry than texts)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_binary(texts.type) else texts
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_KEPT: dict[tuple, dict] = {}


def _kept(kind: type, path: str):
    """One encoder a Python worker, kept over its tasks."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]


def encoder(path: str) -> SegmentEncoder | WholeEncoder:
    return _kept(SegmentEncoder if by_segments(path) else WholeEncoder, path)


def span_encoder(path: str) -> SpanEncoder:
    return _kept(SpanEncoder, path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
