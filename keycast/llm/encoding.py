"""Exact token ids from the tokenizers library, encoding each distinct piece of text once per worker.

Texts repeat their words far more often than they bring new ones, so a text is
cut at single spaces, each distinct piece is encoded by the library once and
kept in a bounded memory, and the ids of the text are those of its pieces in
order. A cut is made only where the tokenizer itself always cuts:

* byte-level, "keep" mode: at a space with a non-space behind it, the space
  going to the right piece; the library's own pattern starts a token there;
* white space dropped, "drop" mode: at any space.

Tokenizers of any other make, or with special strings that hold a space, get
whole texts.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from contextlib import contextmanager
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_CUT = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" (?:\s|\Z)")  # a space that belongs to a longer run, or ends the text
_RUNS = regex.compile(r" ?\p{L}+|\P{L}+")
_MARKS = ".,;:!?"
_BREAK = "\n"
_PLAIN = r"^\pL+[.,;:!?]?(?:\n\pL+[.,;:!?]?)*$"  # lines of a word and at most one mark; marks and lone line breaks are tokens of their own in "keep" mode
_GROWS = "\u0130"  # the one letter that becomes two characters in lower case
_SPACE_LETTER = "\u0120"  # a space in the alphabet of byte-level vocabularies
_SPACES = re.compile(r"\s\s")
_LONGEST = 64  # characters of a piece worth remembering
MANY = 1_000_000  # pieces a worker may remember where it has some 120 MB for them; new words never stop, and a lost one is encoded again


def cut_mode(path: str) -> str:
    """Where texts may be cut for this tokenizer: keep, drop or none."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    if any(" " in token["content"] or token["lstrip"] or token["rstrip"] or token["single_word"] for token in made["added_tokens"]):
        return "none"
    before, split = made["normalizer"], made["pre_tokenizer"] or {}
    if before is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return "keep"
    steps = split.get("pretokenizers", [])
    spaced = [step for step in (before or {}).get("normalizers", []) if step.get("type") == "Replace"]
    known = {"NFC", "Replace", "Lowercase"} >= {step["type"] for step in (before or {}).get("normalizers", [])}
    drops = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    if known and drops and [(step["pattern"].get("Regex"), step["content"]) for step in spaced] == [(r"\s+", " ")]:
        return "drop"
    return "none"


@contextmanager
def _uncollected():
    """Nothing made here refers back to itself, and the collector would walk the memory again and again."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


class Pieces:
    """Something kept per distinct piece; `compute` is called with new pieces only."""

    def __init__(self, mode: str, compute, most: int = 150_000):
        self.mode, self.compute, self.most = mode, compute, most
        self.first: dict = {}  # pieces at the beginning of a text
        self.rest: dict = {}  # pieces after a space, without it
        self.brief: list = []

    def _fill(self, held: dict, parts: list[list], missing: set, lead: str) -> dict:
        """The values of all pieces of `parts`; those in use stay when the memory is full."""
        if not missing:
            return held
        if len(held) + len(missing) > self.most:
            used = set().union(*parts) - missing
            known = {p: held[p] for p in used}
            held.clear()
            held.update(known)
        new = list(missing)
        held.update(zip(new, self.compute([lead + p for p in new] if lead else new), strict=True))
        self.brief += [(held, p) for p in new if len(p) > _LONGEST]
        return held

    def of(self, texts: list[str]) -> list[list]:
        """For each text the kept values of its pieces, in order."""
        with _uncollected():
            return self._of(texts)

    def renew(self) -> None:
        """Forget long pieces, which live for one batch only."""
        for held, piece in self.brief:
            held.pop(piece, None)
        self.brief.clear()

    def values(self, pieces: list[str], start: bool) -> list:
        """The values of the pieces, which stand at the beginning of a text or after a space."""
        held, lead = (self.first, "") if start else (self.rest, " " if self.mode == "keep" else "")
        found = list(map(held.get, pieces))
        missing = {p for p, value in zip(pieces, found, strict=True) if value is None}
        if not missing:
            return found
        held = self._fill(held, [pieces], missing, lead)
        return [held[p] if value is None else value for p, value in zip(pieces, found, strict=True)]

    def _of(self, texts: list[str]) -> list[list]:
        if self.mode == "none":
            return [[v] for v in self.compute(texts)]
        self.renew()
        parts = [text.split(" ") for text in texts]
        heads = [part.pop(0) for part in parts]
        missing = _absent(parts, self.rest)
        if self.mode == "keep":
            # A piece that is empty or starts with white space is part of a longer run: cut such a text with more care.
            # These pieces are never kept, so they are always among the missing ones.
            loose = {p for p in missing if not p or p[0].isspace()}
            if loose:
                for i, part in enumerate(parts):
                    if not loose.isdisjoint(part):
                        heads[i], *parts[i] = _CUT.split(texts[i])
                missing = _absent(parts, self.rest)
        first = self._fill(self.first, [heads], _absent([heads], self.first), "")
        rest = self._fill(self.rest, parts, missing, " " if self.mode == "keep" else "").__getitem__
        return [[first[head], *map(rest, part)] for head, part in zip(heads, parts, strict=True)]


def _absent(parts: list, held: dict) -> set:
    """The distinct pieces that are not held."""
    return set(filterfalse(held.__contains__, chain.from_iterable(parts)))


class Encoder:
    """Token ids of texts as little-endian bytes, as the library gives them without added special tokens."""

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}
        self.most_runs = min(2 * most, max(300_000, most))
        self.pieces = Pieces(cut_mode(path), self._encode, most)
        self.marked = self._marked()
        # Marks and line breaks may stand apart from words unless they or words are special strings.
        apart = self.pieces.mode == "keep" and not any(all(c.isalpha() or c in _MARKS + _BREAK for c in s) for s in self.special)
        self.marks = self._one_by_one([*_MARKS, _BREAK]) if apart else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each piece, put together from its runs of letters and of other characters where tokens never span two runs."""
        if self.pieces.mode == "none":
            return self._one_by_one(texts)
        if self.marks is None:
            return self._by_runs(texts)
        # Words come without their marks: pieces remember them, and runs need not.
        word = [t[:1] == " " and t[1:].isalpha() for t in texts]
        words = iter(self._encode_words([t for t, of in zip(texts, word, strict=True) if of]))
        others = iter(self._by_runs([t for t, of in zip(texts, word, strict=True) if not of]))
        return [next(words) if of else next(others) for of in word]

    def _by_runs(self, texts: list[str]) -> list[bytes]:
        split = list(map(self._split, texts))
        missing = _absent(split, self.runs)
        if len(self.runs) + len(missing) > self.most_runs:
            used = set().union(*split) - missing
            known = {run: self.runs[run] for run in used}
            self.runs.clear()
            self.runs.update(known)
        self.runs.update(self._encode_runs(list(missing)))
        get = self.runs.__getitem__
        out = [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in split]
        for run in missing:
            if len(run) > _LONGEST:
                del self.runs[run]
        return out

    def _split(self, text: str) -> tuple[str, ...] | list[str]:
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return (text,)
        mark = word[-1:]
        if mark and mark in ".,;:!?" and word[:-1].isalpha() and _GROWS not in word:
            return (text[:-1], mark)
        # Tokens may depend on more than one run at apostrophes, longer white space, special strings and open accents.
        if "'" in text or _SPACES.search(text) or any(s in text for s in self.special):
            return (text,)
        if not text.isascii() and (_GROWS in text or not unicodedata.is_normalized("NFC", text)):
            return (text,)
        return _RUNS.findall(text)

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(texts), 4096):
            found = self.library.encode_batch_fast(texts[start : start + 4096], add_special_tokens=False)
            out += [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]
        return out

    def _encode_runs(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of each run. Runs of letters that a space parts are encoded as one text, for they cannot influence each other."""
        lead = " " if self.pieces.mode == "keep" else ""
        words = [r for r in runs if r.startswith(lead) and r[len(lead) :].isalpha() and _GROWS not in r]
        parted = set(words)
        alone = [r for r in runs if r not in parted]
        return dict(zip(alone, self._one_by_one(alone), strict=True)) | dict(zip(words, self._encode_words(words), strict=True))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with its space in "keep" mode: hundreds are encoded as one text (the library takes longer per word in longer texts)."""
        joint, out = "" if self.pieces.mode == "keep" else " ", []
        for start in range(0, len(words), 256):
            part = words[start : start + 256]
            found = self.library.encode_batch_fast([joint.join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype=self.dtype)
            # A word starts with the one token that holds its space, or ends with the one that is marked as an end.
            marks = np.flatnonzero(self.marked[ids])
            cuts = (np.append(marks, len(ids)) if joint == "" else np.append(0, marks + 1)) * self.dtype.itemsize
            if len(cuts) != len(part) + 1:
                out += self._one_by_one(part)
                continue
            raw, cuts = ids.tobytes(), cuts.tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _marked(self) -> np.ndarray:
        """Which ids begin with a space (keep mode) or end a word (drop mode)."""
        table = np.zeros(self.library.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            table[i] = bool(suffix and token.endswith(suffix)) if self.pieces.mode == "drop" else token.startswith(_SPACE_LETTER)
        return table

    def ids(self, texts: list[str]) -> list[bytes]:
        loose = [self.pieces.mode == "none" or self.pieces.mode == "keep" and bool(_LOOSE.search(text)) for text in texts]
        slow = iter([b"".join(x) for x in self.pieces.of([t for t, apart in zip(texts, loose, strict=True) if apart])])
        with _uncollected():
            fast = iter(self._joined([t for t, apart in zip(texts, loose, strict=True) if not apart]))
        return [next(slow if apart else fast) for apart in loose]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at every space. Arrow cuts them and finds the distinct pieces, so Python sees each piece once."""
        if not texts:
            return []
        self.pieces.renew()
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words, bounds = cut.values, cut.offsets.to_numpy()
        inner = np.ones(len(words), dtype=bool)
        inner[bounds[:-1]] = False
        rest = words.filter(pa.array(inner)).dictionary_encode()
        known = self._after_space(rest.dictionary)
        place = np.empty(len(words), dtype=np.int64)
        place[inner] = rest.indices.to_numpy()
        place[bounds[:-1]] = np.arange(len(known), len(known) + len(texts))
        heads = pa.array(self.pieces.values(_strings(words.take(pa.array(bounds[:-1]))), start=True), pa.large_binary())
        # Taken in the order of the texts, the ids lie one behind the other in a single buffer.
        taken = pa.concat_arrays([known, heads]).take(pa.array(place))
        _, offsets, raw = taken.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(words) + 1][bounds].tolist()
        whole = memoryview(raw or b"")
        return [whole[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def _after_space(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces after a space. Where marks and line breaks stand apart, Arrow cuts them off first: a word is then looked up and kept once."""
        if self.marks is None:
            return pa.array(self.pieces.values(_strings(pieces), start=False), pa.large_binary())
        plain = pc.match_substring_regex(pieces, _PLAIN)
        cut = pc.split_pattern(pieces.filter(plain), _BREAK)
        lines, bounds, odd = cut.values, cut.offsets.to_numpy(), pieces.filter(pc.invert(plain))
        words = pc.ascii_rtrim(lines, characters=_MARKS)
        first = np.zeros(len(lines), dtype=bool)
        first[bounds[:-1]] = True
        spaced, bare = words.filter(pa.array(first)).dictionary_encode(), words.filter(pa.array(~first)).dictionary_encode()
        values = self.pieces.values(_strings(spaced.dictionary) + _strings(odd), start=False)
        bare_at = len(values)
        values += self.pieces.values(_strings(bare.dictionary), start=True)
        marks_at = len(values)
        values = pa.array(values + self.marks, pa.large_binary())
        # Per line its word, its mark if it has one, and the line break unless it is the last.
        marked = (pc.binary_length(lines).to_numpy() - pc.binary_length(words).to_numpy()).astype(bool)
        broken = np.ones(len(lines), dtype=bool)
        broken[bounds[1:] - 1] = False
        steps = 1 + marked + broken.astype(np.int64)
        ends = np.cumsum(steps)
        parts = np.empty(steps.sum(), dtype=np.int64)
        at = ends - steps
        parts[at[first]] = spaced.indices.to_numpy()
        parts[at[~first]] = bare_at + bare.indices.to_numpy()
        last = pc.binary_slice(lines.filter(pa.array(marked)).cast(pa.large_binary()), -1)
        parts[at[marked] + 1] = marks_at + pc.index_in(last, pa.array([c.encode() for c in _MARKS], pa.large_binary())).to_numpy()
        parts[ends[broken] - 1] = marks_at + len(_MARKS)
        _, offsets, raw = values.take(pa.array(parts)).buffers()
        offsets = np.frombuffer(offsets, np.int64)[np.append(at[bounds[:-1]], len(parts))]
        whole = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), raw])
        place, plain = np.empty(len(pieces), dtype=np.int64), plain.to_numpy(zero_copy_only=False)
        place[plain] = np.arange(len(whole))
        place[~plain] = np.arange(len(whole), len(pieces))
        return pa.concat_arrays([whole, values.slice(len(spaced.dictionary), len(odd))]).take(pa.array(place))


def _strings(column: pa.Array) -> list[str]:
    """The column as a list, many times faster than by `to_pylist`."""
    return column.to_numpy(zero_copy_only=False).tolist()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 150_000) -> Encoder:
    """One encoder per worker process and size of its memory."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]
