"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding the encoding of each prefix of a word ends in exactly one
token, and two tokens may stand side by side in an encoding if and only if the
two of them together encode to themselves. So the last token of prefix i is the
one candidate that may follow the last token of the prefix it extends, and
count[i] = count[i - len(token)] + 1. Words are independent of each other, so
counts at prefixes of a whole text are running sums over its words.
`prefix_counts` stores them all; `token_counts` runs the same programme and keeps
what a document needs, its total and the cut for a budget.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keycast.llm.encoding import MANY, Encoder, Pieces, cut_mode
from keycast.llm.shared import bundles, in_python


class PrefixCounter:
    """Counts of tokens at prefixes, for byte-level BPE files of the tokenizers library."""

    def __init__(self, path: str):
        if cut_mode(path) != "keep":
            raise ValueError("Prefix counts need a byte-level BPE file without a normalizer.")
        self.library = Encoder(path).library
        self.split = self.library.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab, self.longest = model["vocab"], max(map(len, model["vocab"]))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.parts = {a + b: (r, a, b) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(a != b and a in b for a in self.special for b in self.special):
            raise ValueError("Special strings that hold one another are not supported.")
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.space = self.split.pre_tokenize_str(" ")[0][0]
        self.letters: dict[str, str] = {}  # characters in the vocabulary's alphabet of bytes
        self.together: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, bool], list] = {}
        self.words: dict[str, int] = {}
        self.most_words = MANY
        self.pieces = Pieces("keep", self._totals, MANY)

    def edge(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """The parts that stand at one edge of a token while it is being merged, each with the ranks of the merges that make and end it."""
        found = self.edges.get((token, right))
        if found is None:
            found, part, ends = [], token, len(self.rank)
            while part in self.parts:
                made, left, last = self.parts[part]
                found.append((part, made, ends))
                part, ends = last if right else left, made
            found.append((part, -1, ends))
            self.edges[token, right] = found
        return found

    def follows(self, left: str, right: str) -> bool:
        """May token `right` stand behind token `left`?

        It may unless some merge across their border would come before the
        merges that build the two: between a part at the border on the left and
        one on the right, while both are there.
        """
        found = self.together.get((left, right))
        if found is None:
            if len(self.together) > 400_000:
                self.together.clear()
            found, ranks = True, self.rank
            for a, a_made, a_ends in self.edge(left, True):
                for b, b_made, b_ends in self.edge(right, False):
                    if a_made < b_ends and b_made < a_ends:  # both are there for a while
                        rank = ranks.get((a, b))
                        # Of equal merges the left one comes first.
                        if rank is not None and rank < a_ends and rank <= b_ends:
                            found = False
            self.together[left, right] = found
        return found

    def word(self, word: str, count: list[int] | None = None, last: list[str] | None = None, known: int = 0) -> list[int]:
        """Counts at all prefixes of one word, of which the first `known` are in `count` and `last` already."""
        vocab, together, follows, longest = self.vocab, self.together, self.follows, self.longest
        count, last = count if count is not None else [0], last if last is not None else [""]
        del count[known + 1 :], last[known + 1 :]
        for end in range(known + 1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                token = word[start:end]
                if token in vocab:
                    fits = True
                    if start:
                        fits = together.get((last[start], token))
                        if fits is None:
                            fits = follows(last[start], token)
                    if fits:
                        count.append(count[start] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError("The vocabulary lacks a byte.")
        return count

    def _spell(self, text: str) -> str:
        if text.isascii() and text.isprintable():  # these stand for themselves, but for the space
            return text.replace(" ", self.space)
        letters = self.letters
        for c in set(text) - letters.keys():
            letters[c] = self.split.pre_tokenize_str(c)[0][0]
        return "".join(map(letters.__getitem__, text))

    def _split(self, piece: str) -> list[str]:
        """The words of a piece: by a glance for letters with a mark behind, by the library for all else."""
        lead = 1 if piece[:1] == " " else 0
        if piece[lead:].isalpha():
            return [self._spell(piece)]
        if piece[-1:] in ".,;:!?" and piece[lead:-1].isalpha():
            return [self._spell(piece[:-1]), piece[-1]]
        return [w for w, _ in self.split.pre_tokenize_str(piece)]

    def _totals(self, pieces: list[str]) -> list[int]:
        """Counts of whole pieces: the last of the prefix counts of each of their words.

        Words come in order, so that a word starts from the prefix it shares with the one before.
        """
        split = []
        joint = "\n".join(pieces)
        special = [s for s in self.special if s in joint]
        for piece in pieces:
            if special and any(s in piece for s in special):  # the library takes these strings out first
                split.append(len(self.library.encode(piece, add_special_tokens=False).ids))
            else:
                split.append(self._split(piece) if piece else [])
        new = sorted({w for x in split if isinstance(x, list) for w in x} - self.words.keys())
        if len(self.words) + len(new) > self.most_words:
            self.words.clear()
            new = sorted({w for x in split if isinstance(x, list) for w in x})
        count, last, before, totals = [0], [""], "", self.words
        for w in new:
            shared = 0
            for a, b in zip(before, w, strict=False):
                if a != b:
                    break
                shared += 1
            totals[w] = self.word(w, count, last, shared)[-1]
            before = w
        return [x if isinstance(x, int) else sum(map(totals.__getitem__, x)) for x in split]

    def totals(self, texts: list[str]) -> list[list[int]]:
        """For each text the counts of its pieces, in order."""
        return self.pieces.of(texts)

    def every_prefix(self, text: str) -> np.ndarray:
        """counts[i]: exact token count of the first i characters, from one pass over the words.

        Inside a word its own prefix counts serve. Where a shorter prefix may
        split into other words (next to white space and apostrophes) the last
        two words are counted anew. Special strings are cut out first, as the
        library does; what a prefix holds of one that it does not finish is plain text.
        """
        if not any(s in text for s in self.special):
            return self._plain_prefixes(text)
        counts, at, base = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
        for found in self.specials.finditer(text):
            start, end = found.span()
            before = self._plain_prefixes(text[at : end - 1])
            counts[at:end] = base + before
            base += int(before[start - at]) + 1
            counts[end], at = base, end
        counts[at:] = base + self._plain_prefixes(text[at:])
        return counts

    def _plain_prefixes(self, text: str) -> np.ndarray:
        counts = np.zeros(len(text) + 1, dtype=np.int64)
        words, base, ends = self.split.pre_tokenize_str(text), 0, []
        for word, (start, end) in words:
            inside, at = self.word(word), 0
            for i in range(start, end):
                at += len(text[i].encode("utf-8"))
                counts[i + 1] = base + inside[at]
            before = base
            base += inside[-1]
            ends.append((start, end, before))
        for k, (start, end, before) in enumerate(ends):
            if not (text[start:end].isspace() or text[start] == "'" or text[start : start + 2] == " '"):
                continue
            back = ends[k - 1] if k else (start, end, before)
            for i in range(start + 1, end + 1):
                tail = self.split.pre_tokenize_str(text[back[0] : i])
                counts[i] = back[2] + sum(self.word(w)[-1] for w, _ in tail)
        return counts


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, tokens, whether it is over `limit`, and where to cut it to stay within.

    `keep_chars` is the length of the longest prefix that ends before a word
    and holds at most `limit` tokens (the whole text if it fits). One row per
    input row; a null text is empty and has no tokens; other columns are not read.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = counter(tokenizer)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for low, high in bundles(texts):
                rows = []
                for doc, text, found in zip(batch["doc_id"].iloc[low:high], texts[low:high], counts.totals(texts[low:high]), strict=True):
                    total, keep = sum(found), len(text)
                    if total > limit:
                        keep = _fitting(counts, text, found, limit)
                    rows.append((doc, len(text.encode("utf-8")), total, total > limit, keep))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars"]).astype({"doc_id": "Int64"})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_python(source, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long")


def _fitting(counts: PrefixCounter, text: str, found: list[int], limit: int) -> int:
    """Characters of the pieces that fit, from their running counts."""
    from keycast.llm.encoding import _CUT

    parts = text.split(" ")
    if len(parts) != len(found) or any(not p or p[0].isspace() for p in set(parts[1:])):
        parts = _CUT.split(text)
    fit = sum(1 for total in accumulate(found) if total <= limit)
    return max(0, sum(map(len, parts[:fit])) + max(0, fit - 1))


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole table of counts: per document an array whose entry i is the token count of the first i characters.

    Any truncation or budget question is then a lookup in that array.
    """

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = counter(tokenizer)
        for batch in batches:
            for row in range(len(batch)):
                text = batch["text"].iloc[row] or ""
                found = {"doc_id": pd.array([batch["doc_id"].iloc[row]], dtype="Int64"), "counts": [counts.every_prefix(text)]}
                yield pd.DataFrame(found)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_python(source, table, "doc_id long, counts array<long>")
