"""Licence scan, conversation trie and filter audit against brute force; ids beside null ids."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keycast.llm import filter_audit, html, licences, minhash, packing, prefix_tokens, tokenfile, toxicity, turn_trie

# -- 11 -------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_scan(texts: list[str], settings: licences.Settings) -> list[tuple]:
    """Word by word: document frequencies, votes per grid cell, phrases, base places."""
    split = [WORD.findall(low(t)) for t in texts]
    documents = Counter(w for words in split for w in set(words))
    out = []
    for words in split:
        found = []
        for t in settings.templates:
            form = t.words.split()
            own = sorted(set(form), key=lambda w: (documents[w], w))
            chosen = own[: min(settings.most, math.ceil(settings.share * len(own)))]
            weight = {w: math.log((1 + len(texts)) / (1 + documents[w])) + 1 for w in chosen}
            votes = defaultdict(set)
            for p, w in enumerate(words):
                for q, x in enumerate(form):
                    if w == x and w in weight:
                        for k in (0, 1):
                            votes[(p - q) // settings.grid - k].add(w)
            for cell, agreed in votes.items():
                at = max(0, cell * settings.grid)
                part = " " + " ".join(words[at : max(at, (cell + 2) * settings.grid + len(form))]) + " "
                if len(agreed) >= math.ceil(settings.agree * len(chosen)) and all(f" {p} " in part for p in t.phrases):
                    found.append((t.label, min(1.0, sum(weight[w] for w in agreed) / sum(weight.values()))))
        places = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        base = {label for _, label in places}
        score = 1.0 if base else max((s for _, s in found), default=0.0)
        starts = [i for i, _ in places]
        out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), round(score, 5)))
    return out


def licence_texts(seed: int = 2) -> list:
    rnd = random.Random(seed)
    filler = ["the", "of", "license", "Version", "free", "über", "été", "2", "copy", "x1", "public", "software", "Kopy"]
    notices = [t.words for t in licences.TEMPLATES] + ["Creative (CC) BY-NC 4.0!", "ALL RIGHTS RESERVED", "All rights reserved.", "GNU General-Public License", "ccİ by"]
    texts: list = [None, "", "...", " \n", "word", "cc by" * 3, "all rights reserved " * 40]
    for _ in range(120):
        words = [rnd.choice(filler) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.choice((0, 1, 1, 2))):
            notice = rnd.choice(notices).split(" ")
            for _ in range(rnd.choice((0, 0, 1, 3))):  # edits
                at = rnd.randrange(len(notice))
                notice[at : at + rnd.choice((0, 1))] = rnd.choice(([], ["really"], ["OR"]))
                notice = notice or ["x"]
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() if rnd.random() < 0.2 else w for w in notice]
        texts.append(rnd.choice((" ", ", ", "\n")).join(words))
    return texts + [" ".join(rnd.choice(filler) for _ in range(30_000)) + " released under the MIT License."]


def test_licences_equal_a_plain_scan(spark):
    texts = licence_texts()
    texts += [texts[20]] * 3
    rows = [(None if i == 9 else 7 if i > 140 else i, t, "en", 3, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int, words string").repartition(3)
    settings = licences.Settings(grid=8)
    got = licences.licence_scan(docs, settings).drop("found").collect()
    want = Counter((r[0], *w) for r, w in zip(rows, plain_scan([t or "" for t in texts], settings), strict=True))
    assert Counter((*r[:-1], round(r.score, 5)) for r in got) == want
    assert any(w[6] and not w[5] for w in want)  # labels of the method's own
    assert licences.licence_scan(docs.limit(0)).count() == 0


def test_licence_places_tell_where(spark):
    text = "one two three " * 20 + "Released under the MIT License."
    found = licences.licence_scan(spark.createDataFrame([(1, text), (2, "mit license released")], "doc_id long, text string")).where("doc_id = 1").first().found
    assert {f.label for f in found} == {"mit"} and all(40 <= f.word <= 60 for f in found)


# -- 12 -------------------------------------------------------------------------


def plain_trie(rows: list[tuple]) -> list[tuple]:
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - abs(c) % 100 * (1 if c >= 0 else -1), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    done: dict = {}
    for node in sorted(members, key=len, reverse=True):
        ids, below = sorted(members[node]), children[node]
        saved = (len(ids) - 1) * (len(node[-1][1]) if node else 0) + sum(done[b][6] for b in below)
        ends = hashlib.sha256(",".join(str(c) for c, last in ids if last).encode()).hexdigest()
        above = min(members[node[:-1]])[0] if node else None
        done[node] = (ids[0][0], len(node), above, len(ids), len(below), sum(done[b][5] for b in below) if below else 1, saved, ends)
    return sorted(done.values(), key=lambda r: r[:2])


def talks(seed: int = 4) -> list[tuple]:
    rnd = random.Random(seed)
    rows: list[tuple] = []
    for c in [*range(0, 330, 3), -250, -200, -100, -1, 2**61 + 7, 2**61 - (2**61 % 100), 777]:
        rows += [(c, t, rnd.choice(("user", "bot", None)), rnd.choice(("hi", "yes", "no", "ü🙂", None, ""))) for t in range(rnd.randint(1, 7))]
    rows += [(c, t, "user", f"turn {t}") for c in range(1000, 1100, 2) for t in range(4)]  # copies
    rows += [(1200, t, "user", f"step {t}") for t in range(300)]  # one long chain
    rows += [(1203, None, "user", "b"), (1203, None, "user", "a"), (1203, None, "user", "a"), (1203, 5, "x", "y"), (1203, -5, "x", "y"), (None, 1, "user", "lost"), (None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("in_task", [20_000, 40])
def test_trie_equals_brute_force(spark, in_task):
    rows = talks()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs int").repartition(6)
    got = turn_trie.prefix_trie(table, turn_trie.Settings(in_task=in_task, ids=3))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turn_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 1, "user", "gone")]  # fewer turns than it shares, and nothing to share from
    assert [tuple(r) for r in turn_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()] == plain_trie(rows)


def test_centroid_totals_on_random_forests():
    rnd = random.Random(1)
    for size in (1, 2, 3, 50, 400):
        for shape in (lambda i: i - 1, lambda i: 0 if i else -1, lambda i: rnd.randint(-1, i - 1)):
            parents = [shape(i) for i in range(size)]
            values = [(rnd.randint(0, 9), 1) for _ in range(size)]
            want = [list(v) for v in values]
            for i in reversed(range(size)):
                if parents[i] >= 0:
                    want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i], strict=True)]
            assert turn_trie.centroid_totals(parents, values) == want


# -- 13 -------------------------------------------------------------------------


def plain_audit(docs: list[tuple], labels: list[tuple]) -> dict:
    least: dict = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc is not None and text in least and least[text] < doc
        parts[lang or ""].append(({f for f, x in fails.items() if x}, doc in good, doc in toxic))
    out = {}
    for part, rows in parts.items():
        worth: Counter = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [r for r in rows if f in r[0] and not before & r[0]]
                worth[f] += len(gone)
                kept = sum(1 for r in rows if not (before | {f}) & r[0])
                out[part, "".join(order), step + 1] = [kept, len(gone), sum(1 for r in rows if f in r[0] and before & r[0]), sum(1 for r in rows if r[0] == {f}), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(worth[order[step - 1]])
    return out


def audit_rows(seed: int = 6) -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    texts: list = [None, "", " ", "A", "short", "x" * 5000, "é" * 300, "same " * 250, "caps LOCK " * 150, "a & b " * 120]
    header = " ".join(word() for _ in range(300))
    texts += [" ".join(word() for _ in range(rnd.randint(150, 260))) for _ in range(20)]
    texts += [header + f" {i} " + word() for i in range(20)]  # a long start in common
    docs = [(i, rnd.choice(texts), rnd.choice(("en", "de", None, ""))) for i in range(200)]
    docs += [(500 + i, "copy of a hot text " * 70, "en") for i in range(150)] + [(None, "short", "fr"), (None, None, "fr"), docs[3], docs[4], (2**61 + 1, "short", "en"), (2**61, "short", "en"), (-5, "short", "en")]
    rnd.shuffle(docs)
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for i in range(0, 600, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (2**61 + 1, 1, 1)]
    return docs, labels


@pytest.mark.parametrize(("range_bytes", "trie_bytes"), [(1 << 20, 16 << 20), (3000, 5000)])
def test_audit_equals_brute_force(spark, range_bytes, trie_bytes):
    docs, labels = audit_rows()
    table = spark.createDataFrame([(*d, 1, "k", "p") for d in docs], "doc_id long, text string, lang string, mask int, key string, part string").repartition(7)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    report = filter_audit.filter_audit(table, known, filter_audit.Settings(range_bytes=range_bytes, trie_bytes=trie_bytes))
    got = {tuple(r[:3]): list(r[3:]) for r in report.collect()}
    assert got == plain_audit(docs, labels) and len(got) == 600 * 4
    assert filter_audit.filter_audit(table.limit(0), known).count() == 0


def test_heavy_prefixes_grow(spark):
    docs, _ = audit_rows()
    texts = spark.createDataFrame([(d[1] or "",) for d in docs], "text string")
    levels, total = filter_audit.heavy_prefixes(texts, filter_audit.Settings(range_bytes=3000))
    assert [length for length, *_ in levels][:3] == [2, 8, 32] and total == sum(len((d[1] or "").encode()) for d in docs)


def test_trie_of_texts_holds_every_text_once():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(400)] + [b"\x00\xff" * 500, b"\x00\xff" * 500 + b"a"]
    trie = filter_audit.Trie()
    for t in texts:
        trie.terminal(t).append(t)
    found = dict(trie.walk())
    assert set(found) == set(texts) and all(set(v) == {k} and len(v) == texts.count(k) for k, v in found.items())


# -- ids ------------------------------------------------------------------------

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def test_large_ids_beside_null_ids_stay_exact(spark):
    big = [2**60 + 2 * i + 1 for i in range(12)]
    rnd = random.Random(0)
    texts = [" ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(40 + i)) for i in range(13)]
    docs = spark.createDataFrame(list(zip([*big, None], texts, strict=True)), "doc_id long, text string").coalesce(1)
    ids = lambda df, c="doc_id": sorted((r[0] for r in df.select(c).collect()), key=lambda x: (x is None, x))
    want = [*big, None]
    assert ids(prefix_tokens.token_counts(docs, BYTE_BPE)) == want
    assert ids(prefix_tokens.prefix_counts(docs, BYTE_BPE)) == want
    assert ids(tokenfile.round_trip(docs, BYTE_BPE)) == want
    assert ids(packing.pack_documents(docs, WORD_BPE)) == want
    found = minhash.near_duplicates(docs)
    assert ids(found) == want and ids(found, "component_id") == want
    assert ids(minhash.without_near_duplicates(docs)) == want
    labels = spark.createDataFrame([(b, i % 2) for i, b in enumerate(big)], "doc_id long, toxic int")
    scored = {r.doc_id: r.held_out for r in toxicity.toxicity(docs, labels).collect()}
    assert scored == {d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d in want}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert ids(html.main_text(pages), "page_id") == want


def test_prefix_counts_of_texts_with_special_strings_are_exact_and_linear():
    import time

    counter = prefix_tokens.PrefixCounter(BYTE_BPE)
    special = counter.special[0]
    rnd = random.Random(8)
    words = ["one", " two", "  ", "don't", "é🙂", "\n", special, special[:-1], special[1:], "<|", "7"]
    for _ in range(25):
        text = "".join(rnd.choice(words) for _ in range(rnd.randint(1, 14)))
        want = [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.every_prefix(text).tolist() == want, text
    text = ("some words of a text " * 400 + special) * 8
    start = time.perf_counter()
    assert counter.every_prefix(text)[-1] == len(counter.library.encode(text, add_special_tokens=False).ids)
    assert time.perf_counter() - start < 20
