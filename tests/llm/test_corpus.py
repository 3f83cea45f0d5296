"""Corpus operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keycast.llm import ann, encoding, html, imatch, minhash, mixing, packing, pii, prefix_tokens, tokenfile, toxicity
from keycast.llm.encoding import Encoder
from keycast.llm.shared import shared_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, start long, score double, component_id long"


def corpus(seed: int = 3) -> list[tuple]:
    """Texts with exact and near copies, short ones, odd white space, personal data, nulls and repeated rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    texts: list = [None, "", "   \n\t ", "One", "one", "two words", "TWO  words", "a b c d e", "İ é́ ½ 가 각 🙂"]
    for _ in range(25):
        base = make(rnd.randint(30, 160))
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.02, 0.05, 0.2):
            if rnd.random() < 0.6:
                texts.append(" ".join(rnd.choice(words) if rnd.random() < share else w for w in base))
    texts += [" ".join(make(6000)), "x" * 3000, ("7" * 200 + " ") * 20]
    rows = [(i * 3, t, "en", rnd.choice(["a", "b", "ü", None]), len(t or ""), 1, 2, 0.5, 9) for i, t in enumerate(texts)]
    rows += [rows[20], rows[21], (None, texts[15], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 ------------------------------------------------------------------------


def test_neighbours_find_nearly_all_and_score_exactly(spark):
    rnd = np.random.default_rng(5)
    data = rnd.standard_normal((1200, 24))
    data[100:140] = data[7]  # a group of equal vectors: ties go to smaller ids
    rows = [(i, data[i].tolist(), "x") for i in range(1200)]
    rows += [(5000, None, "x"), (5100, [0.0] * 24, "x"), (5200, [float("nan")] * 24, "x"), (5300, [None] * 24, "x"), (5400, [float("inf")] * 24, "x"), (None, [1.0] * 24, "x"), (6000, [1.0, 2.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    settings = ann.Settings(block_rows=300)
    got = defaultdict(list)
    for r in ann.nearest_every(table, 100, 10, settings).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i * 100 for i in range(12)]  # 6000 has no candidate of its own length
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        for _, v, s in found:
            assert v != q and s == pytest.approx(np.sqrt(((data[v] - data[q]) ** 2).sum()), rel=1e-12)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        distance = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1200), distance))[:10].tolist()))
    assert hits >= 0.9 * 120
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest_every(few).orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 1)]
    assert ann.nearest_every(few.limit(0)).count() == 0


# -- 2 ------------------------------------------------------------------------


def test_page_text(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy</div>{pre}<article><h1>{h}</h1><p><b>{a}<br>next&nbsp;line<p>Sh<i>ar</i>ed &amp; same.</p></article><div id="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>'
    box = '<div class="q7"><p>Our shop is open on Sundays.</p></div>'
    rows = [(i, f"http://h{i % 2}.example.com/{i}", page.format(pre=box, h=f"Head {i}", a=f"Text number {i} \n of this")) for i in range(10)]
    # Copies of one page: their own text is no template.
    rows += [(100 + i, "http://c.example.com/", "<body><div><p>The very same article again.</p></div></body>") for i in range(8)]
    rows += [(200, None, "<p>no host</p>"), (201, "http://h0.example.com", None), (202, "http://h0.example.com", ""), (None, "x", "plain"), (203, "http://z.example.com", "<div>" * 3000 + "deep")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(10):
        text = f"Head {i} Text number {i} of this next line Shared & same."
        assert got[(i, f"http://h{i % 2}.example.com/{i}")] == (text, len(text))
    assert got[(103, "http://c.example.com/")][0] == "The very same article again."
    assert got[(200, None)][0] == "no host" and got[(201, "http://h0.example.com")] == ("", 0) == got[(202, "http://h0.example.com")]
    assert got[(None, "x")][0] == "plain" and got[(203, "http://z.example.com")][0] == "deep"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page_texts(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_notices_longer_than_articles_go(spark):
    law = "".join(f'<div class="q{k}"><p>' + f"Terms and conditions {k} of this site apply to all. " * 9 + "</p></div>" for k in range(2))
    rows = [(i, f"http://law.example.com/{i}", f"<body>{law}<div><p>Short text {i}.</p></div></body>") for i in range(6)]
    rows += [(10 + i, f"http://main.example.com/{i}", f"<main>{law}<p>Short text {i}.</p></main>") for i in range(6)]
    assert page_texts(spark, rows) == {i: f"Short text {i % 10}." for i in [*range(6), *range(10, 16)]}


def test_boxes_on_a_small_share_of_a_host_go(spark):
    box = '<div class="q7"><p>Our shop is open on Sundays.</p></div>'
    rows = [(i, f"http://big.example.com/{i}", f"<body>{box if i % 10 == 0 else ''}<p>Text {i}.</p>{'<p>Yes.</p>' if i % 10 == 1 else ''}</body>") for i in range(400)]
    urls = [None, "/local/{}", "Bare.example.com/{}", "//www.bare.example.com:80/{}"]
    rows += [(1000 + i, urls[i % 4] and urls[i % 4].format(i), f"<body>{box}<p>Text {i}.</p></body>") for i in range(40)]
    want = {i: f"Text {i}." + (" Yes." if i % 10 == 1 else "") for i in range(400)}  # a short paragraph recurs by chance
    assert page_texts(spark, rows) == want | {1000 + i: f"Text {i}." for i in range(40)}
    hosts = spark.createDataFrame([(u,) for u in ("Bare.example.com/a", "//u@www.bare.example.com:80/", "ftp://bare.example.com")], "url string")
    assert {r[0] for r in hosts.select(html._host(F.col("url"))).collect()} == {"bare.example.com"}


def test_names_do_not_empty_an_article(spark):
    body = "<p>The whole article stands here and is the longest part of its page.</p>"
    names = ["content has-sidebar", "no-sidebar", "layout-sidebar-right", "nav-open", "share-enabled", "search-page", "notice-board", "related", "content sidebar"]
    pages = [f'<body><div class="{n}"><div class="ad">Buy</div>{body}</div><div class="menu">Go home</div></body>' for n in names]
    pages += [f'<body><div id="{n}"><article>{body}</article></div><div>{"Other text. " * 20}</div></body>' for n in ("related-work", "search")]
    pages += [f'<main>{body * 3}</main><div id="comments"><article>First!</article></div><div class="related"><p>More</p></div>']
    got = page_texts(spark, [(i, f"http://n{i}.example.com/", p) for i, p in enumerate(pages)])
    text = body[3:-4]
    want = [text] * len(names) + [" ".join([text, *["Other text."] * 20])] * 2 + [" ".join([text] * 3)]
    assert got == dict(enumerate(want))


# -- 3 ------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_of(text: str) -> list[tuple]:
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            else:
                good = {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


def private_rows() -> list[tuple]:
    rnd = random.Random(8)
    alphabet = ["a", "B", "@", ".", "-", "+", " ", "(", ")", "7", "0", "255", "4111111111111111", "1.2.3.4", "x@y.zz", "+1 (201) 555-0100", "é", "🙂", "\n", "%", "_"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    texts += [f"please call me at +1 (201) 555-0{i}00 today" for i in range(6)] + ["please call me at 555-0199 today", "we met at 555-0199 today", "Version 4.0 of 2021 is at page 17"]
    texts += [None, "", "9" * 40_000, "a@" * 3000, "." * 30_000, "1.2.3.4.5.6.7.8 a@b.c@d.e"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x@y.zz"), (3, texts[3])]


def test_personal_data(spark):
    rows = private_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = pii.report(table).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text in rows:
        found = base_of(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        n = Counter(k for *_, k in found)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest())] += 1
        assert any(r.doc_id == i and set(filter(None, joined.split(","))) <= set(r.spans.split(",")) for r in got)
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    # "call me at" is a context of phones, so the short number behind it is one too, wherever it stands.
    found = {r.doc_id: r.spans for r in got if r.n_discovered}
    texts = dict(r for r in rows if r[0] is not None)
    assert {texts[i] for i in found} == {"please call me at 555-0199 today", "we met at 555-0199 today"}
    assert pii.report(table.limit(0)).count() == 0


def test_spaced_numbers_are_discovered(spark):
    cards = ["4111 1111 1111 1111", "5555 5555 5555 4444", "3782 822463 10005", "6011 1111 1111 1117", "5105 1051 0510 5100", "4012 8888 8888 1881"]
    rows = [(i, f"pay with card {c} now") for i, c in enumerate(cards)]
    rows += [(20 + i, f"please call me at +1 (201) 555-0{i}00 today") for i in range(12)]
    long = "a" * 70 + "@home"
    rows += [(40 + i, f"you should write to someone{i}@mail.example.com today") for i in range(6)]
    odd = {60: ("pay with card ", "4111 1111 1111 1112", " now", "card"), 61: ("he would call me at ", "(555) 123-4567", " soon", "phone"), 62: ("call me at ", "020 7946 0958", "", "phone"),
           63: ("call me at ", "(555) 123-4569 2000", " 3000 4000", "phone"), 64: ("write to ", long, " now", "email")}
    rows += [(i, a + b + c) for i, (a, b, c, _) in odd.items()] + [(70, "the years 2019 2020 2021 and 1 2 3 4 5 6 7 8")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_discovered}
    assert got == {i: f"{kind}:{len(a)}:{len(a + b)}" for i, (a, b, _, kind) in odd.items()}


def test_masking_keeps_all_else(spark):
    rows = [(1, "Write a@b.cc or +1 201 555 0100.", "k"), (2, None, "k"), (3, "clean", None), (None, "a@b.cc", "k"), (1, "clean", "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_chars", F.length("text").cast("long"))
    got = pii.masked(table)
    assert got.columns == table.columns
    assert Counter(map(tuple, got.collect())) == Counter([(1, "Write <EMAIL> or <PHONE>.", "k", 25), (2, None, "k", 0), (3, "clean", None, 5), (None, "<EMAIL>", "k", 7), (1, "clean", "k", 5)])


# -- 4, 7, 9: tokens ------------------------------------------------------------


def odd_texts(n: int = 1500) -> list[str]:
    rnd = random.Random(1)
    letters = "ab '\n\t.,3²é́Σİ_<|>*가 "
    fixed = ["", " ", "don't 'll x's  'S", "<|endoftext|> a<|endoftext|>b", "\x1c a \x1d", "x²2 ²2²", "\n\nB a\n\nB .\n\nB", "İstanbul Ǆ", "a.\n\n\nB   c \n d ", "q" * 500]
    return fixed + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_gives_the_librarys_ids(path):
    library, own, texts = Tokenizer.from_file(path), Encoder(path), odd_texts()
    own.pieces.most, own.most_runs = 200, 300  # the memory runs over again and again
    for start in range(0, len(texts), 50):
        for text, ids in zip(texts[start : start + 50], own.ids(texts[start : start + 50]), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_prefix_counts_are_exact_at_every_prefix():
    library, counts = Tokenizer.from_file(BYTE_BPE), prefix_tokens.PrefixCounter(BYTE_BPE)
    texts = odd_texts(250)
    exact = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text, found in zip(texts, counts.totals(texts), strict=True):
        assert sum(found) == exact(text), text
    for text in texts[:120]:
        assert counts.every_prefix(text).tolist() == [exact(text[:i]) for i in range(len(text) + 1)], text


def test_token_counts(spark, docs, nothing):
    library = Tokenizer.from_file(BYTE_BPE)
    got = prefix_tokens.token_counts(docs, BYTE_BPE, 512).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows)
    assert Counter(tuple(r)[:4] for r in got) == want
    text = next(r.text for r in rows if r.text and len(r.text) > 20_000)
    keep = next(r.keep_chars for r in got if r.n_bytes == len(text))
    assert len(library.encode(text[:keep], add_special_tokens=False).ids) <= 512 < len(library.encode(text[: text.index(" ", keep + 1)], add_special_tokens=False).ids)
    assert prefix_tokens.token_counts(nothing, BYTE_BPE).count() == 0
    assert prefix_tokens.prefix_counts(docs.limit(2), BYTE_BPE).count() == 2


def test_token_files(spark, docs, nothing):
    library, path = Tokenizer.from_file(BYTE_BPE), shared_folder(spark, "test-tokens")
    tokenfile.write_tokens(docs, path, BYTE_BPE, block_tokens=700)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert len({(r.part, r.block) for r in spark.read.parquet(path).collect()}) > 3
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids[:-1])) for r in got) == want
    assert tokenfile.round_trip(nothing, BYTE_BPE).count() == 0
    rnd = np.random.default_rng(2)
    for ids in (rnd.integers(0, 100_000, 5001), rnd.zipf(1.3, 999) % 60_000, np.array([7])):
        assert (tokenfile.decode_block(len(ids), *tokenfile.encode_block(ids)) == ids).all()


def test_packing(spark, docs, nothing):
    library = Tokenizer.from_file(WORD_BPE)
    got = packing.pack_documents(docs, WORD_BPE, capacity=64).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(r.doc_id, k // 64, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 64 + 1
    assert packing.pack_documents(nothing, WORD_BPE).count() == 0


def test_best_two_fit():
    rnd = random.Random(4)
    # The largest that fits leaves 10 + 5 of 16; two for the 5 fill it.
    assert sorted(sorted([10, 5, 3, 3][i] for i in b) for b in packing.best_two_fit([10, 5, 3, 3], 16)) == [[3, 3, 10], [5]]
    for _ in range(60):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 60))]
        bins = packing.best_two_fit(lengths, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 40 for b in bins)


# -- 5 ------------------------------------------------------------------------


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups_of(rows) -> list[int | None]:
    """Smallest id reachable from each row, by comparing all pairs."""
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            label[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        known = [x for x in (least.get(find(i)), r.doc_id) if x is not None]
        least[find(i)] = min(known) if known else None
    return [least[find(i)] for i in range(len(rows))]


def test_near_duplicates(docs, nothing):
    rows = docs.collect()
    want = Counter((r.doc_id, len(shingles(r.text)), c, r.doc_id == c) for r, c in zip(rows, groups_of(rows), strict=True))
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert minhash.near_duplicates(nothing).count() == 0


def test_one_row_per_group_stays(docs):
    rows = docs.collect()
    got = minhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    left = got.collect()
    label = dict(zip(((r.doc_id, r.text) for r in rows), groups_of(rows), strict=True))
    groups = Counter(label[(r.doc_id, r.text)] for r in left if shingles(r.text))
    assert set(groups.values()) == {1}
    assert set(groups) == {c for r, c in zip(rows, groups_of(rows), strict=True) if shingles(r.text)}
    assert sum(not shingles(r.text) for r in left) == sum(not shingles(r.text) for r in rows)


def test_components_are_told_apart_whatever_their_ids(spark):
    rnd = random.Random(12)
    make = lambda: " ".join("".join(rnd.choice("aeioustrnl") for _ in range(6)) for _ in range(40))
    alone, same_id, group = [make() for _ in range(20)], [make(), make()], make()
    rows = [(None, t) for t in alone] + [(5, t) for t in same_id] + [(None, group), (None, group), (None, group + " x")]
    rows += [(7, alone[0]), (9, alone[0] + " y"), (None, None), (None, "")]
    got = Counter(map(tuple, minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sum(got[(None, t)] for t in (group, group + " x")) == 1
    got -= Counter([(None, group), (None, group + " x")])
    assert got == Counter([(None, t) for t in alone[1:]] + [(5, t) for t in same_id] + [(7, alone[0]), (None, None), (None, "")])


def test_large_group_of_near_copies(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(9999)}" for _ in range(60)]
    rows = [(i, " ".join("z%d" % rnd.randrange(10**6) if rnd.random() < rnd.choice((0.005, 0.02, 0.05)) else w for w in words)) for i in range(250)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()}
    collected = table.collect()
    assert got == {r.doc_id: c for r, c in zip(collected, groups_of(collected), strict=True)}


# -- 6 ------------------------------------------------------------------------


def test_fingerprints(spark, docs, nothing):
    got = imatch.compared(docs).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert len(got) == len(rows)
    ids = Counter(x[:2] for x in rows)
    edited = {}
    for x, y in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(x[2]) // 2
        edited[x[:2]] = x[2][: len(x[2]) - half] + y[2][:half]
    by_text, texts = defaultdict(set), {x[:2]: x[2] for x in rows}
    for r in got:
        key = (r.doc_id is not None, r.doc_id or 0)
        if ids[key] > 1:  # the order of repeated ids is by hash
            continue
        assert r.edited_sha256 == hashlib.sha256(edited[key].encode()).hexdigest() and r.n_chars == len(texts[key])
        by_text[texts[key]].add(r.fingerprint)
        by_text[edited[key]].add(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited for r in got if r.n_chars > 200]) > 0.05
    assert all(len(x) == 1 for x in by_text.values())
    assert imatch.compared(nothing).count() == 0


# -- 8 ------------------------------------------------------------------------


def test_apportionment_gives_each_block_to_the_highest_quotient(spark):
    rnd = random.Random(7)
    for case in range(4):
        n = rnd.randint(1, 60)
        items = [(f"i{k:03d}", rnd.choice([0.6, 0.6, 3.5, rnd.random() * 40]), rnd.randint(0, 60)) for k in range(n)]
        seats = rnd.randint(0, 300)
        want, heap = dict.fromkeys((i for i, _, _ in items), 0), [(-w, i, w, m) for i, w, m in items if m > 0]
        heapq.heapify(heap)
        for _ in range(min(seats, sum(m for _, _, m in items))):
            _, i, w, m = heapq.heappop(heap)
            want[i] += 1
            if want[i] < m:
                heapq.heappush(heap, (-w / (2 * want[i] + 1), i, w, m))
        table = spark.createDataFrame(items, "id string, weight double, most long")
        assert {r.id: r.seats for r in mixing.apportion(table, seats).collect()} == want, case


def test_mix(spark, docs, nothing):
    rows = docs.collect()
    settings = mixing.Settings(shard_words=2000)
    got = mixing.mix(docs, settings).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in rows:
        size[r.source] += words(r.text)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, stopped = 1.5 * sum(size.values()), {}, set()
    while True:
        left = total - sum(2 * size[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in stopped) for s in order if s not in stopped}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            target = share | {s: 2.0 * size[s] for s in stopped}
            break
        stopped |= over
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, words(r.text)) for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 4 * (1 + size[s] / 2000) + 4
    again = mixing.mix(docs.repartition(3), settings).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mixed_documents(docs, settings)
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in mixed.collect()) == pytest.approx(sum(r.taken for r in got), abs=8)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# -- 10 -----------------------------------------------------------------------


def test_toxicity(spark, nothing):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text, bad = [rnd.choice(words) for _ in range(rnd.randint(10, 120))], i % 5 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(["grumbold", "zwackle", "pfiffkopf"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "grumbold zwackle", "x"), (0, rows[0][1], "x")]
    labels += [(None, 1), (4, None), (77777, 1), (1, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(table, known, settings=toxicity.Settings(most_per_label=400)).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id < 900:
            right += r.predicted == int(r.doc_id % 5 == 0)
    assert right >= 0.97 * sum(r.held_out and r.doc_id < 900 for r in got)
    assert len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1
    empty = toxicity.toxicity(table, known.limit(0)).collect()
    assert {r.predicted for r in empty} == {0}
    assert toxicity.toxicity(nothing, known).count() == 0
    model = toxicity.train(table, known, toxicity.Settings(most_per_label=400))
    scored = toxicity.score(table, model, "_t")
    assert scored.columns == [*table.columns, "_t"] and scored.count() == len(rows)


def test_token_operators_remember_many_pieces_and_leave_the_collector_alone(spark, monkeypatch):
    pieces, seen = prefix_tokens.PrefixCounter(BYTE_BPE).pieces, []
    assert pieces.most == encoding.MANY and Encoder(WORD_BPE).pieces.most < encoding.MANY
    assert encoding.encoder(WORD_BPE, encoding.MANY).pieces.most == encoding.encoder(WORD_BPE, encoding.MANY).most_runs == encoding.MANY
    assert encoding.encoder(WORD_BPE, encoding.MANY) is not encoding.encoder(WORD_BPE)
    compute = pieces.compute
    monkeypatch.setattr(pieces, "compute", lambda new: (seen.append(gc.isenabled()), compute(new))[1])
    pieces.of(["a text", "another text"])
    assert seen and not any(seen) and gc.isenabled()
