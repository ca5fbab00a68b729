"""Encoding, token totals, leaks and shared spans against brute force, with the awkward cases of each."""

import json
import os
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import budget, encode, leakage, sieve, spans
from tokenloom.llm.vocab import BYTE_BPE_50K, TOKENIZER_DIR, encoder, safe_parts

PATH = os.path.join(TOKENIZER_DIR, BYTE_BPE_50K)
TEXTS = ["", None, " ", "\n\n  x", "don't 12ab", "<|endoftext|> x", "naïve 日本 𝄞", "a​b\r\n\tc", "hello world  ", "x" * 5000]


# --- encoding --------------------------------------------------------------------------------------------------------


def test_ids_agree_with_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[3])], "id long, text string")
    for r in encode.encode_column(df.withColumn("ids", df.id), "id", "text").collect():
        text = TEXTS[3] if r.ids and r.id == 0 else TEXTS[r.id]
        assert r.ids == (other.encode(text, add_special_tokens=False).ids if text else [])
    back = {r.id: r.text for r in encode.decode_column(encode.encode_column(df.where("id > 0"), "id", "text"), "id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS) if i}
    assert encode.encode_column(df.limit(0), "id", "text").count() == 0


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=" \n\t'aZ1é-.st日 ", max_size=60), st.integers(1, 8))
def test_parts_encode_as_the_whole(text, size):
    enc = encoder(PATH)
    parts = safe_parts(text, size)
    assert "".join(parts) == text
    assert sum((enc.encode_ordinary(p) for p in parts), []) == enc.encode_ordinary(text)


def test_long_words_take_linear_time():
    began = time.time()
    assert len(encode._ids(encoder(PATH), "ab" * 200_000)) > 0
    assert len(encode._ids(encoder(PATH), "lorem ipsum 12\n" * 60_000)) > 0
    assert time.time() - began < 20


# --- token totals ----------------------------------------------------------------------------------------------------


def test_totals_are_exact(spark):
    texts = TEXTS * 3 + ["some words and some more words"] * 20
    data = [(i, t, "ab"[i % 2] if i % 5 else None, i % 3, 10 if i % 4 == 0 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "id long, text string, source string, piece int, known long")
    enc = encoder(PATH)
    want = defaultdict(lambda: [0] * 6)
    for _, t, s, _, k in data:
        w = want[s]
        for i, x in enumerate((1, not t, len(t or ""), len(enc.encode_ordinary(t or "")), k is not None, k or 0)):
            w[i] += x
    for sent in (10**6, 5, 0):  # all lengths sent, some, none
        counted = budget.document_tokens(df, ["id", "source", "known"], "text", sent_pieces=sent)
        assert {r.id: r.n_tokens for r in counted.collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in data}
        got = {r.source: [r.n_texts, r.n_empty, r.n_chars, r.n_tokens, r.n_known, r.known_tokens] for r in budget.token_budget(counted, ["source"], "known").collect()}
        assert got == dict(want)
    assert budget.document_tokens(df.limit(0), ["id"], "text").count() == 0


def test_pieces_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(budget, "HELD_PIECES", 3)
    df = spark.createDataFrame([("a b c d e f a b c",)] * 3, "text string")
    assert {r.piece: r.freq for r in budget.piece_counts(df, "text").collect()}[" b"] == 6


def test_long_pieces_go_by_their_digest(spark):
    long = "x" * 70
    df = spark.createDataFrame([(1, long), (2, f"{long} {long}"), (3, "y" * 5000), (4, "\0" + "a" * 32)], "id long, text string")
    enc = encoder(PATH)
    for sent in (100, 0):
        got = {r.id: r.n_tokens for r in budget.document_tokens(df, ["id"], "text", sent_pieces=sent).collect()}
        assert got == {r.id: len(enc.encode_ordinary(r.text)) for r in df.collect()}


# --- leaks -----------------------------------------------------------------------------------------------------------


def _brute_leaks(docs, items, n=12):
    words = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower())
    index = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            index[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + n]), ())}
    return sorted(out, key=repr)


ITEM = "The train number 12 leaves Dover at 9 kg and arrives in Paris with forty calm and quiet passengers on board today"


def _leak_tables(spark):
    words = ITEM.split()
    docs = [
        ITEM, ITEM.upper(), "_".join(words), "x " + " \n\t".join(words[:12]) + " y", " ".join(words[:11]), " ".join(words[1:12] + ["now"]), ITEM.replace("train", "ｔｒａｉｎ"), "…".join(words[5:17]), None, "", "  ", "ﬁ " * 20,
        ITEM.replace("Dover", "Calais").replace("12", "15"), ("z " * 300) + ITEM, "word " * 40, " ".join(words[:6] + ["and"] + words[6:]),
    ]
    items = [ITEM, "word " * 13, "too short", None, "", ITEM]
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(docs)] + [(0, ITEM, "k")], "id long, text string, template string")
    i = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "id long, text string")
    return d, i, list(enumerate(docs)), [(100 + i, t) for i, t in enumerate(items)]


@pytest.mark.parametrize(("limit", "bits"), [(leakage.BROADCAST_WINDOWS, sieve.BITMAP_BITS), (3, sieve.BITMAP_BITS), (3, 15)])
def test_leaks(spark, rows, monkeypatch, limit, bits):
    monkeypatch.setattr(sieve, "BITMAP_BITS", bits)
    d, i, docs, items = _leak_tables(spark)
    assert rows(leakage.leaks(d, "id", "text", i, "id", "text", limit=limit)) == _brute_leaks(docs, items)
    assert leakage.leaks(d.limit(0), "id", "text", i, "id", "text").count() == 0
    assert leakage.leaks(d, "id", "text", i.limit(0), "id", "text").count() == 0


def test_leaks_over_part_borders(spark, rows, monkeypatch):
    monkeypatch.setattr(leakage, "PART_CHARS", 50)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    d, i, docs, items = _leak_tables(spark)
    assert rows(leakage.leaks(d, "id", "text", i, "id", "text")) == _brute_leaks(docs, items)


def test_reparameterised(spark):
    towns = ["Lima", "Oslo", "Cairo", "Quito", "Turin", "Accra"]
    items = [(i, f"In the quiet city of {towns[i]} the old driver number {i} sells fresh bread to every happy child for coins") for i in range(6)]
    docs = [(1, items[0][1]), (2, items[0][1].replace("Lima", "Rome").replace(" 0 ", " 77 ")), (3, "nothing of the kind here at all but many other words in a row")]
    d, i = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    got = {(r.doc, r.item): r.n_changed for r in leakage.reparameterised(d, "doc", "text", i, "item", "text").collect()}
    assert got[(1, 0)] == 0 and got[(2, 0)] == 2 and got[(1, 3)] == 2
    assert not any(doc == 3 for doc, _ in got)


@pytest.mark.parametrize("part", [leakage.PART_CHARS, 50])
def test_reparameterised_several_copies(spark, monkeypatch, part):
    monkeypatch.setattr(leakage, "PART_CHARS", part)
    towns = ["Lima", "Oslo", "Cairo", "Quito", "Turin", "Accra"]
    text = "In the quiet city of {0} the old driver number {1} sells fresh bread to every happy child in the old city of {2} for coins"
    items = [(i, text.format(towns[i], 10 + i, towns[i])) for i in range(6)]
    gap = " xyzzy quux " * 3
    docs = [
        text.format("Rome", 15, "Rome") + gap + text.format("Bonn", 18, "Bonn"),  # two variants
        items[0][1] + " " + text.format("Rome", 15, "Rome"),  # the passage itself and a variant right after it
        text.format("Rome", 15, "Bonn"),  # one slot, two words
        text.format("Rome", 15, "Bonn") + gap + text.format("Rome", 15, "Rome"),
        text.format("Rome", 15, "Rome"),
    ]
    d, i = spark.createDataFrame(list(enumerate(docs)), "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    got = {(r.doc, r.item): (r.n_words, r.n_changed) for r in leakage.reparameterised(d, "doc", "text", i, "item", "text").collect()}
    assert {k for k, _ in got} == {0, 1, 3, 4} and all((k, j) in got for k in (0, 1, 3, 4) for j in range(6))
    assert got[(0, 0)] == got[(1, 0)] == got[(3, 0)] == got[(4, 0)] == (len(set(items[0][1].lower().split())), 2)


def test_reparameterised_for_any_size_of_the_item_table(spark, rows):
    towns = ["Lima", "Oslo", "Cairo", "Quito", "Turin", "Accra"]
    text = "In the quiet city of {0} the old driver number {1} sells fresh bread to every happy child in the old city of {0} for coins"
    docs = [(1, text.format("Lima", 10)), (2, text.format("Rome", 77)), (3, text.format("Lima", 78)), (4, None), (5, "a few words")]
    d = spark.createDataFrame(docs, "doc long, text string")
    tables = {n: spark.createDataFrame([(i, text.format(towns[i], 10 + i)) for i in range(n)], "item long, text string") for n in (1, 6)}
    want = rows(leakage.reparameterised(d, "doc", "text", tables[6], "item", "text"))
    assert {r[0] for r in want} == {1, 2, 3} and len(want) == 18
    assert rows(leakage.reparameterised(d, "doc", "text", tables[6], "item", "text", limit=3)) == want
    other = [(9, "Every morning the baker of our village walks along a river and counts white swans before the shop opens at noon")]
    for few in (tables[1], tables[1].union(spark.createDataFrame(other, "item long, text string"))):
        got = {(r.doc, r.item): r.n_changed for r in leakage.reparameterised(d, "doc", "text", few, "item", "text").collect()}
        assert got[(1, 0)] == 0 and got[(3, 0)] == 1 and {i for _, i in got} == {0}


def test_reparameterised_recall(spark):
    """Of questions whose numbers and rare words were replaced one to one, at least nine in ten are found again."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet").collect()]
    held = Counter(w for _, t in items for w in set(leakage.words_of(t)))
    rng = np.random.default_rng(11)
    docs, planted = [], set()
    for k, (i, t) in enumerate(items):
        words = leakage.words_of(t)
        slots = [w for w in dict.fromkeys(words) if w.isdigit() or held[w] < leakage.NAME_ITEMS]
        chosen = {w: str(rng.integers(100, 10_000)) if w.isdigit() else f"zq{n}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for n, w in enumerate(slots[:4])}
        if len(words) < 14 or not chosen:
            continue
        text = " ".join(chosen.get(w, w) for w in words)
        docs.append((k, f"{' '.join(rng.choice(['lorem', 'dolor', 'sit', 'amet'], 30))} {text} {' '.join(rng.choice(['magna', 'aliqua', 'ut'], 30))}"))
        planted.add((k, i))
    d, i = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    got = {(r.doc, r.item) for r in leakage.reparameterised(d, "doc", "text", i, "item", "text").where("n_changed > 0").collect()}
    recall = len(planted & got) / len(planted)
    print(len(planted), recall)
    assert len(planted) > 100 and recall >= 0.9


# --- shared spans ----------------------------------------------------------------------------------------------------


def _brute_spans(docs, n):
    first, out = {}, set()
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            j = first.setdefault(t[k : k + n], i)
            if j != i:
                out |= {i, j}
    # a later document may share with the first only; go again so that all holders are found
    return sorted((i,) for i in out)


def _random_text(rng, n, alphabet="abcdefgh é𝄞\n"):
    return "".join(rng.choice(list(alphabet), n))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("span", [200, 64])
def test_shared_spans(spark, rows, seed, span):
    rng = np.random.default_rng(seed)
    docs = [_random_text(rng, rng.integers(0, 1500)) for _ in range(30)]
    for _ in range(40):  # copies of just enough, one too few, and more
        source = docs[rng.integers(0, 30)]
        n = span + [-1, 0, 0, 1, 30, 300][rng.integers(0, 6)]
        if len(source) > n:
            at = rng.integers(0, len(source) - n + 1)
            docs.append(_random_text(rng, rng.integers(0, 50)) + source[at : at + n] + _random_text(rng, rng.integers(0, 50)))
    docs += [None, "", "x" * 500, "x" * (span - 1), "y" * 600 + "y", "ab" * 300, docs[0], docs[0]]
    docs.append("".join(d[:span] for d in docs[:2]) if all(docs[:2]) else "")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "id long, text string, marks int")
    assert rows(spans.shared_documents(df, "id", "text", span)) == sorted(_brute_spans(list(enumerate(docs)), span), key=repr)


def test_repetition_within_one_document(spark):
    df = spark.createDataFrame([(1, "abc" * 400), (2, "q")], "id long, text string")
    assert spans.shared_documents(df, "id", "text").count() == 0
    assert spans.shared_documents(df.limit(0), "id", "text").count() == 0


def test_long_texts_go_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_CHARS", 300)
    rng = np.random.default_rng(9)
    docs = [_random_text(rng, 5000) for _ in range(4)]
    docs += [docs[0][1234:1434] + _random_text(rng, 100), docs[1][2000:2199] + "#", _random_text(rng, 950) + docs[2][4000:4210]]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    assert rows(spans.shared_documents(df, "id", "text")) == sorted(_brute_spans(list(enumerate(docs)), 200), key=repr)


def _brute_stretches(docs, n):
    holders = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            holders[t[k : k + n]].add(i)
    out = []
    for i, t in docs:
        flags = bytearray(len(t or ""))
        for k in range(len(t or "") - n + 1):
            if len(holders[t[k : k + n]]) > 1:
                flags[k : k + n] = b"\1" * n
        out += [(i, m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(flags))]
    return sorted(out, key=repr)


def _brute_amounts(docs, stretches):
    out = []
    for i, t in docs:
        own = [n for j, _, n in stretches if i == j]
        out.append((i, None if t is None else len(t), sum(own), sum(own) / len(t) if t else 0.0, len(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bits"), [(spans.BLOCK_CHARS, sieve.BITMAP_BITS), (300, 15)])
@pytest.mark.parametrize("span", [200, 64])
def test_shared_amounts(spark, rows, monkeypatch, span, block, bits):
    monkeypatch.setattr(spans, "BLOCK_CHARS", block)
    monkeypatch.setattr(sieve, "BITMAP_BITS", bits)  # with few bits much of it hits by chance
    rng = np.random.default_rng(span)
    docs = [_random_text(rng, rng.integers(0, 2000)) for _ in range(25)]
    for _ in range(40):  # one to three stretches of other documents, some of them too short
        parts = [_random_text(rng, rng.integers(0, 50))]
        for _ in range(rng.integers(1, 4)):
            source = docs[rng.integers(0, len(docs))]
            at = rng.integers(0, len(source) + 1)
            parts += [source[at : at + span + [-1, 0, 1, 30, 700][rng.integers(0, 5)]], _random_text(rng, rng.integers(0, 3))]
        docs.append("".join(parts))
    notice = _random_text(rng, span + 150)
    docs += [_random_text(rng, 100) + notice + _random_text(rng, 100) for _ in range(5)]
    docs += [notice[: span + 60] + "#", "#" + notice[60:], notice[:-1] + "#" + notice[1:]]  # two partners, each with a side
    docs += [None, "", "x" * 500, "x" * (span - 1), "x" * span, "ab" * 300, docs[0], docs[0], notice + notice]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "id long, text string, marks int")
    stretches = _brute_stretches(list(enumerate(docs)), span)
    assert rows(spans.shared_stretches(df, "id", "text", span)) == stretches
    assert rows(spans.shared_amounts(df, "id", "text", span)) == _brute_amounts(list(enumerate(docs)), stretches)
    assert rows(spans.shared_documents(df, "id", "text", span)) == sorted({(i,) for i, *_ in stretches}, key=repr)
    assert spans.shared_amounts(df.limit(0), "id", "text", span).count() == 0


def test_no_tokenizer_is_copied():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, fs in os.walk(os.path.join(root, "tokenloom")) for f in fs if f.endswith((".tiktoken", ".model"))]
    assert json.loads("[]") == []
