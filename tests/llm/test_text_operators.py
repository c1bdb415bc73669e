"""URL rules, licence scan, token ids and counts, packing: against plain versions."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from helpers import by_id
from tokenizers import Tokenizer

from foliary.llm import byte_bpe, licences, packing, queries, token_counts, url_rules

VOCABULARY, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            key = (len(h) + len(p or ""), len(h), v == "block")
            if best is None or key > best[0]:
                best = (key, h + (p or ""), v)
    return host, path, best and best[1], best[2] if best else default


def test_urls_against_every_rule(spark):
    random.seed(5)
    labels = ["a", "b", "net", "x-y", "B", ""]
    hosts = [".".join(random.choices(labels, k=random.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/é"]
    rules = [(random.choice(hosts).lower(), random.choice(paths), random.choice(["allow", "block"])) for _ in range(40)]
    rules += [rules[0], (None, "/", "block"), ("net", None, "block")]
    urls = [f"http://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '?q=/en/', '#f'])}" for _ in range(600)]
    urls += [None, "", "no scheme/en/", "http://", "http://NET", "x://a://b/en/"] + ["http://b.net/en/hot"] * 500
    pages = spark.createDataFrame([(i % 1000, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = url_rules.judged(pages.repartition(4), table).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(str((i % 1000, *plain_verdict(u, rules))) for i, u in enumerate(urls))
    assert sorted(str(tuple(r)) for r in got) == want


def test_urls_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judged(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert url_rules.judged(one, rules, default="block").collect()[0]["verdict"] == "block"


def plain_licences(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [
        (i, label)
        for phrase, label in licences.BASE
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_licences_base_counts(spark, documents, corpus):
    texts = [None, "", "!!", "cc by", "CC-BY cc by cc by", "all rights reserved all Rights\nreserved", "xcc by", "é cc by ünd"]
    texts += ["x " * 50_000 + "general public license", "cc by cc by cc by"]
    df = documents(list(enumerate(texts)) + [(3, "cc by")])
    got = {(r.doc_id, tuple(r)[1:6]) for r in licences.scanned(df).collect()}
    assert got == {(i, plain_licences(t)) for i, t in enumerate(texts)}
    for row in licences.scanned(corpus).join(corpus.select("doc_id", "text"), "doc_id").collect():
        assert tuple(row)[1:6] == plain_licences(row.text)
    assert licences.scanned(documents([])).count() == 0


@pytest.mark.parametrize(
    "expression, ids, value, fine",
    [
        ("MIT", {"mit"}, 0.2, True),
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.2, True),
        ("MIT AND GPL-3.0-only OR Apache-2.0", {"mit", "gpl-3.0-only", "apache-2.0"}, 0.2, True),
        ("MIT AND (GPL-3.0-only OR Apache-2.0)", {"mit", "gpl-3.0-only", "apache-2.0"}, 0.2, True),
        ("(MIT OR Apache-2.0) AND GPL-2.0", {"mit", "gpl-2.0", "apache-2.0"}, 0.7, True),
        ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2.0"}, 0.35, True),
        ("MIT AND", {"mit"}, 0.2, False),
        ("(MIT", {"mit"}, 0.2, False),
        ("OR MIT", set(), 0.0, False),
        ("MIT MIT", {"mit"}, 0.2, False),
        ("", set(), 0.0, False),
    ],
)
def test_licence_expressions(expression, ids, value, fine):
    assert licences.evaluate(expression) == (ids, value, fine)


def test_licence_expression_in_text(documents):
    df = documents([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause\ncode")])
    row = licences.scanned(df).collect()[0]
    assert row["labels"] == "bsd-3-clause,gpl-2.0,mit,spdx" and row["score"] == 0.2


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a", "b ", "  ", " ", "\n", "\t", "\xa0", "\x1c", "\x85", "é", "1", "'s", "!!", "<|endoftext|>", "日本", "\u2003", "x" * 50, "🙂", "\u0301"]


def test_encoding_and_decoding(spark, documents, corpus, library):
    random.seed(2)
    texts = [None, "", " ", "\n\n", "y" * 20_000, "🙂" * 3000] + ["".join(random.choices(ODD, k=random.randint(1, 60))) for _ in range(400)]
    df = documents(list(enumerate(texts)))
    made = byte_bpe.with_decoded(byte_bpe.encoded(df, VOCABULARY, public.PATTERN, RANKS, with_offsets=True), VOCABULARY, RANKS)
    for i, row in by_id(made).items():
        text = texts[i] or ""
        assert row["ids"] == library.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        # each token lies in the bytes of the characters it names
        table = byte_bpe.token_bytes(VOCABULARY)
        for token, a, b in zip(row["ids"], row["starts"], row["ends"]):
            assert table[token] in text[a:b].encode()
        parts = list(byte_bpe.decoded_parts(table[t] for t in row["ids"]))
        assert "".join(parts) == text
    query = by_id(queries.op3_byte_bpe(spark, SMALL))
    for row in corpus.collect():
        ids = library.encode_ordinary(row["text"])
        got = query[row["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()


def test_decoding_refuses_unknown_ids(spark):
    for wrong in ([-1], [60_000]):
        df = spark.createDataFrame([(1, wrong)], "doc_id long, ids array<int>")
        with pytest.raises(Exception):
            byte_bpe.with_decoded(df, VOCABULARY).collect()


def test_small_memory_gives_the_same_ids(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 2)
    encode = byte_bpe.encoder(VOCABULARY, public.PATTERN)
    for text in ("a b c d e f a b c", "one two, three. four", "x" * 100 + " y"):
        assert np.frombuffer(encode(text), "<i4").tolist() == library.encode_ordinary(text)


def test_token_counts(documents, corpus):
    own = Tokenizer.from_file(VOCABULARY)
    random.seed(3)
    texts = [None, "", "z" * 5000, "a<|endoftext|>b", " <|endoftext|>  <|endoftext|>", "<|endof" * 30]
    texts += ["".join(random.choices(ODD, k=random.randint(1, 120))) for _ in range(300)]
    df = documents(list(enumerate(texts)))
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for chunk, overlap in ((1 << 15, 1 << 10), (24, 8), (64, 16), (40, 40)):
        got = by_id(token_counts.counted(df, VOCABULARY, public.PATTERN, limit=30, chunk=chunk, overlap=overlap))
        assert {i: r["n_tokens"] for i, r in got.items()} == want
        assert all(r["over_limit"] == (r["n_tokens"] > 30) and r["n_bytes"] == len((texts[i] or "").encode()) for i, r in got.items())
    counts = by_id(token_counts.counted(corpus, VOCABULARY, public.PATTERN, chunk=1000, overlap=50))
    assert all(counts[r["doc_id"]]["n_tokens"] == len(own.encode(r["text"], add_special_tokens=False).ids) for r in corpus.collect())


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.checked_tokenizer(public.path("word_bpe_49k.json"))


@pytest.mark.parametrize("width", [7, 64, 2048])
def test_packing_is_lossless(documents, library, width):
    random.seed(4)
    texts = [None, ""] + ["word " * random.randint(0, 60) + str(i) for i in range(120)]
    df = documents(list(enumerate(texts)))
    rows = packing.packed(df, RANKS, public.PATTERN, width=width, block=500).collect()
    pieces = {}
    for row in rows:
        ids, lengths = np.array(row["ids"]), row["lengths"]
        assert len(ids) == width and lengths[0] == 0 and lengths[-1] <= width and row["resets"] == lengths[:-1]
        places = packing.positions(lengths)
        for a, b, doc, n in zip(lengths, lengths[1:], row["doc_ids"], row["segments"]):
            pieces[doc, n] = ids[a:b].tolist()
            assert places[a:b].tolist() == list(range(b - a))
        assert (ids[lengths[-1] :] == 50256).all()
    for i, text in enumerate(texts):
        own = [pieces[k] for k in sorted(pieces) if k[0] == i]
        assert sum(own, []) == library.encode_ordinary(text or "") + [50256]
        assert all(len(p) == width for p in own[:-1])
    assert packing.packed(documents([]), RANKS, public.PATTERN).count() == 0


def test_best_fit_against_a_scan_of_all_rows():
    random.seed(0)
    for _ in range(200):
        width = random.randint(1, 40)
        sizes = [random.randint(1, width) for _ in range(random.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, width)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        room = []
        for size in sorted(sizes, reverse=True):
            fitting = [i for i, r in enumerate(room) if r >= size]
            if fitting:
                room[min(fitting, key=lambda i: room[i])] -= size
            else:
                room.append(width - size)
        assert sorted(width - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_ranks_encode_whole_texts(monkeypatch):
    """The library splits a text itself: the same ids, and no lookup of pieces."""
    by_pieces = byte_bpe.encoder(VOCABULARY, public.PATTERN)
    texts = ["", " ", "  a b", "a\n\n b  c ", "don't 'll　 y  z", "\U0001f600<|endoftext|>", "é" * 300, " " * 3000 + "x", "\n" * 200 + " q"]
    expected = [by_pieces(text) for text in texts]
    monkeypatch.setattr(byte_bpe, "pieces_of", None)
    encode = byte_bpe.rank_encoder(RANKS, public.PATTERN)
    assert [encode(text) for text in texts] == expected
