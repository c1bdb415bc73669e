"""Alignment of tokenizers, shards and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliary.llm import alignment, periodic_runs, sharding

NAMES = (
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.PATTERN,
    public_tokenizers.path("piece_bpe_32k.model"),
)


# ---- alignment ----


def plain_alignment(texts):
    """Whole texts by the libraries, ends compared in lists; the contract's columns for each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_own = Tokenizer.from_file(NAMES[0])
    a_own.encode_special_tokens = True
    b_own = sentencepiece.SentencePieceProcessor(model_file=NAMES[2])
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in printable}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def piece(i):
        p = b_own.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_own.is_byte(i) else p.replace("▁", " ").encode()

    rows, total = [], Counter()
    for text in texts:
        groups = []
        if text:
            a = a_own.encode(" " + text, add_special_tokens=False).ids
            b = b_own.encode(text)
            a_bytes = [bytes(table[c] for c in a_own.id_to_token(i)) for i in a]
            b_bytes = [piece(i) for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
                x = y = 0
                for end in [e for e in a_ends if e in set(b_ends)]:
                    i, j = a_ends.index(end) + 1, b_ends.index(end) + 1
                    groups.append((a[x:i], b[y:j]))
                    x, y = i, j
        rows.append(groups)
        total.update((a[-1], b[-1]) for a, b in groups)
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for groups in rows:
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        links = [(a[-1], b[-1]) for a, b in groups]
        out.append(
            (
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                len(links),
                sum(total[x] == most[x[1]] for x in links),
                sum(total[x] for x in links),
                hashlib.sha256(listed.encode()).hexdigest() if groups else "",
            )
        )
    return out, rows, total


ODD_TEXTS = [
    None,
    "",
    " ",
    "a  b ",
    "\n\n x\t y\r\n",
    "a▁b c",
    "<s> hi</s> <|endoftext|> it's",
    "　中文 \U0001f600​ \xa0x\x1c y\x00",
    "word " * 3000,
    "x" * 5000,
    "same text here",
    "same text here",
]


def aligned_rows(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = alignment.summaries(df, *NAMES)
    assert set(out.columns) == set(columns)
    return sorted(tuple(r[c] for c in columns) for r in out.collect())


def test_alignment_by_the_libraries(documents, corpus):
    r = random.Random(5)
    parts = ["a", " ", "  ", "\n", "é", "中", "<s>", "1", "'s", "\U0001f600", "word", "\x85", ". "]
    texts = ODD_TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(150)]
    texts += [t["text"] for t in corpus.select("text").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, texts[10])]
    want, _, _ = plain_alignment([t for _, t in rows])
    assert aligned_rows(documents(rows)) == sorted((i, *w) for (i, _), w in zip(rows, want))


def test_alignment_does_not_depend_on_blocks(documents, monkeypatch):
    rows = [(i, f"some words {i} " * (1 + i % 7)) for i in range(120)]
    one = aligned_rows(documents(rows, 1))
    assert aligned_rows(documents(rows, 7)) == one


def test_alignment_of_nothing(documents):
    assert aligned_rows(documents([])) == []
    assert aligned_rows(documents([(1, None), (1, "")])) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_groups_and_pair_counts(documents):
    texts = [t for t in ODD_TEXTS if t]
    df = documents(list(enumerate(texts)))
    _, groups, total = plain_alignment(texts)
    for row in alignment.groups_of_texts(df, *NAMES).collect():
        assert [(g["a"], g["b"]) for g in row["groups"]] == groups[row["doc_id"]]
        if row["groups"]:
            assert row["groups"][-1]["end"] == len((" " + texts[row["doc_id"]]).encode())
    found = alignment.pair_counts(df, *NAMES).collect()
    assert {(r["a"], r["b"]): r["times"] for r in found} == total


def test_parts_that_leave_the_memory(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 3)
    align = alignment.Aligner(*NAMES)
    parts = [" a", " b", " c", " a", " d" * 40, " e", (" ", " f")]
    for _ in range(3):
        assert align.look_up(parts, list) == [align.groups(p) for p in parts]


# ---- shards ----


def check_shards(rows, documents, shards=8):
    """Sizes, checksums, slots and the spread of the shards; gives the members of each text by shard."""
    out = sharding.sharded(documents(rows), shards).collect()
    text = defaultdict(list)
    for i, t, *_ in rows:
        text[i].append(t or "")
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    sizes, slots, by_text = Counter(), defaultdict(list), defaultdict(Counter)
    for r in out:
        assert (r["size"], r["text_crc32"]) in [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in text[r["doc_id"]]]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"], r["size"]][r["shard"]] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(sizes.values()) / shards
    largest = max((r["size"] for r in out), default=0)
    assert all(abs(sizes[s] - share) <= max(2 * largest, 0.01 * share) for s in range(shards))
    return by_text


def test_shards_keep_equal_texts_together(documents):
    r = random.Random(1)
    rows = [(i, " ".join(str(r.randrange(99)) for _ in range(r.randint(1, 60)))) for i in range(1200)]
    copies = [f"copied text {k} " * r.randint(1, 6) for k in range(80)]
    rows += [(5000 + 20 * k + j, t) for k, t in enumerate(copies) for j in range(r.randint(2, 12))]
    groups = [c for c in check_shards(rows, documents).values() if sum(c.values()) > 1]
    assert sum(len(c) > 1 for c in groups) <= 0.05 * len(groups)


def test_a_group_larger_than_a_shard_fills_few(documents):
    rows = [(i, f"text number {i:05d} of the others") for i in range(800)]
    rows += [(10_000 + i, "the hot text " + "x" * 20) for i in range(400)]
    by_text = check_shards(rows, documents)
    hot = max(by_text.values(), key=lambda c: sum(c.values()))
    # a third of the rows needs three shards of eight; few members stay elsewhere
    assert sum(n for _, n in hot.most_common(4)) >= 0.9 * sum(hot.values())


def test_shards_of_odd_rows(documents):
    assert sharding.sharded(documents([])).count() == 0
    rows = [(1, None), (1, ""), (2, "x" * 100_000), (3, "é中"), (3, "é中")]
    check_shards(rows + [(i, None) for i in range(10, 60)], documents, 4)
    check_shards([(i, "all the same") for i in range(300)], documents)


def test_shards_do_not_depend_on_chance(documents):
    df = documents([(i, f"t{i % 70} " * (i % 9)) for i in range(400)])
    runs = [sorted(map(str, sharding.sharded(df).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_links_through_several_hubs(spark):
    """Six clusters that overlap in hubs, and rows without links: rows of one cluster end together."""
    rows = [(i, 10) for i in range(240)]
    links = [(i, b"%d" % (i // 20)) for i in range(120)] + [(i, b"n%d" % (i // 20)) for i in range(0, 120, 2)]
    df = spark.createDataFrame(rows, "tag long, size long")
    hubs = spark.createDataFrame(links, "tag long, hub binary")
    found = sharding.balanced(df, hubs, 4).groupBy("shard").agg(F.sum("size").alias("n"), F.collect_list("tag").alias("tags")).collect()
    assert sorted(r["n"] for r in found) == [600] * 4
    assert sum(len({i // 20 for i in r["tags"] if i < 120}) for r in found) <= 9  # chance would give 24


def test_sharding_plans_no_python(documents):
    plan = sharding.sharded(documents([(i, f"t{i}") for i in range(50)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---- periodic runs ----


def plain_runs(words, min_length=6, repeats=4):
    """All stretches of each period, by looking at every period; the smallest period of equal stretches."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_length, repeats * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("limits", [(6, 4), (1, 3), (10, 3), (8, 5)])
def test_runs_of_random_words(limits):
    r = random.Random(str(limits))
    total = 0
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            kinds, n = r.choice([1, 2, 3, 5]), r.choice([0, 3, 10, 40, 120])
            words = [b"%d" % r.randrange(kinds) for _ in range(n)]
            if n and r.random() < 0.6:
                p, i = r.randint(1, 12), r.randrange(n)
                words = words[:i] + (words[i : i + p] or [b"x"]) * r.randint(2, 9) + words[i:]
                words = words * r.choice([1, 1, 1, 3])
            texts.append(words)
        want = [plain_runs(w, *limits) for w in texts]
        assert periodic_runs.runs_of(texts, *limits) == want
        total += sum(map(len, want))
    assert total > 300


def test_long_runs_take_near_linear_work():
    for n, p in ((60_000, 1), (60_000, 7), (60_000, 9_000)):
        assert periodic_runs.runs_of([[b"%d" % (i % p) for i in range(n)]]) == [[(0, n, p)]]
    # a phrase that comes back far away again and again has no run
    words = []
    for i in range(3000):
        words += [b"a", b"b", b"c", b"d", b"e", b"f", b"%d" % i, b"%d" % (i * i)]
    assert periodic_runs.runs_of([words]) == [[]]


def plain_summary(doc_id, text):
    words = [w for w in (text or "").encode().split() if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    digest = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode(), b" ".join(kept))]
    return doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *digest


def test_run_summaries(documents, corpus):
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t", "a " * 40, "a b " * 9 + "c", "x　y " * 8, "w " * 30_000, "\x1ca \x1ca " * 9])]
    rows += [(i, f"one two three four {i} " * (1 + i % 6)) for i in range(10, 200)]
    rows += [(7, "same id"), (7, "same id"), (None, "a b c " * 8)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect() if r["text"] and len(r["text"]) < 4000]
    rows = [r for r in rows if len(r[1] or "") < 50_000] + [(99_999, "w " * 30_000)]
    got = periodic_runs.summaries(documents(rows), change=periodic_runs.planted).collect()
    short = [r for r in rows if r[0] != 99_999]
    want = {str(plain_summary(*r)) for r in short}
    found = {str(tuple(r)) for r in got if r["doc_id"] != 99_999}
    assert found == want and len(got) == len(rows)
    assert sum(r["n_runs"] > 0 for r in got) > 20
    assert periodic_runs.summaries(documents([])).count() == 0


def test_collapsed_texts(documents):
    rows = [(1, "go a b a b a b a b stop"), (2, "plain text"), (3, None)]
    got = {r["doc_id"]: r for r in periodic_runs.collapsed_texts(documents(rows)).collect()}
    assert got[1]["text"] == "go a b stop" and got[1]["runs"][0].asDict() == {"start": 1, "length": 8, "period": 2}
    assert got[2]["text"] == "plain text" and got[3]["text"] == "" and not got[3]["runs"]
