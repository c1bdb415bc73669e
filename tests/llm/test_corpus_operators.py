"""Duplicates, language models and the mix: against plain versions, and on held-out rows."""

import bz2
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import by_id

from foliary.llm import bloom, exact_duplicates, kneser_ney, mixing, near_duplicates, perplexity, toxicity
from foliary.llm.common import words_of

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


# exact duplicates


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for text, members in groups.items():
        first = min(members)
        keep = None if first[1] else first[2]
        for m in sorted(members):
            sha = hashlib.sha256(text.encode()).hexdigest()
            out.append((None if m[1] else m[2], keep, len(members), m == first, sha))
    return out


EXACT = [
    (5, "a b"),
    (3, "ab "),
    (4, "a  b"),
    (9, None),
    (8, ""),
    (7, " \n"),
    (11, "a\xa0b"),
    (12, "x" * 100_000),
    (None, "é\t1"),
    (13, "é1 "),
] + [(100 + i, f"hot {'' if i % 7 else ' '}copy") for i in range(300)]


@pytest.mark.parametrize("bits", [27, 16])
def test_exact_groups(documents, bits):
    df = documents(EXACT)
    got = [tuple(r) for r in exact_duplicates.groups(df, max_filter_bits=bits, bits_per_row=1).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_groups(EXACT)))


def test_exact_repeated_rows_keep_one(documents):
    df = documents([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "b")])
    got = exact_duplicates.groups(df).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 2), (3, 3, 2)]
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [1, 3]
    left = exact_duplicates.without_copies(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_exact_copies_leave(documents):
    df = documents(EXACT)
    kept = sorted(str(r[0]) for r in plain_groups(EXACT) if r[3])
    assert sorted(str(r["doc_id"]) for r in exact_duplicates.without_copies(df).collect()) == kept
    assert exact_duplicates.groups(documents([])).count() == 0
    assert exact_duplicates.without_copies(documents([])).count() == 0


def test_filter_lets_only_repeats_shuffle(spark):
    hashes = [hashlib.sha256(str(i % 900).encode()).digest() for i in range(1000)]
    df = spark.createDataFrame([(bytearray(h),) for h in hashes], "sha binary").repartition(5)
    size = bloom.filter_size(1000)
    marked = bloom.with_test(df, "sha", bloom.filled(df, size, 2), size)
    seen = Counter(bytes(r["sha"]) for r in marked.where("possible").collect())
    repeated = {h for h, n in Counter(hashes).items() if n > 1}
    assert repeated <= set(seen) and len(seen) < len(repeated) + 30


# near duplicates


def plain_near_classes(rows, size=5, threshold=0.8):
    """Classes by comparing all pairs."""
    sets, words = {}, {}
    for key, (_, text) in enumerate(rows):
        w = words_of((text or "").encode())
        words[key] = tuple(w)
        sets[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keys = list(sets)
    holders = defaultdict(list)
    for k in keys:
        for s in sets[k]:
            holders[s].append(k)
    shared = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            parent[root(a)] = root(b)
    for own in Counter(words.values()):
        same = [k for k in keys if words[k] == own and own]
        for k in same[1:]:
            parent[root(k)] = root(same[0])
    classes = defaultdict(list)
    for k in keys:
        classes[root(k)].append(rows[k][0])
    return {frozenset(Counter(c).items()) for c in classes.values()}


def classes_of(df):
    found = defaultdict(list)
    rows = df.collect()
    for r in rows:
        found[r["class_id"]].append(r["doc_id"])
    assert all(r["class_id"] == min(found[r["class_id"]]) and r["class_size"] == len(found[r["class_id"]]) for r in rows)
    assert Counter(r["class_id"] for r in rows if r["kept"]) == Counter(dict.fromkeys(found, 1))
    return {frozenset(Counter(c).items()) for c in found.values()}


def varied(random_, base, changes):
    words = list(base)
    for _ in range(changes):
        words[random_.randrange(len(words))] = f"w{random_.randrange(10**6)}"
    return " ".join(words)


def test_near_classes_of_variants(documents):
    r = random.Random(7)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One, two!"), (4, "one two three"), (5, "!!! ..."), (6, "one two")]
    for family in range(12):
        base = [f"b{r.randrange(10**6)}" for _ in range(r.choice([30, 120, 400]))]
        rows += [(len(rows) + i, varied(r, base, r.choice([0, 1, len(base) // 60, len(base) // 25]))) for i in range(12)]
    rows += [(5000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(40))) for i in range(50)]
    rows += [(9000, "long " + " ".join(map(str, range(40_000)))), (9001, "longer " + " ".join(map(str, range(40_000))))]
    assert classes_of(near_duplicates.classes(documents(rows))) == plain_near_classes(rows)


def test_near_classes_of_the_test_table(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert classes_of(near_duplicates.classes(df)) == plain_near_classes(rows)


def test_large_group_of_near_copies(documents):
    r = random.Random(8)
    base = [f"b{r.randrange(10**6)}" for _ in range(100)]
    rows = [(i, varied(r, base, 1)) for i in range(500)] + [(1000 + i, varied(r, base, 4)) for i in range(100)]
    got = classes_of(near_duplicates.classes(documents(rows)))
    assert got == plain_near_classes(rows)


def bridged_families(r, start, sizes, bridges):
    """Two families of near copies that share buckets but no link, and texts between them that are linked with
    few members of each."""
    base = [f"b{r.randrange(10**6)}" for _ in range(400)]
    middle, other = list(base), list(base)
    middle[320:358] = other[320:358] = [f"m{r.randrange(10**6)}" for _ in range(38)]
    other[358:396] = [f"o{r.randrange(10**6)}" for _ in range(38)]
    texts = [" ".join(w) for w in (base, other, *[[*middle[:-1], f"e{i}"] for i in range(bridges)])]
    # one more changed word takes the similarity of a member to the texts between below 0.8
    for own, n in zip((base, other), sizes):
        for i in range(n):
            words = list(own)
            words[10 + i % 300] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(words))
    return [(start + i, text) for i, text in enumerate(texts)]


def test_families_joined_by_one_bridge(documents):
    r = random.Random(11)
    rows = [row for k in range(4) for row in bridged_families(r, 1000 * k, (250, 120), 1)]
    want = plain_near_classes(rows)
    assert sorted(sum(n for _, n in c) for c in want) == [373] * 4
    assert classes_of(near_duplicates.classes(documents(rows))) == want


def test_linked_nodes_still_meet_the_other_parts_of_their_buckets(spark):
    # b is linked to a in bucket 1; bucket 2 holds b beside c, bucket 3 one part only
    rows = [(1, b"a", b"a"), (1, b"b", b"a"), (2, b"b", b"a"), (2, b"c", b"c"), (2, b"d", b"c"), (3, b"c", b"c"), (3, b"d", b"c")]
    members = spark.createDataFrame(rows, "bucket long, node binary, part binary").selectExpr("*", "0 AS alone", "0 AS side")
    grouped = near_duplicates.several_parts(members)
    assert sorted((r["bucket"], bytes(r["node"])) for r in grouped.collect()) == [(2, b"b"), (2, b"c"), (2, b"d")]
    heads = near_duplicates.bucket_heads(grouped, 1).collect()
    assert {bytes(r["part"]) for r in heads} == {b"a", b"c"} and b"b" in {bytes(r["node"]) for r in heads}


def test_sides_of_a_bucket(spark):
    rows = [(1, b"a", 1), (1, b"b", 1), (2, b"a", 1), (2, b"b", 2), (3, b"a", 0), (3, b"b", 0)]
    members = spark.createDataFrame(rows, "bucket long, node binary, side int").selectExpr("*", "node AS part", "0 AS alone")
    assert {r["bucket"] for r in near_duplicates.several_parts(members).collect()} == {2, 3}


def test_rare_buckets_hold_every_link(spark):
    r = random.Random(13)
    sets = []
    for _ in range(6):
        base = r.sample(range(1, 10**9), r.choice([5, 40, 150]))
        for _ in range(40):
            own = r.sample(base, len(base) - r.randrange(1 + len(base) // 4))
            sets.append(set(own) | {r.randrange(10**9) for _ in range(r.randrange(1 + len(base) // 5))})
    key = lambda i: f"{i:03d}".encode()
    table = spark.createDataFrame([(key(i), sorted(s)) for i, s in enumerate(sets)], "node binary, cells array<long>")
    nodes = table.selectExpr("node", "node AS part")
    for threshold in (0.8, 0.55):
        links = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) >= threshold * len(a | b)}
        buckets = defaultdict(list)
        for row in near_duplicates.rare_buckets(nodes, table, threshold).collect():
            buckets[row["bucket"]].append((int(bytes(row["node"])), row["side"]))
        met = {tuple(sorted((i, j))) for own in buckets.values() for i, a in own for j, b in own if i < j and (a == 0 or a != b)}
        assert len(links) > 100 and links <= met


@pytest.mark.parametrize("words", [30, 400])
def test_compared_pairs_grow_with_the_family(spark, documents, monkeypatch, words):
    """A family whose members are 0.7 to 0.85 similar, some of them far from all: pairs in proportion, no link lost."""
    compared = []
    plain = near_duplicates.similar

    def similar(pairs, *others):
        compared[-1] += pairs.count()
        return plain(pairs, *others)

    monkeypatch.setattr(near_duplicates, "similar", similar)
    r = random.Random(14)
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    rows = [(i, varied(r, base, 1 + r.randrange(max(1, words // 30)))) for i in range(800)]
    for n in (200, 400, 800):
        compared.append(0)
        assert classes_of(near_duplicates.classes(documents(rows[:n]))) == plain_near_classes(rows[:n])
        assert compared[-1] < 40 * n
    assert compared[2] < 6 * compared[0] + 1000


def test_near_copies_leave(documents):
    text = " ".join(map(str, range(50)))
    rows = [(4, text + " end"), (2, text), (2, text), (7, "other words stand here, quite alone"), (8, None), (9, ""), (1, text.upper())]
    df = documents(rows)
    left = near_duplicates.without_near_copies(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 7, 8, 9]
    assert near_duplicates.classes(documents([])).count() == 0
    assert near_duplicates.without_near_copies(documents([])).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**62, 300).astype(np.uint64)
    a, b = rng.random(300), rng.random(300)
    b[:150] = a[:150]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 6000
    owner = np.repeat([0, 1], 300)
    made = near_duplicates.signatures(np.r_[elements, elements], owner, 2, k, np.r_[a, b])
    assert abs((made[0] == made[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)
    # the same signatures whatever else is in the batch
    alone = near_duplicates.signatures(elements, np.zeros(300, np.int64), 1, k, b)
    assert (alone[0] == made[1]).all()


def test_counted_shingles_are_the_weighted_similarity():
    hashes = near_duplicates.WordHashes()
    one, two = b"a b a b a b".split(), b"a b a b".split()
    sets = [set(near_duplicates.shingles(hashes(w), 2, True).tolist()) for w in (one, two)]
    assert len(sets[0]) == 5 and len(sets[1]) == 3 and len(sets[0] & sets[1]) == 3
    assert len(near_duplicates.shingles(hashes(one), 2, False)) == 2


def test_components_of_a_long_chain(spark):
    key = lambda i: f"{i:04d}".encode()
    links = [(key(i), key(i + 1)) for i in range(60)] + [(key(200), key(100)), (key(150), key(200))]
    random.Random(1).shuffle(links)
    found = near_duplicates.components(spark.createDataFrame(links, "node binary, first binary"))
    got = {bytes(r["node"]): bytes(r["root"]) for r in found.collect()}
    assert got == {key(i): key(0) for i in range(1, 61)} | {key(150): key(100), key(200): key(100)}


# language models


def plain_kneser_ney(words, order, context, symbol):
    """Modified Kneser-Ney by dictionaries, from the definition."""
    table = kneser_ney.symbol_table()
    grams = Counter()
    for w in words:
        s = [0] * (order - 1) + [int(table[ord(c)]) for c in w.decode()] + [0]
        for i in range(order - 1, len(s)):
            grams[tuple(s[i - order + 1 : i + 1])] += 1
    p = 1 / kneser_ney.SYMBOLS
    levels = [grams]
    for k in range(order, 1, -1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    for k, own in enumerate(reversed(levels), 1):
        d = kneser_ney.discounts(np.array(list(own.values())))
        c = tuple(context[len(context) - k + 1 :])
        following = {g[-1]: n for g, n in own.items() if g[:-1] == c}
        if following:
            total = sum(following.values())
            free = sum(d[min(n, 3)] for n in following.values()) / total
            n = following.get(symbol, 0)
            p = (n - d[min(n, 3)]) / total + free * p if n else free * p
    return p


def test_kneser_ney_against_the_definition():
    r = random.Random(3)
    words = ["".join(r.choices("abcde'", k=r.randint(1, 6))).encode() for _ in range(400)]
    codes, counts = kneser_ney.gram_counts(Counter(words), 4)
    model = kneser_ney.Model.of(codes, counts, 4)
    for _ in range(300):
        context, symbol = [r.choice([0, 1, 2, 3, 5, 9]) for _ in range(3)], r.choice([0, 1, 2, 4, 28, 30])
        code = np.array([context[0] << 15 | context[1] << 10 | context[2] << 5 | symbol], np.uint64)
        assert model.probabilities(code)[0] == pytest.approx(plain_kneser_ney(words, 4, context, symbol), rel=1e-5)
    every = (codes[:40, None] >> np.uint64(5) << np.uint64(5)) | np.arange(32, dtype=np.uint64)
    assert np.allclose([model.probabilities(row).sum() for row in every], 1, atol=1e-6)


def plain_base(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + j for own in windows.values() if len(own) > 1 for i in own for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.sub("", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


def test_base_rules(spark, documents):
    odd = [None, "", "a b c a b c", "a a a a", "x\ny\nx\n \n \nx ", "#1 <b> é\xa0ü\x85", "\x1c \x0b", "w " * 90, "d " * 3 + "e"]
    odd += [" ".join(random.Random(i).choices("abcdefgh", k=120)) for i in range(30)]
    rows = list(enumerate(odd))
    got = by_id(perplexity.judged(documents(rows)))
    assert {i: tuple(r)[1:7] for i, r in got.items()} == {i: plain_base(t) for i, t in rows}
    assert all(r["perplexity"] is None and not r["kept"] for i, r in got.items() if not plain_base(odd[i])[0])
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    table = by_id(perplexity.judged(df))
    assert all(tuple(table[r["doc_id"]])[1:7] == plain_base(r["text"]) for r in df.collect())
    assert perplexity.judged(documents([])).count() == 0


def test_perplexity_against_a_model_built_at_once(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = df.collect()
    own = defaultdict(Counter)
    for r in rows:
        own[r["lang"]].update(r["text"].encode().split())
    models = {lang: kneser_ney.Model.of(*kneser_ney.gram_counts(words, 4), 4) for lang, words in own.items()}
    got = by_id(perplexity.judged(df))
    for r in rows:
        words = r["text"].encode().split()
        total = models[r["lang"]].log_words(words).sum()
        want = math.exp(-total / sum(len(w.decode()) + 1 for w in words))
        assert got[r["doc_id"]]["perplexity"] == pytest.approx(want, rel=1e-9)


def test_perplexity_bands_keep_clean_documents(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = perplexity.judged(df).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert np.mean(good) > 0.99
    noise = [(i, "".join(chr(33 + (i * 7 + j * j) % 94) + " " * (j % 5 == 0) for j in range(600)), None) for i in range(10_000, 10_003)]
    extra = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in noise], df.schema)
    judged = by_id(perplexity.judged(df.unionByName(extra)))
    assert not any(judged[i]["kept"] for i, _, _ in noise)


def plain_character_model(words, order):
    """Probability of each n-gram over characters as they are, by dictionaries, from the definition."""
    grams = Counter()
    for w, n in words.items():
        s = ["end"] * (order - 1) + list(w) + ["end"]
        for i in range(order - 1, len(s)):
            grams[tuple(s[i - order + 1 : i + 1])] += n
    levels = [grams]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    below = {(): 1 / (0x110000 + 1)}
    for own in reversed(levels):
        d = kneser_ney.discounts(np.array(list(own.values())))
        total, free = Counter(), Counter()
        for g, n in own.items():
            total[g[:-1]] += n
            free[g[:-1]] += d[min(n, 3)]
        below = {g: (n - d[min(n, 3)] + free[g[:-1]] * below[g[1:]]) / total[g[:-1]] for g, n in own.items()}
    return below


@pytest.mark.parametrize("most", [perplexity.BLOCK_BYTES, 300])
def test_perplexity_over_characters_as_they_are(spark, documents, monkeypatch, most):
    """Characters that fold to one symbol are told apart, in one block and in many; a zero character is one too."""
    monkeypatch.setattr(perplexity.blocked, "__defaults__", (most,))
    r = random.Random(5)
    alphabets = ["abcdeABCDE", "\u4e00\u4e1a\u4e34\u4e4e", "0123456789", "a\x00é\U0001f600"]
    rows = [(i, " ".join("".join(r.choices(alphabets[i % 4], k=r.randint(1, 6))) for _ in range(60))) for i in range(40)]
    rows += [(40, None), (41, " "), (7, rows[7][1])]
    own = Counter(w for _, t in rows for w in (t or "").split())
    model = plain_character_model(own, 4)
    got = perplexity.judged(documents(rows), languages=(), folded=False).collect()
    assert len(got) == len(rows) and sum(x["doc_id"] == 7 for x in got) == 2
    texts = dict(rows)
    for x in got:
        words = (texts[x["doc_id"]] or "").split()
        assert tuple(x)[1:7] == plain_base(texts[x["doc_id"]])
        if not words:
            assert x["perplexity"] is None
            continue
        grams = [tuple((["end"] * 3 + list(w) + ["end"])[i : i + 4]) for w in words for i in range(len(w) + 1)]
        assert x["perplexity"] == pytest.approx(math.exp(-sum(math.log(model[g]) for g in grams) / len(grams)), rel=1e-9)
    assert perplexity.judged(documents([]), folded=False).count() == 0
    assert perplexity.judged(documents([(1, None)]), folded=False).count() == 1


def test_perplexity_blocks_hold_texts_in_little_room():
    """A block's documents come back as they were, and take an eighth less than zstd makes of them."""
    r = random.Random(21)
    words = ["".join(r.choice(["th", "er", "an", "on", "in", "at", "re", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(800)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(900)] + [None, ""]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    held = perplexity.block_row("en", 0, rows, 4).column("documents")[0].as_py()
    assert pa.ipc.open_stream(bz2.decompress(held)).read_all().to_pydict() == rows.to_pydict()
    raw = "".join(t or "" for t in texts).encode()
    assert len(held) < 0.875 * len(pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True))


def test_foreign_characters_are_told_apart(spark, documents):
    """Folded, both alphabets give the same symbols; as they are, the rare one stands out."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = [(i, " ".join(r.choices(words, k=80))) for i in range(200)]
    other = str.maketrans({c: next(chr(p) for p in range(0x4E00, 0x4F00) if 1 + p % 26 == 1 + i) for i, c in enumerate("abcdefgh")})
    rows.append((200, rows[0][1].translate(other)))
    folded, plain = (by_id(perplexity.judged(documents(rows), folded=f)) for f in (True, False))
    assert folded[200]["perplexity"] == pytest.approx(folded[0]["perplexity"])
    assert plain[200]["perplexity"] > 1.2 * plain[0]["perplexity"]


def test_bands_over_characters_as_they_are(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = perplexity.judged(df, folded=False).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.99


def test_toxicity_on_held_out_rows(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = toxicity.scored(df, toxicity.fitted(df, labels)).join(labels, "doc_id").where("held_out").collect()
    hits = [(r["predicted"], r["toxic"]) for r in rows]
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    caught = sum(p for p, t in hits if t) / sum(t for _, t in hits)
    wrong = sum(p for p, t in hits if not t) / sum(1 - t for _, t in hits)
    assert caught > 0.7 and wrong < 0.02


def test_toxicity_edges(spark, documents):
    df = documents([(i, f"nice words number {i} here") for i in range(40)] + [(40 + i, f"you awful fool {i}") for i in range(40)] + [(90, None), (91, ""), (None, "fool " * 30_000), (1, "again")])
    labels = spark.createDataFrame([(i, int(40 <= i < 80)) for i in range(80)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fitted(df, labels)
    got = toxicity.scored(df, model).collect()
    assert len(got) == 84 and all(0 <= r["score"] <= 1 for r in got)
    scores = defaultdict(list)
    for r in got:
        scores[r["doc_id"]].append(r["score"])
    assert min(scores[i][0] for i in range(40, 80)) > max(scores[i][0] for i in range(2, 40))
    left = toxicity.without_toxic(df, labels)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    nothing = labels.where("toxic = 0")
    assert {r["score"] for r in toxicity.scored(df, toxicity.fitted(df, nothing)).collect()} == {0.0}
    assert toxicity.scored(documents([]), toxicity.fitted(documents([]), labels)).count() == 0


def test_rare_toxic_labels_are_learned_from(spark, documents):
    r = random.Random(12)
    say = lambda words: " ".join(r.choices(words, k=12))
    rows = [(i, say(["nice", "calm", "word", "number", "here", "table", "green", "apple"])) for i in range(6000)]
    rows += [(6000 + i, say(["awful", "fool", "stupid", "idiot", "you"])) for i in range(60)]
    df = documents(rows)
    labels = spark.createDataFrame([(i, int(i >= 6000)) for i, _ in rows], "doc_id long, toxic int")
    ids, classes, rarer = toxicity.sample(labels, "doc_id", "toxic", 0, 50)
    toxic = [i for i in range(6000, 6060) if zlib.crc32(str(i).encode()) % 3 == 0]
    ordinary = sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(6000))
    assert ids[classes == 1].tolist() == toxic and (classes == 0).sum() == 50
    assert rarer == pytest.approx(math.log(ordinary / 50))
    scores = by_id(toxicity.scored(df, toxicity.fitted(df, labels, model_rows=50, fit_rows=50)))
    assert min(scores[i]["score"] for i in range(6000, 6060)) > max(scores[i]["score"] for i in range(6000))
    assert np.mean([scores[i]["predicted"] for i in range(6000, 6060)]) > 0.7


def test_held_out_rows_do_not_matter(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    one, two = (by_id(toxicity.scored(df, toxicity.fitted(df, own))) for own in (labels, turned))
    assert one == two


# mixing


def plain_targets(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    sizes = Counter()
    for source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def check_mix(rows, df):
    got = mixing.mixture(mixing.sizes_of(df)).collect()
    sizes = [(r["source"], r["size"]) for r in got]
    want = plain_targets(sizes)
    taken, own, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        own[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(r["source_size"] == own[r["source"]] for r in got)
    for s in want:
        assert abs(taken[s] - want[s]) <= 1.5 * largest[s]
    # the rates meet the targets exactly, and tilt with size
    rated = Counter()
    for r in got:
        rated[r["source"]] += r["rate"] * r["size"]
    assert all(rated[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6) for s in want)
    again = mixing.mixture(mixing.sizes_of(df.repartition(5))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return got


def test_mix_of_odd_sources(documents):
    r = random.Random(6)
    rows = [(i, "w " * r.choice([0, 1, 5, 30, 200]), r.choice(["b", "a", "ä", "Z", None, "big", "big", "big"])) for i in range(900)]
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, "x " * 50_000, "huge"), (2003, "one", None), (1, "w w", "a"), (1, "w w", "a")]
    got = check_mix(rows, documents(rows))
    assert len(got) == len(rows)
    assert mixing.mixture(mixing.sizes_of(documents([]))).count() == 0


def test_mix_of_the_test_table(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    check_mix(None, df)


def test_mixed_rows(documents):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(200)] + [(7, "same id", "a"), (7, "same id", "a")]
    df = documents(rows)
    copies = Counter()
    for r in mixing.mixture(mixing.sizes_of(df)).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert mixing.mixed(documents([])).count() == 0


def test_mix_shuffles_texts_once(spark, documents):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(200)]
    rows += [(7, f"same id {i}", "a") for i in range(40)] + [(8, f"no source {i}", None) for i in range(30)]
    rows += [(None, f"no id {i}", s) for i in range(20) for s in ("a", "", None)]
    df = documents(rows)
    size = lambda text: len(text.split())
    copies = Counter()
    for r in mixing.mixture(mixing.sizes_of(df)).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = mixing.mixed(df)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = out.collect()
        nodes, shuffles = [out._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            columns = [node.output().apply(i).name() for i in range(node.output().size())]
            # the given table is repartitioned and has a row of its own
            shuffles += node.nodeName() == "Exchange" and "row" in columns and "text" not in columns
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert shuffles == 1
    assert Counter((r["doc_id"], r["source"], size(r["text"])) for r in got) == Counter({k: n for k, n in copies.items() if n})
    # of rows that share id, source and size none is taken two times more often than another
    taken = Counter((r["doc_id"], r["source"], r["text"]) for r in got)
    alike = Counter((i, source, size(text)) for i, text, source in rows)
    for i, text, source in rows:
        n, of = copies[i, source, size(text)], alike[i, source, size(text)]
        assert taken[i, source, text] in (n // of, -(-n // of))
