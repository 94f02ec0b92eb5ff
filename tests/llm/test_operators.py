"""Each operator against a plain version, and on awkward tables: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import random
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, common, components, exact_dedup, html_text, knn, language_id, near_dedup, packing, pretokens, quality, queries, suffix_dedup, token_files, token_ids
from tessera.llm.common import Workspace, load

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards mix potions at midnight near an old stone bridge"
TEXTS = [
    (5, "Hello  world,\n it's 42 degrees here  ", "en"),
    (1, None, None),
    (2, "", "en"),
    (3, " \t\n", "fr"),
    (4, "a" * 3000, "en"),
    (6, PASSAGE + " and one ending", "en"),
    (7, "Another start. " + PASSAGE + " with much else", "en"),
    (8, PASSAGE + " and one ending", "en"),
    (9, PASSAGE + "  and one ending", "en"),
    (10, "été ça où œuvre naïve   déjà-vu \U0001f600\U0001f468‍\U0001f469 \x1c\x00 end", "fr"),
    (11, "ααα βββ " * 50, None),
    (11, "ααα βββ " * 50, None),
    (12, "<|endoftext|> 日本語テキスト ²½ Ⅷ ＡＢ", "ja"),
    (None, "no id here at all, my friend", "en"),
    (None, None, "en"),
    (13, "12 34 56 !!! ??? ...", "en"),
]
LONG = (14, " ".join(random.Random(3).choice(["lorem", "ipsum", "dolor", "x1", "été"]) for _ in range(30000)), "en")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "k", 1, "d", "n", 2, "l", "s") for i, t, lang in [*TEXTS, LONG]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, id int, data string, node string, n int, label string, digest string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def ranks():
    with open(queries.MULTI, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def reference_ids(texts):
    t = Tokenizer.from_file(queries.JSON_50K)
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_bpe(odd, none):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = bpe.encode(odd, queries.MULTI, queries.PATTERN)
    want = []
    for i, t, _ in [*TEXTS, LONG]:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == plain(want)
    back = bpe.decode(got, queries.MULTI, queries.PATTERN).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((i, t or "") for i, t, _ in [*TEXTS, LONG])
    assert bpe.encode(none, queries.MULTI, queries.PATTERN).count() == 0


def test_chunks_agree_with_the_pattern():
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(5)
    parts = ["a", "'s", " ", "  ", "\n", " ", " ", "1", ".", "é", "\x1c", "\x85", "日", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        cut = pretokens.chunks(text)
        assert [t for i, c in enumerate(cut) for t in find(" " * (i > 0) + c)] == find(text), repr(text)


def test_batch_encoder():
    """Against the library at its defaults: odd white space, added tokens, batches of any size."""
    rng = random.Random(1)
    parts = ["a", "'s", " ", "  ", "\n", " ", " ", "1", ".", "é", "\x1c", "\x85", "日", "²", "<|endoftext|>", "\t", "\r\n", "word", "the", "\u3000", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "\n", "\n\n", " ", "a\n", "a\n\nb", None]
    encode = token_ids.BatchEncoder(queries.JSON_50K, 2, most=500, at_once=50)
    want = reference_ids(texts)
    for step in (1, 7, 900):
        for i in range(0, len(texts), step):
            ids, begin = encode(pa.array(texts[i : i + step], pa.string()))
            assert len(ids) == begin[-1]
            for j, w in enumerate(want[i : i + step]):
                assert (ids[begin[j] : begin[j + 1]] == w).all() and begin[j + 1] - begin[j] == len(w), texts[i + j]
    assert encode.ranked is not None
    words = " ".join("".join(rng.choice("abcdefghißéжλ'.,-1") for _ in range(rng.randint(1, 25))) for _ in range(20000))
    slow = token_ids.BatchEncoder(queries.JSON_50K, 2)
    slow.ranked = None
    assert (encode(pa.array([words]))[0] == reference_ids([words])[0]).all() and (slow(pa.array([words]))[0] == reference_ids([words])[0]).all()
    bad = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 3], "<i4").tobytes()), pa.py_buffer(b"a\xffb")])
    assert encode(bad)[0].tolist() == reference_ids(["a\ufffdb"])[0].tolist()


def test_token_files(spark, odd, none):
    got = [tuple(r) for r in token_files.token_table(odd, queries.JSON_50K).orderBy("start").collect()]
    rows = [*TEXTS, LONG]
    ids = reference_ids([t for _, t, _ in rows])
    marks = [r[0] for r in spark.createDataFrame([(k, t or "") for k, (_, t, _) in enumerate(rows)], "k int, t string").orderBy("k").select(F.xxhash64("t")).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, marks[k]))
    at, want = 0, []
    for k in order:
        want.append((rows[k][0], at, len(ids[k]), zlib.crc32(ids[k].tobytes())))
        at += len(ids[k])
    assert got == want
    assert token_files.token_table(none, queries.JSON_50K).count() == 0


def test_token_files_in_small_shards(spark):
    docs = spark.range(300).select((F.lit(299) - F.col("id")).alias("doc_id"), F.expr("repeat(concat('word', id, ' '), cast(id % 40 as int))").alias("text")).repartition(4)
    path = Workspace(spark).path("shards")
    token_files.write_tokens(docs, path, queries.JSON_50K, shard_ids=500)
    got = token_files.read_tokens(spark, path, with_ids=True).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = 0
    for r, ids in zip(got, reference_ids([texts[i] for i in range(300)]), strict=True):
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (at, len(ids), ids.tolist())
        at += len(ids)
    assert spark.read.parquet(path).count() > 10


def test_shards_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 7, 50257, 2**31):
            ids = np.where(rng.random(n) < 0.05, top - 1, rng.integers(0, max(1, top // 300) + 1, n))
            lengths = np.array([n // 3, n - n // 3])
            s = token_files.Shard(token_files.write_shard(ids, np.array([1, 2]), lengths, 9))
            assert (s.read() == ids).all() and s.before == 9 and s.lengths.tolist() == lengths.tolist()
            for lo, hi in ((0, 10), (n // 2, n), (300, 301)):
                assert (s.read(lo, hi) == ids[lo:hi]).all()


def test_packing(odd, none):
    rows = [*TEXTS, LONG]
    ids = collections.defaultdict(list)
    for (i, _, _), x in zip(rows, reference_ids([t for _, t, _ in rows]), strict=True):
        ids[i].append(x)
    got = packing.pack(odd, queries.JSON_50K).collect()
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r["length"] for r in got) == total
    for r in got:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert r["length"] == 1024 or r["piece"] == 0
    full = collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(full) <= -(-total // 1024) + 1
    assert packing.pack(none, queries.JSON_50K).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        counts = collections.Counter(rng.randint(1, 20) for _ in range(rng.randint(0, 60)))
        placed = packing.plan(counts, 20)
        seen, fill = collections.Counter(), collections.defaultdict(list)
        for length, rank, count, first, offset in placed:
            assert rank == seen[length]
            seen[length] += count
            for s in range(first, first + count):
                fill[s].append((offset, length))
        assert seen == counts
        for own in fill.values():
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 20
        assert len(fill) <= 1.25 * -(-sum(k * v for k, v in counts.items()) // 20) + 3


def test_exact_dedup(odd, none):
    rows = [*TEXTS, LONG]
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        key = (t or "").translate(dict.fromkeys(b" \t\n\x0b\x0c\r"))
        groups[key].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for key, own in groups.items():
        keep = min(own)[3]
        want += [(x[3], keep, len(own), x[3] == keep, hashlib.sha256(key.encode()).hexdigest()) for x in own]
    assert plain(map(tuple, exact_dedup.exact_groups(odd).collect())) == plain(want)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_runs_merge_without_sorting_again():
    rng = np.random.default_rng(5)
    for _ in range(50):
        runs, every = [], []
        for _ in range(rng.integers(0, 6)):
            r = np.zeros(rng.integers(0, 40), exact_dedup.RECORD)
            r["d"] = rng.integers(0, 3, (len(r), 4))
            r["n"], r["id"], r["c"] = rng.integers(0, 3, len(r)), rng.integers(0, 9, len(r)), 1
            every += [(tuple(d), -n, i) for d, n, i in zip(r["d"].tolist(), r["n"].tolist(), r["id"].tolist(), strict=True)]
            runs.append(exact_dedup.sort_run(r))
        got = exact_dedup.merge(runs)
        want = {}
        for d, n, i in sorted(every, reverse=True):
            want[d] = (n, i, want.get(d, (0, 0, 0))[2] + 1)
        assert [(tuple(r["d"].tolist()), -r["n"], r["id"], r["c"]) for r in got] == [(d, *want[d]) for d in sorted(want)]


def test_exact_dedup_large_groups(odd):
    assert plain(map(tuple, exact_dedup.exact_groups(odd, heavy=4).collect())) == plain(map(tuple, exact_dedup.exact_groups(odd).collect()))


def test_exact_dedup_rounds(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise((F.col("id") % 700).cast("string")).alias("text")).repartition(7)
    for radix, rounds in ((2, 3), (4, 2), (16, 1)):
        best = exact_dedup.best_ids(exact_dedup.digests(many), radix, rounds, run_rows=100)
        assert best.count() == many.select("text").distinct().count()
        assert best.agg(F.sum("group_size")).collect()[0][0] == 3000


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        n, letters = rng.randint(1, 60), rng.choice([b"ab", b"abc", b"a", bytes([0, 1, 255])])
        text = bytes(rng.choice(letters) for _ in range(n))
        order = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda p: text[p:])
        wanted = np.array([rng.random() < 0.3 for _ in range(n)])
        some = suffix_dedup.suffix_array(text, 8, wanted)
        some = some[wanted[some]]
        assert [text[p : p + 8] for p in some] == sorted(text[p : p + 8] for p in np.flatnonzero(wanted)) or 0 in text


@pytest.mark.parametrize("more", [{}, {"hot_contexts": 3, "group_bytes": 2000, "hold": 500}])
def test_suffix_dedup(odd, none, more):
    rows = [(i, (t or "").encode()) for i, t, _ in [*TEXTS, LONG] if i is not None]
    want = suffix_dedup.brute_force(rows)
    got = suffix_dedup.remove_repeats(odd.where("doc_id is not null"), with_text=True, **more).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.remove_repeats(odd).count() == len(TEXTS) + 1
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.cut(odd).columns == odd.columns and suffix_dedup.cut(none).count() == 0


def test_suffix_dedup_with_shared_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            parts.append(s[rng.randint(0, 20) :] if rng.random() < 0.5 else s)
            parts.append(" ".join(word() for _ in range(rng.randint(0, 8))))
        rows.append((i, rng.choice(["\n", " "]).join(parts)))
    rows += [(150 + i, rows[i % 3][1]) for i in range(9)]  # exact copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = suffix_dedup.brute_force([(i, t.encode()) for i, t in rows])
    for more in ({}, {"hot_contexts": 5, "group_bytes": 3000}, {"hot_contexts": 3, "group_bytes": 300_000, "hold": 1000}):
        assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, **more).collect()} == want
    left = {r["doc_id"]: r["text"].encode() for r in suffix_dedup.cut(docs).collect()}
    assert {i: hashlib.sha256(t).hexdigest() for i, t in left.items()} == {i: w[3] for i, w in want.items() if i in left}
    assert all(want[i][1] and want[i][0] - want[i][1] < 50 for i, _ in rows if i not in left)


def test_cut_gives_every_row_its_own_text(spark):
    """Rows that share an id, or have none, and have the same length."""
    tail = PASSAGE + " tail one AAAA"
    other = "unrelated words".ljust(len(tail), "q")
    lost = "something else".ljust(len(tail), "z")
    rows = [(1, PASSAGE, "a", None), (2, tail, "b", 1.5), (2, other, "c", 2.5), (None, tail, None, 3.0), (None, lost, "d", 4.0), (None, None, "e", 5.0), (9, tail, "f", None)]
    got = suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string, key string, `a.b` double").repartition(3)).collect()
    assert plain(map(tuple, got)) == plain([rows[0], (2, " tail one AAAA", "b", 1.5), rows[2], rows[4], (None, "", "e", 5.0)])


def test_workspace_leaves_nothing_it_has_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_path", lambda _, tag: f"file://{tmp_path}/{tag}-{len(list(tmp_path.iterdir()))}-{random.random()}")
    with Workspace.recorded(spark):
        docs = spark.createDataFrame([(i, PASSAGE + f" {i % 7} " + "x" * i) for i in range(40)], "doc_id long, text string")
        n = near_dedup.drop_near(suffix_dedup.cut(docs)).count()
        assert n and list(tmp_path.iterdir())
    Workspace.finish(spark)
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]


def near_by_hand(rows, least=0.8):
    sets = {}
    for i, t in rows:
        h, who, n = near_dedup.counted(*near_dedup.shingles([t or ""])[:2])
        sets[i] = (h, n)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a][0]) and near_dedup.similarity(sets[a], sets[b]) >= least:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


def test_near_dedup(spark, sf, odd, none):
    rows = [(i, t) for i, t, _ in [*TEXTS, LONG] if i is not None]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(odd.where("doc_id is not null")).collect()}
    assert got == near_by_hand(rows)
    assert near_dedup.near_groups(odd).count() == len(TEXTS) + 1
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.drop_near(odd).columns == odd.columns
    docs = load(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in queries.op3_near_dedup(spark, sf).collect()} == near_by_hand(rows)


def test_near_dedup_chains_and_blocks(spark):
    """Chains A-B-C in which A and C are no link, in numbers, with small blocks."""
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        for step in range(8):
            words = words[:]
            words[20 * step : 20 * step + 4] = [f"v{rng.randint(0, 10**6)}" for _ in range(4)]
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs, block=3).collect()} == near_by_hand(rows)


def test_near_dedup_second_look_knows_shared_bands_by_their_whole_hash(spark):
    """A link met only in the second look, in whose signatures 8 bits of each dart agree in a band before the first shared one."""
    rng = random.Random(347)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base, docs = [word() for _ in range(150)], []
    for _ in range(13):
        words = base[:]
        for at in rng.sample(range(0, 150, 5), 3):
            words[at] = word()
        docs.append(" ".join(words))
    rows = [*enumerate(docs[1:]), (12, " ".join(base)), (13, docs[0])]
    h, who, n = near_dedup.counted(*near_dedup.shingles([t for _, t in rows])[:2])
    sig, _ = near_dedup.dart_signatures(h, n.astype(float), who, len(rows))
    bits = (near_dedup.mix(sig) >> np.uint64(56)).astype(np.uint8)
    real, chance = ((x[12] == x[13]).reshape(near_dedup.BANDS, near_dedup.ROWS).all(axis=1) for x in (sig, bits))
    assert real.any() and chance.argmax() < real.argmax()
    want = near_by_hand(rows)
    assert want[13] == want[12] == 0
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_dedup_keeps_texts_of_one_id_apart(spark):
    """Null ids and ids on several texts: every text is judged for itself, in both drops."""
    rng = random.Random(12)
    a, b, c, d, e = ([f"w{rng.randint(0, 10**6)}" for _ in range(120)] for _ in range(5))
    near = lambda words: " ".join([*words[:-2], "other", "end"])
    good = [(1, " ".join(a)), (7, " ".join(b)), (None, " ".join(c)), (None, " ".join(d)), (8, " ".join(e)), (None, "")]
    copies = [(7, near(a)), (None, near(b)), (None, near(c)), (None, near(e)), (9, near(b))]
    docs = spark.createDataFrame([*good, *copies], "doc_id long, text string").repartition(3)
    left = collections.Counter(map(tuple, near_dedup.drop_near(docs).collect()))
    # of the two near texts without an id either one may stand for the class
    assert sum(left.values()) == len(good) and left[None, " ".join(c)] + left[None, near(c)] == 1
    assert all(left[r] == 1 for r in good if r != (None, " ".join(c)))
    same = [(7, " ".join(a) + " "), (1, " ".join(a) + "  "), (None, " ".join(b)), (None, " ".join(e))]
    docs = spark.createDataFrame([*good, *same], "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, exact_dedup.drop_copies(docs).collect())) == collections.Counter([*good[1:], same[1], good[0]])


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = rng.random(400) * 5 + 0.01, rng.random(400) * 5 + 0.01
    sig, has = near_dedup.dart_signatures(np.append(e, e), np.append(a, b), np.repeat([0, 1], 400), 3)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.15 and has.tolist() == [True, True, False]


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000, x) for x in range(1001, 1100)] + [(x, x + 1) for x in range(2000, 2040)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}


def test_top_k(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(queries.OP2_SQL).fetchall())
    assert sorted(map(tuple, queries.op2_top_k(spark, sf).collect())) == want


def test_top_k_with_odd_rows(spark):
    rng = random.Random(7)
    odd_ones = [(200, None, 0), (201, [1.0, None, 0.0], 0), (202, [1.0, float("nan"), 0.0], 0), (203, [float("inf"), 0.0, 0.0], 0), (204, [1.0], 0), (205, [], 0), (None, [1.0, 1.0, 1.0], 0)]
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], i) for i in range(200)] + odd_ones

    def check(rows, **more):
        data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int").repartition(4)
        low, high = -(2**63), 2**63 - 1
        good = [(i, [max(low, min(high, math.floor(64 * x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        want = []
        for q, v in good:
            if q % 20 == 0:
                best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, w in good if i != q)[:20]
                want += [(q, r + 1, i, max(low, min(high, -s))) for r, (s, i) in enumerate(best)]
        assert sorted(map(tuple, knn.top_k(data, data.where("vec_id % 20 = 0"), **more).collect())) == sorted(want)
        return data

    data = check(rows)
    check(rows, pivots=3, block=2, slice_rows=50)
    for big in (1e3, 1e8, 1e25):  # components and scores of 32, 64 and more bits
        check([*rows, *((300 + i, [rng.uniform(-big, big) for _ in range(3)], 0) for i in range(30))])
    assert knn.top_k(data.where("vec_id < 3"), data.where("vec_id < 3")).count() == 6
    assert knn.top_k(data.where("false"), data).count() == 0
    assert knn.top_k(data, data.where("false")).count() == 0


def test_query_blocks_hold_every_cell():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 40)
    base, split, blocks = knn._plan_blocks(rng.random((40, 5)), counts.tolist(), 30)
    fill = np.zeros(blocks)
    for c, b, s in zip(counts, base, split, strict=True):
        fill[b : b + int(s)] += c / s
    assert fill.sum() == counts.sum() and (fill <= 30).all() and blocks <= 2 * counts.sum() / 30 + 2


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a><h1>Site</h1></header>
    <div class="cookie-notice">We use cookies. Accept them, please.</div><nav>a b c</nav><main><article class="post"><header><h1>Title &amp; more</h1></header>
    <p>First para <b>bold</b> text, long enough. Yes.</p><p>Short.<script>var x="</p>";</script><ul><li>one thing</li></ul><div class="ad">Buy now, great offers. Really.</div>
    <form><p>Enter your email, subscribe.</p></form><p>Last&nbsp; one.<section class="comments"><p>Great article, really, thanks.</p></section></article></main>
    <aside>Related: x y z.</aside><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst para bold text, long enough. Yes.\nShort.\none thing\nLast one."
    assert html_text.main_text("") == ""


def test_html_scan_keeps_what_is_no_menu():
    text = html_text.main_text
    assert text("<p>We know <math><mi>x</mi>=<mn>2</mn></math> holds here, and <my-tag>more</my-tag> so. Then it is fine.</p>") == "We know x=2 holds here, and more so. Then it is fine."
    assert text('<p>Before it, some words. <svg><title>no</title><text>no</text></svg>After it, more words, too.</p>') == "Before it, some words. After it, more words, too."
    review = ["This film is a slow, quiet one. It says what it has to say, well.", "We liked it, all in all, and would see it again."]
    assert text(f'<div class="review"><p>{review[0]}</p><p>{review[1]}</p></div>') == "\n".join(review)
    assert text("<article><p>Some text, cut off.</p><img " + " ".join(f'a{i}="v"' for i in range(60))) == "Some text, cut off."
    assert text("<p>One &lt; two, &amp; so on.</p><p>x <y and z, then</p><p>more of it.") .startswith("One < two, & so on.\nx")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x, yes.", "<b>" * 100_000 + "<p>x</p>" * 1000, "<h1>" * 100_000, "<ul><li>" * 50_000, "</p>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<head><body>" * 30_000, "<table><tr><td>" * 30_000, '<a href="x">y ' * 50_000, '<a ' + '" ' * 50_001, "<p>a, b.</p>" * 30_000],
)
def test_html_time_grows_with_length(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10  # quadratic scans take minutes


def by_levels(page):
    """Blocks and their open elements by the standard library's parser, for well-formed pages."""
    out, stack, held = [], [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCKS:
                flush()
            if tag not in html_text.VOID:
                stack.append(tag)
            elif tag == "br":
                held.append(" ")

        def handle_endtag(self, tag):
            if tag in html_text.BLOCKS:
                flush()
            if tag in stack:
                del stack[len(stack) - 1 - stack[::-1].index(tag) :]

        def handle_data(self, data):
            if not set(stack) & html_text.DROPPED:
                held.append(data)

    def flush():
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    flush()
    return out


def test_html_blocks_agree_with_the_standard_parser(spark, sf):
    pages = [r["html"] or "" for r in load(spark, sf, "pages").collect()]
    assert pages
    for page in pages:
        assert [b.text for b in html_text.blocks(page)] == by_levels(page)
    # what the query returns are blocks of its page, in order
    for r in queries.op7_html_text(spark, sf).join(load(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        rest = iter(by_levels(r["html"]))
        assert all(line in rest for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])


def test_min_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.choice([-3, -1, -0.4, 0.3, 1, 2.5]) for _ in range(n)]
        edges = {(i, j): rng.random() * 2 for i in range(n) for j in range(i) if rng.random() < 0.6}

        def cost(y, gain=gain, edges=edges):
            return sum(abs(g) for g, k in zip(gain, y, strict=True) if (g > 0) != k) + sum(c for (a, b), c in edges.items() if y[a] != y[b])

        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.max_flow_labels(gain, edges)) - least) < 1e-6


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<p>Some text, here. More of it.", "x"), (2, None, "", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, html_text.train(pages)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "Some text, here. More of it.", 28), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_text.extract(pages.where("false"), html_text.train(pages.where("false"))).count() == 0


def test_language(spark, sf, odd, none):
    got = queries.op10_language(spark, sf).join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    rows = language_id.identify(odd, language_id.train(odd)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = next((t for i, t, _ in [*TEXTS, LONG] if i == r["doc_id"]), None)
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}
    assert language_id.keep_identified(odd, language_id.train(odd)).columns == odd.columns


def test_language_viterbi_is_best():
    """Against all labellings of short texts."""
    rng = random.Random(2)
    model = language_id.fit([("aa ab ba abab", "x"), ("bb bc cb bcbc", "y"), ("cc ca ac caca", "z")], least=1)
    for _ in range(60):
        penalty = rng.choice([0.5, 2.0, 8.0])
        labeller = language_id.Labeller(model, penalty)
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        label, _ = next(labeller.label([" ".join(words)]))
        score = [labeller.scores[labeller.seen[w]] for w in words]
        cost = lambda own: sum(float(s[k]) for s, k in zip(score, own, strict=True)) - penalty * sum(a != b for a, b in itertools.pairwise(own))  # noqa: B023, E731
        assert cost(label.tolist()) >= max(map(cost, itertools.product(range(3), repeat=len(words)))) - 1e-3


def test_language_samples_each_language(spark):
    rows = [(i, "the cat and the other dog with them", "en") for i in range(3000)] + [(5000 + i, "και το άλλο σκυλί με τη γάτα", "el") for i in range(8)] + [(6000, "собака и кошка", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, train_rows=50)
    assert model.langs == ["el", "en"]
    assert language_id.keep_identified(docs, model).count() == len(rows)  # a script that nothing was learned of is no reason to go


def test_language_spans():
    rng = random.Random(1)
    one, two = ["the", "and", "with", "other", "there"], ["que", "para", "los", "cuando", "ñandu"]
    model = language_id.fit([(" ".join(rng.choices(one, k=300)), "en"), (" ".join(rng.choices(two, k=300)), "es")])
    label, _ = next(language_id.Labeller(model, penalty=12.0).label([" ".join([*rng.choices(one, k=30), *rng.choices(two, k=20), "the", *rng.choices(two, k=20)])]))
    assert label.tolist() == [0] * 30 + [1] * 41


def test_quality(spark, sf, odd, none):
    labels = load(spark, sf, "labels")
    got = queries.op9_quality(spark, sf).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in got) >= 0.9 * len(got)
    model = quality.train(load(spark, sf, "documents"), labels)
    assert model.rules and model.describe()
    stats = quality.with_statistics(load(spark, sf, "documents")).select(*quality.STATS, model.column().alias("p")).collect()
    x = np.array([r[:-1] for r in stats])
    z = model.bias + sum(w * quality.holds(rule, x) for rule, w in model.rules)
    assert np.allclose([r["p"] for r in stats], 1 / (1 + np.exp(-z)))
    twice = quality.train(load(spark, sf, "documents"), labels.union(labels))
    assert twice.rules == model.rules
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels.where("false"))).collect()} == {0.5}


def test_exact_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries.op8_exact_dedup(spark, sf).collect())) == sorted(con.sql(queries.OP8_SQL).fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = load(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    first = corpus_pipeline.identify_language(spark, docs, sf)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(kept)
    best = {}
    for i, t in kept.items():
        key = t.translate(dict.fromkeys(b" \t\n\x0b\x0c\r"))
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    kept = {i: kept[i] for _, i in best.values()}
    near = near_by_hand(kept.items())
    kept = {i: t for i, t in kept.items() if near[i] == i}
    cut = suffix_dedup.brute_force([(i, t.encode()) for i, t in kept.items()])
    third = near_dedup.drop_near(exact_dedup.drop_copies(first))
    assert {r["doc_id"] for r in third.collect()} == set(kept)
    fourth = corpus_pipeline.cut_repeats(spark, third, sf)
    assert fourth.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in fourth.collect()}
    for i, t in left.items():
        assert cut[i][1] or t == kept[i]
    assert all(i in left for i in kept if not cut[i][1])
    want = sum(map(len, reference_ids(left.values())))
    got = corpus_pipeline.run(spark, sf).agg(F.sum("length"), F.count_distinct("doc_id")).collect()[0]
    assert tuple(got) == (want, len(left))
