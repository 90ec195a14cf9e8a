"""Operators against plain Python over the small tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medialake.llm import components, exact_dedup, fingerprint, language_id, ngram_join, packing, piece_codec, quality, queries, reshard, toxicity, url_filter
from medialake.llm.common import Tables, all_labelled, labelled
from medialake.llm.tokens import ByteBpe

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_edited_texts(spark, texts):
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SMALL).collect()}
    ids = sorted(texts)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by = defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def plain_lanes(text):
    """The number of paragraphs and the sums of their lanes, by plain Python."""
    parts = [p for p in re.split(r"[\r\n]+|(?<=[.!?])[ \t]+", text) if p]
    lanes = np.zeros(3 * fingerprint.WIDTH, np.int64)
    for p in parts:
        hashes = [xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)) for seed in range(fingerprint.SEEDS)]
        lanes += [(h >> (shift + at)) & 15 for h in hashes for shift in fingerprint.SHIFTS for at in (0, 20, 40)]
    return len(parts), lanes


def test_fingerprints_against_plain_sums(spark, texts):
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SMALL).collect()}
    ids = sorted(texts)
    for i, after in list(zip(ids, ids[1:] + ids[:1]))[:60]:
        (n, lanes), (m, other) = plain_lanes(texts[i]), plain_lanes(texts[after])
        packed = [lanes[k] % 65536 | lanes[k + 1] % 65536 << 20 | lanes[k + 2] % 65536 << 40 for k in range(0, len(lanes), 3)]
        assert got[i].fingerprint == f"{n:08X}" + "".join(f"{x:015X}" for x in packed)
        x, y = 2.0 * lanes - 15 * n, 2.0 * other - 15 * m
        assert abs(got[i].near_next - (1.0 if (n, lanes.tolist()) == (m, other.tolist()) else min(1.0, max(0.0, 2 * x @ y / (x @ x + y @ y))))) < 1e-9


def following(keys):
    order = sorted(set(keys))
    return dict(zip(order, order[1:] + order[:1]))


@pytest.mark.parametrize("keys", [[*range(0, 900, 3), 10**12, -(10**9), 5, 5], [2**63 - 1, -(2**63), 0, 4], [2**63 - 1], [-(2**63)] * 900 + [*range(100)] + [77] * 900 + [2**63 - 1] * 300, random.Random(3).sample(range(10**15), 3000)], ids=["sparse", "extreme", "one", "hot", "many"])
def test_next_over_many_buckets(spark, keys):
    """Also the largest and smallest keys, and keys that a third of all rows have, with equal and with different texts."""
    rows = spark.createDataFrame([(k, f"t{i % 97 if k == 77 else k}") for i, k in enumerate(keys)], "key long, text string").repartition(4)
    got = fingerprint.with_next(rows, ["key"], bytes_per_bucket=50).collect()
    after, times = following(keys), Counter(keys)
    assert Counter(r.key for r in got) == times
    leaves = Counter(r.key for r in got if r.next_key != r.key or len(times) == 1)
    assert all(r.next_key in (r.key, after[r.key]) for r in got)
    assert len(times) == 1 or leaves == Counter(dict.fromkeys(times, 1))  # of the rows of a key just one is followed by another key


def test_paragraphs_come_and_go(spark):
    df = spark.createDataFrame([("a b\nc d\ne f", "e f\na b")], "x string, y string").select(fingerprint.fingerprint(F.col("x")).alias("x"), fingerprint.fingerprint(F.col("y")).alias("y"))
    r = df.select((fingerprint.delete(F.col("x"), F.lit("c d")) == F.col("y")).alias("gone"), (fingerprint.insert(F.col("y"), F.lit("c d")) == F.col("x")).alias("back"), fingerprint.likeness(F.col("x"), F.col("x")).alias("same")).first()
    assert r.gone and r.back and r.same == 1.0


def test_token_ids_and_packing(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "a  b", "x \n y", " \n\nz", "tab\t t", "don't  stop", "<|endoftext|> x", "日本 語\u3000x \u00a0y", "a \u00a0b"]
    for bpe in (ByteBpe(*queries.BPE), ByteBpe(queries.BPE[0]), ByteBpe(*queries.BPE, keep=3)):
        for text, got in zip([*odd, *texts.values()], bpe.batch([*odd, *texts.values()])):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]
    wrong = ByteBpe(*queries.BPE)
    wrong.ranks = tiktoken.Encoding("wrong", pat_str=r".", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    with pytest.raises(ValueError, match="not of one vocabulary"):
        wrong.batch(["Whole words here."])
    rows = queries.op5_packing(spark, SMALL).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.asarray([*whole.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 2048 for r in pieces[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == list(np.cumsum([0, *[r.length for r in seq]])[:-1]) and sum(r.length for r in seq) <= 2048
    assert len(by_seq) <= 1.06 * sum(r.length for r in rows) / 2048 + 1


def test_patterns_fit_the_histogram():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(0, 32, 5000), minlength=32)
    used = packing.repeats(counts, 3)
    left = counts.copy()
    for way, n in used:
        assert sum(way) == 32
        for b in way:
            left[b - 1] -= n
    assert (left >= 0).all() and left.sum() < 0.1 * counts.sum()
    a, b = rng.random((20, 30)), rng.random(20)
    x = packing.nnls(a, b)
    grad = a.T @ (b - a @ x)
    assert (x >= 0).all() and grad.max() < 1e-6 and abs(grad @ x) < 1e-6
    at, free = packing.best_fit(np.array([9, 5, 4, 3]), np.array([4, 6]), 10)
    assert at.tolist() == [2, 1, 0, 3] and free.tolist() == [10, 6, 4, 10]


def test_sentencepiece_parity(spark, texts):
    model = open(queries.PIECES, "rb").read()
    reader = sentencepiece.SentencePieceProcessor(model_proto=model)
    odd = ["", " ", "  a", "a  b ", "\n", "\n\nx", "x \n y", "日本語 😀", "<s> hi", "<0x41>", "tab\tx"]
    codec, decoder = piece_codec.Codec(model), piece_codec.Decoder(model)
    for text, (ids, same) in zip([*odd, *texts.values()], codec.batch([*odd, *texts.values()])):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == reader.encode(text) and same, text[:40]
        assert decoder.text(ids.tobytes()) == text
    assert all(r.parity and r.round_trip for r in queries.op2_sentencepiece(spark, SMALL).collect())


def piece_model(pieces, kind, byte_fallback, squeeze):
    """The protobuf of a SentencePiece model."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda field, data: number(field << 3 | 2) + number(len(data)) + data
    plain = lambda field, n: number(field << 3) + number(n)
    listed = b"".join(part(1, part(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + plain(3, k)) for p, s, k in pieces)
    return listed + part(2, plain(3, kind) + plain(35, byte_fallback)) + part(3, plain(3, 1) + plain(4, squeeze) + plain(5, 1))


@pytest.mark.parametrize("byte_fallback", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("user", [0, 1])
def test_unigram_parity(byte_fallback, squeeze, user):
    """Pieces that are not normal are never matched in a text that spells them; unknown characters become bytes, or one unknown piece a stretch."""
    rng = random.Random(1)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if byte_fallback else []), *([("<u>", 0.0, 4), ("ab!", 0.0, 4)] if user else [])]
    pieces += [(c, -3 - rng.random(), 1) for c in "▁abcd<>/s0x41"] + [(w, -4 - 3 * rng.random(), 1) for w in ("▁a", "ab", "▁ab", "cd", "abc", "bcd", "▁the", "th")]
    data = piece_model(pieces, 1, byte_fallback, squeeze)
    reader, codec, decoder = sentencepiece.SentencePieceProcessor(model_proto=data), piece_codec.Codec(data), piece_codec.Decoder(data)
    parts = ["a", "b", "c", "d", " ", "\n", "日", "é", "<s>", "<0x41>", "</s>", "the", "ab!", "<u>", "<unk>", "z", "▁"]
    texts = ["", "a", " ", "</s>", "<s> ab", "x<0x41>y", "日本 語", "\n\n日\n", "  ab  cd ", "<u>ab!<u>", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000))]
    for text, (ids, same) in zip(texts, codec.batch(texts)):
        want = reader.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and same, text
        assert decoder.text(ids) == reader.decode(want), text


def grams(text):
    words = re.findall(r"\w+", text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_classes(texts):
    sets = {i: grams(t) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(i for s, i in first.items() if s)
    inverted, shared = defaultdict(list), Counter()
    for i in reps:
        for g in sets[i]:
            inverted[g].append(i)
    for ids in inverted.values():
        shared.update(combinations(ids, 2))
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        if s:
            a, b = find(i), find(first[s])
            root[max(a, b)] = min(a, b)
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    degree = Counter(x for pair in links for x in pair)
    return {i: (find(i), degree[first[s]] if s else 0) for i, s in sets.items()}


def near_texts():
    """Families of near copies, one of them large, and texts that only share a passage."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = [word() for _ in range(60)]
    out = {}
    for size in (2, 3, 5, 150):
        base = [word() for _ in range(150)]
        for _ in range(size):
            own = list(base)
            for at in rng.choice(len(own), int(rng.integers(1, 4)), replace=False):
                own[at] = word()
            out[len(out)] = " ".join(own)
    for _ in range(200):
        out[len(out)] = " ".join([word() for _ in range(40)] + passage)
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 16, "split_above": 40, "deepest": 6}, {"block": 8}], ids=["whole", "split", "pivots"])
def test_near_classes_and_links(spark, limits):
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs, **limits).collect()}
    assert sum(got[i] == want[i] for i in texts) >= 0.98 * len(texts)
    assert all(got[i][1] <= want[i][1] for i in texts)  # a link is never made up
    assert sum(got[i][1] for i in texts) >= 0.99 * sum(want[i][1] for i in texts)  # recall of links


def test_close_sets_need_no_comparison(spark):
    """Texts that all differ in one place from one text: with a pivot, hardly any row goes through the blocks, and all links are there."""
    base = [f"w{i}" for i in range(400)]
    texts = {i: " ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(3, 103)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs, block=8).collect()}
    assert got == dict.fromkeys(texts, (3, 99))


def test_split_leaves_lose_no_pair(spark):
    """Every pair of one leaf that agrees in enough places shares a leaf after the split too; the leaf is split as it holds many small families."""
    rng, agree = np.random.default_rng(8), 40
    tokens = rng.integers(0, 1 << 16, (60, ngram_join.COORDINATES), dtype=np.uint16).repeat(5, axis=0)
    tokens[:, :30] = tokens[0, :30]  # a passage that all share
    for row in tokens:
        row[rng.choice(64, int(rng.integers(0, 14)), replace=False)] = rng.integers(0, 1 << 16)
    rows = [(i, bytearray(row.tobytes())) for i, row in enumerate(tokens)]
    sketches = spark.createDataFrame(rows, "rid long, sketch binary")
    shared = sketches.select(F.lit(7).cast("long").alias("leaf"), "rid", F.lit(len(rows)).cast("long").alias("members"))
    got, large = ngram_join.split_leaves(shared, shared, sketches, agree, 40, Tables(spark))
    leaves = defaultdict(set)
    for r in got.collect():
        leaves[r.leaf].add(r.rid)
    assert 7 not in leaves and large.count() == 0
    met = {pair for rids in leaves.values() for pair in combinations(sorted(rids), 2)}
    close = {(i, j) for i, j in combinations(range(len(tokens)), 2) if (tokens[i] == tokens[j]).sum() >= agree}
    assert len(close) > 300 and close <= met


def test_limits_change_no_result(spark):
    """Splitting leaves is for speed only."""
    docs = spark.createDataFrame(list(near_texts().items()), "doc_id long, text string")
    whole, split = ([tuple(r) for r in ngram_join.ngram_join(docs, split_above=most, deepest=8).orderBy("doc_id").collect()] for most in (20_000, 2))
    assert whole == split


def test_components_of_chains(spark):
    """Chains numbered against the rule and at random have one component each, in rounds that grow with the logarithm of their length."""
    n, rng, rounds = 300, np.random.default_rng(5), []

    class Counting(Tables):
        def save(self, df, name):
            rounds.append(name)
            return super().save(df, name)

    chains = [[0, *range(n - 1, 0, -1)], (n + rng.permutation(n)).tolist()]
    edges = spark.createDataFrame([pair for c in chains for pair in zip(c, c[1:])], "u long, v long")
    with Counting(spark) as tables:
        got = {r.node: r.root for r in components.components(edges, tables).collect()}
    assert got == {i: i // n * n for i in range(2 * n)}
    assert rounds.count("component-labels") <= 16


def test_near_classes_of_the_small_table(spark, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op8_ngram_join(spark, SMALL).collect()}
    assert got == brute_classes(texts)


def test_resharding(spark, small):
    rows = queries.op10_reshard(spark, SMALL).collect()
    sizes = {r.doc_id: (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in small.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == sizes and len(rows) == len(sizes)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    each = [sum(r.size for r in by[s]) for s in range(24)]
    assert max(each) - min(each) <= 2 * max(s for s, _ in sizes.values())
    source = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(24))
    plan = reshard.reshard(small, source, 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in plan} == {(r.doc_id, r.shard, r.slot) for r in rows}  # the files say what was planned
    total, old = sum(each), Counter()
    for r in plan:
        old[r.old_shard] += r.size
    fewest = sum(max(0, old[s] - total // 24) for s in range(24))
    assert abs(sum(r.size for r in plan if r.moved) - fewest) <= 24 * max(s for s, _ in sizes.values())


def test_flow_is_cheapest():
    cost = [[0, 1, 4], [2, 0, 1], [1, 3, 0]]
    sent = reshard.cheapest_flow([5, 7, 2], [6, 2, 6], cost)
    assert [sum(r) for r in sent] == [5, 7, 2] and [sum(c) for c in zip(*sent)] == [6, 2, 6]
    best = min(sum(x * c for r, k in zip(s, cost) for x, c in zip(r, k)) for s in all_flows([5, 7, 2], [6, 2, 6]))
    assert sum(x * c for r, k in zip(sent, cost) for x, c in zip(r, k)) == best


def all_flows(supply, room):
    if len(supply) == 1:
        yield [list(room)]
        return
    for a in range(min(supply[0], room[0]) + 1):
        for b in range(min(supply[0] - a, room[1]) + 1):
            c = supply[0] - a - b
            if c <= room[2]:
                for rest in all_flows(supply[1:], [room[0] - a, room[1] - b, room[2] - c]):
                    yield [[a, b, c], *rest]


def shards_of(spark, path):
    return sorted(((r.doc_id, r.text, r.slot, r.shard, r.shard_, r.slot_) for r in spark.read.parquet(path).collect()), key=repr)


def test_only_touched_shards_are_rewritten(spark, tmp_path):
    """Over an existing layout, with repeated rows, null ids and texts, and columns named as the folders are: rows in are rows out."""
    path = str(tmp_path / "out")
    rows = [(i if i % 9 else None, None if i == 70 else "x" * (100 if i < 60 else 1), "o", str(i)) for i in range(90)] + [(5, "twice", "o", "r")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, shard string")
    at = F.length("text") % 3
    docs.withColumn("shard_", F.coalesce(at, F.lit(0))).withColumn("slot_", F.lit(0).cast("long")).write.partitionBy("shard_").parquet(path)
    kept = spark.read.parquet(path)
    still = [f.name for f in (tmp_path / "out" / "shard_=2").iterdir()]
    layout = reshard.plan_moves(kept, F.col("shard_"), 3, 3)
    names = reshard.rewrite_moved(docs, reshard.plan_moves(docs, F.coalesce(at, F.lit(0)), 3, 3), path)
    assert names == ("shard_", "slot_") and layout.touched
    got = spark.read.parquet(path)
    assert sorted(map(repr, got.select("doc_id", "text", "slot", "shard").collect())) == sorted(map(repr, docs.collect()))
    plan = reshard.reshard(docs, F.coalesce(at, F.lit(0)), 3, 3).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in plan) == Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard_) for r in got.collect())
    if 2 not in layout.touched:
        assert still == [f.name for f in (tmp_path / "out" / "shard_=2").iterdir()]
    sizes = [sum(r.size for r in plan if r.shard == s) for s in range(3)]
    assert max(sizes) - min(sizes) <= 2 * 108


def laid_out(spark, path):
    rows = [(i, "x" * (i % 7), i % 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, was int")
    docs.withColumn("shard", F.col("was")).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    return docs, sorted(i for i, _, _ in rows)


@pytest.mark.parametrize("done", [0, 1, 2, 3])
def test_a_swap_that_a_dead_driver_left_is_finished(spark, tmp_path, monkeypatch, done):
    """The driver dies before the swap, between the two renames of a shard, or after some shards."""
    path = str(tmp_path / "out")
    docs, ids = laid_out(spark, path)

    def dies(spark, path, shard, aside, full):
        here, names = tmp_path / "out", [f"{shard}={i}" for i in full]
        aside = here / aside.rsplit("/", 1)[1]
        (aside / "_old").mkdir()
        for name in names[: done // 2 + done % 2]:
            if (here / name).exists():
                (here / name).rename(aside / "_old" / name)
            if done != 1:
                (aside / name).rename(here / name)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(reshard, "swap", dies)
        with pytest.raises(KeyboardInterrupt):
            reshard.rewrite_moved(docs, reshard.plan_moves(docs, F.col("was"), 3, 5), path)
    assert len(reshard.finish_swaps(spark, path)) == 1 and not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_aside")]
    got = spark.read.parquet(path)
    assert sorted(r.doc_id for r in got.collect()) == ids and {r.shard for r in got.select("shard").distinct().collect()} == set(range(5))


def test_a_rename_that_fails_loses_no_shard(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    docs, ids = laid_out(spark, path)
    real = reshard.files_of(spark, path)

    class Refusing:
        def __getattr__(self, name):
            return getattr(real, name)

        def rename(self, a, b):
            return False if "_aside" in a.toString() and "_old" not in a.toString() else real.rename(a, b)

    layout = reshard.plan_moves(docs, F.col("was"), 3, 5)
    with monkeypatch.context() as m:
        m.setattr(reshard, "files_of", lambda *_: Refusing())
        with pytest.raises(OSError, match="can't take its place"):
            reshard.rewrite_moved(docs, layout, path)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == ids  # the old files
    reshard.finish_swaps(spark, path)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == ids


def test_equal_rows_without_ids_are_spread(spark):
    """100,000 rows that agree in all columns: no block and no group has more than its share."""
    docs = spark.range(100_000).select(F.when(F.col("id") < 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    layout = reshard.plan_moves(docs, F.lit(0), 2, 4)
    assert layout.keyed(docs).groupBy("old", "fine").count().agg(F.max("count")).first()[0] < 1300
    rows = reshard.assigned(docs, layout).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert [(r.n, r.slots, r.last) for r in rows] == [(25_000, 25_000, 24_999)] * 4
    pieces = docs.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    got = packing.pack(pieces).groupBy("sequence_id").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("at"), F.max("offset").alias("last")).collect()
    assert sum(r.n for r in got) == 100_000 and all(r.n == r.at <= 2 and r.last == 700 * (r.n - 1) for r in got) and len(got) <= 50_050


def test_rows_outside_the_old_shards(spark, tmp_path):
    """They come from nowhere, all move, and none is lost."""
    docs = spark.createDataFrame([(i, "abc", [0, 1, 7, -1, None][i % 5]) for i in range(50)], "doc_id long, text string, old int")
    rows = reshard.reshard(docs, F.col("old"), 2, 4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(50)) and {r.shard for r in rows} == set(range(4))
    assert all(r.moved for r in rows if r.old_shard not in (0, 1))
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 2


def test_chain_marginals():
    rng = np.random.default_rng(2)
    move, begin = rng.normal(size=(2, 2)), np.array([0.0, 0.7])
    lengths = [1, 3, 8]
    e = rng.normal(size=sum(lengths))
    starts = np.zeros(len(e), bool)
    starts[[0, 1, 4]] = True
    got = toxicity.marginals(e, starts, move, begin)
    at = 0
    for n in lengths:
        weight = np.zeros(n)
        total = 0.0
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(begin[y[0]] + sum(e[at + i] * y[i] for i in range(n)) + sum(move[a][b] for a, b in zip(y, y[1:])))
            total += w
            weight += w * np.array(y)
        assert np.allclose(got[at : at + n], weight / total)
        at += n


def test_offending_offsets():
    """Offsets are places in the text as it is, also where lower-casing makes it longer."""
    scorer = toxicity.Scorer(toxicity.Field({"=idiot": 0}, np.array([9.0]), -4.0, np.zeros((2, 2)), np.zeros(2)))
    texts = ["You IDIOT, idiot there", "", "fine", "İİ İİ. idiot. Idiot"]
    _, spans = scorer.texts(texts, True)
    assert [[t[x["start"] : x["stop"]] for x in at] for t, at in zip(texts, spans)] == [["IDIOT, idiot"], [], [], ["idiot", "Idiot"]]
    assert (spans[3][0]["start"], spans[3][1]["start"]) == (7, 14)


def test_evidence_by_enumeration():
    """Marginals of two chains with neighbour features, and the evidence of their spans, by trying every labelling."""
    model = toxicity.Field({"=bad": 0, "foul": 1}, np.array([3.0, 2.5]), -2.0, np.array([[0.3, -0.4], [-0.2, 0.6]]), np.array([0.0, -0.7]), (0.5, -0.3))
    text, evidence = "a Bad foulness thing. so bad! it is", 0.0
    for part in re.split("[.!]", text):
        words = part.split()
        hit = ["bad" == w.lower() or w.lower().startswith("foul") for w in words]
        e = [-2.0 + 3.0 * (w.lower() == "bad") + 2.5 * w.lower().startswith("foul") + 0.5 * (i > 0 and hit[i - 1]) - 0.3 * (i + 1 < len(words) and hit[i + 1]) for i, w in enumerate(words)]
        weight, total = np.zeros(len(words)), 0.0
        for code in range(2 ** len(words)):
            y = [code >> i & 1 for i in range(len(words))]
            w = math.exp(model.begin[y[0]] + sum(a * b for a, b in zip(e, y)) + sum(model.move[a][b] for a, b in zip(y, y[1:])))
            total, weight = total + w, weight + w * np.array(y)
        top = 0.0
        for p in [*(weight / total), 0.0]:
            if p >= 0.05:
                top = max(top, p)
            elif top:
                evidence, top = evidence - math.log(1 - top), 0.0
    assert abs(toxicity.Scorer(model).texts([text], False)[0][0] - evidence) < 1e-9


def test_telling_terms_and_chains(spark):
    """Terms by plain counting; chains give back every token of the text."""
    rng = random.Random(4)
    rows = [(i, int(i % 4 == 0), " ".join(rng.choice(["red", "green", "blue", "yellowish"]) for _ in range(12)) + (" Nastyword. yellow" if i % 4 == 0 and i % 5 else "") + (" nasty" if i == 3 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    bad, good = Counter(), Counter()
    for _, toxic, text in rows:
        (bad if toxic else good).update({t for w in set(re.findall(r"\w+", text.lower())) for t in toxicity.terms_of(w)})
    counts = toxicity.term_counts(df)
    assert {(r.term, r.bad, r.good) for r in counts.collect()} == {(t, bad[t], good[t]) for t in bad | good}
    tried = {t for t in bad | good if bad[t] + good[t] >= 3}

    def gain(t):
        return sum(n * math.log(n / (bad[t] + good[t]) / of) for n, of in ((bad[t], 0.25), (good[t], 0.75)) if n)

    want = sorted(t for t in tried if bad[t] >= 3 and 3 * bad[t] >= 2 * good[t] and gain(t) >= math.log(len(tried)) + 3)
    got = toxicity.telling(counts, 50, 150)
    assert got == want and "=nastyword" in got
    terms = {t: i for i, t in enumerate(got)}
    text = " ".join(["word"] * 900) + ". Nastyword nasty! x"
    chains = [(m, np.frombuffer(c, "<i4").tolist()) for m, c in toxicity.chains_of(text, True, terms)]
    assert [c[0] for _, c in chains] == [400, 400, 100, 2, 1] and [m for m, _ in chains] == [False, False, False, True, False]
    assert sum(c[0] for _, c in chains) == len(re.findall(r"\w+", text))


def test_calibration_is_the_likeliest():
    rng = np.random.default_rng(6)
    x = rng.random(400) * 5
    y = rng.random(400) < 1 / (1 + np.exp(2 - x))
    slope, base = toxicity.logistic(x, y, l2=0.0)
    loss = lambda a, b: np.logaddexp(0, np.where(y, -1, 1) * (a * x + b)).sum()
    assert all(loss(slope, base) <= loss(slope + da, base + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_one_labelled_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (4, "x"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, None), (3, 1), (4, 5), (None, 1)], "doc_id long, toxic int")
    got = labelled(docs, labels, "toxic", 1, 2, "doc_id", "text", 100).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (2, 1, "")]


def accuracy(rows, truth):
    rows = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    return np.mean([truth[r.doc_id] == (r.predicted if hasattr(r, "predicted") else r.lang_pred) for r in rows]), len(rows)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    share, n = accuracy(language_id.language_id(docs).collect(), {r.doc_id: r.lang for r in docs.collect()})
    assert n > 200 and share > 0.97
    known = labels.collect()
    share, n = accuracy(quality.quality(docs, labels).collect(), {r.doc_id: r.quality for r in known})
    assert n > 80 and share > 0.93
    share, n = accuracy(toxicity.toxicity(docs, labels).collect(), {r.doc_id: r.toxic for r in known})
    assert n > 80 and share > 0.9
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    # of all held-out toxic documents; four of the 18 hold no term that 34 toxic documents can teach
    held = [r.doc_id for r in known if r.toxic == 1 and scored[r.doc_id].held_out]
    assert len(held) == 18 and sum(scored[i].predicted for i in held) >= 14
    assert not any(scored[r.doc_id].predicted for r in known if r.toxic == 0 and scored[r.doc_id].held_out)


def test_most_held_out_toxic_documents_are_found(spark):
    """At ten times the labels: nine of ten of all, of which some have no toxic word at all."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id"), "doc_id").select("doc_id", "held_out", "predicted").collect()
    held = [r for r in rows if r.held_out and toxic[r.doc_id] == 1]
    clean = [r for r in rows if r.held_out and toxic[r.doc_id] == 0]
    assert len(held) > 140 and sum(r.predicted for r in held) >= 0.9 * len(held)
    assert len(clean) > 1000 and sum(r.predicted for r in clean) < 0.005 * len(clean)


def test_what_is_learned_from_is_bounded(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("label"), F.repeat(F.lit("word "), 20).alias("text")).unionByName(spark.range(1).select(F.lit(-1).alias("doc_id"), F.lit(1).alias("label"), F.repeat(F.lit("x"), 10_000).alias("text")))
    assert toxicity.within_bytes(rows, 1 << 20).count() == 2001
    some = toxicity.within_bytes(rows, 100_000)
    assert 850 < some.count() < 1150 and some.where("doc_id = -1").count() == 0


def test_quality_by_plain_python(spark):
    """Features of texts by their definition, and a fit whose gradient vanishes over the same pairs."""
    texts = ["", None, "One two two.\nOne two two.", "A|B | c!! 12 &", "ALL CAPS HERE, and more.\n\n\tx", "naïve 日本 日本"]
    for text, got in zip(texts, quality.features(texts)):
        t = text or ""
        raw, words, lines = t.encode(), t.split(), t.split("\n")
        n, w = len(raw), max(1, len(words))
        count = lambda cs: sum(raw.count(c.encode()) for c in cs)
        letters = max(1, sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw))
        want = [0.0] * 14 if not t else [
            math.log1p(n), sum(65 <= b <= 90 for b in raw) / letters, (count("!") / w) ** 0.5, (count("#$%&*+=@^~") / w) ** 0.5, (count("|") / w) ** 0.5, count("0123456789") / n, count(" \t") / n, len(lines) / w, min(20, n / w),
            math.log(max(1, len(set(words)))) / math.log(w + 1), max(Counter(words).values(), default=0) / w, (sum(a == b for a, b in zip(words, words[1:])) / w) ** 0.5, 1 - len(set(lines)) / len(lines), count(".,") / w,
        ]
        assert np.allclose(got, want, atol=1e-5), text
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.6).astype(int)
    x = rng.normal(size=(500, 14)) + 0.5 * y[:, None]
    model = quality.bradley_terry(x, y, pairs=4000, l2=1e-3, seed=3)
    z, draw = np.clip((x - model.mean) / model.scale, -8, 8), np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(y == 1), 4000)] - z[draw.choice(np.flatnonzero(y == 0), 4000)]
    loss = lambda w: np.mean(np.log1p(np.exp(-d @ w))) + 0.5e-3 * w @ w
    best = loss(model.weights)
    assert all(loss(model.weights + step * np.eye(14)[i]) > best for i in range(14) for step in (1e-3, -1e-3))


def test_quality_learns_from_all_rows_and_pairs(spark):
    """Weights where the gradient over every pair of all rows vanishes, and a threshold of an exact rank."""
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.7).astype(int)
    x = (rng.normal(size=(600, 14)) + 0.4 * y[:, None]).astype(np.float32)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "label int, features array<float>")
    model = quality.Ranking(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(14), 0.0)
    model.weights = quality.all_pairs(rows, model)
    z = np.clip((x - model.mean) / model.scale, -8, 8).astype(float)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 14)
    slope = d.T @ (1 / (1 + np.exp(d @ model.weights))) / len(d) - 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-3
    order = np.sort(model.raw(x.astype(float)))
    assert abs(quality.rank_of_all(rows, model, int((y == 0).sum())) - (order[(y == 0).sum() - 1] + order[(y == 0).sum()]) / 2) < 1e-9
    docs = spark.range(13_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    used = all_labelled(docs.unionByName(docs.where("doc_id = 0").withColumn("text", F.lit("!"))), labels, "quality", 4, 2, "doc_id", "text")
    assert used.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(13_000)) and [r.text for r in used.where("doc_id = 0").collect()] in (["!"], [])


def test_pairs_rank_and_quantile():
    rng = np.random.default_rng(5)
    y = (rng.random(2000) > 0.3).astype(int)
    x = rng.normal(size=(2000, 14)) + y[:, None] * np.array([2.0] + [0.0] * 13)
    model = quality.bradley_terry(x, y)
    s = model.score(x)
    assert abs((s < 0.7).mean() - (y == 0).mean()) < 0.01
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.88


def test_backoff():
    model = language_id.Backoff(["a", "b"], np.array([[0, -5], [-5, 0], [0, -1]], np.float32), {"known": 0}, {"ow": 2, "wor": 1}, 4)
    assert model.rows("known") == [0] and model.rows("word") == [1] and model.rows("bow") == [2] and model.rows("zz") == []


def test_languages_against_plain_counts(spark, small):
    """The whole query by plain Python: counts of words and n-grams, backoff, share of the likelihood."""
    rows = small.select("doc_id", "text", "lang").collect()
    split = lambda t: regex.findall(r"\w+", t.lower())
    counts, langs = defaultdict(Counter), sorted({r.lang for r in rows if r.lang})
    for r in rows:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in split(r.text or ""):
                counts[0, w][r.lang] += 1
                for n in range(1, 5):
                    for i in range(len(w) + 3 - n):
                        counts[n, f"<{w}>"[i : i + n]][r.lang] += 1
    counts = {k: c for k, c in counts.items() if sum(c.values()) >= 3}
    totals = {(n, x): sum(c[x] + 0.5 for (m, _), c in counts.items() if m == n) for n in range(5) for x in langs}
    log = lambda key: np.array([math.log((counts[key][x] + 0.5) / totals[key[0], x]) for x in langs])

    def rate(w):
        if (0, w) in counts:
            found = [(0, w)]
        else:
            found = next((f for n in range(4, 0, -1) if (f := [(n, g) for i in range(len(w) + 3 - n) if (n, g := f"<{w}>"[i : i + n]) in counts])), [])
        return np.mean([log(k) - log(k).max() for k in found], axis=0) if found else np.zeros(len(langs))

    kept = {}
    for r in queries.op1_language_id(spark, SMALL).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id) or ""
        total = sum((kept.setdefault(w, rate(w)) for w in split(text)), np.zeros(len(langs)))
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        if any(map(str.isalpha, text)):
            assert r.lang_pred == langs[int(share.argmax())] and abs(r.score - share.max()) < 1e-3, r.doc_id
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_marks_belong_to_words(spark):
    """Learning and predicting cut words alike where vowel signs and accents are characters of their own."""
    docs = spark.createDataFrame([(i, t, x) for i in range(40) for t, x in (("हिन्दी में लिखना", "hi"), ("मराठी मध्ये लिहिणे", "mr"), ("de\u0301ja\u0300 vu", "fr"))], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert {"हिन्दी", "में", "मराठी", "de\u0301ja\u0300"} <= set(model.words)
    got = language_id.identify(spark.createDataFrame([(1, "हिन्दी", "x"), (2, "मध्ये", "x"), (3, "de\u0301ja\u0300", "x")], "doc_id long, text string, score string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["hi", "mr", "fr"] and got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}


@pytest.mark.parametrize("few", [100_000, 0], ids=["broadcast", "shuffled"])
def test_thousands_of_url_rules(spark, few):
    """The same verdicts as from trying every rule on every URL, and few rules are tried."""
    rng = random.Random(9)
    word = lambda k: f"{rng.choice('abcdefghij')}{rng.randrange(k)}"
    named = {(f"{word(40)}.{rng.choice(['com', 'net', 'org'])}", rng.choice(["/", f"/{word(5)}/", f"/{word(5)}/{word(9)}"])): rng.choice(["block", "allow"]) for _ in range(2000)}
    rules = [url_filter.host_rule(h, p, v) for (h, p), v in named.items()]
    words = sorted({word(60) for _ in range(600)})
    rules += [url_filter.pattern_rule(rf"^(?:[^/]*[.-])?{w}[.-]", (w,)) for w in words] + [url_filter.UrlRule(r"^\d+(?:\.\d+){3}(?:/|$)", (), "block")]
    urls = [None, "", "x", "http://1.2.3.4/", *(f"https://{'.'.join([word(60) for _ in range(rng.randrange(1, 3))] + [word(40)])}.{rng.choice(['com', 'net', 'org'])}/{word(5)}/{word(9)}?q" for _ in range(600))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, broadcast_rules=few).collect()}
    hits = 0
    for i, url in enumerate(urls):
        host, _, path = (url.split("://", 1)[1].split("?")[0] if url and "://" in url else "").partition("/")
        path = f"/{path}" if url and "://" in url else ""
        fits = [(len(h) + len(p), h + p, v) for (h, p), v in named.items() if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        if fits:
            want = max(fits)[1:]
        else:
            whole = host + path
            want = (None, "block" if re.match(r"\d+(\.\d+){3}(/|$)", whole) or any(re.match(rf"(?:[^/]*[.-])?{w}[.-]", whole) for w in words) else "allow")
        hits += bool(fits)
        assert got[i] == want, url
    assert hits > 50


def test_hot_texts_are_salted(spark):
    """A text of most rows, with repeated and null ids: one group, one row kept, with and without a column that tells rows apart."""
    rows = [(i if i % 3 else None, "hot  text") for i in range(1500)] + [(7, "hot text")] * 200 + [(i, f"t{i % 50}") for i in range(1000)] + [(None, "t3"), (None, "zz"), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    for row in (None, "row"):
        got = exact_dedup.exact_dedup(docs, row_col=row).collect()
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        assert len(got) == len(rows) and max(map(len, by.values())) == 1700 and len(by) == 52
        for rs in by.values():
            least = min((r.doc_id for r in rs if r.doc_id is not None), default=None)
            assert {(r.keep_id, r.group_size) for r in rs} == {(least, len(rs))} and [r.doc_id for r in rs if r.kept] == [least]
