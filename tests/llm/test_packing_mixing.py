import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import rows as R  # noqa: E402

from tabulon.llm import mixing, packing, queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(packing.default_tokenizer())


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_text(encoder):
    choose = random.Random(3)
    parts = ["Hello", "it's", "don't!!", "ÉCOLE.", "word,###", "12.5", "a-b", "\n", "\t", " ", "  ", "é́x", "́", "<|endoftext|>", "<|",
             "İstanbul", "ΣΑΣ", " ", "\x1c", "x" * 90, "(a)", "...", "$9", "中文", "\U0001f600", "'s", "we'll"]
    texts = ["".join(choose.choice(parts) + choose.choice(["", " "]) for _ in range(choose.randint(0, 30))) for _ in range(400)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == direct(encoder, text), text


def test_ids_of_any_unicode_text(encoder):
    """Ten thousand texts of letters, marks and accents, as the tokenizer has them whole."""
    choose = random.Random(5)
    pool = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), *range(0x300, 0x320), *range(0x390, 0x3D0), *range(0x958, 0x960),
                             0x130, 0x131, 0x1E9E, 0xFB01, 0x212A, 0x2126, 0xA0, 0x85, 0x2028, 0xAC00, 0x1100, 0x1161, 0x4E2D, 0x1F600)]
    common = list("aeiou  ..,!?İ\n'") + ["é", "e\u0301"]
    texts = ["".join(choose.choice(common if choose.random() < 0.6 else pool) for _ in range(choose.randint(0, 12))) for _ in range(10_000)]
    texts += ["İ.", "a. b", "a... ,b", "K.", "क़.", "x." * 5, ". a.  ", "İ̇. "]
    for start in range(0, len(texts), 256):
        some = texts[start : start + 256]
        for text, ids in zip(some, encoder.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == direct(encoder, text), repr(text)


def test_forgotten_words_are_learnt_again(encoder, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    choose = random.Random(6)
    for _ in range(30):
        texts = [" ".join(f"w{choose.randint(0, 400)}x, y{choose.randint(0, 9)}." for _ in range(20)) for _ in range(4)]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == direct(encoder, text)


def test_rows_of_one_document_spread_over_groups(spark):
    df = spark.createDataFrame([(None, "word " * (i % 50)) for i in range(600)], "doc_id long, text string")
    found = packing.packed(df, packing.default_tokenizer(), pieces_per_group=50).collect()
    assert len(found) == 600
    groups = defaultdict(int)
    for r in found:
        groups[r.sequence_id >> 40] += 1
    assert len(groups) == 12 and max(groups.values()) < 100


def test_sequences_hold_their_pieces_and_few_are_needed():
    lengths = np.array(sorted(np.random.default_rng(1).integers(1, 4097, 3000), reverse=True))
    sequence, offset = packing.place(lengths)
    ends = defaultdict(list)
    for s, o, n in zip(sequence, offset, lengths):
        ends[s].append((o, n))
    for placed in ends.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 4096
    assert len(ends) <= 1.01 * lengths.sum() / 4096 + 1


def test_large_items_that_pair_exactly():
    sequence, _ = packing.place(np.array([3000, 1096] * 50))
    assert len(set(sequence)) == 50


def check_packing(found, docs, encoder):
    by_row = defaultdict(list)
    for r in found:
        by_row[r.doc_id].append(r)
    for doc, copies in docs.items():
        pieces = sorted(by_row.pop(doc), key=lambda r: (r.piece, r.sequence_id))
        ids = [*direct(encoder, copies[0]), 1]
        expected = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        assert len(pieces) == len(expected) * len(copies)
        for r in pieces:
            own = np.array(expected[r.piece], "<u4")
            assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(own), zlib.crc32(own.tobytes()))
    assert not by_row
    placed = defaultdict(list)
    for r in found:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096


def test_query_packs_every_document(spark, base_dir, encoder):
    found = Q.op1_packing(spark, base_dir).collect()
    docs = {r.doc_id: [r.text] for r in spark.read.parquet(f"{base_dir}/documents.parquet").collect()}
    check_packing(found, docs, encoder)


def test_packing_stands_awkward_rows(spark, encoder):
    df = R.awkward(spark)
    docs = defaultdict(list)
    for r in df.collect():
        docs[r.doc_id].append(r.text)
    check_packing(packing.packed(df, packing.default_tokenizer()).collect(), docs, encoder)
    assert packing.packed(R.empty(spark), packing.default_tokenizer()).count() == 0


def filled(sizes, most=3):
    """Targets by repeated resharing of what is above the limit."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [n for n in names if n not in fixed]
        left = total - sum(fixed.values())
        share = {n: left * weight[n] / max(1, sum(weight[o] for o in open_)) for n in open_}
        above = [n for n in open_ if share[n] > most * sizes[n]]
        if not above:
            return fixed | share
        fixed |= {n: most * sizes[n] for n in above}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 1, None: 50}, {"a": 10}, {"Z": 0, "a": 7, "é": 1000}, {"a": 0, None: 0}, {"a": 1, "b": 1, "c": 1000, "d": 3},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    expected = filled(sizes)
    assert got.keys() == expected.keys()
    assert all(abs(got[n] - expected[n]) < 1e-9 * max(1, expected[n]) for n in got)


def test_hypergeometric_draws(spark):
    from math import comb

    u = mixing.unit_hash(F.col("id"), seed=3)
    long = lambda n: F.lit(n).cast("long")
    drawn = spark.range(20_000).select(mixing.hypergeometric(long(50), long(20), long(10), u).alias("x")).groupBy("x").count()
    for r in drawn.collect():
        p = comb(20, r.x) * comb(30, 10 - r.x) / comb(50, 10)
        assert abs(r["count"] - 20_000 * p) < 5 * (20_000 * p) ** 0.5 + 5
    edge = spark.range(1).select(
        mixing.hypergeometric(long(0), long(0), long(0), F.lit(0.5)).alias("a"),
        mixing.hypergeometric(long(5), long(5), long(3), F.lit(0.9)).alias("b"),
        mixing.hypergeometric(long(5), long(0), long(3), F.lit(0.1)).alias("c")).first()
    assert tuple(edge) == (0, 3, 0)


def test_tree_splits_quotas_exactly(spark):
    quotas = {1: 1000, 2: 0, 3: 7, 4: 123}
    dealt = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "number int, quota long"), depth=3).collect()
    shares = defaultdict(int)
    for number, quota in quotas.items():
        own = sorted((r for r in dealt if r.number == number), key=lambda r: r.shard)
        assert [r["from"] for r in own] == [0, *[r["to"] for r in own[:-1]]] and own[-1]["to"] == quota and len(own) == 8
        for r in own:
            shares[r.shard] += r["to"] - r["from"]
    assert max(shares.values()) - min(shares.values()) <= 3


def test_mix_comes_near_its_targets_and_reruns_agree(spark, base_dir):
    first = Q.op10_mixing(spark, base_dir).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, Q.op10_mixing(spark, base_dir).collect()))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{base_dir}/documents.parquet").collect()}
    taken, target, sizes = defaultdict(int), {}, defaultdict(int)
    for r in first:
        own = docs[r.doc_id]
        assert r["size"] == len((own.text or "").encode().split()) and r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[own.source] += r.taken
        sizes[own.source] += r["size"]
        target[own.source] = r.target
    expected = filled(sizes)
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 20
    mix = mixing.mixed(spark.read.parquet(f"{base_dir}/documents.parquet"), places=True)
    count = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert count == {r.doc_id: r.taken // r["size"] for r in first if r.taken}
    assert mix.groupBy("doc_id", "mix_copy").agg(F.countDistinct("mix_shard").alias("n")).where("n > 1").count() == 0


def test_mixing_stands_awkward_rows(spark):
    df = R.awkward(spark)
    got = mixing.mix_counts(df).collect()
    assert len(got) == df.count()
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.taken // r["size"] for r in got if r["size"]) + sum(
        1 for r in out.collect() if not (r.text or "").split())
    assert mixing.mix_counts(R.empty(spark)).count() == 0 and mixing.mixed(R.empty(spark)).count() == 0


def test_targets_are_met_without_ids_and_with_repeated_rows(spark):
    """Sources of five-word documents: no ids and other texts, one id and text, ids that repeat."""
    rows = [(None, f"a b c d e{i}", "a") for i in range(1000)] + [(7, "one text of five words", "b")] * 1000
    rows += [(i % 3, f"v w x y z{i % 5}", "c") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"__block": F.lit(1), "__copy": F.lit("x"), "__order": F.lit(2), "key": F.lit("k"), "same": F.lit(9)}).repartition(3)
    got = mixing.mix_counts(df).collect()
    assert len(got) == 3000 and all(r["size"] == 5 and r.taken <= 15 for r in got)
    targets = sorted({round(r.target, 6) for r in got})
    assert targets == [2500.0, 5000.0, 7500.0]
    per = defaultdict(int)
    for r in got:
        per[round(r.target, 6)] += r.taken
    assert all(abs(per[t] - t) <= 0.01 * t for t in targets), per
    out = mixing.mixed(df, places=True)
    count = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert {s: 5 * n for s, n in count.items()} == {"a": per[2500.0], "b": per[5000.0], "c": per[7500.0]}
    assert out.columns == [*df.columns, "mix_shard", "mix_copy"] and out.where("`__copy` <> 'x' or `__block` <> 1").count() == 0


def test_counts_come_through_the_tree(spark, monkeypatch):
    """A tree that gives shards less takes less."""
    df = spark.createDataFrame([(i, "a b", "s") for i in range(500)], "doc_id long, text string, source string")
    whole = sum(r.taken for r in mixing.mix_counts(df).collect())
    right = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: right(*a).where("shard < 4"))
    part = sum(r.taken for r in mixing.mix_counts(df).collect())
    assert whole == 1000 and 0.15 * whole < part < 0.35 * whole
