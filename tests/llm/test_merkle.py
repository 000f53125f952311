"""The manifest against a plain tree over all rows at once."""

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from rows import awkward, empty

from tabulon.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(*values):
    texts = [None if v is None else str(v) for v in values]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def slow_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def slow_chain(levels, index):
    chain = []
    for level in levels[:-1]:
        start = index // 8 * 8
        chain.append((level[start:index], level[index + 1 : start + 8]))
        index //= 8
    return chain


def slow_log(levels):
    """Digests in postorder, by recursion."""
    out = []

    def visit(level, index):
        if level:
            for child in range(index * 8, min(index * 8 + 8, len(levels[level - 1]))):
                visit(level - 1, child)
        out.append((level, index, levels[level][index]))

    visit(len(levels) - 1, 0)
    return out


def slow(rows):
    """Result rows for (doc_id, source, lang, n_chars, text)."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((slow_leaf(*row), row))
    order = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        held = sorted(by_lang[lang], key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
        trees[lang] = held, slow_tree([leaf for leaf, _ in held])
    top = slow_tree([trees[lang][1][-1][0] for lang in order])
    root, out = top[-1][0], []
    for number, lang in enumerate(order):
        held, levels = trees[lang]
        for index, (leaf, (doc_id, source, own, n, text)) in enumerate(held):
            chain = slow_chain(levels, index) + slow_chain(top, number)
            digest = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                digest = slow_leaf(doc_id, source, own, n, lower)
            for left, right in chain:
                digest = sha("".join([*left, digest, *right]))
            proof = "".join("".join(left + right) for left, right in chain)
            out.append((doc_id, leaf, levels[-1][0], root, sha(proof), digest, digest == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def plain(df):
    return [tuple(r) for r in df.select(*merkle.COLUMNS).collect()]


@pytest.mark.parametrize("base", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_slow_version(spark, base):
    rows = pq.read_table(f"{base}/documents.parquet", columns=list(merkle.COLUMNS)).to_pylist()
    result = got(queries.op12_merkle(spark, base))
    assert result == slow([tuple(r[c] for c in merkle.COLUMNS) for r in rows])
    assert 0 < sum(r[-1] for r in result) < len(result)


def proved(df, levels):
    return merkle.proofs(merkle.built(df, claimed=merkle.lowered_leaf(), levels=levels), levels=levels)


def test_small_builders_and_many_bands(spark):
    langs = ["en"] * 700 + ["de"] * 64 + ["zh"] * 65 + ["fr"] + [None] * 9 + ["É", "Z", "a"] + [f"l{i}" for i in range(70)]
    rows = [(i if i % 50 else None, f"s{i % 3}", lang, i, f"Text {i}") for i, lang in enumerate(langs)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    for levels in (1, 2):
        assert got(proved(df, levels)) == slow(plain(df))


def test_whole_proofs_hash_to_their_checksum(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, "A") for i in range(30)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.proofs(merkle.built(df, levels=1), levels=1, whole=True).collect()
    assert len(rows) == 30 and all(sha(r.proof) == r.proof_sha256 and r.verified for r in rows)


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("tree", F.lit("x")).withColumn("idx", F.lit(None)).withColumn("leaf", F.lit("y"))
    assert got(proved(df, 1)) == slow(plain(df))
    assert proved(empty(spark), 1).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73, 512, 600])
def test_positions_follow_from_sizes(n):
    levels = slow_tree([sha(str(i)) for i in range(n)])
    expected = slow_log(levels)
    assert merkle.height(n) == len(levels) - 1
    assert merkle.append_log(levels[0], merkle.height(n)) == [digest for _, _, digest in expected]
    for place, (level, index, _) in enumerate(expected):
        assert merkle.position(level, index, n, merkle.height(n)) == place


def test_log_holds_every_node_once(spark):
    rows = [(i, "s", "a" if i < 90 else "b", 1, str(i)) for i in range(91)]
    manifest = merkle.built(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), levels=1)
    log = sorted(map(tuple, merkle.log(manifest, levels=1).collect()))
    expected = [
        (lang, place, *node) for lang, part in (("a", rows[:90]), ("b", rows[90:]))
        for place, node in enumerate(slow_log(slow_tree([slow_leaf(*r) for r in part])))
    ]
    assert log == sorted(expected)
