"""Quality rules, fingerprints, personal data, secrets and the language model against slow versions."""

import collections
import itertools
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import rows as R  # noqa: E402

from tabulon.llm import hmm, pii, quality, queries as Q, secrets, simhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, base_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{base_dir}/documents.parquet").collect()}


# quality rules

def slow_features(text):
    own = WORD.findall(text or "")
    windows = collections.Counter(zip(own, own[1:], own[2:]))
    covered = {j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_base_features():
    choose = random.Random(2)
    for _ in range(3000):
        text = "".join(choose.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "<", "\x1c", " "]) for _ in range(choose.randint(0, 40)))
        assert quality.base_features(text) == slow_features(text), repr(text)


def boilerplate(spark):
    line = "All rights reserved by the publisher of this site"
    rows = [(i, "\n".join([R.text(i), line, R.text(1000 + i)]), "s") for i in range(30)]
    rows += [(100 + i, "\n".join([line] * 9 + [f"only these {i} words"]), "s") for i in range(3)]
    rows += [(200 + i, R.text(77) + f"\nown line {i}", "s") for i in range(60)]  # copies of one document
    rows += [(300 + i, R.text(i), "t") for i in range(3)]
    # near copies: each has one of ten lines changed
    rows += [(400 + i, "\n".join(f"changed {i} here" if j == i % 10 else x for j, x in enumerate(R.text(55, 10).split("\n"))), "s")
             for i in range(300)]
    return line, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))


def slow_frequent(df, limit):
    keys, texts = collections.defaultdict(set), collections.defaultdict(set)
    for r in df.collect():
        hashes = set(quality.line_table(r.text)[0])
        for h in hashes:
            keys[r.source, h].add(min(hashes - {h}, default=None))
            texts[r.source, h].add(r.text)
    return {k for k, v in keys.items() if len(v) > limit and 2 * len(v) >= len(texts[k])}


def test_frequent_lines_go_and_depleted_documents_too(spark):
    line, df = boilerplate(spark)
    judged, frequent = quality.judged(df, limit=10)
    assert {(r.host, r.line) for r in frequent.collect()} == slow_frequent(df, 10)
    got = {r.doc_id: r for r in judged.collect()}
    assert got[5].kept and got[5].removed_words == 9 and not any(got[100 + i].kept for i in range(3))
    assert all(got[200 + i].kept and got[200 + i].removed_words == 0 for i in range(60))  # copies count once
    assert all(got[400 + i].kept and got[400 + i].removed_words == 0 for i in range(300))
    clean = {r.doc_id: r for r in quality.cleaned(df, limit=10, length_col="n_chars").collect()}
    assert set(clean) == {i for i, r in got.items() if r.kept}
    assert line not in clean[5].text and len(clean[5].text) == clean[5].n_chars and R.text(5) in clean[5].text


def test_shared_lines_of_template_pages_dont_hide_each_other(spark):
    """Many shared lines and few own ones: all shared lines go, copies with changed words stay."""
    shapes = [(2, 5), (5, 5), (5, 2), (8, 2), (8, 1), (20, 2)]
    rows, shared = [], {}
    for k, (s, u) in enumerate(shapes):
        host = f"{s} shared, {u} own"
        shared[host] = {quality.line_hash(x) for x in R.text(9000 + k, s).split("\n")}
        rows += [(1000 * k + i, R.text(9000 + k, s) + "\n" + R.text(100_000 + 1000 * k + i, u), host) for i in range(500)]
    choose = random.Random(3)
    for i in range(400):  # one word in fifteen changed
        text = "\n".join(" ".join(f"w{choose.randrange(10**9):x}" if choose.random() < 1 / 15 else w for w in line.split())
                         for line in R.text(8999).split("\n"))
        rows.append((20_000 + i, text, "copies"))
    _, frequent = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = collections.defaultdict(set)
    for r in frequent.collect():
        found[r.host].add(r.line)
    assert found == shared


def test_join_gives_the_same_as_the_broadcast(spark, monkeypatch):
    _, df = boilerplate(spark)
    by_broadcast = sorted(map(tuple, quality.cleaned(df, limit=10, length_col="n_chars").collect()))
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, quality.cleaned(df, limit=10, length_col="n_chars").collect())) == by_broadcast


def test_quality_query(spark, base_dir):
    docs = documents(spark, base_dir)
    found = Q.op6_quality(spark, base_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        own = slow_features(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert r.kept == (not r.base_failed and r.n_words - r.removed_words >= 0.3 * r.n_words)


def test_quality_stands_awkward_rows(spark):
    df = R.awkward(spark)
    judged, _ = quality.judged(df)
    assert judged.count() == df.count()
    clean = quality.cleaned(df, length_col="n_chars")
    assert clean.columns == df.columns
    assert clean.count() == judged.where("kept").count() == 5
    assert quality.judged(R.empty(spark))[0].count() == 0 and quality.cleaned(R.empty(spark)).count() == 0


# fingerprints

def slow_fingerprint(text):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(points, bits=2):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= bits).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(points))])


def clouds(seed, centres=60, n=2000, spread=6):
    choose = np.random.default_rng(seed)
    base = choose.integers(0, 2**63, centres, dtype=np.uint64) * 2
    points = []
    for _ in range(n):
        point = int(base[choose.integers(centres)])
        for bit in choose.integers(0, 64, choose.integers(0, spread)):
            point ^= 1 << int(bit)
        points.append(point)
    return np.unique(np.array(points, np.uint64))


@pytest.mark.parametrize("centres,spread", [(60, 6), (1, 4), (1, 9), (400, 3)])
def test_local_trees_and_shards_lose_no_link(centres, spread):
    points = clouds(centres, centres, 1500, spread)
    assert (simhash.local_groups(points, leaf=64) == slow_groups(points)).all()
    who, shard = simhash.homes(points, simhash.fit_tree(points, 16))
    places = collections.defaultdict(set)
    for i, s in zip(who.tolist(), shard.tolist()):
        places[i].add(s)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= 2).tolist():
            assert places[i] & places[j]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 4000), (4000, 4500), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1100))
    assert got[5000] == got[4500] == 4000
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query_and_many_shards(spark, base_dir):
    docs = documents(spark, base_dir)
    ids = sorted(docs)
    prints = np.array([slow_fingerprint(docs[i].text) for i in ids], np.uint64)
    groups = slow_groups(prints)
    expected = {i: (f"{int(p):016x}", ids[g]) for i, p, g in zip(ids, prints, groups)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op8_simhash(spark, base_dir).collect()} == expected
    small = simhash.near_duplicates(spark.read.parquet(f"{base_dir}/documents.parquet"), shard_rows=20)
    assert {r.doc_id: r.component_id for r in small.collect()} == {i: c for i, (_, c) in expected.items()}


def test_simhash_stands_awkward_rows(spark):
    df = R.awkward(spark)
    found = simhash.near_duplicates(df).collect()
    assert len(found) == df.count()
    by_id = collections.defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.fp, r.component_id))
    assert by_id[2] == by_id[3] == by_id[4] == {(0, 2)} and {c for _, c in by_id[9]} == {1}
    one = simhash.one_of_each(df)
    assert one.columns == df.columns
    ids = [r.doc_id for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 6, 7, 8, 10] and ids.count(None) == 1
    assert simhash.near_duplicates(R.empty(spark)).count() == 0 and simhash.one_of_each(R.empty(spark)).count() == 0


# personal data

def slow_personal(text):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_personal_data_against_patterns():
    find, choose = pii.Finder(), random.Random(1)
    for _ in range(15_000):
        text = "".join(choose.choice("@.+-() 0123456789 aé@.1.2.3\n25,４") for _ in range(choose.randint(0, 60)))
        assert [s for s in find(text) if s[2] in pii.BASE_KINDS] == slow_personal(text), repr(text)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_prose_with_numbers_is_no_address():
    find = pii.Finder()
    for text in ("5 miles down the road", "2019 she moved abroad", "12 inches broad", "3 hours of night drive", "5 square metres",
                 "40 when he died. The square", "20 for every seat in the airplane", "In 1990 Tom Smith died. Baker Street was empty",
                 "3 of the Kings Road", "2 Kings of the Road", "12\nOld Street", "3 Americans drive north", "7 Main Streets"):
        assert find(text) == [], text
    for address in ("12 Old Main Street", "221b Baker street", "9 St. John's Road", "4 Isle of Man Avenue", "7 Éluard Square, Town 12345",
                    "15 Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch Wolfeschlegelsteinhausenbergerdorff Memorial Hill North Lane"):
        text = f"at ({address}, there"
        assert [text[start:end] for start, end, _ in find(text)] == [address], address


def test_added_kinds_and_masking():
    find = pii.Finder()
    text = "IBAN: DE89 3704 0044 0532 0130 00, 12 Old Main Street, Town 12345; account no: AB123456; http://me:pw@h.example.org/ a@b.org"
    kinds = [k for *_, k in find(text)]
    assert {"account", "address", "login", "email"} <= set(kinds) and kinds.count("account") == 2
    masked = pii.masked_text(text, find(text))
    assert not find(masked) and "[ADDRESS]" in masked and masked.startswith("IBAN: [ACCOUNT],")
    assert find("IBAN: DE88 3704 0044 0532 0130 00") == [] and find(None) == []
    assert pii.masked_text("plain", []) == "plain"


def test_personal_data_query_and_awkward_rows(spark, base_dir):
    import hashlib

    docs = documents(spark, base_dir)
    for r in Q.op9_pii(spark, base_dir).collect():
        own = slow_personal(docs[r.doc_id].text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in own) for kind in pii.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in own).encode()).hexdigest()
    df = R.awkward(spark)
    assert pii.personal_data(df).count() == df.count()
    assert sorted(pii.masked(df, length_col="n_chars").collect(), key=str) == sorted(df.collect(), key=str)
    assert pii.personal_data(R.empty(spark)).count() == 0 and pii.masked(R.empty(spark)).count() == 0


# secrets

def slow_secrets(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(*m.span(), "assign") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secrets_against_patterns():
    scan, choose = secrets.Scanner({"the": 0, "monkey": 9}), random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", " ", "=", ":", "'", '"', "abc", "AKIA", "X9Z", "0f", "é", "pwd", "aaaaaa",
             "123456", " is ", "ſecret", "toKen", "KEY"]
    for _ in range(15_000):
        text = "".join(choose.choice(parts) for _ in range(choose.randint(0, 25)))
        assert [s for s in scan(text) if s[2] != "value"] == slow_secrets(text), repr(text)


def test_guess_cost_is_the_cheapest_segmentation():
    ranks = {"monkey": 9, "key": 99, "dragon": 20}
    cost = secrets.GuessCost(ranks)

    def slow(value):
        lower, n = value.lower(), len(value)
        runs = cost._runs(lower)
        size = sum(c for t, c in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)) if any(map(t, value)))
        size += 33 * any(not c.isalnum() for c in value)
        guess, best = math.log10(max(10, size)), math.inf
        for cuts in itertools.product((0, 1), repeat=n - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
            total, at = 0.0, 0
            for end in ends:
                own = [guess] if end == at + 1 else []
                extra = 0.3 if at else 0.0
                if lower[at:end] in ranks and end - at >= 3:
                    own.append(extra + math.log10(ranks[lower[at:end]] + 1) + 0.3 * sum(map(str.isupper, value[at:end])))
                own += [extra + p for e, p in runs.get(at, ()) if e == end]
                total, at = total + min(own, default=math.inf), end
            best = min(best, total)
        return best

    for value in ("monkey1", "Monkeykey", "qwerty99", "aaaaaa", "2024-01-31", "dragonkey", "abcabcabc", "x7K!qLm"):
        assert abs(cost(value) - slow(value)) < 1e-9, value
    assert cost("monkeydragon") < cost("x7#Kq!92Lmzw") and cost("a" * 5000) < 10


def test_values_behind_cues_are_added():
    scan = secrets.Scanner({"welcome": 3})
    kinds = lambda t: [k for *_, k in scan(t)]
    assert kinds("pwd: x7#Kq!92Lmzw") == ["value"] and kinds("pwd: welcome") == [] and kinds("the pwd is welcome2") == []
    assert kinds("password=hunter") == ["assign"] and kinds(None) == []


def test_secrets_query_and_awkward_rows(spark, base_dir):
    docs = documents(spark, base_dir)
    for r in Q.op5_secrets(spark, base_dir).collect():
        own = slow_secrets(docs[r.doc_id].text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for *_, k in own) for kind in secrets.BASE_KINDS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("value")] == [f"{k}:{s}:{e}" for s, e, k in own]
    df = R.awkward(spark)
    assert secrets.secrets(df).count() == df.count() and secrets.secrets(R.empty(spark)).count() == 0


# language model

def random_model():
    choose = np.random.default_rng(0)
    model = hmm.Model([b"", b"a", b"b"], np.array([5, 3, 2]), 4, 3)
    model.move, model.start = choose.dirichlet([1, 1, 1], 3), choose.dirichlet([1, 1, 1])
    return model, [np.array(choose.integers(0, 4, k), np.int32) for k in (1, 2, 5, 6, 3)]


def paths(model, s):
    for p in itertools.product(range(3), repeat=len(s)):
        yield p, model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(
            model.move[p[i - 1], p[i]] * model.emit[s[i], p[i]] for i in range(1, len(s)))


def test_forward_and_expected_counts_by_enumeration(monkeypatch):
    model, sequences = random_model()
    exact = [math.log(sum(w for _, w in paths(model, s))) for s in sequences]
    assert np.allclose(hmm.forward_log(model, sequences), exact)
    start, move, emit = hmm.expected(model, sequences, np.ones(5, bool))
    slow = np.zeros(3), np.zeros((3, 3)), np.zeros((model.pad, 3))
    for s, log in zip(sequences, exact):
        for p, w in paths(model, s):
            slow[0][p[0]] += w / math.exp(log)
            for i, symbol in enumerate(s):
                slow[2][symbol, p[i]] += w / math.exp(log)
                if i:
                    slow[1][p[i - 1], p[i]] += w / math.exp(log)
    assert all(np.allclose(a, b) for a, b in zip((start, move, emit), slow))
    monkeypatch.setattr(hmm, "SEGMENT", 2)
    assert np.allclose(hmm.forward_log(model, sequences), exact)


def test_rounds_raise_the_likelihood():
    model, _ = random_model()
    choose = np.random.default_rng(3)
    texts = [np.array([*choose.choice([[1, 1, 2], [3, 3, 2]][i % 2], 30), 0], np.int32) for i in range(40)]
    before = hmm.forward_log(model, texts).sum()
    for _ in range(5):
        model.learn(*hmm.expected(model, texts, np.ones(len(texts), bool)))
        after = hmm.forward_log(model, texts).sum()
        assert after > before - 1e-2
        before = after


def test_language_model_query(spark, base_dir):
    docs = documents(spark, base_dir)
    own = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for i, r in docs.items()}
    counts = collections.Counter(w for i, ws in own.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    found = Q.op7_hmm(spark, base_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(own[r.doc_id]), sum(counts[w] > 0 for w in own[r.doc_id]))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    training = [r for r in found if not r.held_out]
    assert sum(r.score for r in training) > sum(r.base_score for r in training)


def test_single_words_sum_to_one(spark):
    """With one state the model is a distribution over words: common, rare and unseen."""
    words = ["a"] * 50 + ["b"] * 30 + ["c", "d", "e"]
    df = spark.createDataFrame([(1, " ".join(words)), *[(10 + i, w) for i, w in enumerate(["a", "b", "c", "d", "e", "unseen", ""])]],
                               "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.scored(df, F.col("doc_id") == 1, states=1, rounds=1, share=0.1).collect()}
    end = 10 ** got[16]
    assert abs(sum(10 ** got[10 + i] / end for i in range(6)) + end - 1) < 1e-9


def test_language_model_stands_awkward_rows(spark):
    df = R.awkward(spark)
    found = hmm.scored(df, ~hmm.held_out("doc_id")).collect()
    assert len(found) == df.count() and all(math.isfinite(r.score) for r in found)
    assert len({r.score for r in found if r.doc_id in (2, 3, 4)}) == 1
    assert hmm.scored(R.empty(spark), ~hmm.held_out("doc_id")).count() == 0
    nothing = hmm.scored(df, F.lit(False)).collect()
    assert len(nothing) == df.count() and all(r.n_known == r.train_tokens == 0 for r in nothing)


def test_long_runs_of_zeros_are_numbers():
    find = pii.Finder()
    assert find("0" * 10_000 + ".1.1.1") == [(0, 10_006, "ip")]
    assert find("9" * 10_000 + ".1.1.1") == []
    assert find("1.1.1." + "0" * 10_000 + "256") == []
