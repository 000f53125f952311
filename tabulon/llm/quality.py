"""Quality rules with cross-document line frequency.

Every line is normalised (lower case, digits as 0, marks and white space dropped to
single spaces) and hashed. For each host and line, distinct documents are counted;
lines in more than ``limit`` of them are removed, and a document that keeps less than
``keep_share`` of its words is rejected, as is one that fails the base rules (too few
words, too many repeated three-word windows).

Copies count once. A line that more than ``limit`` different texts hold is looked at
closely: its texts are taken in the order of their hashes, and one counts if it is like
none of those counted before, up to ``limit`` + 1. Two texts are alike if they share
``ALIKE`` of their words, or if what they don't share as whole lines is alike
(``REST_ALIKE``): copies with single words changed have similar other lines, pages of
one template have unrelated ones, however few. Resemblance is that of the multisets of
normalised words, estimated by 256 smallest hashes.

Null text has no words and fails the base rules; a null host is a host like others;
repeated rows get the same verdict. An empty table gives an empty result. Other columns
pass unchanged.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import BROADCAST_BYTES, kept, slices, small_or_plain, words

LIMIT = 20
KEEP_SHARE = 0.3
#: Least resemblance of copies: of the whole texts; or of the whole texts, and of what
#: is left of them without the lines that both hold.
ALIKE, PARTLY_ALIKE, REST_ALIKE = 0.9, 0.5, 0.5
#: Texts that are compared in one group, about.
GROUP_TEXTS = 512
BINS = 256
MIN_WORDS = 50
MAX_REPEATED = 0.5
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
DROPPED = re.compile(r"[^\w]+|_+")
DIGIT = re.compile(r"\d")


def line_hash(line: str) -> int:
    """Hash of a normalised line as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    plain = DROPPED.sub(" ", DIGIT.sub("0", line.lower())).strip()
    return xxh64_intdigest(plain.encode()) - (1 << 63)


def line_table(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Hash, number of words, and line number of each line that has a word."""
    hashes, counts, places = [], [], []
    for place, line in enumerate((text or "").split("\n")):
        n = len(words(line))
        if n:
            hashes.append(line_hash(line))
            counts.append(n)
            places.append(place)
    return hashes, counts, places


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    raw = text.encode()
    own = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = Counter(line for line in raw.split(b"\n") if line.split())
    return len(own), chars, symbols, sum(lines.values()) - len(lines), repeated_words(own)


def repeated_words(own: list[bytes]) -> int:
    """Words inside a three-word window that comes twice or more."""
    n = len(own)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(own))}
    ids = np.fromiter(map(number.__getitem__, own), np.int64, n)
    size = len(number)
    code = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # else three numbers fit 63 bits
        code = np.unique(code, return_inverse=True)[1]
    _, which, counts = np.unique(code[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    starts = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= starts
    return int(covered.sum())


def sketch(text: str | None) -> bytes:
    """A byte of the smallest hash in each of 256 ranges, over the normalised words and
    their repeat numbers; 0 where there is none."""
    from xxhash import xxh64_intdigest

    own = DROPPED.sub(" ", DIGIT.sub("0", (text or "").lower())).split()
    if not own:
        return bytes(BINS)
    number = {w: i for i, w in enumerate(dict.fromkeys(own))}
    ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.searchsorted(ids, np.arange(len(number)))
    repeat = (np.arange(len(ids)) - starts[ids]).astype(np.uint64)
    hashes = np.fromiter((xxh64_intdigest(w.encode(), 7) for w in number), np.uint64, len(number))[ids]
    hashes = hashes ^ (repeat * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
    hashes = np.sort(hashes ^ (hashes >> np.uint64(33)))
    places, first = np.unique((hashes >> np.uint64(56)).astype(np.int64), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[places] = 1 + hashes[first] % np.uint64(255)
    return out.tobytes()


class Distinct:
    """Texts of which no two are alike, up to ``limit`` + 1."""

    def __init__(self, limit: int):
        self.limit = limit
        self.sketches = np.zeros((limit + 1, BINS), np.uint8)
        self.lines: list[dict] = []
        self.texts: list[int] = []  # places of the counted texts

    def full(self) -> bool:
        return len(self.texts) > self.limit

    def add(self, place: int, own: np.ndarray, lines: dict) -> None:
        others = self.sketches[: len(self.texts)]
        either = np.count_nonzero(others | own, axis=1)
        same = np.count_nonzero((others == own) & (own > 0), axis=1) / np.maximum(either, 1)
        if (same >= ALIKE).any():
            return
        for at in np.flatnonzero(same >= PARTLY_ALIKE):
            theirs = self.lines[at]
            size = sum(lines.values()) + sum(theirs.values())
            shared = sum(n for line, n in lines.items() if line in theirs)
            rest = same[at] / (1 + same[at]) * size - shared
            if rest >= REST_ALIKE * (size - 2 * shared - rest):
                return
        self.sketches[len(self.texts)] = own
        self.lines.append(lines)
        self.texts.append(place)


def distinct_texts(table: pa.Table, limit: int) -> pa.Table:
    """Of one line's texts, those that count; only one row, ``full``, if over ``limit`` do."""
    table = table.sort_by("text_hash")
    found = Distinct(limit)
    lines, counts = table.column("lines"), table.column("line_words")
    for place, own in enumerate(table.column("sketch")):
        # lines that come again add their words, so that both sides hold them alike
        words_of: dict = {}
        for line, n in zip(lines[place].as_py(), counts[place].as_py()):
            words_of[line] = words_of.get(line, 0) + n
        found.add(place, np.frombuffer(own.as_py(), np.uint8), words_of)
        if found.full():
            break
    out = table.take(pa.array(found.texts[:1] if found.full() else found.texts, pa.int64()))
    return out.set_column(out.schema.get_field_index("full"), "full", pa.array([found.full()] * len(out), pa.bool_()))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(df: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeated: float) -> DataFrame:
    """doc, host, text_hash, the features, base_failed, hashes and words of the lines, and the sketch."""
    def run(batches):
        from xxhash import xxh64_intdigest

        for part in slices(batches):
            texts = part.column(1).to_pylist()
            numbers = [base_features(t) for t in texts]
            lines = [line_table(t) for t in texts]
            failed = [n < min_words or 100 * repeated > 100 * max_repeated * n for n, *_, repeated in numbers]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2),
                 pa.array(np.array([xxh64_intdigest((t or "").encode(), 42) for t in texts], np.uint64).view(np.int64)),
                 *[pa.array(list(v), pa.int64()) for v in (zip(*numbers) if numbers else [[]] * 5)],
                 pa.array(failed, pa.bool_()),
                 pa.array([x[0] for x in lines], pa.list_(pa.int64())),
                 pa.array([x[1] for x in lines], pa.list_(pa.int64())),
                 pa.array([sketch(t) for t in texts], pa.binary())],
                ["doc", "host", "text_hash", *FEATURES, "base_failed", "lines", "line_words", "sketch"],
            )

    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, host_col)}
    numbers = ", ".join(f"{n} long" for n in FEATURES)
    schema = f"doc {kinds[id_col]}, host {kinds[host_col]}, text_hash long, {numbers}, base_failed boolean, " \
             "lines array<long>, line_words array<long>, sketch binary"
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(host_col).alias("host")).mapInArrow(run, schema)


def frequent_lines(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """host, line and documents of the lines in more than ``limit`` distinct documents of a host.

    Lines of few different texts go first. A line's other texts are compared in groups of
    about ``GROUP_TEXTS``, by hash, and what the groups count is compared again, unless
    one group alone is over the limit. ``documents`` stops at ``limit`` + 1.
    """
    lines = rows.select("host", "text_hash", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > limit)
    held = kept(held.select(F.col("host").alias("h"), F.col("line").alias("l"), F.ceil(F.col("texts") / GROUP_TEXTS).alias("groups")))
    wide = rows.select("host", "text_hash", F.struct("lines", "line_words", "sketch").alias("own"),
                       F.explode(F.array_distinct("lines")).alias("line"))
    wide = wide.join(small_or_plain(held, 64), F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    texts = wide.groupBy("host", "line", "groups", "text_hash").agg(F.min("own").alias("own"))
    texts = texts.select("host", "line", F.pmod(F.xxhash64("text_hash"), F.col("groups")).alias("part"), "text_hash", "own.*",
                         F.lit(False).alias("full"))
    first = kept(texts.groupBy("host", "line", "part").applyInArrow(lambda t: distinct_texts(t, limit), texts.schema))
    over = first.where("full").select("host", "line").distinct()
    rest = first.join(over.select(F.col("host").alias("h"), F.col("line").alias("l")),
                      F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_anti")
    again = rest.groupBy("host", "line").applyInArrow(lambda t: distinct_texts(t, limit), texts.schema)
    return over.unionByName(again.where("full").select("host", "line")).withColumn("documents", F.lit(limit + 1).cast("long"))


def removed_lines(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc, h (host), text_hash and gone: the hashes of its frequent lines, for documents that have any."""
    lines = rows.select("doc", F.col("host").alias("h"), "text_hash", F.explode(F.array_distinct("lines")).alias("hash"))
    of_line = small_or_plain(frequent.select("host", "line"), 64)
    hits = lines.join(of_line, F.col("h").eqNullSafe(F.col("host")) & (F.col("hash") == F.col("line")))
    return hits.groupBy("doc", "h", "text_hash").agg(F.collect_set("hash").alias("gone"))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           limit: int = LIMIT, keep_share: float = KEEP_SHARE, min_words: int = MIN_WORDS,
           max_repeated: float = MAX_REPEATED) -> tuple[DataFrame, DataFrame]:
    """Rows with the features, removed_words, base_failed and kept, and the frequent lines."""
    rows = kept(features(df, id_col, text_col, host_col, min_words, max_repeated))
    frequent = kept(frequent_lines(rows, limit))
    removed = removed_lines(rows, frequent).select(
        F.col("doc").alias("d"), "h", F.col("text_hash").alias("t"), "gone")
    same = F.col("doc").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("text_hash") == F.col("t"))
    found = rows.join(removed, same, "left")
    gone = F.coalesce("gone", F.array().cast("array<bigint>"))
    lost = F.aggregate(
        F.zip_with("lines", "line_words", lambda h, n: F.when(F.array_contains(gone, h), n).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a + b)
    found = found.withColumn("removed_words", lost)
    depleted = (F.col("n_words") - F.col("removed_words")) < keep_share * F.col("n_words")
    found = found.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return found.select(
        F.col("doc").alias(id_col), "host", "text_hash", *FEATURES, "removed_words", "base_failed", "kept",
        F.col("gone").alias("removed_lines"),
    ), frequent


def verdict(text: str | None, gone, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED,
            keep_share: float = KEEP_SHARE) -> tuple[bool, str | None]:
    """Whether a text is kept, and the text without the lines whose hashes are in ``gone``."""
    n, *_, repeated = base_features(text)
    if n < min_words or 100 * repeated > 100 * max_repeated * n:
        return False, text
    hashes, counts, places = line_table(text)
    out = {place for h, place in zip(hashes, places) if h in gone}
    lost = sum(count for h, count in zip(hashes, counts) if h in gone)
    if n - lost < keep_share * n:
        return False, text
    if out:
        text = "\n".join(line for place, line in enumerate(text.split("\n")) if place not in out)
    return True, text


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            length_col: str | None = None, limit: int = LIMIT, keep_share: float = KEEP_SHARE,
            min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> DataFrame:
    """The rows that stay, with all their columns and without frequent lines.

    Where the frequent lines fit a broadcast of checked size, every row is judged where
    it is read. Otherwise the lines removed from each document come by a join.
    """
    names = df.columns
    rows = kept(features(df, id_col, text_col, host_col, min_words, max_repeated))
    frequent = kept(frequent_lines(rows, limit))

    def judge(batches, lines_of, last):
        for part in slices(batches):
            texts = part.column(names.index(text_col)).to_pylist()
            hosts = part.column(names.index(host_col)).to_pylist()
            extra = part.column(last).to_pylist() if last is not None else [None] * len(texts)
            got = [verdict(t, lines_of(h, x), min_words, max_repeated, keep_share) for t, h, x in zip(texts, hosts, extra)]
            stay = pa.array([keep for keep, _ in got], pa.bool_())
            columns = list(part.columns)[: len(names)]
            columns[names.index(text_col)] = pa.array([t for _, t in got], pa.string())
            if length_col:
                old = columns[names.index(length_col)]
                lengths = [n if t == b else len(t) for n, (_, t), b in zip(old.to_pylist(), got, texts)]
                columns[names.index(length_col)] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(stay)

    if frequent.count() * 64 <= BROADCAST_BYTES:
        lines: dict = {}
        for row in frequent.select("host", "line").toLocalIterator():
            lines.setdefault(row["host"], set()).add(row["line"])
        sent = df.sparkSession.sparkContext.broadcast(lines)
        nothing = frozenset()
        return df.mapInArrow(lambda b: judge(b, lambda host, _: sent.value.get(host, nothing), None), df.schema)
    found = removed_lines(rows, frequent)
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__doc")) & F.col(host_col).eqNullSafe(F.col("__host")) & (text_hash == F.col("__text"))
    wide = df.join(found.select(F.col("doc").alias("__doc"), F.col("h").alias("__host"), F.col("text_hash").alias("__text"),
                                F.col("gone").alias("__gone")), same, "left").select(*names, "__gone")
    return wide.mapInArrow(lambda b: judge(b, lambda _, gone: frozenset(gone or ()), len(names)), df.schema)
