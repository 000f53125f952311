"""Secret scans with a guess-cost model for credential values.

Base spans come from three patterns: ``assign`` (a credential name, a sign and a
value), ``access`` (AKIA keys) and ``hex`` (long hexadecimal runs). The method then
looks at the value behind every credential cue, a wider set than the assigned names,
and prices it: the cheapest segmentation into common words, dates, repeats, keyboard
walks and brute-force stretches, by dynamic programming over the value. A value that
costs at least ``MIN_COST`` decimal digits of guesses is added as a ``value`` span.

Common words are ranked by their count over all texts; a word belongs when it makes up
``WORD_SHARE`` of all alphabetic words, so that there are at most 1 / WORD_SHARE.

Spans are half-open code-point ranges of the whole text. Null counts as empty and has
none; repeated rows are scanned as often as they come; an empty table gives an empty
result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import kept, slices, word_table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "value")
WORD_SHARE = 1e-5
MIN_COST = 9.0

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
VALUE = re.compile(r"""["'`]?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+(?:is|was)[ \t]+)["'`]?([^\s"'`<>,;]{6,})""")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CUES = (*NAMES, "passphrase", "passcode", "pwd", "credential", "credentials", "bearer", "private_key",
        "access_key", "client_secret", "auth_key", "login_key")
#: Neighbours on a keyboard, row by row.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"
                  r"|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}")
LONGEST_WORD = 24


def neighbours() -> frozenset[str]:
    pairs = {a + b for row in ROWS for a, b in zip(row, row[1:])}
    return frozenset(pairs | {p[::-1] for p in pairs})


class GuessCost:
    """Decimal digits of guesses that a value needs at least."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.walks = neighbours()

    def __call__(self, value: str) -> float:
        lower = value.lower() if value.isascii() else value.encode().lower().decode()
        n = len(value)
        kinds = (str.islower, 26), (str.isupper, 26), (str.isdigit, 10)
        size = sum(count for test, count in kinds if any(map(test, value)))
        size += 33 * any(not c.isalnum() for c in value) + 100 * (not value.isascii())
        guess = math.log10(max(size, 10))
        cost = [0.0] + [math.inf] * n
        runs = self._runs(lower)
        for at in range(n):
            here = cost[at] + (0.3 if at else 0.0)  # a further segment
            if cost[at] + guess < cost[at + 1]:
                cost[at + 1] = cost[at] + guess
            for end in range(at + 3, min(n, at + LONGEST_WORD) + 1):
                rank = self.ranks.get(lower[at:end])
                if rank is not None:
                    case = 0.0 if value[at:end] == lower[at:end] else 0.3 * sum(map(str.isupper, value[at:end]))
                    cost[end] = min(cost[end], here + math.log10(rank + 1) + case)
            for end, price in runs.get(at, ()):
                cost[end] = min(cost[end], here + price)
        return cost[n]

    def _runs(self, lower: str) -> dict[int, list[tuple[int, float]]]:
        """Where dates, repeats of a character or a block, and keyboard walks end, and their cost."""
        found: dict[int, list[tuple[int, float]]] = {}

        def add(start: int, end: int, price: float) -> None:
            found.setdefault(start, []).append((end, price))

        for m in DATE.finditer(lower):
            add(m.start(), m.end(), 2.1 if m.end() - m.start() == 4 else 4.6)
        for period in range(1, 9):
            start = 0
            for i in range(period, len(lower) + 1):
                if i == len(lower) or lower[i] != lower[i - period]:
                    if i - start >= max(3, 2 * period):
                        add(start, i, 1.5 * period + math.log10(i - start))
                    start = i - period + 1
        start = 0
        for i in range(1, len(lower) + 1):
            if i == len(lower) or lower[i - 1 : i + 1] not in self.walks:
                if i - start >= 4:
                    add(start, i, 2.0 + 0.4 * (i - start))
                start = i
        return found


def automaton():
    import ahocorasick

    built = ahocorasick.Automaton()
    for cue in CUES:
        built.add_word(cue, cue)
    built.make_automaton()
    return built


class Scanner:
    def __init__(self, ranks: dict[str, int], min_cost: float = MIN_COST):
        self.cues, self.cost, self.min_cost = automaton(), GuessCost(ranks), min_cost

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all spans, by start and then by kind's place in KINDS."""
        text = text or ""
        found = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        places = sorted((last - len(cue) + 1, last + 1, cue) for last, cue in self.cues.iter(text.encode().lower().decode()))
        values, done = set(), 0
        for start, end, cue in places:
            if start >= done and cue in NAMES and (m := ASSIGN.match(text, start)):
                done = m.end()
                if m.end() - m.start(2) >= 6:
                    found.append((start, m.end(), "assign"))
            if m := VALUE.match(text, end):
                values.add(m.span(1))
        for start, end in values:
            if self.cost(text[start:end]) >= self.min_cost:
                found.append((start, end, "value"))
        place = {k: i for i, k in enumerate(KINDS)}
        return sorted(found, key=lambda s: (s[0], place[s[2]], s[1]))


def common_words(df: DataFrame, text_col: str = "text", share: float = WORD_SHARE) -> dict[str, int]:
    """Rank, from 0, of every word of A-Z letters that makes up ``share`` of them all;
    at most 1 / share words, so the driver holds few."""
    counts = kept(word_table(df, text_col).withColumn("word", F.decode("word", "UTF-8"))
                  .where(F.col("word").rlike("^[a-z]{3,24}$")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") >= max(2.0, share * total)).orderBy(F.col("n").desc(), "word")
    return {row["word"]: rank for rank, row in enumerate(common.select("word").collect())}


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = WORD_SHARE,
            min_cost: float = MIN_COST) -> DataFrame:
    """id, the number of spans of each base kind, base_sha256 and all spans of every row."""
    ranks = common_words(df, text_col, share)

    def digest(spans, kinds):
        return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans if kind in kinds)

    def run(batches):
        scan = Scanner(ranks, min_cost)
        for part in slices(batches):
            rows = [scan(t) for t in part.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for *_, k in r) for r in rows], pa.int64()) for kind in BASE_KINDS]
            sums = [hashlib.sha256(digest(r, BASE_KINDS).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(sums, pa.string()), pa.array([digest(r, KINDS) for r in rows], pa.string())],
                [id_col, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}, base_sha256 string, spans string")
