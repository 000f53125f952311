"""Hidden Markov language model.

Tokens are words with A-Z in lower case, then one end token per text. Words that make
up at least ``COMMON_SHARE`` of the training tokens are emitted by name (at most
1 / COMMON_SHARE of them); all others share one rare symbol, under which a word has
probability (count + 1) / (rare tokens + rare words + 1), unseen words included.

Training is Baum-Welch. In every round each task runs scaled forward and backward
passes over its texts, cut to segments of ``SEGMENT`` tokens, and sends its expected
counts; Spark adds them up, all training texts in every round. Scores are exact: the
scaled forward recursion runs over each whole text, whatever its length, and the rare
words' own factor, which doesn't depend on the states, is added by a join on the words.

Null text counts as empty: the end token alone. A null id counts as training text.
Repeated rows are learned from and scored as often as they come. Without any training
text every count is zero and the model is uniform. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import kept, slices, word_table

STATES = 4
ROUNDS = 3
COMMON_SHARE = 1e-6
SEGMENT = 512
END = b""
LOG10 = np.log(10.0)


def tokens(text) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return [*raw.lower().split(), END]


def held_out(id_col: str, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


class Model:
    """Start, transition and emission probabilities. Symbols: common words in order,
    then the rare symbol, then padding, which every state emits with probability 1."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare: int, states: int = STATES):
        self.words = words
        self.rare, self.pad = len(words), len(words) + 1
        base = np.append(counts, rare).astype(float) + 0.5
        # fixed noise sets the states apart at the start
        noise = np.random.default_rng(7).uniform(0.25, 1.75, (len(base), states))
        self.start = np.full(states, 1 / states)
        self.usual = self.start.copy()
        stay = 0.95
        self.move = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(self.move, stay if states > 1 else 1.0)
        self.emit = self._emission(base[:, None] * noise)

    @staticmethod
    def _emission(weights: np.ndarray) -> np.ndarray:
        return np.vstack([weights / weights.sum(axis=0), np.ones(weights.shape[1])])

    def learn(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """New probabilities from expected counts, each with a little added."""
        self.start = (start + 0.01) / (start + 0.01).sum()
        self.move = (move + 0.01) / (move + 0.01).sum(axis=1, keepdims=True)
        usual = emit.sum(axis=0) + 0.01
        self.usual = usual / usual.sum()
        self.emit = self._emission(emit + 0.01)


def padded(rows: list[np.ndarray], width: int, pad: int) -> np.ndarray:
    """Rows as columns of a time-major table."""
    table = np.full((width, len(rows)), pad, np.int32)
    for i, row in enumerate(rows):
        table[: len(row), i] = row
    return table


def expected(model: Model, segments: list[np.ndarray], firsts: np.ndarray):
    """Expected start, move and emission counts of segments; ``firsts`` begin a text."""
    ids = padded(segments, max(map(len, segments)), model.pad)
    steps, states = len(ids), len(model.start)
    emitted = model.emit[ids]
    forward = np.empty_like(emitted)
    scale = np.empty(ids.shape)
    now = np.where(firsts[:, None], model.start, model.usual)
    for t in range(steps):
        now = (now @ model.move if t else now) * emitted[t]
        scale[t] = now.sum(axis=1)
        now /= scale[t][:, None]
        forward[t] = now
    later = np.empty_like(emitted)  # emission and backward of each step, scaled
    back = np.ones((len(segments), states))
    gamma = np.empty_like(emitted)
    turn = model.move.T
    for t in range(steps - 1, -1, -1):
        gamma[t] = forward[t] * back
        later[t] = emitted[t] * back / scale[t][:, None]
        back = later[t] @ turn
    real = ids != model.pad
    move = np.einsum("tbi,tbj->ij", forward[:-1] * real[1:, :, None], later[1:], optimize=True) * model.move
    weights, flat = gamma[real], ids[real]
    emit = np.stack([np.bincount(flat, weights[:, k], minlength=model.pad) for k in range(states)], axis=1)
    return gamma[0][firsts].sum(axis=0), move, emit


def forward_log(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of every sequence of symbols, exactly."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    total = np.zeros(len(texts))
    now = np.tile(model.start, (len(texts), 1))
    longest = len(texts[order[0]]) if texts else 0
    for at in range(0, longest, SEGMENT):
        active = [i for i in order if len(texts[i]) > at]
        block = [texts[i][at : at + SEGMENT] for i in active]
        ids = padded(block, len(block[0]), model.pad)
        emitted = model.emit[ids]
        state = now[active]
        gained = np.zeros(len(active))
        for t in range(len(ids)):
            state = (state @ model.move if at + t else state) * emitted[t]
            scale = state.sum(axis=1)
            gained += np.log(scale)
            state /= scale[:, None]
        now[active] = state
        total[active] += gained
    return total


def encoded(raws: list, index: dict[bytes, int], rare: int):
    for raw in raws:
        own = tokens(raw)
        yield own, np.fromiter((index.get(w, rare) for w in own), np.int32, len(own))


def train(df: DataFrame, text_col: str, model: Model, rounds: int = ROUNDS) -> None:
    """Baum-Welch over all rows of ``df``, in place."""
    spark, states = df.sparkSession, len(model.start)
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches, sent=sent):
            own = sent.value
            index = {w: i for i, w in enumerate(own.words)}
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((own.pad, states))
            held: list[tuple[np.ndarray, bool]] = []

            def work():
                held.sort(key=lambda s: -len(s[0]))
                for at in range(0, len(held), 1024):
                    some = held[at : at + 1024]
                    got = expected(own, [s for s, _ in some], np.array([f for _, f in some]))
                    for total, part in zip((start, move, emit), got):
                        total += part
                held.clear()

            for part in slices(batches):
                for _, ids in encoded(part.column(0).cast(pa.binary()).to_pylist(), index, own.rare):
                    held += [(ids[at : at + SEGMENT], at == 0) for at in range(0, len(ids), SEGMENT)]
                    if len(held) >= 4096:
                        work()
            work()
            seen = np.flatnonzero(emit.any(axis=1))
            keys = np.concatenate([[-1 - states], np.arange(-states, 0), seen])
            values = np.vstack([start, move, emit[seen]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(values[:, k]) for k in range(states)]],
                                             ["key", *names])

        counts = df.select(text_col).mapInArrow(count, "key long, " + ", ".join(f"{n} double" for n in names))
        summed = counts.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        keys = summed.column("key").to_numpy()
        values = np.stack([summed.column(n).to_numpy() for n in names], axis=1) if len(keys) else np.zeros((0, states))
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((model.pad, states))
        start[:] = values[keys == -1 - states].sum(axis=0)
        for k in range(states):
            move[k] = values[keys == k - states].sum(axis=0)
        emit[keys[keys >= 0]] = values[keys >= 0]
        model.learn(start, move, emit)
        sent.unpersist()


def scored(df: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
           rounds: int = ROUNDS, share: float = COMMON_SHARE) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = df.sparkSession
    training = df.where(is_training)
    counts = kept(word_table(training, text_col, tokens))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = counts.where((F.col("n") >= share * total) | (F.col("word") == END)).orderBy("word").toArrow()
    words = common.column("word").to_pylist()
    n = common.column("n").to_numpy()
    if END not in words:
        words, n = [END, *words], np.append(0, n)
    rare_tokens, rare_kinds = int(total - n.sum()), int(kinds - (n > 0).sum())
    model = Model(words, n, rare_tokens, states)
    train(training, text_col, model, rounds)

    every = float(total + kinds + 1)
    log_base = np.append(np.log10((n + 1) / every), 0.0)
    known = np.append(n > 0, False)
    sent = spark.sparkContext.broadcast((model, log_base, known))

    def score(batches):
        own, base, seen = sent.value
        index = {w: i for i, w in enumerate(own.words)}
        for part in slices(batches, 512):
            rows, texts = [], []
            for all_words, ids in encoded(part.column(3).cast(pa.binary()).to_pylist(), index, own.rare):
                rare = Counter(compress(all_words, ids == own.rare))
                rows.append((len(ids), int(seen[ids].sum()), float(base[ids].sum()), list(rare), list(rare.values())))
                texts.append(ids)
            logs = forward_log(own, texts) / LOG10
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds_out = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *[pa.array(list(c), k) for c, k in zip(columns, kinds_out)], pa.array(logs)],
                ["row", "doc", "held_out", "n_tokens", "known", "base", "rare", "times", "log"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"),
                         (~is_training).alias("held_out"), text_col)
    rows = kept(numbered.mapInArrow(score, f"row long, doc {kind}, held_out boolean, n_tokens long, known long, base double, "
                                           "rare array<binary>, times array<long>, log double"))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    under = float(rare_tokens + rare_kinds + 1)
    factors = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / every)).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / under)).alias("rare_log"),
    )
    return rows.drop("rare", "times").join(factors, "row", "left").select(
        F.col("doc").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("log") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
