"""Best-fit packing by sums of squares.

A document's ids are cut into pieces only where it is longer than a sequence. A
piece goes where the sum over all residual gaps of (open sequences with that gap)
squared becomes smallest. Pieces are written and dealt evenly, whatever their document, to groups of
about ``pieces_per_group`` pieces; each group is packed by itself, longest
pieces first, and only sizes and checksums travel, never ids or texts.

Null text counts as empty: one piece that holds the end id alone. Repeated rows are
packed as often as they come. An empty table gives an empty result. Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tabulon.llm.common import kept, slices

CAPACITY = 4096
END_ID = 1
#: Words of each age whose ids a Python worker keeps.
KEPT_WORDS = 250_000
#: Marks behind a letter that end a word; what is parted by a space has the same ids.
TAIL = r"([a-z])([.,;:!?]+) "
#: Marks that the tokenizer parts from the letters before them, one run at a time.
MARKS = ".,;:!?#$%&*()[]{}+=/|<>~^@\"-"


def default_tokenizer() -> str:
    """Where the vocabulary file is; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def worker_memory(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks."""
    module = sys.modules.setdefault("tabulon_worker_memory", types.ModuleType("tabulon_worker_memory"))
    return module.__dict__.setdefault(name, {})


def stays_letters(word: str) -> bool:
    """Whether a word is letters alone, also in the form that the tokenizer gives it: some
    letters are taken apart into one and a mark, which then joins the marks behind it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", unicodedata.normalize("NFC", word).lower()).isalpha())


class WordEncoder:
    """Ids of whole texts from the ids of their words.

    The tokenizer splits at white space and treats words alone, so a text's ids are
    those of its words in order; a run of marks after letters is treated alone too. New
    words of letters are encoded many at a time, parted by a comma, whose id no such
    word contains. A text with a special token's opening is encoded directly.

    Known words have two ages: when there are too many young ones they become the old ones, and
    what is met again becomes young, so that common words are never encoded twice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.memory = worker_memory(path)
        if "tokenizer" not in self.memory:
            self.memory |= {"tokenizer": Tokenizer.from_file(path), "ids": {}, "old": {}}
        self.tokenizer = self.memory["tokenizer"]
        (self.comma,) = self._plain(",")

    @property
    def known(self) -> dict[str, bytes]:
        return self.memory["ids"]

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self._plain(text), "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        known, old = self.known, self.memory["old"]
        known[""] = b""
        letters, tailed = [], []
        for word in new:
            if word in old:
                known[word] = old[word]
            elif stays_letters(word):
                letters.append(word)
            else:
                stem = word.rstrip(MARKS)
                tailed.append((word, stem, word[len(stem) :]))
        stems = {stem for _, stem, _ in tailed if stem not in known and stays_letters(stem)}.difference(letters)
        for stem in stems:
            if stem in old:
                known[stem] = old[stem]
            else:
                letters.append(stem)
        for at in range(0, len(letters), 512):
            some = letters[at : at + 512]
            (encoded,) = self.tokenizer.encode_batch_fast([" , ".join(some)], add_special_tokens=False)
            ids = np.asarray(encoded.ids, "<u4")
            cuts = 4 * np.flatnonzero(ids == self.comma)
            whole = ids.tobytes()
            for word, start, end in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(whole)]):
                known[word] = whole[start:end]
        marks: dict[str, bytes] = {}
        for word, stem, tail in tailed:
            if stem in known and stays_letters(stem):
                if tail not in marks:
                    marks[tail] = self._bytes(tail)
                known[word] = known[stem] + marks[tail]
            else:
                known[word] = self._bytes(word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, as bytes."""
        direct = {i: self._bytes(t) for i, t in enumerate(texts) if t and "<|" in t}
        column = pa.array(["" if i in direct else t or "" for i, t in enumerate(texts)], pa.string())
        column = pc.replace_substring(pc.ascii_lower(column), "\n", " ")
        column = pc.replace_substring_regex(column, TAIL, r"\1 \2 ")
        split = pc.split_pattern(column, " ")
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > KEPT_WORDS:
            self.memory["old"], self.memory["ids"] = self.known, {}
        known = self.known
        self._learn([w for w in words if w not in known])
        ids = [known[w] for w in words]
        # all words' ids in the order of the texts, by their place among the different ones
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(each) - each
        which = coded.indices.to_numpy()
        sizes = each[which]
        ends = np.cumsum(sizes)
        place = np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        stream = table[place]
        last = np.append(0, ends)[np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
        first = np.append(0, last[:-1])
        return [direct[i] if i in direct else stream[a:b].tobytes() for i, (a, b) in enumerate(zip(first.tolist(), last.tolist()))]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc, piece, start, length and ids_crc32 of every piece of every document."""
    kind = df.schema[id_col].dataType
    schema = StructType([
        StructField("doc", kind), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids_crc32", LongType()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encoder = WordEncoder(tokenizer_path)
        for part in slices(batches):
            out = ([], [], [], [], [])
            keys = part.column(0)
            for row, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for values, value in zip(out, (row, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                        values.append(value)
            taken = keys.take(pa.array(out[0], pa.int64()))
            numbers = [pa.array(v, t) for v, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([taken, *numbers], ["doc", "piece", "start", "length", "ids_crc32"])

    return df.select(id_col, text_col).mapInArrow(cut, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given.

    An open sequence that fits is preferred to a new one; among the gaps that fit,
    the piece goes where the squared counts grow least, ties to the smallest gap.
    """
    add = np.ones(capacity + 1)  # 2 N + 1: what one more open sequence with that gap adds
    add[0] = 0.0
    lost = np.full(capacity + 1, -np.inf)  # 2 N - 1: what one fewer takes away
    open_at: dict[int, list[int]] = {}
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        change = add[: capacity - size + 1] - lost[size:]
        gap = int(change.argmin()) + size
        if lost[gap] == -np.inf:
            gap, number, used = capacity, used, used + 1
        else:
            number = open_at[gap].pop()
            count = len(open_at[gap])
            add[gap], lost[gap] = 2 * count + 1, (2 * count - 1 if count else -np.inf)
        rest = gap - size
        if rest:
            stack = open_at.setdefault(rest, [])
            stack.append(number)
            add[rest], lost[rest] = 2 * len(stack) + 1, 2 * len(stack) - 1
        sequence[i], offset[i] = number, capacity - gap
    return sequence, offset


def packed(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, pieces_per_group: int = 4096) -> DataFrame:
    """Every piece with its sequence and its place there.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = kept(pieces(df, tokenizer_path, id_col, text_col, capacity, end_id))
    groups = max(1, -(-cut.count() // pieces_per_group))
    # dealt by their place in the written table, so that no id or text gathers in one group
    cut = cut.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(groups)), F.lit(groups)))
    schema = StructType([StructField(id_col, cut.schema["doc"].dataType), *cut.schema.fields[1:5],
                         StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(key, frame):
        order = ["length", "doc", "piece", "ids_crc32"]
        frame = frame.sort_values(order, ascending=[False, True, True, True], kind="stable")
        sequence, offset = place(frame["length"].to_numpy(), capacity)
        out = frame.drop(columns="__group").rename(columns={"doc": id_col})
        return out.assign(sequence_id=(int(key[0]) << 40) + sequence, offset=offset)

    return cut.groupBy("__group").applyInPandas(pack, schema)
