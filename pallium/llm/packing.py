"""Packing of token sequences by best-fit decreasing.

Each document's ids, closed by an end id, are first cut into full windows. The rests are placed longest
first, each into the open window with the tightest remaining capacity that holds it; a segment tree over
remaining capacities finds it. Windows that then miss `gap` or more tokens are closed with pieces cut from
the emptiest ones, and the last open window of a group is cut into sequences whose lengths are powers of two.

Rests are packed in groups of about `group_tokens` tokens of one partition, as they are read: nothing is
shuffled, a task holds one group, and each group wastes next to nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.bpe import fast_encoder_of, read_tokenizer
from pallium.llm.words import pieces

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        self._add(capacity, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, number) of a window with the least capacity of at least `need`."""
        node = need + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger under this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: list[int], window: int, gap: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents of these lengths exactly once."""
    full, rests = [], []
    for d, n in enumerate(lengths):
        full += [[(d, s, window)] for s in range(0, n - window + 1, window)]
        if n % window:
            rests.append((n % window, d, n - n % window))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, windows, room = OpenWindows(window), [], []
    for n, d, s in rests:
        found = tree.take_tightest(n)
        if found is None:
            windows.append([])
            room.append(window)
            found = window, len(windows) - 1
        capacity, w = found
        windows[w].append((d, s, n))
        room[w] = capacity - n
        if room[w]:
            tree.put(room[w], w)
    # the emptiest windows give their tokens to the others' large gaps
    order = sorted(range(len(windows)), key=lambda w: (room[w], w))
    open_, fullest = [w for w in order if room[w] >= gap], 0
    while open_ and fullest < len(open_) - 1:
        donor, taker = windows[open_[-1]], open_[fullest]
        d, s, n = donor.pop()
        part = min(n, room[taker])
        windows[taker].append((d, s, part))
        room[taker] -= part
        if n > part:
            donor.append((d, s + part, n - part))
        if not donor:
            open_.pop()
        if not room[taker]:
            fullest += 1
    out = full + [w for w in windows if w and w is not (windows[open_[-1]] if open_ and windows[open_[-1]] else None)]
    if open_ and windows[open_[-1]]:
        out += _powers_of_two(windows[open_[-1]])
    return out


def _powers_of_two(pieces_: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into sequences whose lengths are the powers of two in their sum."""
    total, out, todo = sum(p[2] for p in pieces_), [], list(reversed(pieces_))
    for bit in reversed(range(total.bit_length())):
        need, sequence = total & (1 << bit), []
        while need:
            d, s, n = todo.pop()
            part = min(n, need)
            sequence.append((d, s, part))
            need -= part
            if n > part:
                todo.append((d, s + part, n - part))
        if sequence:
            out.append(sequence)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, group_tokens: int = 4_000_000, gap: int = 32) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids).

    `ids` are the piece's ids as little-endian unsigned 32-bit integers; start counts its document's ids before
    it, doc_tokens the document's ids with the end id, offset the ids before it in its sequence. Every id of
    every row lies in exactly one piece. A null or empty text is the end id alone. Rows with equal or null
    ids are separate documents. An empty table gives no rows. Other columns are ignored. Sequence ids differ
    between partitions and say nothing about order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def apply(batches):
        encoder, number = fast_encoder_of(shared.value), TaskContext.get().partitionId() << 36
        held_ids, held = [], []

        def packed():
            nonlocal number
            rows = []
            for sequence in best_fit([len(x) for x in held], window, gap):
                offset = 0
                for d, s, n in sequence:
                    rows.append((held_ids[d], s, n, len(held[d]), number, offset, held[d][s : s + n].tobytes()))
                    offset += n
                number += 1
            names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
            for lo in range(0, len(rows), 5000):
                columns = zip(*rows[lo : lo + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
            held_ids.clear()
            held.clear()

        total = 0
        for batch in batches:
            id_type = batch.schema.field(id_col).type
            for part in pieces(batch, text_col):
                for i, text in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                    ids = encoder.encode(text or "")
                    held_ids.append(i)
                    held.append(np.append(ids, end_id).astype("<u4"))
                    total += len(held[-1])
                if total >= group_tokens:
                    yield from packed()
                    total = 0
        if held:
            yield from packed()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(apply, f"`{id_col}` {kind}, {PIECES}")
