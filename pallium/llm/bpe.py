"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that ends its encoding. An automaton over the
vocabulary yields the tokens that are suffixes of each prefix; the one whose predecessor (the stored last
token of the shorter prefix) stays next to it under the merges is that last token. Following the stored
tokens backwards from the end gives the ids. Work is linear in the text, whatever the pieces look like.

Texts are first cut at special tokens, then into units (a run of non-space characters with the space before
it, or white space), then into the pieces of the pattern. Short units are remembered, up to a number of bytes.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.words import pieces, slices

# Fixed value: the pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Unicode White_Space, which is what \s means in the pattern.
_WS = "\t-\r \x85\xa0  -     　"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
# A word of Latin letters with an ASCII character or nothing behind it is a unit (and a piece) of its own.
_UNIT = re.compile(rf" ?[{_LATIN}]++(?=[\x00-@\[-`{{-\x7f]|\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_PIECE = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WS}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", f"[{_WS}]+(?![^{_WS}])").replace(r"\s+", f"[{_WS}]+"))

#: Bytes of remembered units after which a worker starts afresh, bytes that one takes besides its characters and
#: tokens, characters of the longest one remembered, and remembered pairs of tokens.
REMEMBERED, OVERHEAD, LONGEST, PAIRS = 96 << 20, 150, 64, 250_000
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 20


def _byte_of_char() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves; the other bytes for 256, 257, ... in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens of a byte-level BPE in the JSON form of the tokenizers library, by rank: bytes first, then merges."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        ids, chars = doc["model"]["vocab"], _byte_of_char()
        merges = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
        made = [a + b for a, b in merges]
        base = sorted(set(ids) - set(made), key=ids.get)
        names = [*base, *made]
        rank = {n: i for i, n in enumerate(names)}
        self.n_base = len(base)
        self.ids = np.array([ids[n] for n in names], dtype=np.int32)
        self.tokens = [bytes(chars[c] for c in n) for n in names]
        self.parts = [(rank[a], rank[b]) for a, b in merges]
        self.joined = {p: self.n_base + i for i, p in enumerate(self.parts)}
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        self.bytes_of_id = dict(zip(self.ids.tolist(), self.tokens, strict=True)) | {i: s.encode() for s, i in self.special.items()}


class Encoder:
    def __init__(self, spec: str):
        self.vocabulary = v = Vocabulary(spec)
        self.suffixes = ahocorasick.Automaton()
        for t, b in enumerate(v.tokens):
            self.suffixes.add_word(b.decode("latin-1"), (t, len(b)))
        self.suffixes.make_automaton()
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, v.special), key=len, reverse=True)) + ")") if v.special else None
        self.fit: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known = _Units(self)
        self.flat, self.begin, self.used = array("i"), array("q", [0]), 0

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` standing side by side.

        The merges are undone at the seam, the latest first; at no time may the two tokens at the seam have
        a merge that would have come before those undone so far.
        """
        v, limit = self.vocabulary, len(self.vocabulary.tokens) + 1
        while True:
            both = v.joined.get((left, right))
            if both is not None and both < limit:
                return False
            if left > right and left >= v.n_base:
                limit, left = left, v.parts[left - v.n_base][1]
            elif right >= v.n_base:
                limit, right = right + 1, v.parts[right - v.n_base][0]
            else:
                return True

    def _stands(self, token: int) -> bool:
        """Whether the merges turn the token's bytes into the token itself: its parts stand and fit till it is made."""
        v = self.vocabulary
        if token < v.n_base:
            return True
        if (known := self.whole.get(token)) is None:
            s = [self.joined_byte(b) for b in v.tokens[token]]
            while len(s) > 1:
                best, at = min((v.joined.get(p, len(v.tokens)), i) for i, p in enumerate(zip(s[:-1], s[1:], strict=True)))
                if best == len(v.tokens):
                    break
                s[at : at + 2] = [best]
            known = self.whole[token] = s == [token]
        return known

    @functools.cache  # noqa: B019  one encoder lives as long as its worker
    def joined_byte(self, b: int) -> int:
        return self.vocabulary.tokens.index(bytes([b]))

    def piece(self, raw: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        last, sizes, fit = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), self.fit
        for end, (token, size) in self.suffixes.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if size == end:
                good = self._stands(token)
            else:
                pair = last[end - size] << 32 | token
                good = fit.get(pair)
                if good is None:
                    if len(fit) >= PAIRS:
                        fit.clear()
                    good = fit[pair] = self._fits(pair >> 32, token)
            if good:
                last[end], sizes[end] = token, size
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out

    def unit(self, text: str) -> list[int]:
        if text.isalpha() or text[1:].isalpha() and text[0] == " ":
            return self.piece(text.encode())
        return [t for p in _PIECE.findall(text) for t in self.piece(p.encode())]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        if self.used > REMEMBERED:
            self.forget()
        #: ranks of units that aren't remembered; special tokens count as ranks behind those of the vocabulary
        self.once: list[list[int]] = []
        known, numbers, count, first_special = self.known, [], [], len(self.vocabulary.ids)
        for text in texts:
            n = 0
            for part in self.cut.split(text or "") if self.cut else [text or ""]:
                if part in self.vocabulary.special:
                    self.once.append([first_special + self.vocabulary.special[part]])
                    number = np.array([-len(self.once)])
                else:
                    number = np.fromiter(map(known.__getitem__, _UNIT.findall(part)), dtype=np.int64)
                numbers.append(number)
                n += len(number)
            count.append(n)
        number = np.concatenate([*numbers, np.zeros(0, dtype=np.int64)])
        # views; units encoded once lie behind the remembered ones, and their numbers count from the end
        flat, begin = np.frombuffer(self.flat, dtype=np.int32), np.frombuffer(self.begin, dtype=np.int64)
        if self.once:
            sizes = np.array([len(x) for x in self.once])
            flat = np.concatenate([flat, np.array([r for x in self.once for r in x], dtype=np.int32)])
            begin = np.concatenate([begin, begin[-1] + np.cumsum(sizes)])
            number = np.where(number < 0, len(self.begin) - 2 - number, number)
        starts = begin[number]
        lengths = begin[number + 1] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        ranks = flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        ids = np.where(ranks < first_special, self.vocabulary.ids[np.minimum(ranks, first_special - 1)], ranks - first_special).astype(np.int32)
        del flat, begin, self.once  # the arrays can grow again
        return ids, total[np.cumsum(count)] if count else total[:0]


class _Units(dict):
    """Number of each unit seen; the tokens of unit i are flat[begin[i]:begin[i+1]].

    Units that are long, or come when the memory is full, are encoded for this call only and numbered -1, -2, ...
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> int:
        e, ranks = self.encoder, self.encoder.unit(unit)
        if len(unit) > LONGEST or e.used > REMEMBERED:
            e.once.append(ranks)
            return -len(e.once)
        e.flat.extend(ranks)
        e.begin.append(len(e.flat))
        e.used += OVERHEAD + 4 * (len(unit) + len(ranks))
        self[unit] = number = len(e.begin) - 2
        return number


class Decoder:
    def __init__(self, spec: str):
        v = Vocabulary(spec)
        n = max(v.bytes_of_id) + 1
        self.size = np.array([len(v.bytes_of_id.get(i, b"")) for i in range(n)], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(v.bytes_of_id.get(i, b"") for i in range(n)), dtype=np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the id ranges that end at `ends`; bytes that aren't UTF-8 become U+FFFD."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.data[np.repeat(self.begin[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cut = [0, *total[ends].tolist()]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(2)
def encoder_of(spec: str) -> Encoder:
    return Encoder(spec)


@functools.lru_cache(2)
def decoder_of(spec: str) -> Decoder:
    return Decoder(spec)


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON (a fixed few MB). The driver reads it; tasks get it as a broadcast variable."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: A white-space run of so many characters is too long for the other encoder, which goes back over it.
_LONG_SPACE = re.compile(f"[{_WS}]{{10000}}")


class FastEncoder:
    """Ids of one text by the tiktoken library on the same vocabulary; texts that it can't take go to Encoder."""

    def __init__(self, spec: str):
        self.vocabulary = v = Vocabulary(spec)
        self.spec = spec
        self.library = tiktoken.Encoding("of-vocabulary", pat_str=PATTERN, mergeable_ranks=dict(zip(v.tokens, v.ids.tolist(), strict=True)), special_tokens=v.special)

    def encode(self, text: str) -> np.ndarray:
        """All ids, special tokens included."""
        if len(text) >= 10_000 and _LONG_SPACE.search(text):
            return encoder_of(self.spec).encode([text])[0].astype(np.uint32)
        return self.library.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def encode_ordinary(self, text: str) -> list[int]:
        """The ids of a text whose special tokens count as plain text."""
        if len(text) >= 10_000 and _LONG_SPACE.search(text):
            e = encoder_of(self.spec)
            return [int(e.vocabulary.ids[r]) for u in _UNIT.findall(text) for r in e.unit(u)]
        return self.library.encode_ordinary(text)


@functools.lru_cache(2)
def fast_encoder_of(spec: str) -> FastEncoder:
    return FastEncoder(spec)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, ids array<int>). Null texts are empty: no ids. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def apply(batches):
        encoder = encoder_of(shared.value)
        for batch in batches:
            for part in pieces(batch, text_col, AT_ONCE):
                yield pa.RecordBatch.from_arrays([part.column(id_col), _lists(*encoder.encode(part.column(text_col).to_pylist()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(apply, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of `encoded`: (id, ids, text). Null ids give an empty text; unknown ids give nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def apply(batches):
        decoder = decoder_of(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, 4 * sizes, AT_ONCE):
                column = part.column(ids_col)
                ids = np.clip(column.flatten().to_numpy(zero_copy_only=False), -1, len(decoder.size) - 1).astype(np.int64)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(id_col), column, pa.array(decoder.decode(ids, ends), pa.string())], [id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(apply, f"`{id_col}` {kind}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python stage: (id, ids, text), the text being what the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def apply(batches):
        encoder, decoder = encoder_of(shared.value), decoder_of(shared.value)
        for batch in batches:
            for part in pieces(batch, text_col, AT_ONCE):
                ids, ends = encoder.encode(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(id_col), _lists(ids, ends), pa.array(decoder.decode(ids, ends), pa.string())], [id_col, "ids", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(apply, f"`{id_col}` {kind}, ids array<int>, text string")
