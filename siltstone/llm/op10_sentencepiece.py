"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by vocabulary score, best first and leftmost on ties; it joins
the pair on top and offers the two new neighbours, until no pair is in the vocabulary. Symbols outside the vocabulary fall
back to byte pieces. No piece of such a vocabulary holds the space mark after another character (checked when the model is
loaded), so no join crosses the start of a word. The words of a part of an Arrow batch are told apart by Arrow, and each
different one is encoded once: words of one length are a table with a column each, whose agenda is the column of its pairs'
ranks, and each round takes the best pair of every column. Words above LONG characters, or with characters of several bytes
outside the vocabulary, have an agenda (a heap) each. Every one of these words is also encoded by the sentencepiece library, in one call
a part, and a difference is an error. Whole texts are decoded by the library. Encoders live as long as the Python worker.

The model is named by its file in the public tokenizers' folder, which each worker looks up for itself, or by a path.

Null text: encoded as empty, no tokens. Empty text: no tokens, empty decoded text. Repeated rows: one row each. Very long
texts, with or without spaces: whole, n log n. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Longest word, in characters, that is encoded in a table with others; columns of such a table.
LONG, COLUMNS = 48, 8192
#: Symbols that are no pieces are numbered from here on, by code point; EDGE is in no pair.
OUTSIDE, EDGE = 1 << 17, (1 << 21) - 1
#: Agenda entries: rank, place and joined piece in one number; NEVER and above: no pair.
RANK, PLACE, NEVER = 32, 20, np.int64(1 << 60)


class AgendaEncoder:
    """Encoder for one word (a run of space marks and what follows it)."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.library.get_piece_size()
        self.ids, self.rank, self.byte = {}, {}, [0] * 256
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not self.library.is_control(i) and not self.library.is_unknown(i):
                self.ids[piece], self.rank[piece] = i, -self.library.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this vocabulary has pieces with a space mark inside; words can't be encoded apart")
        if not self.byte[0]:
            raise ValueError("this vocabulary has no byte pieces")
        self._tables()

    def _tables(self) -> None:
        """Symbol of each character; rank and joined piece of each pair of symbols (a hash table)."""
        self.symbol = np.arange(OUTSIDE, OUTSIDE + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        number = lambda p: int(self.symbol[ord(p)]) if len(p) == 1 else self.ids.get(p)
        longer = sorted((p for p in self.ids if len(p) > 1), key=self.rank.__getitem__)
        order = {x: r for r, x in enumerate(sorted({self.rank[p] for p in longer}))}  # pieces of one score have one rank
        keys, values = [], []
        for p in longer:
            for k in range(1, len(p)):
                a, b = number(p[:k]), number(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    values.append(order[self.rank[p]] << RANK | self.ids[p])
        self.bits = max(12, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and joined piece of each pair, NEVER if it is not in the vocabulary."""
        keys = (left.astype(np.int64) << 21) | right
        at = self._slot(keys)
        held = self.keys[at]
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[on]]
            on = on[(held != keys[on]) & (held >= 0)]
        return self.values[at]

    def _together(self, s: np.ndarray) -> np.ndarray:
        """s: symbols of words of one length, a word a column; what is left of them after all joins, joined ones -1."""
        n, m = s.shape
        col, edge = np.arange(m), np.full((1, m), EDGE, np.int32)
        grid = np.concatenate([edge, s, edge])
        agenda = np.full((n + 1, m), NEVER)
        agenda[1:n] = self.pairs(s[:-1].ravel(), s[1:].ravel()).reshape(n - 1, m) | (np.arange(1, n)[:, None] << PLACE)
        after, before = (np.repeat(np.arange(k, n + 2 + k, dtype=np.int64)[:, None], m, 1).ravel() for k in (1, -1))
        g, r = grid.ravel(), agenda.ravel()
        while True:
            top = agenda.min(0)
            on = np.flatnonzero(top < NEVER)
            if not len(on):
                return grid[1:-1]
            top = top[on]
            place, piece = (top >> PLACE) & 0xFFF, (top & 0xFFFFF).astype(np.int32)
            at = place * m + on
            gone = after[at] * m + on
            behind = after[gone]
            ahead = before[at]
            g[at], g[gone], r[gone] = piece, -1, NEVER
            after[at], before[behind * m + on] = behind, place
            r[at] = self.pairs(piece, g[behind * m + on]) | (place << PLACE)
            r[ahead * m + on] = self.pairs(g[ahead * m + on], piece) | (ahead << PLACE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word): words of one length together."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        alone = (np.maximum.reduceat(symbols, starts) >= OUTSIDE + 128) | (sizes > LONG)
        out = np.full(len(symbols), -1, np.int32)
        for n in np.unique(sizes[~alone]).tolist():
            same = np.flatnonzero(~alone & (sizes == n))
            for k in range(0, len(same), COLUMNS):
                at = starts[same[k : k + COLUMNS]] + np.arange(n)[:, None]
                out[at] = self._together(symbols[at]) if n > 1 else symbols[at]
        single = np.flatnonzero(out >= OUTSIDE)  # characters of one byte
        out[single] = np.array(self.byte, np.int32)[out[single] - OUTSIDE]
        counts = np.add.reduceat(out >= 0, starts, dtype=np.int64)
        if not alone.any():
            return out[out >= 0], counts
        parts = []
        for i, x in enumerate(alone.tolist()):
            if x:
                parts.append(self.encode(words[i]))
                counts[i] = len(parts[-1])
            else:
                part = out[starts[i] : starts[i] + sizes[i]]
                parts.append(part[part >= 0].tolist())
        return np.fromiter(chain.from_iterable(parts), np.int32, int(counts.sum())), counts

    def encode(self, word: str) -> list[int]:
        ids, rank = self.ids, self.rank
        whole = ids.get(word)
        n = len(word)
        if n == 1:
            return [whole] if whole is not None else [self.byte[b] for b in word.encode()]
        piece: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = word[i : i + 2]
            if (r := rank.get(pair)) is not None:
                agenda.append((r, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = piece[i]
            if left is None or (j := after[i]) >= n or len(left) >= len(pair) or left + piece[j] != pair:
                continue
            piece[i], piece[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = pair + piece[k]
                if (r := rank.get(new)) is not None:
                    heapq.heappush(agenda, (r, i, new))
            if (h := before[i]) >= 0:
                new = piece[h] + pair
                if (r := rank.get(new)) is not None:
                    heapq.heappush(agenda, (r, h, new))
        out: list[int] = []
        for p in piece:
            if p is not None:
                x = ids.get(p)
                out.extend([x] if x is not None else [self.byte[b] for b in p.encode()])
        return out


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words with the spaces before them, of each text after one added space, and where each text's words begin and end."""
    texts = pc.replace_substring(texts, SPACE, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = data == 32
    begins[1:] &= data[:-1] != 32
    begins[ends[:-1][np.diff(ends) > 0]] = True
    at = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)), np.searchsorted(at[:-1], ends)


def encode_texts(encoder: AgendaEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids begin and end). Different words are checked against the library in one call."""
    words, bounds = segments(texts)
    told = words.dictionary_encode()
    different = told.dictionary.to_pylist()
    flat, counts = encoder.encode_words([w.replace(" ", SPACE) for w in different])
    theirs = encoder.library.encode([w[1:] for w in different], num_threads=1)
    if " " in different:  # the library adds no space before an empty text
        theirs[different.index(" ")] = encoder.encode(SPACE)
    if not np.array_equal(counts, [len(x) for x in theirs]) or not np.array_equal(flat, np.fromiter(chain.from_iterable(theirs), np.int32)):
        w, ours, ids = next((w, o, x) for w, o, x in zip(different, np.split(flat, np.cumsum(counts)[:-1]), theirs) if o.tolist() != x)
        raise AssertionError(f"the library encodes {w!r} as {ids}, not {ours.tolist()}")
    of = told.indices.to_numpy()
    size = counts[of]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    at = np.repeat((np.cumsum(counts) - counts)[of] - ends[:-1], size)
    at += np.arange(len(at))
    return flat[at], ends[bounds]


_loaded: dict[str, AgendaEncoder] = {}


def loaded(model: str) -> AgendaEncoder:
    """The encoder of a model, made once a worker."""
    if model not in _loaded:
        _loaded[model] = AgendaEncoder(model if os.sep in model else model_file(model))
    return _loaded[model]


def _digests(encoder: AgendaEncoder, texts: pa.Array) -> Iterator[tuple[int, str, str, bool]]:
    """(n_tokens, ids_sha256, decoded_sha256, decoded_equal) of each text; decimals and decoded texts of a few at a time."""
    flat, ends = encode_texts(encoder, texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + 500_000)))
        stop = min(stop, len(texts))
        part, bounds = flat[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        ids = part.tolist()
        if len(ids) < 200_000_000:
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(part).cast(pa.string())), ",").to_pylist()
        else:  # one text, too long for Arrow's 31 bit offsets
            said = [",".join(map(str, ids))]
        back = encoder.library.decode([ids[a:b] for a, b in zip(bounds.tolist(), bounds.tolist()[1:])], num_threads=1)
        for n, ours, text, given in zip(np.diff(bounds).tolist(), said, back, texts.slice(at, stop - at).to_pylist()):
            yield n, hashlib.sha256(ours.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text == given.replace(SPACE, " ")
        at = stop


def encode_decode(docs: DataFrame, model: str = MODEL, text: str = "text", keep: list[str] | None = None, part_bytes: int = 2_000_000) -> DataFrame:
    """keep's columns (default doc_id) with ids ARRAY<INT>-free digests: n_tokens, ids_sha256, decoded_sha256, and decoded_equal (the text came back but for literal space marks)."""
    keep = keep or ["doc_id"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
            at = 0
            while at < batch.num_rows:
                stop = min(batch.num_rows, max(at + 1, int(np.searchsorted(sizes, sizes[at] + part_bytes, "right")) - 1))
                found = list(zip(*_digests(encoder, texts.slice(at, stop - at))))
                made = [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, stop - at) for i in range(len(keep))), *made], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_equal"])
                at = stop
        release()

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def model_file(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
