"""Token ids of whole texts, and their binary form in ORC files.

Texts are encoded with a file of the tokenizers library. A byte-level
pre-tokenizer never joins a space or line feed to what stands before it, nor a
full stop or comma to a letter, so a text can be cut there and the cut pieces
encoded on their own; the words of a batch are made distinct first, and each
worker keeps the ids of the words it has met, up to a bound. Texts with longer
runs of white space or other kinds of it, where such a cut could split what
belongs together, and tokenizers of another kind are encoded whole.
Either way the ids are those of the library for the whole text.

Files: ORC, documents in ascending doc_id over range partitions, so that file
names are in order; ids are a list column that ORC writes as run-length encoded
integers; row indexes every STRIDE rows and Bloom filters on doc_id let a reader
of a few documents skip stripes and row groups by their metadata; a stripe is
the unit of parallel reads.

Null texts count as empty and have the end id alone. Rows with the same doc_id
are ordered by a hash of their text, so that a doc_id with any number of rows is
dealt to many partitions and no text is a range bound; repeated rows are all
written. Null doc_ids come first.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm.common import checkpointed, ordered, scratch_path

END = 2
#: Characters of text that a worker encodes at once; words that it remembers.
CHUNK, REMEMBERED = 8_000_000, 1_000_000
#: The last character whose class every version of Unicode gives alike; runs that the pre-tokenizer of byte-level vocabularies keeps apart.
LATIN = "\u024f"
MARKS = (".", ",")
#: Texts that are encoded whole: with white space other than spaces and line feeds, or more than two of those in a row, or two at the end.
WHOLE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n]{3}|[ \n]{2}\z"
#: A full stop or comma after a letter: always a token run of its own.
MARKED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][.,]\z"
RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
#: ORC: bytes of a stripe, rows of a row group, false positives of Bloom filters.
STRIPE, STRIDE, FPP = 64 << 20, 1000, 0.01


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: visible Latin-1 characters as they are, the others by the characters from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors are parallel by tasks
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.by_words = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made.get("normalizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model  # for what the pre-tokenizer would leave whole
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.spaced: dict[str, int] = {}  # words with a space before them, by what follows it
        self.opening: dict[str, int] = {}  # words without
        self.ids, self.used = np.empty(1 << 20, dtype="uint32"), 0
        self.first, self.length, self.count = np.empty(1 << 16, dtype="int64"), np.empty(1 << 16, dtype="int64"), 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, words: list[str], spaced: bool, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, total = len(words), len(ids)
        while self.count + n > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = ids
        self.first[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count : self.count + n] = lengths
        (self.spaced if spaced else self.opening).update(zip(words, range(self.count, self.count + n), strict=True))
        self.count, self.used = self.count + n, self.used + total

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words kept at these places, one after the other, and where each ends."""
        n, first = self.length[at], self.first[at]
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)], ends

    def learn_runs(self, words: list[str], spaced: bool) -> None:
        """Words that the pre-tokenizer leaves whole go to the model as they are."""
        known = self.spaced if spaced else self.opening
        words = [w for w in words if w not in known]
        if not words:
            return
        mark, letters, tokenize = self.letters[32] if spaced else "", self.letters, self.model.tokenize
        if any("\n" in w for w in words):
            ids = self.plain([" " + w if spaced else w for w in words])
            self.keep(words, spaced, np.array([i for x in ids for i in x], dtype="uint32"), np.array([len(x) for x in ids]))
            return
        ids = [[t.id for t in tokenize(mark + (w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(letters)))] for w in words]
        self.keep(words, spaced, np.fromiter(chain.from_iterable(ids), dtype="uint32"), np.fromiter(map(len, ids), dtype="int64", count=len(ids)))

    def learn(self, words: list[str], spaced: bool) -> None:
        """Keeps the ids of new words."""
        whole, mixed, odd = [], {}, []
        for w in words:
            if w.isalpha() and (w.isascii() or max(w) <= LATIN):
                whole.append(w)
            elif w.isascii() or max(w) <= LATIN:
                mixed[w] = ((" " if spaced else "") + w[:-1], w[-1]) if w[-1:] in MARKS and w[:-1].isalpha() else RUNS(" " + w if spaced else w)
            else:
                odd.append(w)
        if mixed:
            parts = dict.fromkeys(p for m in mixed.values() for p in m)
            whole += [] if not spaced else [p[1:] for p in parts if p[:1] == " " and p[1:]]
            self.learn_runs(list(dict.fromkeys(whole)), spaced)
            self.learn_runs([p for p in parts if p[:1] != " " or len(p) == 1 or not spaced], False)
            after, alone = self.spaced, self.opening
            at = [after[p[1:]] if spaced and p[:1] == " " and p[1:] else alone[p] for m in mixed.values() for p in m]
            mixed = {w: len(m) for w, m in mixed.items()}
            ids, ends = self.gather(np.array(at, dtype="int64"))
            ends = np.concatenate([[0], ends])[np.cumsum([0, *mixed.values()])]
            known = self.spaced if spaced else self.opening
            if any(w in known for w in mixed):  # a part of one word can be another word; its ids are the same
                fresh = np.array([w not in known for w in mixed])
                ids = ids[np.repeat(fresh, np.diff(ends))]
                lengths = np.diff(ends)[fresh]
                self.keep([w for w, ok in zip(mixed, fresh, strict=True) if ok], spaced, ids, lengths)
            else:
                self.keep(list(mixed), spaced, ids, np.diff(ends))
        else:
            self.learn_runs(whole, spaced)
        if odd:
            ids = self.plain([" " + w if spaced else w for w in odd])
            self.keep(odd, spaced, np.array([i for x in ids for i in x], dtype="uint32"), np.array([len(x) for x in ids]))

    def places(self, words: list[str], spaced: bool) -> np.ndarray:
        """Where the ids of each of these distinct words are kept."""
        known = self.spaced if spaced else self.opening
        at = np.fromiter((known.get(w, -1) for w in words), dtype="int64", count=len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            self.learn(fresh, spaced)
            at[new] = np.fromiter(map(known.__getitem__, fresh), dtype="int64", count=len(fresh))
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of each text, without the end id."""
        with uncollected():
            return self.encoded(texts)

    def encoded(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), dtype=bool)
        out: list = [None] * len(texts)
        if whole.any():
            for i, ids in zip(np.flatnonzero(whole), self.plain(texts.filter(pa.array(whole)).to_pylist()), strict=True):
                out[i] = np.array(ids, dtype="uint32")
        cut = np.flatnonzero(~whole)
        if not len(cut):
            return out
        # one part for each space or line feed; a part keeps its line feed, and has lost its space
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~whole)), "\n", " \n"), " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        codes, values = words.indices.to_numpy(), words.dictionary
        fed = pc.starts_with(values, "\n").to_numpy(zero_copy_only=False)
        values = pc.if_else(pa.array(fed), pc.utf8_slice_codeunits(values, 1), values)
        marked = pc.match_substring_regex(values, MARKED).to_numpy(zero_copy_only=False)
        mark = np.where(pc.ends_with(values, ".").to_numpy(zero_copy_only=False), 0, 1)
        core = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(values, 0, -1), values).dictionary_encode()
        core_of, cores = core.indices.to_numpy(), core.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.count > REMEMBERED:  # all but the words of this batch
            known = [w for w in cores if w in self.spaced]
            at = np.array([self.spaced[w] for w in known], dtype="int64")
            (ids, _), lengths = self.gather(at), self.length[at]
            self.forget()
            self.keep(known, True, ids, lengths)

        def placed(which: np.ndarray, spaced: bool) -> np.ndarray:
            """Places of the words with these numbers."""
            each, back = np.unique(core_of[which], return_inverse=True)
            return self.places([cores[c] for c in each], spaced)[back]

        at = np.empty(len(values), dtype="int64")
        at[~fed] = placed(np.flatnonzero(~fed), True)
        at[fed] = placed(np.flatnonzero(fed), False)
        marks, feed = self.places([".", ","], False), self.places(["\n"], False)[0]
        # each part is up to three pieces: a line feed, the word, a mark
        fed_at, marked_at = fed[codes], marked[codes]
        fed_at[bounds[:-1]] = False  # what opens a text has neither
        pieces = 1 + fed_at.astype("int64") + marked_at
        ends = np.cumsum(pieces)
        flat_at = np.empty(ends[-1], dtype="int64")
        flat_at[ends - pieces] = feed
        flat_at[ends - 1 - marked_at] = at[codes]
        flat_at[(ends - 1)[marked_at]] = marks[mark[codes[marked_at]]]
        opening = bounds[:-1]
        flat_at[(ends - 1 - marked_at)[opening]] = placed(codes[opening], False)
        flat, stops = self.gather(flat_at)
        stops = np.concatenate([[0], stops])[np.concatenate([[0], ends])[bounds]]
        for i, a, b in zip(cut, stops[:-1], stops[1:], strict=True):
            out[i] = flat[a:b]
        return out


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles: short lists by the hundred thousand, none of which has one, would set it off again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def trim() -> None:
    """Gives freed memory back to the system. An idle worker would keep it beside those that run."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        give(0)


def release() -> None:
    """Frees what a worker remembers for encoding. Workers outlive stages; the tasks of other operators call this first."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    trim()


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose column number text has about `most` bytes at most (a longer text is a batch alone)."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j
    trim()


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """array<int> column of ids."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype("int32") if arrays else np.empty(0, "int32")))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END) -> None:
    """ORC files of (key, part, line, ids); part and line number files and their rows, in ascending key."""
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, line = TaskContext.get().partitionId(), 0
        for b in chunks(batches, 1, CHUNK):
            ids = [np.append(x, np.uint32(end)) for x in encoder(tokenizer).encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(range(line, line + len(ids)), pa.int64()), lists(ids)], names=[key, "part", "line", "ids"])
            line += len(ids)

    by = (F.col(key), F.xxhash64(text))
    rows = docs.select(key, text).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(encode, f"`{key}` {kind}, part int, line long, ids array<int>")
    options = {"orc.compress": "LZ4", "orc.stripe.size": STRIPE, "orc.row.index.stride": STRIDE, "orc.create.index": "true", "orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": FPP}
    rows.write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read_tokens(spark: SparkSession, path: str, only: list | None = None, key: str = "doc_id") -> DataFrame:
    """The rows of the files; those of some keys are found through stripe statistics, row indexes and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if only is None else rows.where(F.col(key).isin(only))


def token_digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of rows that read_tokens read."""
    kind = rows.schema[key].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            sums = [crc(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(bounds).astype("int64")), pa.array(sums, pa.int64())], names=[key, "part", "line", "n_tokens", "ids_crc32"])

    found = rows.select(key, "part", "line", "ids").mapInArrow(digest, f"`{key}` {kind}, part int, line long, n_tokens long, ids_crc32 long")
    return ordered(checkpointed(found), ["part", "line"], "n_tokens").select(key, "start", "n_tokens", "ids_crc32")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return token_digests(read_tokens(spark, path))
