"""Token ids as directly addressable codes (DACs) in files that give any token without decoding a block.

File format (little endian). A file holds consecutive documents.
    magic  b"LFDAC1\\0\\0"
    u32    chunk bits (8), levels, documents; u32 unused; u64 tokens
    per level: u64 entries, u64 bytes of the continuation bitmap, u64 entries of the rank directory
    i64[documents] ids, u8[documents] 1 where the id is null, u64[documents + 1] starts of documents
    per level: u8[entries] chunks; bitmap (bit i of byte i // 8: the code of entry i goes on in the next
               level); u32[...] rank directory: ones before each block of 512 entries
Level 0 has a chunk of each id (its low 8 bits); entry i of level k goes on at entry rank(i) of level k + 1.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"LFDAC1\0\0"
CHUNK = 8
BLOCK = 512
#: A file is closed at so many tokens; texts are tokenised in pieces of about so many characters.
FILE_TOKENS = 1 << 20
PIECE_CHARS = 1 << 22
#: Distinct stretches that an encoder keeps, at most, and how many words it encodes in one string.
CACHED_WORDS = 700_000
LEARN_WORDS = 4096
#: ASCII marks: a run of them at a stretch's end is a word of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: This process's encoder by the digest of its tokenizer.
ENCODERS: dict[str, "Encoder"] = {}

WRITTEN = "part int, seq long, n_docs long, n_tokens long, payload binary"
READ = "part int, seq long, at long, doc_id long, n_tokens long, ids_crc32 long"


def pack_ids(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of chunks, continuation bitmap and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 1 << CHUNK
        pad = -len(more) % BLOCK
        ones = np.concatenate([more, np.zeros(pad, bool)]).reshape(-1, BLOCK).sum(1)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.zeros(0)
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), ranks.astype(np.uint32)))
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK


def to_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = pack_ids(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    head = [MAGIC, struct.pack("<IIIIQ", CHUNK, len(levels), len(doc_ids), 0, len(ids))]
    head += [struct.pack("<QQQ", len(c), len(b), len(r)) for c, b, r in levels]
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    body = [known.tobytes(), nulls.tobytes(), starts.tobytes()]
    body += [x for c, b, r in levels for x in (c.tobytes(), b.tobytes(), r.astype("<u4").tobytes())]
    return b"".join(head + body)


class TokenFile:
    """Reads a file's bytes (or a memory map) in place."""

    def __init__(self, data) -> None:
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        bits, levels, docs, _, self.n_tokens = struct.unpack_from("<IIIIQ", data, 8)
        if bits != CHUNK:
            raise ValueError(f"chunks of {bits} bits")
        sizes = [struct.unpack_from("<QQQ", data, 32 + 24 * k) for k in range(levels)]
        at = 32 + 24 * levels

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, nulls = array("<i8", docs), array("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(known, nulls)]
        self.starts = array("<u8", docs + 1)
        self.levels = [(array("u1", c), array("u1", b), array("<u4", r)) for c, b, r in sizes]

    def _rank(self, k: int, i: int) -> int:
        """Ones before entry i of level k: the directory's count and the bits of part of one block."""
        _, bits, ranks = self.levels[k]
        if not len(ranks):
            return 0
        block = min(i // BLOCK, len(ranks) - 1)
        return int(ranks[block]) + int(np.unpackbits(bits[block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, k = 0, 0
        while True:
            chunks, bits, _ = self.levels[k]
            value |= int(chunks[i]) << CHUNK * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, k = self._rank(k, i), k + 1

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only these entries of each level are touched."""
        return self._slice(0, start, stop)

    def _slice(self, k: int, start: int, stop: int) -> np.ndarray:
        chunks, bits, _ = self.levels[k]
        out = chunks[start:stop].astype(np.uint32)
        more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
        if more.any():
            low = self._rank(k, start)
            out[more] |= self._slice(k + 1, low, low + int(more.sum())) << np.uint32(CHUNK)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


class _Known:
    """Strings and their ids, kept in flat arrays; forgets all when it would hold more than limit."""

    def __init__(self, encode, limit: int, fits=None) -> None:
        self._encode, self._limit, self._fits = encode, limit, fits
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts = self.lens = np.zeros(0, np.int32)

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Places of distinct words in starts and lens, -1 where they do not fit; unknown ones are encoded first."""
        known = self._at
        found = [known.get(w) for w in words]
        new = [w for w, k in zip(words, found) if k is None]
        if not new:
            return np.array(found, np.int64)
        if len(known) + len(new) > self._limit and known:
            self._forget()
            return self.rows(words)
        mine = new if self._fits is None else [w for w in new if self._fits(w)]
        if self._fits is not None:
            known.update(dict.fromkeys(new, -1))
        if mine:
            flat, lens = self._encode(mine)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids] * 2)
            self.ids[self.used : self.used + len(flat)] = flat
            known.update(zip(mine, range(len(self.lens), len(self.lens) + len(mine))))
            self.starts = np.concatenate([self.starts, (self.used + np.cumsum(lens) - lens).astype(np.int32)])
            self.lens = np.concatenate([self.lens, lens])
            self.used += len(flat)
        return np.array([known[w] if k is None else k for w, k in zip(words, found)], np.int64)


def of_letters(word: str) -> bool:
    """Whether a word in lower case is of letters alone, also after composition."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def spread(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids one after the other, and where each ends."""
    ends = np.cumsum(lens, dtype=np.int32)
    at = np.repeat(starts - ends + lens, lens)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends


class Encoder:
    """Ids of texts by the tokenizers library, asked once for each distinct word that it has not kept.

    Only for tokenizers whose pre-tokenizer drops ASCII white space, never joins across it, takes runs of
    letters and runs of marks apart and ignores the case of A-Z, and whose words all end in a token with
    the suffix </w>. Then a text's ids are those of its stretches between white space one after the other;
    letters and the marks after them are looked up apart, and words of letters are encoded many at a time:
    the suffix tells where each one ends. All other stretches are encoded as they are.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._letters = _Known(self._together, CACHED_WORDS, of_letters)
        self._others = _Known(self._singly, CACHED_WORDS // 4)

    @staticmethod
    def shared(tokenizer_json: str) -> Encoder:
        """The one encoder of this process, kept from task to task with what it has learnt."""
        digest = hashlib.sha256(tokenizer_json.encode()).hexdigest()
        if digest not in ENCODERS:
            ENCODERS.clear()
            ENCODERS[digest] = Encoder(tokenizer_json)
        return ENCODERS[digest]

    def _singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        lens = np.fromiter(map(len, made), np.int32, len(made))
        return np.fromiter((i for ids in made for i in ids), np.uint32, int(lens.sum())), lens

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [], []
        for k in range(0, len(words), LEARN_WORDS):
            some = words[k : k + LEARN_WORDS]
            ids = np.array(self._tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self._ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("this tokenizer does not mark the ends of words")
            flat.append(ids)
            lens.append(np.diff(stops, prepend=0).astype(np.int32))
        return np.concatenate(flat), np.concatenate(lens)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct stretches: flat, first places, lengths."""
        trimmed = pc.utf8_rtrim(words, characters=MARKS)
        coded = pc.dictionary_encode(pc.ascii_lower(trimmed))
        at = self._letters.rows(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        plain = at >= 0
        starts, lens = np.zeros((len(words), 2), np.int32), np.zeros((len(words), 2), np.int32)
        starts[plain, 0], lens[plain, 0] = self._letters.starts[at[plain]], self._letters.lens[at[plain]]
        # What is left to look up: marks after letters, and all other stretches as they are.
        marked = np.flatnonzero(~plain | (pc.binary_length(words).to_numpy() > pc.binary_length(trimmed).to_numpy()))
        some = words.take(pa.array(marked))
        other = pc.if_else(pa.array(plain[marked]), pc.replace_substring_regex(some, f"^[^{re.escape(MARKS)}]+", ""), some)
        coded = pc.dictionary_encode(other)
        at = self._others.rows(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        starts[marked, 1], lens[marked, 1] = self._others.starts[at] + self._letters.used, self._others.lens[at]
        ids = np.concatenate([self._letters.ids[: self._letters.used], self._others.ids[: self._others.used]])
        flat, ends = spread(ids, starts.ravel(), lens.ravel())
        size = lens.sum(1, dtype=np.int32)
        return flat, ends[1::2] - size, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. Null: none."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(parts.flatten())
        ids, starts, lens = self._distinct(coded.dictionary)
        rows = coded.indices.to_numpy(zero_copy_only=False)
        flat, ends = spread(ids, starts[rows], lens[rows])
        edge = np.concatenate([np.zeros(1, np.int32), ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return flat, np.diff(edge)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a very long text at spaces or line ends; a longer stretch without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = min((c for c in (text.find(" ", at + size), text.find("\n", at + size)) if c >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Documents and their ids, a bounded number of characters at a time."""
    ids, texts = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(ids):
        high, held = low + 1, int(sizes[low])
        while high < len(ids) and held + sizes[high] <= PIECE_CHARS:
            held += int(sizes[high])
            high += 1
        if held > PIECE_CHARS:
            runs = [encoder.encode(pa.array([p]))[0] for p in pieces(texts[low].as_py())]
            yield [ids[low].as_py()], [np.concatenate(runs)]
        else:
            flat, lens = encoder.encode(texts.slice(low, high - low))
            yield ids.slice(low, high - low).to_pylist(), np.split(flat, np.cumsum(lens)[:-1])
        low = high


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents' ids as DAC files in ascending doc_id order and returns the table of files.

    Files lie in a table of the shared folder (part, seq, n_docs, n_tokens, payload), so any store that
    Spark writes to will do; part and seq order them. Each document ends with end_id. Null text: just the
    end id. Null doc_id: first. Equal rows: each for itself. Empty table: no files.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder, ids, runs, held = Encoder.shared(vocabulary.value), [], [], 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            lengths = [len(r) for r in runs]
            made = to_bytes(ids, lengths, np.concatenate(runs))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([made], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "payload"],
            )

        for batch in batches:
            for some, found in encoded(encoder, batch):
                ids += some
                for run in found:
                    runs.append(np.concatenate([run, end]))
                    held += len(run) + 1
                if held >= FILE_TOKENS:
                    yield close()
                    ids, runs, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.saved(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(work, WRITTEN), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of u32 little-endian ids).

    The offsets of files come from their lengths (one small row per file). No files give no rows; null ids stay null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*[batch.column(i) for i in range(3)]):
                file = TokenFile(payload.as_buffer())
                starts = file.starts.astype(np.int64)
                crcs = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(len(file.doc_ids))]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int64()), pa.array(starts[:-1]), pa.array(file.doc_ids, pa.int64()), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())],
                    ["part", "seq", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    rows = files.select("part", "seq", "payload").mapInArrow(work, READ).join(offsets, ["part", "seq"])
    return rows.select("doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
