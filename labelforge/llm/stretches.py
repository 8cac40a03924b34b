"""Token ids of whole texts from the ids of their stretches, each distinct stretch encoded once.

A stretch ends before a single space that has no white space on either side. Tokenizers that put a space before
the word after it, and never join what such a space parts, give a text the ids of its stretches one after the other.
"""

from __future__ import annotations

import json
import os
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import _Known, spread

#: White space beside a space: there the text is not cut.
GAP = r"[\x09-\x0D\x{85}\p{Z}]"
#: Distinct stretches that an encoder keeps, at most.
KEPT = 500_000
#: Texts are encoded in batches of about so many bytes; a longer text is a batch by itself.
BATCH_BYTES = 2 << 20


def batches(sizes: np.ndarray, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Row ranges whose sizes add up to at most `most`; a larger row has a range of its own."""
    out, low, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k > low and held + size > most:
            out.append((low, k))
            low, held = k, 0
        held += int(size)
    if low < len(sizes):
        out.append((low, len(sizes)))
    return out


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All stretches, without the space between them, and where each text's begin (one more than texts). Null is empty."""
    listed = pc.split_pattern(pc.fill_null(texts, ""), " ")
    parts, edges = listed.flatten(), listed.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    coded = pc.dictionary_encode(parts)
    at = coded.indices.to_numpy(zero_copy_only=False)
    head = pc.match_substring_regex(coded.dictionary, f"^({GAP}|$)").to_numpy(zero_copy_only=False)
    tail = pc.match_substring_regex(coded.dictionary, f"(^|{GAP})$").to_numpy(zero_copy_only=False)
    glued = np.zeros(len(parts), bool)
    if len(parts):
        glued[1:] = head[at][1:] | tail[at][:-1]
        glued[edges[:-1]] = False
    if not glued.any():
        return parts, edges
    starts = np.flatnonzero(~glued)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(parts)).astype(np.int32)), parts)
    return pc.binary_join(lists, " "), np.searchsorted(starts, edges)


class StretchEncoder:
    """Ids of texts; `encode` gives the flat ids of many strings and the number of ids of each.

    With spaced, a stretch after another is encoded with the space before it; without, the tokenizer adds that itself.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaced: bool, kept: int = KEPT) -> None:
        self._known, self._spaced = _Known(encode, kept), spaced

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        words, edges = cut(texts)
        empty = np.diff(edges) == 1
        empty &= pc.equal(words.take(pa.array(edges[:-1])), "").to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(words)
        at, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)
        if self._spaced:
            # The first stretch of a text stands without a space.
            at[edges[:-1]] += len(distinct)
            used, at = np.unique(at, return_inverse=True)
            distinct = np.array([distinct[k - len(distinct)] if k >= len(distinct) else f" {distinct[k]}" for k in used.tolist()], object)
        rows = self._known.rows(distinct)[at]
        lens = self._known.lens[rows].copy()
        lens[edges[:-1][empty]] = 0
        flat, ends = spread(self._known.ids, self._known.starts[rows], lens)
        return flat, np.diff(np.concatenate([np.zeros(1, np.int32), ends])[edges])


def lasting(key: str, make: Callable[[], object]) -> object:
    """What make() gave first for the key in this process. One key is held at a time.

    Functions that are sent by value have globals of their own in each task, so it hangs on a module made here.
    """
    held = sys.modules.setdefault("_lasting_encoders", types.ModuleType("_lasting_encoders")).__dict__
    if held.get("key") != key:
        held.clear()
        held.update(key=key, made=make())
    return held["made"]


def flattened(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    lists = list(lists)
    lens = np.fromiter(map(len, lists), np.int32, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.uint32, int(lens.sum())), lens


#: Characters whose class all versions of Unicode agree on; stretches with others go to the tokenizers library.
SETTLED = r"^[\x{00}-\x{24F}]*$"
#: Stretches that are encoded in one string.
TOGETHER = 8192


def bpe_encode(tokenizer_json: str, plain: bool = False) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of many stretches by the tokenizers library's rules; with plain, strings of special tokens are ordinary text.

    A byte-level tokenizer whose merges stand in the order of their ids has the same ids by ranks, which is several times
    faster: stretches of settled characters without special tokens are encoded so, many in one string, and told apart
    by their bytes. All other stretches, and all of other tokenizers, go to the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = plain

    def library(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened(e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    ranked = by_ranks(json.loads(tokenizer_json))
    if ranked is None:
        return library
    encoding, sizes, special = ranked

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = pa.array(texts, pa.string())
        easy = pc.and_(pc.match_substring_regex(words, SETTLED), pc.match_substring_regex(words, rf"^ ?[^{GAP[1:-1]}]+$"))
        for t in [] if plain else special:
            easy = pc.and_not(easy, pc.match_substring(words, t))
        easy = easy.to_numpy(zero_copy_only=False)
        spaced = pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
        # Without a space before it a stretch would run into the one before.
        quick, slow = np.flatnonzero(easy & spaced), np.flatnonzero(~(easy & spaced))
        lens, runs = np.zeros(len(texts), np.int32), []
        bytes_of = pc.binary_length(words).to_numpy()
        for low in range(0, len(quick), TOGETHER):
            some = quick[low : low + TOGETHER]
            ids = np.array(encoding.encode_ordinary("".join([texts[k] for k in some])), np.uint32)
            stops = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(bytes_of[some])) + 1
            lens[some] = np.diff(stops, prepend=0)
            runs.append(ids)
        first = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
        if not len(slow):
            return first, lens
        rest, lens[slow] = library([texts[k] for k in slow])
        starts = np.zeros(len(texts), np.int64)
        starts[quick] = np.cumsum(lens[quick]) - lens[quick]
        starts[slow] = np.cumsum(lens[slow]) - lens[slow] + len(first)
        return spread(np.concatenate([first, rest]), starts.astype(np.int32), lens)[0], lens

    return encode


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: visible Latin-1 characters themselves, the rest from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how byte-level tokenizers of this kind take words apart.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_ranks(spec: dict):
    """An encoding by ranks, the bytes of each id and the special strings; None for a tokenizer that is not of this kind."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    entries, merges = model.get("vocab"), model.get("merges")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    decoded = byte_table()
    base = len(entries) - len(merges) - sum(t in entries for t in special)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if base != 256 or any(entries.get(a + b) != base + k for k, (a, b) in enumerate(pairs)):
        return None
    import tiktoken

    ranks = {bytes(decoded[c] for c in w): i for w, i in entries.items() if w not in special}
    sizes = np.zeros(max(entries.values()) + 1, np.int64)
    for b, i in ranks.items():
        sizes[i] = len(b)
    return tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes, list(special)
