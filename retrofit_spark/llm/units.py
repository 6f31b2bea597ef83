"""Exact encoding of many texts by the tokenizers library, with every repeated stretch encoded once.

A break is proven safe where white space follows a visible ASCII character or a Latin letter of U+00C0 to
U+00FF, or where a mark of .,;:!?) follows a letter of these: no alternative of either tokenizer's
splitting pattern matches across it, the pattern's only look-ahead concerns runs of white space,
special tokens hold neither white space nor such marks, and NFC, lower-casing and white-space folding
don't cross it. So the ids of a text are the ids of its stretches between safe breaks, one after the
other. Stretches are told apart by hash and then compared byte by byte. A tokenizer that splits in another way than
the proof covers (covered()) has no safe breaks but the starts of texts: each distinct text is encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

from .arrowtext import SpanHash, spread

MEMO_UNITS, MEMO_BYTES = 300_000, 64
#: Bytes of text that are put together for one call of the library, about.
JOINED = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


_SPACE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b".,;:!?)")] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[9, 10, 11, 12, 13]] = 32


def safe_breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row starts and safe breaks within rows, ascending; empty rows have none."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        prev, now = data[:-1], data[1:]
        latin = np.zeros(len(prev), bool)
        latin[1:] = (data[:-2] == 0xC3) & (prev[1:] >= 0x80) & (prev[1:] != 0x97) & (prev[1:] != 0xB7)
        cut[1:-1] = ((prev > 0x20) & (prev < 0x7F) | latin) & _SPACE[now] | (_LETTER[prev] | latin) & _MARK[now]
    cut[offsets[:-1]] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def drops_case_and_space(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, makes white space one blank, and drops it."""
    made = json.loads(tokenizer.to_str())
    kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
    first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return "Lowercase" in kinds and "Replace" in kinds and first.get("behavior") == "Removed" and bool(first.get("invert"))


#: Fixed value: the splitting pattern, beside byte-level's own, for which breaks are proven safe.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The normalisers, with all of their fields, for which breaks are proven safe.
NORMALISERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


def covered(tokenizer) -> bool:
    """Whether the proof of safe breaks holds for the tokenizer's splitting, normalising and special strings."""
    made = json.loads(tokenizer.to_str())
    steps = made.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    own_split = len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space")
    word_split = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
    normal = made.get("normalizer") or {"type": "Sequence", "normalizers": []}
    plain = all(step in NORMALISERS for step in (normal["normalizers"] if normal.get("type") == "Sequence" else [normal]))
    special = all(not (t.lstrip or t.rstrip or t.single_word) and not set(t.content) & set(" \t\n\r\v\f.,;:!?)") for t in tokenizer.get_added_tokens_decoder().values())
    return bool((own_split or word_split) and plain and special)


def keeps_bytes(tokenizer) -> bool:
    """Whether the tokens of a text are its bytes, one after the other: byte level, nothing normalised or dropped."""
    made = json.loads(tokenizer.to_str())
    return not made.get("normalizer") and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel"


def token_sizes(tokenizer) -> np.ndarray:
    """Bytes of each token: a byte level's token has a character for each, an added one is as it is written."""
    out = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, np.int64)
    for token, k in tokenizer.get_vocab(with_added_tokens=True).items():
        out[k] = len(token)
    for k, added in tokenizer.get_added_tokens_decoder().items():
        out[k] = len(added.content.encode())
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse) over spans that tile `data`: which span first has each content, and each span's content."""
    _, first, inverse = np.unique(hashes.of(starts, ends), return_index=True, return_inverse=True)
    origin, lengths = starts[first][inverse], ends - starts
    same = np.array_equal(lengths, (ends - starts)[first][inverse]) and np.array_equal(data[spread(origin, lengths)], data[spread(starts, lengths)])
    if not same:  # two contents with one hash: tell them apart by themselves
        raw, seen, first, inverse = data.tobytes(), {}, [], np.zeros(len(starts), np.int64)
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            inverse[k] = seen.setdefault(raw[a:b], len(seen))
            if inverse[k] == len(first):
                first.append(k)
        first = np.array(first)
    return first, inverse


class UnitEncoder:
    """Ids of stretches of bytes. Keeps a bounded memo of short stretches over the life of a Python worker:
    what has been met since the memo last filled up, and what had been met in the filling before that."""

    def __init__(self, path: str):
        self.tokenizer, self.memo, self.older = load(path), {}, {}
        self.covered = covered(self.tokenizer)
        self.folds = self.covered and drops_case_and_space(self.tokenizer)
        self.sizes = token_sizes(self.tokenizer) if self.covered and keeps_bytes(self.tokenizer) else None

    def breaks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of stretches that are encoded by themselves."""
        starts = safe_breaks(data, offsets) if self.covered else np.unique(offsets[:-1])
        return starts[starts < len(data)]

    def lookup(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit as uint32 bytes."""
        memo, older = self.memo, self.older
        found, missing = list(map(memo.get, units)), []
        for k in [k for k, x in enumerate(found) if x is None]:
            again = older.get(units[k])
            if again is None:
                missing.append(k)
            else:
                found[k] = memo[units[k]] = again
        if missing:
            for k, ids in zip(missing, self._encoded([units[k] for k in missing]), strict=True):
                found[k] = ids
                if len(units[k]) <= MEMO_BYTES:
                    memo[units[k]] = found[k]
        if len(memo) > MEMO_UNITS:
            self.memo, self.older = {}, memo
        return found

    def _encoded(self, units: list[bytes]) -> list[bytes]:
        """The ids of units that aren't remembered. Units are put together to texts of some KB where the joints are safe breaks, if tokens keep their bytes, by which ids are told apart again."""
        one_by_one = lambda some: [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([u.decode() for u in some], add_special_tokens=False)]
        if self.sizes is None:
            return one_by_one(units)
        raw = b"".join(units)
        data, ends = np.frombuffer(raw, np.uint8), np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        starts = np.append(0, ends[:-1])
        safe = np.isin(starts, safe_breaks(data, np.zeros(1, np.int64)), assume_unique=True)
        firsts = np.flatnonzero(~safe | np.append(True, starts[1:] // JOINED != starts[:-1] // JOINED))
        edges = np.append(starts[firsts], len(raw)).tolist()
        encoded = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in encoded)), np.uint32)
        upto = np.cumsum(self.sizes[ids])
        at = np.searchsorted(upto, ends)
        if not np.array_equal(upto[np.minimum(at, len(upto) - 1)] if len(upto) else at, ends):
            return one_by_one(units)
        blob, cuts = ids.tobytes(), ((at + 1) * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _parts(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all distinct stretches, where each one's begin, how many, which stretch is where, starts of stretches)."""
        starts = self.breaks(data, offsets)
        # Letters of either case and kinds of white space fold where no combining mark could tell them apart.
        if self.folds and data.max() < 0xC4 and b"<|" not in data.tobytes():
            data = _FOLDED[data]
        ends = np.append(starts[1:], len(data))
        first, inverse = distinct(data, starts, ends, SpanHash(data))
        raw = data.tobytes()
        ids = self.lookup([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        return np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes, sizes, inverse, starts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows among them)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        flat, begin, sizes, inverse, starts = self._parts(data, offsets)
        counts = sizes[inverse]
        total = np.concatenate(([0], np.cumsum(counts)))
        return flat[spread(begin[inverse], counts)], total[np.searchsorted(starts, offsets)]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each row."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        _, _, sizes, inverse, starts = self._parts(data, offsets)
        total = np.concatenate(([0], np.cumsum(sizes[inverse])))
        return np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One for each tokenizer and Python worker."""
    return UnitEncoder(path)
