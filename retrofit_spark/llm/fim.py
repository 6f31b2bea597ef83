"""Fill-in-middle transformation with an indexable skip list of lines.

A text is a sequence of lines (each with its line feed; what follows the last one is a line too). Two ranks, drawn from
a hash of the document's id, cut it into prefix, middle and suffix, and these are put in another order between
sentinels: prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Texts that are empty, hold a sentinel, or are not
drawn stay as they are (plain).

The lines of a slice of texts are the lowest lane of a skip list. Each lane above holds the first line of each text and
a quarter of the other lines of the lane below, by a hash of their place, so that a rerun makes the same lanes. A link
carries its width in lines, code points and bytes. From the top lane down, a cut takes each link that doesn't go
beyond its rank, and adds up the widths; on the lowest lane, whose links are one line wide, it has reached the rank exactly. All
cuts of a slice descend together.

Null text counts as empty, null ids hash as the empty string. Repeated rows are transformed alike, an empty table gives an empty
result, other columns are ignored. Texts of any length are transformed whole. There is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, text_slices
from .scratch import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT, SEED = 100, 50, "7"
#: One of so many lines of a lane is on the lane above.
PROMOTED = 4

_MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def check_sentinels(prefix: str, suffix: str, middle: str) -> None:
    """A text without sentinels can be rebuilt if a sentinel's first character occurs only there, and no sentinel begins another."""
    all_three = (prefix, suffix, middle)
    firsts = {s[:1] for s in all_three}
    if not all(all_three) or any(c in s[1:] for s in all_three for c in firsts) or any(a is not b and a.startswith(b) for a in all_three for b in all_three):
        raise ValueError(f"sentinels {all_three} could be confused with each other or with text")


class SkipList:
    """Lines of the texts of one slice.

    lanes: from the lowest up, (widths of shape (3, nodes) in lines, code points and bytes; place of each node on the lane below; place of each
    text's first node, and the end of the lane).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begins = np.zeros(len(data) + 1, bool)
        begins[1:][data == 10] = True
        begins[offsets[:-1]] = True
        begins[len(data)] = False
        starts = np.flatnonzero(begins)
        widths = np.ones((3, len(starts)), np.int64)
        if len(starts):
            widths[1] = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts)
        widths[2] = np.diff(np.append(starts, len(data)))
        first = np.searchsorted(starts, offsets)
        self.lines = np.diff(first)
        self.lanes = [(widths, np.arange(len(starts)), first)]
        while True:
            widths, _, first = self.lanes[-1]
            n, level = widths.shape[1], np.uint64(len(self.lanes))
            promoted = mix(np.arange(n, dtype=np.uint64) + (level << np.uint64(40))) % np.uint64(PROMOTED) == 0
            some = np.diff(first) > 0
            promoted[first[:-1][some]] = True
            nodes = np.flatnonzero(promoted)
            if len(nodes) in (n, some.sum()):
                break
            self.lanes.append((np.add.reduceat(widths, nodes, axis=1), nodes, np.searchsorted(nodes, first)))

    def descend(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points, bytes) before the given rank of each text; a rank is 0 to the text's number of lines."""
        node, gone = self.lanes[-1][2][:-1].copy(), np.zeros((3, len(ranks)), np.int64)
        for level in range(len(self.lanes) - 1, -1, -1):
            widths, below, first = self.lanes[level]
            ends = first[1:]
            going = np.flatnonzero(node < ends)
            while len(going):
                step = widths[:, node[going]]
                fits = gone[0, going] + step[0] <= ranks[going]
                going = going[fits]
                gone[:, going] += step[:, fits]
                node[going] += 1
                going = going[node[going] < ends[going]]
            if level:  # to the same line on the lane below; a text's end stays its end
                inside = node < ends
                node = np.where(inside, below[np.where(inside, node, 0)], self.lanes[level - 1][2][1:])
        return gone[1], gone[2]


def _holding(raw: bytes, offsets: np.ndarray, words: tuple[bytes, ...]) -> np.ndarray:
    """Whether each text holds one of the words."""
    out = np.zeros(len(offsets) - 1, bool)
    for word in words:
        at = raw.find(word)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(word) <= offsets[row + 1]:
                out[row] = True
                at = raw.find(word, int(offsets[row + 1]))
            else:
                at = raw.find(word, at + 1)
    return out


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit integers from the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED,
    prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE,
) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars (null if plain) and the output text."""
    check_sentinels(prefix, suffix, middle)
    p, s, m = (x.encode() for x in (prefix, suffix, middle))

    def run(batches):
        for rows, data, offsets in text_slices(batches):
            lines = SkipList(data, offsets)
            h1, h2, h3, h4 = (rows.column(rows.schema.get_field_index(f"h{k}")).to_numpy() for k in range(1, 5))
            x, y = h1 % (lines.lines + 1), h2 % (lines.lines + 1)
            raw = data.tobytes()
            plain = (np.diff(offsets) == 0) | (h3 % 100 >= fim_percent) | _holding(raw, offsets, (p, s, m))
            suffix_first = h4 % 100 < spm_percent
            (chars_a, bytes_a), (chars_b, bytes_b) = lines.descend(np.minimum(x, y)), lines.descend(np.maximum(x, y))
            out = []
            for start, a, b, end, keep, turned in zip(offsets[:-1].tolist(), (offsets[:-1] + bytes_a).tolist(), (offsets[:-1] + bytes_b).tolist(), offsets[1:].tolist(), plain.tolist(), suffix_first.tolist(), strict=True):
                if keep:
                    out.append(raw[start:end])
                else:
                    out.append(b"".join((s, raw[b:end], p, raw[start:a], m, raw[a:b]) if turned else (p, raw[start:a], s, raw[b:end], m, raw[a:b])))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            columns = [rows.column(0), pa.array(lines.lines, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(chars_a, pa.int64(), mask=plain), pa.array(chars_b - chars_a, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = documents(docs, id_col, text_col)
    return own.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1))).mapInArrow(run, _MADE)


def restored(output: Column, form: Column, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE) -> Column:
    """The text that an output of fill_in_middle was made from."""

    def between(body: Column, first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, first, 1)
        body = F.substr(body, F.length(one) + F.lit(len(first) + 1))
        two = F.substring_index(body, second, 1)
        return one, two, F.substr(body, F.length(two) + F.lit(len(second) + 1))

    head, tail, mid = between(F.substr(output, F.lit(len(prefix) + 1)), suffix, middle)
    psm = F.concat(head, mid, tail)
    tail, head, mid = between(F.substr(output, F.lit(len(suffix) + 1)), prefix, middle)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(head, mid, tail))


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns from fill_in_middle()."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
