"""Fill-in-the-middle: a text is cut in three at units' borders and written with its middle last.

A text's UTF-8 bytes become big integers with one bit a byte: bytes.translate
maps each byte to whether it is in a class, and int() reads the result. Shifts
and boolean operations over these masks mark where units start, bit_count()
numbers the units and code points, and the place of the k-th unit is found by
halving: whichever half of the mask holds the k-th bit is halved again. So a
text of any length takes time in proportion to it and no loop over its lines.

Units: "line", a run up to and with \\n; "word", a run without white space (the
six ASCII characters) and the white space behind it; "char", a code point. What
comes before the first word is a unit of its own.

Null is an empty text, and a null doc_id the empty string where chances are
drawn. A text that is empty, or contains a sentinel, or isn't chosen, stays as
it is: its form is "plain". Repeated rows are transformed alike, each for
itself. A cut may be at the text's ends, so any of the three parts may be
empty. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.llm import text


@dataclass(frozen=True)
class Style:
    """unit: what cuts fall between. rate: in how many of 100 texts. spm: in how many of 100 of these the suffix comes first. seed: of the chances. prefix, suffix, middle: the sentinels."""

    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in STARTS:
            raise ValueError(f"no such unit: {self.unit}")
        s = self.sentinels
        if any(not a for a in s) or any(a[-k:] == b[:k] and (a != b or k < len(a)) for a in s for b in s for k in range(1, min(len(a), len(b)) + 1)) or any(a in b for i, a in enumerate(s) for j, b in enumerate(s) if i != j):
            raise ValueError("sentinels must be different, and none may begin within another or itself")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def classes(of: bytes) -> bytes:
    """A table for bytes.translate: "1" for the bytes of the class, "0" for others."""
    return bytes(49 if b in of else 48 for b in range(256))


NEWLINE, WHITE, LEAD = classes(b"\n"), classes(text.SPACE), classes(bytes([*range(0x80), *range(0xC0, 0x100)]))


def mask(doc: bytes, table: bytes) -> int:
    """Bit i is set if byte i of doc, which isn't empty, is in the table's class."""
    return int(doc[::-1].translate(table), 2)


def _lines(doc: bytes) -> int:
    return ((mask(doc, NEWLINE) << 1) | 1) & ((1 << len(doc)) - 1)


def _words(doc: bytes) -> int:
    white = mask(doc, WHITE)
    return (((white << 1) & ~white) | 1) & ((1 << len(doc)) - 1)


def _chars(doc: bytes) -> int:
    return mask(doc, LEAD)


#: For each unit, the mask of the bytes that a unit starts at, for a text that isn't empty.
STARTS = {"line": _lines, "word": _words, "char": _chars}


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, from 0; bits has more than k of them."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, at, k, width = bits >> half, at + half, k - n, width - half
    return at


def cut(doc: bytes, unit: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units, and the bytes where prefix and middle end."""
    if not doc:
        return 0, 0, 0
    starts = STARTS[unit](doc)
    n = starts.bit_count()
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, *(len(doc) if k == n else select(starts, k) for k in (lo, hi))


def chars(doc: bytes, at: int) -> int:
    """Code points before byte at."""
    return (mask(doc, LEAD) & ((1 << at) - 1)).bit_count() if at else 0


_OUT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _rewritten(style: Style):
    p, s, m = (x.encode() for x in style.sentinels)

    def of(batches):
        for b in batches:
            ids, chances = b.column("doc_id"), np.stack([b.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)])
            for lo, hi, buf, offs in text.slices(b.column("text"), 8 << 20):
                data, rows = buf.tobytes(), []
                for d in range(hi - lo):
                    doc = data[offs[d] : offs[d + 1]]
                    h1, h2, h3, h4 = chances[:, lo + d].tolist()
                    n, i, j = cut(doc, style.unit, h1, h2)
                    if not doc or h3 % 100 >= style.rate or p in doc or s in doc or m in doc:
                        rows.append((n, "plain", None, None, doc))
                        continue
                    first, pre, mid, suf = chars(doc, i), doc[:i], doc[i:j], doc[j:]
                    spm = h4 % 100 < style.spm
                    out = s + suf + p + pre + m + mid if spm else p + pre + s + suf + m + mid
                    rows.append((n, "spm" if spm else "psm", first, chars(doc, j) - first, out))
                columns = [pa.array(c, pa.binary() if f.name == "output" else f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)]
                columns[-1] = columns[-1].view(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *columns], ["doc_id", *_OUT.names])

    return of


def chances(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 drawn from seed and doc_id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def transform(documents: DataFrame, style: Style = Style()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text): number of units, plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle), code points of the prefix and the middle (null if plain), and the text as it is then."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", *chances(F.col("doc_id"), style.seed)).mapInArrow(_rewritten(style), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str, form: str, style: Style = Style()) -> Column:
    """The text that transform() made output of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in style.sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
