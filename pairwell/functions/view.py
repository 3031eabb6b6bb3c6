"""The rendered view of a text, with evidence and positions (TXT8), and its caseless form for TXT1 to TXT4, LEK1 and LEK3.

The view drops zero-width signs and is composed (NFC). ASCII texts, which it cannot change, stay in the JVM: the Arrow
functions here are given null for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import rows

#: The code points that the rendered view drops.
REMOVED = (0x200B, 0x2060, 0xFEFF)
ZERO_WIDTH = tuple(map(chr, REMOVED))
_DROP = dict.fromkeys(REMOVED)
_DROPPED = re.compile("[" + "".join(ZERO_WIDTH) + "]")


def view_of(text: str) -> str:
    return unicodedata.normalize("NFC", text.translate(_DROP))


def fold_of(text: str) -> str:
    return view_of(text).casefold()


def _plain(text: Column) -> Column:
    """Whether a text is ASCII: a byte a character."""
    return F.octet_length(text) == F.length(text)


def _beyond_ascii(text: Column) -> Column:
    return F.when(~_plain(text), text)


_folds = rows.of_text(T.StringType(), lambda t: None if t is None else fold_of(t))
_views = rows.of_text(T.StringType(), lambda t: None if t is None else view_of(t))


def rendered(text: Column) -> Column:
    """The view itself."""
    return F.when(_plain(text), text).otherwise(_views(_beyond_ascii(text)))


def folded(text: Column) -> Column:
    """The view with full case folding: ß is ss, İ is i with a dot above, a final sigma is a sigma."""
    return F.when(_plain(text), F.lower(text)).otherwise(_folds(_beyond_ascii(text)))


EVIDENCE = T.StructType([
    T.StructField("changed", T.BooleanType()), T.StructField("canonical_normalized", T.BooleanType()),
    T.StructField("removed", T.MapType(T.StringType(), T.IntegerType())), T.StructField("removed_at", T.ArrayType(T.IntegerType())),
])


def _evidence_of(t: str | None) -> dict:
    if t is None:
        return {"changed": False, "canonical_normalized": False, "removed": [], "removed_at": []}
    at = [m.start() for m in _DROPPED.finditer(t)]
    counts = [(f"U+{c:04X}", n) for c in REMOVED if (n := t.count(chr(c)))]
    stripped = t.translate(_DROP)
    composed = unicodedata.normalize("NFC", stripped)
    return {"changed": composed != t, "canonical_normalized": composed != stripped, "removed": counts, "removed_at": at}


_evidence = rows.of_text(EVIDENCE, _evidence_of)


def normalization(text: Column) -> Column:
    """TXT8: whether the view differs, whether it was composed, what was removed how often, and at which characters."""
    return F.when(text.isNotNull(), _evidence(_beyond_ascii(text)))


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that compose apart from each other: an ASCII character begins one, for it never joins what stands before it."""
    start = 0
    for i in range(1, len(text)):
        if text[i] < "\x80":
            yield start, i
            start = i
    if text:
        yield start, len(text)


def positions(text: str) -> tuple[str, list[int], list[int]]:
    """The folded view and, for each of its characters, the stretch of the text that it comes from."""
    out, starts, ends = [], [], []
    for low, high in _segments(text):
        raw = text[low:high]
        if raw.isascii() or unicodedata.is_normalized("NFC", raw.translate(_DROP)):
            for i, c in enumerate(raw, low):
                if ord(c) not in _DROP:
                    folds = c.casefold()
                    out.append(folds)
                    starts += [i] * len(folds)
                    ends += [i + 1] * len(folds)
            continue
        folds = fold_of(raw)
        out.append(folds)
        starts += [low] * len(folds)
        ends += [high] * len(folds)
    return "".join(out), starts, ends


def located(text: Column, value: str) -> Column:
    """struct(start, end): the characters of the text as it stands in which the value is first found on the folded view; null if it is not."""
    want = fold_of(value)
    spans = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def find_in(t: str | None) -> dict | None:
        at = -1 if t is None or want not in fold_of(t) else (found := positions(t))[0].find(want)
        return {"start": found[1][at], "end": found[2][at + len(want) - 1]} if at >= 0 and want else None

    find = rows.of_text(spans, find_in)
    at = F.instr(F.lower(text), F.lit(want)) if want.isascii() and want else F.lit(0)
    plain = F.struct((at - 1).cast("int").alias("start"), (at - 1 + len(want)).cast("int").alias("end"))
    far = find(_beyond_ascii(text))
    return F.when(_plain(text), F.when(at > 0, plain)).otherwise(F.when(far["start"].isNotNull(), far))
