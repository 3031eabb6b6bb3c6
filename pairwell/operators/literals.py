"""A set of literals sought in every text at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairwell.functions.view import ZERO_WIDTH

#: Characters of literals that are sent to the workers at once.
MOST_CHARS = 4 << 20
_DROP = dict.fromkeys(map(ord, ZERO_WIDTH))


def fold(text: str) -> str:
    """The caseless form of the rendered view: composed, without zero-width signs, case-folded."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(_DROP)).casefold())


def lower(text: str) -> str:
    """Lower case character by character, as SQL's `lower`: no character becomes two and none looks at its neighbours."""
    return text.lower() if text.isascii() else text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def blank(literal: str) -> bool:
    """No literal to seek: nothing but white space."""
    return not literal.strip()


def literal_hits(
    texts: DataFrame, literals: DataFrame, text_id: str, literal_id: str, text: str = "text", literal: str = "text",
    fold: Callable[[str], str] = fold, skip: Callable[[str], bool] = blank,
) -> DataFrame:
    """text_id and literal_id wherever the folded text holds the folded literal, whatever its length.

    Every text is read once for each block of literals: a block is as much of
    them as MOST_CHARS allows, measured before it is collected, so a larger
    set takes more scans and never more memory. Literals to `skip` are in no
    text, blank ones by default, an empty one otherwise in each; null texts
    hold none; repeated rows give repeated pairs. `fold` is the rendered,
    caseless form by default.
    """
    wanted = literals.select(F.col(literal_id).alias("__id"), F.col(literal).alias("__literal")).filter(F.col("__literal").isNotNull())
    chars = wanted.agg(F.coalesce(F.sum(F.length("__literal") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // MOST_CHARS))
    source = texts.select(F.col(text_id), F.col(text).alias("__text"))
    schema = texts.select(text_id).schema.add(literal_id, literals.schema[literal_id].dataType)
    out = to_arrow_schema(schema)
    found = None
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("__id", "__literal"), F.lit(blocks)) == block)
        ids: dict[str, list] = {}
        for row in some.collect():  # at most about MOST_CHARS characters
            if not skip(folded := fold(row[1])):
                ids.setdefault(folded, []).append(row[0])
        shared = texts.sparkSession.sparkContext.broadcast(ids)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine, named, everywhere = ahocorasick.Automaton(), list(shared.value.values()), []
            for i, word in enumerate(shared.value):
                if word:
                    machine.add_word(word, i)
                else:
                    everywhere = [i]
            if not named:
                return
            machine.make_automaton()
            held = machine.iter if len(machine) else lambda _: ()
            for batch in batches:
                at, hits = [], []
                for row, value in enumerate(batch.column(1)):
                    value = value.as_py()
                    for i in () if value is None else sorted({i for _, i in held(fold(value))}.union(everywhere)):
                        at += [row] * len(named[i])
                        hits += named[i]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, out.field(1).type)], schema=out)

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found
