"""Words and trigrams of a table's texts by language, counted over all of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import Tally
from .words import words

WORD, TRIGRAM = "word", "trigram"
#: Distinct words that a task holds before it hands on what it counted; the parts are added up afterwards.
HELD = 500_000


def _count(kinds: tuple[str, ...]):
    def rows(tally: Tally) -> pa.RecordBatch:
        found = [(k, lang, x, n) for k in kinds for lang, c in (tally.words() if k == WORD else tally.trigrams()).items() for x, n in c.items()]
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, types)], names=["kind", "lang", "item", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for column in batch.columns:
                for text in column.to_pylist():
                    tally.add(words(text))
            if len(tally) > HELD:
                yield rows(tally)
                tally = Tally()
        yield rows(tally)

    return run


def learn(texts: DataFrame, *kinds: str) -> list[dict[str, Counter]]:
    """For each kind, by language, how often each word or trigram is in the texts of all columns.

    The driver gets a row for each distinct word or trigram, of which there are few new ones the more texts there are."""
    counted = texts.mapInArrow(_count(kinds), "kind string, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, Counter]] = {k: {} for k in kinds}
    for batch in counted.toArrow().to_batches():
        for kind, lang, item, n in zip(*(c.to_pylist() for c in batch.columns)):
            out[kind].setdefault(lang, Counter())[item] = n
    return [out[k] for k in kinds]
