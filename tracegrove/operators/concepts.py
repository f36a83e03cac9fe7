"""Which of many concepts a text holds: one automaton over all of them, one pass a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Concepts of an automaton at most; more are taken in several passes over the texts.
AUTOMATON = 200_000


def first_concept(texts: DataFrame, concepts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``texts`` that hold a concept, with the columns of the first of ``concepts`` (ord, concept, ...) that they hold, by ord.

    A concept is held if it is a part of the text, case included; an empty one is a part of each text, a null text holds none.
    An Aho-Corasick automaton of AUTOMATON concepts at most goes to the workers, which read each text once. Of concepts with one
    ord, any counts.
    """
    own = concepts.select("ord", "concept").where("concept IS NOT NULL")
    blocks = max(1, -(-own.count() // AUTOMATON))
    found = texts.withColumn("ord", F.lit(None).cast("long"))
    for k in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("concept"), F.lit(blocks)) == k)
        found = _pass(found, [(r["ord"], r["concept"]) for r in part.collect()], text)
    return found.where("ord IS NOT NULL").join(concepts, "ord")


def _pass(texts: DataFrame, concepts: list[tuple[int, str]], text: str) -> DataFrame:
    """The rows with ``ord`` brought down to the least of these concepts, if one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, always = ahocorasick.Automaton(), min((o for o, c in concepts if not c), default=None)
        for order, concept in sorted(concepts, reverse=True):  # the least ord of equal concepts comes last and stays
            if concept:
                automaton.add_word(concept, order)
        automaton.make_automaton()
        for batch in batches:
            orders = []
            for t, best in zip(batch.column(text).to_pylist(), batch.column("ord").to_pylist(), strict=True):
                if t is not None:
                    hits = [o for _, o in automaton.iter(t)] if len(automaton) else []
                    best = min([*hits, *(x for x in (best, always) if x is not None)], default=None)  # noqa: PLW2901
                orders.append(best)
            at = batch.schema.get_field_index("ord")
            yield batch.set_column(at, "ord", pa.array(orders, pa.int64()))

    return texts.mapInArrow(run, texts.schema)
