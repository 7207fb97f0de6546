"""The corpus pipeline: five stages, each of which reads what the stage before it has written.

All stages but the last return the columns of their input, further ones included. Null texts count as empty; empty
tables pass through. What a stage has read is deleted once the stage after it has been written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import line_dedup, near_dedup, packing, quality_rules, toxicity
from quarry.llm.common import forget, materialize, table


def toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go. The model learns from the labelled documents of the input table."""
    model = toxicity.fit(toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, model)


def quality(spark, docs, sf_dir):
    """Documents that fail the quality rules go."""
    return quality_rules.quality_filter(docs)


def lines(spark, docs, sf_dir):
    """Later copies of repeated runs of lines go; all documents stay, with the number of characters that they now have."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return line_dedup.line_dedup(docs).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near(spark, docs, sf_dir):
    """One document of each group of texts of similarity 0.8 and more over five-word shingles stays: the one with the least doc_id."""
    return near_dedup.one_of_each(docs)


def pack(spark, docs, sf_dir):
    """The documents' ids in sequences."""
    return packing.packed(docs)


STAGES = [("toxicity", toxic), ("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("packing", pack)]


def run(spark, sf_dir):
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = read, materialize(docs, f"stage{k}")
            read = docs
            if before is not None:
                forget(before)
    return docs


#: The toxicity stage is a learned model, which SQL cannot express; the pipeline is tested against plain Python.
ORACLE_SQL = None
