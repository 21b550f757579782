"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  A stage works on all that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from proxima.llm import decontam, mixing, sharding, simhash, toxicity
from proxima.llm.common import table, write_table

NEAR_DUPLICATES = {"k": 4, "radius": 4}  # four-word shingles, at most four differing bits


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity tagger rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i))
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return simhash.keep_one_per_group(docs, **NEAR_DUPLICATES)


def decontaminate(spark, docs, sf_dir):
    """Documents of which benchmark passages make up a twentieth or more go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Each source's documents as often as the target weights take them."""
    return mixing.take_mix(docs)


def shard(spark, docs, sf_dir):
    """Shard and slot of every row."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL expresses neither the trained toxicity model nor the minimax partition; the tests
#: compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
