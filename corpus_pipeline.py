"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet
and read back as the next stage's docs. All but the last return the columns of docs.

Odd input has a defined result in every stage. Null, empty and blank texts fail the quality rules; handed to
a later stage they have no n-grams, passages or items, stay, and are packed as the end token alone. Documents
without a doc_id are judged, packed and searched for items like others; the join drops none of them and no
passage is cut from them. Repeated rows are judged each, and the join keeps one of them. Very long texts are treated whole.
Ties are settled by the least doc_id. An empty table gives an empty one. Columns other than doc_id, text, source and
n_chars travel along whatever their names.

Stages that run Python bound the bytes of the session's Arrow batches, if it names no bound of its own.
"""

from __future__ import annotations

from thresher.llm import contamination, host_rules, overlap_join, packing, passages
from thresher.llm.registry import Query, table
from thresher.session import bounded_batches, pinned


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules, or the rules applied to their host, reject go."""
    return host_rules.kept_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates the document with the least doc_id stays."""
    bounded_batches(spark)
    return overlap_join.first_documents(docs)


def substring_dedup(spark, docs, sf_dir):
    """Passages that an earlier document has are cut out of the texts."""
    bounded_batches(spark)
    return passages.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark, docs, sf_dir):
    """Token pieces and their places in sequences."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

# Tokenizing and packing have no SQL form; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = Query("pipeline", run, ORACLE_SQL)
