"""Duplicates hidden by formatting differences: commutative multiset hashing of fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import profiles
from termloom.plans.lineage import cut


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the second texts that are not the same in form as the first ones."""
    for batch in batches:
        ids, a, b = (batch.column(c).to_pylist() for c in range(3))
        bad = [i for i, x, y in zip(ids, a, b, strict=True) if not profiles.same_in_form(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["id"])


def form_classes(forms: DataFrame) -> DataFrame:
    """(l1, l2, kept, copies): per letter fingerprint the smallest id of its class.

    Rows with equal letters are one class; labelled rows with equal field multisets join their
    letters' classes.  Both steps work on one row per (letters, fields) combination, made with
    map-side combining.  Only letters with labelled rows take part in the joining rounds.
    """
    nodes = cut(forms.groupBy("l1", "l2", "m1", "m2").agg(F.min("id").alias("label"), F.count(F.lit(1)).alias("n")))
    labelled = nodes.where("m1 is not null").join(
        nodes.groupBy("l1", "l2").agg(F.min("label").alias("low")), ["l1", "l2"]
    )
    links = cut(labelled.select("l1", "l2", "m1", "m2", F.col("low").alias("label")))
    while True:
        by_fields = links.groupBy("m1", "m2").agg(F.min("label").alias("f"))
        by_letters = links.join(by_fields, ["m1", "m2"]).groupBy("l1", "l2").agg(F.min("f").alias("g"))
        moved = cut(links.join(by_letters, ["l1", "l2"]).select("l1", "l2", "m1", "m2", F.col("g").alias("label"), (F.col("g") < F.col("label")).alias("down")))
        changed = moved.where("down").limit(1).count()
        links = moved.drop("down")
        if not changed:
            break
    letters = nodes.groupBy("l1", "l2").agg(F.min("label").alias("low"), F.sum("n").alias("n"))
    joined = links.groupBy("l1", "l2").agg(F.min("label").alias("label"))
    return letters.join(joined, ["l1", "l2"], "left").select("l1", "l2", F.coalesce("label", "low").alias("kept"), "n", "low")


def form_copies(docs: DataFrame, id_col: str = "ordinal", text_col: str = "text") -> DataFrame:
    """(kept, copy): every row that is the same in form as another, with its class's smallest id.

    Texts are the same in form when the letters and digits of their folded texts agree in order,
    or when both are made of labelled fields and agree in the multiset of (name, value) pairs.
    Both relations join: a text that agrees in letters with one labelled text is in the class of
    all its orders.  Every link of a class is verified on the texts, rows against the first row
    with equal letters and labelled rows against the first one with equal fields; rows whose
    fingerprints collide by chance stay records of their own.

    Null, empty and letterless texts are never copies.  Rows with a null id are left out.  Rows
    that repeat an id are copies of each other only through their texts: the pair (id, id) is not
    given.  An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    forms = cut(texts.mapInArrow(profiles.forms, profiles.FORM_SCHEMA))
    classes = form_classes(forms)
    joined = classes.where("kept < low").select("kept").distinct().withColumn("joined", F.lit(True))  # a kept row may be alone with its letters
    classes = classes.join(joined, "kept", "left").where("n > 1 or joined").select("l1", "l2", "kept", "low")
    members = cut(forms.join(classes, ["l1", "l2"]).select("id", "kept", "low", "l1", "l2", "m1", "m2"))
    labelled = members.where("m1 is not null").groupBy("l1", "l2", "m1", "m2").agg(F.min("id").alias("id"))
    first = labelled.groupBy("m1", "m2").agg(F.min("id").alias("first"))
    links = members.where("id > low").select(F.col("low").alias("first"), "id").union(labelled.join(first, ["m1", "m2"]).where("id > first").select("first", "id"))
    # only the texts that take part are read again for the exact comparison
    second = links.join(texts.select("id", F.col("text").alias("b")), "id")
    both = second.join(texts.select(F.col("id").alias("first"), F.col("text").alias("a")), "first").select("id", "a", "b")
    bad = cut(both.mapInArrow(_differ, "id bigint").distinct())
    pairs = members.where("id > kept")
    if bad.limit(1).count():
        wrong = members.join(bad, "id", "left_semi").select("l1", "l2", "id", (F.col("id") == F.col("low")).alias("whole"))
        pairs = pairs.join(wrong.select("id"), "id", "left_anti").join(wrong.where("whole").select("l1", "l2"), ["l1", "l2"], "left_anti")
    return pairs.select("kept", F.col("id").alias("copy"))


def collapse(docs: DataFrame, id_col: str = "ordinal", text_col: str = "text") -> DataFrame:
    """One row per record, all columns of its kept row, and ``copies``: the rows it stands for.

    A record's kept row is the one with the smallest id.  Texts that are never copies (null,
    empty, letterless) each stay as a record with one copy.  A column named ``copies`` in the
    input is replaced.
    """
    pairs = cut(form_copies(docs, id_col, text_col))
    counts = pairs.groupBy("kept").agg((F.count(F.lit(1)) + 1).alias("__copies"))
    rest = docs.drop("copies").join(pairs.select(F.col("copy").alias(id_col)), id_col, "left_anti")
    return (
        rest.join(counts.withColumnRenamed("kept", id_col), id_col, "left")
        .withColumn("copies", F.coalesce("__copies", F.lit(1).cast("bigint")))
        .drop("__copies")
    )
