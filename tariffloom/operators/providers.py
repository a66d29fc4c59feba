"""Providers of documents, found or made: documents that share a number or a name are one group, each is folded in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import business_id, normalise
from ..session import workspace
from . import once

#: Fixed value: what a provider without a name is called.
UNNAMED = "Неизвестный партнёр"


def groups(pairs: DataFrame) -> DataFrame:
    """node, label of the nodes of pairs (a, b): the smallest node that is reached from each. A null end is none.

    Every round takes the least label of a node, of its neighbours, and the label of that label; rounds are written to the
    shared folder, and their number grows with the logarithm of the longest path. A node with many neighbours has their
    least label pre-aggregated."""
    spark, at = pairs.sparkSession, workspace(pairs.sparkSession)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{at}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{at}/{name}")

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    edges = pairs.where("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels, number = kept(nodes.select("node", F.col("node").alias("label")), "0"), 0
    while True:
        number += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("least"), F.col("label").alias("old"))
        # what a label's own node has found is a label for all that carry it
        lower = least.groupBy("old").agg(F.min("least").alias("low"))
        jumped = least.join(lower.withColumnRenamed("old", "_l"), F.col("least") == F.col("_l"), "left").join(lower.withColumnRenamed("low", "_own"), "old", "left")
        now = kept(jumped.select("node", F.least("least", F.coalesce("low", "least"), F.coalesce("_own", "least")).alias("label"), "old"), str(number))
        if now.where("label <> old").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


KNOWN = "kind string, key string, partner_id long, since long"


def fold(rows: Iterable[tuple], base: int) -> Iterator[tuple]:
    """rows of one group in order: (partner_id of a known provider or None, document, number, name). Gives what numbers and names
    stand for from a document on: ("bin" or "name", key, partner_id, since)."""
    by_bin: dict[str, int] = {}
    by_name: dict[str, int] = {}
    numbered: set[int] = set()

    def owns(number, partner, since):
        if number and partner not in numbered:
            numbered.add(partner)
            if number not in by_bin:
                by_bin[number] = partner
                yield "bin", number, partner, since

    def called(name, partner, since):
        if name and name not in by_name:
            by_name[name] = partner
            yield "name", name, partner, since

    for known, document, number, name in rows:
        found = by_bin.get(number) if known is None and number else known
        if found is None and name:
            found = by_name.get(name)
        partner = base + 1 + document if found is None else found
        yield from owns(number, partner, document)
        if known is not None or found is None:
            yield from called(name, partner, document)


def resolve_or_create(documents: DataFrame, partners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with partner_id, by, partner_confidence; providers with new ones), as if documents (document_id, name, bin) came
    one after another by document_id.

    A document's valid number finds the provider that has it; else its normalised name finds the first one of that name,
    which takes the number if it has none; else a provider is made, of the name (UNNAMED without one) and number. A number
    that misses falls back to the name even if the provider of that name has another number. Only the first document of each
    number and name changes anything, so these are reduced to one row each before they are grouped and folded; all
    documents then look up who had their number, if it was had by then, or else their name. Names without letters or digits
    find nothing: each such document without a number makes a provider of its own. Documents are read twice, to be reduced by
    what they say as it is written, so that the rest works on what differs, and to look up. A new provider's id is one
    more than its first document's added to the greatest known one. Documents need distinct ids from 0 on. Empty tables are fine."""
    base = partners.agg(F.coalesce(F.max("partner_id"), F.lit(0))).first()[0]
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit(UNNAMED))
    docs = documents.withColumns({"_b": business_id(F.col("bin")), "_called": name}).withColumn("_n", normalise(F.col("_called")))
    written = documents.groupBy("bin", "name").agg(F.min("document_id").alias("document"))
    keys = once.told(written, ["document"], _b=business_id(F.col("bin")), _n=normalise(name)).where("_b IS NOT NULL OR _n <> ''")
    met = keys.groupBy("_b", "_n").agg(F.min("document").alias("document"))
    known = partners.select(F.col("partner_id").alias("partner"), F.lit(None).cast("long").alias("document"), business_id(F.col("bin")).alias("_b"), normalise(F.col("partner_name")).alias("_n"))
    rows = known.unionByName(met.withColumn("partner", F.lit(None).cast("long")), allowMissingColumns=True)
    keyed = rows.withColumns({"a": F.concat(F.lit("b"), "_b"), "b": F.when(F.col("_n") != "", F.concat(F.lit("n"), "_n"))})
    at = workspace(documents.sparkSession)
    keyed.write.parquet(f"{at}/keys")
    keyed = documents.sparkSession.read.schema(keyed.schema).parquet(f"{at}/keys")
    found = groups(keyed.select("a", "b"))
    dealt = keyed.join(found, F.coalesce("a", "b") == found["node"]).select("label", "partner", F.col("document").cast("long").alias("document"), "_b", "_n")

    def run(batches):
        def told():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("label", "partner", "document", "_b", "_n")))

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "key", "partner_id", "since"])

        out = []
        for _, rows in groupby(told(), key=lambda r: r[0]):
            for fact in fold((r[1:] for r in rows), base):
                out.append(fact)
                if len(out) == 5000:
                    yield packed()
                    out.clear()
        yield packed()

    order = ["label", F.col("partner").asc_nulls_last(), "document"]
    facts = dealt.repartition("label").sortWithinPartitions(*order).mapInArrow(run, KNOWN)
    facts.write.parquet(f"{at}/facts")
    facts = documents.sparkSession.read.schema(KNOWN).parquet(f"{at}/facts")
    of = lambda kind, key: facts.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("partner_id").alias(f"_by_{kind}"), F.col("since").alias(f"_since_{kind}"))
    told = docs.join(of("bin", "_kb"), F.col("_b") == F.col("_kb"), "left").join(of("name", "_kn"), F.col("_n") == F.col("_kn"), "left")
    own = F.lit(base + 1) + F.col("document_id")
    had = F.col("_by_bin").isNotNull() & (F.col("_since_bin").isNull() | (F.col("_since_bin") <= F.col("document_id")))
    partner = F.when(had, F.col("_by_bin")).when(F.col("_by_name").isNotNull(), F.col("_by_name")).otherwise(own)
    first = F.col("partner_id") == own
    by = F.when(first, "new").when(had & (F.col("_since_bin").isNull() | (F.col("_since_bin") < F.col("document_id"))), "bin").otherwise("name")
    confidence = F.when(F.col("_b").isNotNull(), 0.9).when(F.trim(F.coalesce("name", F.lit(""))) != "", 0.6).otherwise(0.3)
    done = told.withColumn("partner_id", partner).withColumns({"by": by, "partner_confidence": confidence})
    made = done.where(first).select("partner_id", F.col("_called").alias("partner_name"))
    return done.select(*documents.columns, "partner_id", "by", "partner_confidence"), partners.unionByName(made, allowMissingColumns=True)
