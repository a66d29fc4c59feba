"""Price versions: same-day duplicates, chains, anomalies, snapshots and the one active row of each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise

ANOMALY = "PRICE_ANOMALY"


def anomaly(new: Column, old: Column, limit: float = 0.5) -> Column:
    """Whether a price moved by more than the limit; false without both prices or from zero."""
    return F.coalesce((old != 0) & (F.abs(new - old) > F.lit(limit).cast("decimal(6,4)") * F.abs(old)), F.lit(False))


def chain(rows: DataFrame, price: str = "price", tie: str = "item_id") -> DataFrame:
    """The closed form of upserting all rows in date order: version, previous_item_id, is_active, is_anomaly for each row.

    A line is a partner and a trimmed raw name. Dates ascend, null first; equal ones are ordered by the tie column."""
    line = Window.partitionBy("partner_id", F.trim("service_name_raw")).orderBy(F.col("effective_date").asc_nulls_first(), tie)
    return rows.withColumns({
        "version": F.row_number().over(line), "previous_item_id": F.lag(tie).over(line),
        "is_active": F.lead(tie).over(line).isNull(), "is_anomaly": anomaly(F.col(price), F.lag(price).over(line)),
    })


def same_day(new: DataFrame, active: DataFrame) -> DataFrame:
    """Each new row with the active row that it replaces: same partner, trimmed name and date, null dates being equal."""
    old = active.where("is_active").select(F.col("partner_id").alias("_p"), F.trim("service_name_raw").alias("_n"), F.col("effective_date").alias("_d"), F.col("item_id").alias("old_item_id"), F.col("version").alias("old_version"))
    best = old.withColumn("_k", F.row_number().over(Window.partitionBy("_p", "_n", "_d").orderBy(F.col("old_version").desc(), "old_item_id"))).where("_k = 1").drop("_k")
    on = F.col("partner_id").eqNullSafe(F.col("_p")) & F.trim("service_name_raw").eqNullSafe(F.col("_n")) & F.col("effective_date").eqNullSafe(F.col("_d"))
    return new.join(best, on, "left").drop("_p", "_n", "_d")


def snapshot_merge(stored: DataFrame, document: DataFrame, price: str = "price") -> DataFrame:
    """One document's rows upserted into the stored ones: all rows after it, with is_active, version, previous_item_id, is_anomaly.

    Rows of the document see the snapshot before it, not each other, so equal keys inside it all become active. A row
    replaces the active stored row of its key and date; whether or not it has one, its price is compared with the best
    prior row of its key with another date (for a null date, any date), the active, latest and highest version first; that
    one is its predecessor if nothing was replaced, and is deactivated. Rows of the document that repeat an item_id of their
    key and date are one.
    stored needs item_id, partner_id, service_name_raw, effective_date, version, is_active, previous_item_id, is_anomaly.

    A line's rows meet once, sorted by date. Of its stored rows two can be anyone's prior: the best, and the best of another
    date than that one's, for rows of the best one's date. So no row meets all of its line.
    """
    own = ["version", "is_active", "previous_item_id", "is_anomaly"]
    both = stored.withColumn("_new", F.lit(False)).unionByName(document.select(*(c for c in stored.columns if c not in own), F.lit(True).alias("_new")), allowMissingColumns=True)
    day = F.col("effective_date")
    line = Window.partitionBy("partner_id", "_name")
    same = line.partitionBy("partner_id", "_name", "effective_date").orderBy("_new", F.col("is_active").desc_nulls_last(), F.col("version").desc_nulls_last(), "item_id")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = both.withColumn("_name", F.trim("service_name_raw")).withColumns({
        "_replaced": F.first(F.when(~F.col("_new") & F.col("is_active"), F.struct("item_id", "version")), ignorenulls=True).over(whole), "_hit": F.max("_new").over(whole),
        "_again": F.col("_new") & F.coalesce(F.lag("_new").over(same) & F.lag("item_id").over(same).eqNullSafe(F.col("item_id")), F.lit(False)),
    }).where("NOT _again")
    # fields in the order of preference, the least first
    ranked = F.struct(
        F.when(F.col("is_active"), 0).when(~F.col("is_active"), 1).otherwise(2).alias("idle"), (-F.unix_date(day)).alias("early"), F.col("version").isNull().alias("unversioned"), (-F.col("version").cast("long")).alias("low"),
        F.col("item_id").alias("item_id"), day.alias("day"), F.col("version").alias("version"), F.col(price).alias("price"), F.col("is_active").alias("is_active"),
    )
    prior = ~F.col("_new") & day.isNotNull() & F.col("_name").isNotNull()
    met = met.withColumn("_best", F.min(F.when(prior, ranked)).over(line))
    its_day = day.eqNullSafe(F.col("_best.day"))
    met = met.withColumns({
        "_next": F.min(F.when(prior & ~its_day, ranked)).over(line),
        "_hit_best": F.max(F.col("_new") & ~its_day).over(line), "_hit_next": F.max(F.col("_new") & its_day).over(line),
    })
    met = met.withColumn("_prior", F.when(its_day, F.col("_next")).otherwise(F.col("_best")))
    gone = lambda row, hit: F.coalesce(F.col(hit) & F.col(f"{row}.is_active") & (F.col(f"{row}.item_id") == F.col("item_id")), F.lit(False))
    off = F.coalesce(F.col("_hit") & (F.col("_replaced.item_id") == F.col("item_id")), F.lit(False)) | gone("_best", "_hit_best") | gone("_next", "_hit_next")
    told = {
        "version": F.coalesce(F.col("_replaced.version") + 1, F.col("_prior.version") + 1, F.lit(1)).cast("int"), "is_active": F.lit(True),
        "previous_item_id": F.coalesce("_replaced.item_id", "_prior.item_id"), "is_anomaly": anomaly(F.col(price), F.col("_prior.price")),
    }
    kept = {c: F.col(c) for c in own} | {"is_active": F.col("is_active") & ~off}
    return met.select(*(F.when(F.col("_new"), told[c]).otherwise(kept[c]).alias(c) if c in own else c for c in stored.columns))


def reconcile(rows: DataFrame, tie: str = "item_id", created: str = "created_at", within: tuple[str, ...] = ()) -> DataFrame:
    """rows with is_active set anew: of each partner's service (or normalised raw name, if unmatched) with more than one row,
    only the latest by date (null first), version and, where rows have it, creation stays active; single rows keep what they
    have. within: columns that follow from the partner and the service, by which rows come sorted first."""
    key = F.coalesce(F.col("service_id").cast("string"), F.concat(F.lit("raw:"), normalise(F.col("service_name_raw"))))
    group = Window.partitionBy(*within, "partner_id", key)
    order = group.orderBy(F.col("effective_date").desc_nulls_last(), F.col("version").desc_nulls_last(), *([F.col(created).desc_nulls_last()] if created in rows.columns else []), tie)
    nth, more = F.row_number().over(order), F.lead(F.lit(True)).over(order).isNotNull()
    return rows.withColumn("is_active", F.when((nth > 1) | more, nth == 1).otherwise(F.col("is_active")))


def document_status(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, n_items, status: error without items, needs_review if any item asks for it, else done."""
    counts = rows.groupBy("document_id").agg(F.count("*").alias("n"), F.bool_or("needs_review").alias("review"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "error").when(F.col("review"), "needs_review").otherwise("done")
    return documents.select("document_id").join(counts, "document_id", "left").select("document_id", n.alias("n_items"), status.alias("status"))


def batch_status(documents: DataFrame) -> DataFrame:
    """batch_id with counts and status: processing while anything is pending, done without errors, partial, or error."""
    s = F.col("status")
    counts = documents.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(s.isin("pending", "processing")).alias("pending"), F.count_if(s == "error").alias("errors"))
    done = F.col("total") - F.col("pending") - F.col("errors")
    status = F.when(F.col("pending") > 0, "processing").when(F.col("errors") == 0, "done").when(done > 0, "partial").otherwise("error")
    return counts.withColumns({"processed": done, "status": status})


def decide(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Operators' decisions overlaid on rows: the latest decision of an item sets service, status, verification and review.

    decisions: item_id, action (approve, reject, match or create), service_id, operator, decided_at. A rejected item stays under
    review; an approved or matched one is verified, and a given service makes the match a manual one of confidence 1.
    """
    last = Window.partitionBy("item_id").orderBy(F.col("decided_at").desc_nulls_last(), "action")
    d = decisions.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("item_id", F.col("action").alias("_a"), F.col("service_id").alias("_s"), F.col("operator").alias("_o"), F.col("decided_at").alias("_t"))
    accepted = F.col("_a").isin("approve", "match", "create")
    linked = accepted & F.col("_s").isNotNull()
    return rows.join(d, "item_id", "left").withColumns({
        "service_id": F.when(linked, F.col("_s")).otherwise(F.col("service_id")), "match_status": F.when(linked, "matched_manual").otherwise(F.col("match_status")),
        "match_confidence": F.when(linked, F.lit(1.0)).otherwise(F.col("match_confidence")), "is_verified": F.when(accepted, F.lit(True)).otherwise(F.col("is_verified")),
        "needs_review": F.when(accepted, F.lit(False)).when(F.col("_a") == "reject", F.lit(True)).otherwise(F.col("needs_review")),
        "verified_by": F.when(accepted, F.col("_o")), "verified_at": F.when(accepted, F.col("_t")),
    }).drop("_a", "_s", "_o", "_t")


def create_services(decisions: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with the service_id of the service that each creates, services with the new ones).

    decisions: those of decide() with new_service (a name, or null). One that names a service, whatever its action was, is a
    create: a service of exactly that name is used, the smallest id of several, else one is made and active, once for all
    decisions that name it. New ids follow the greatest known one in the order of names; they are as few as operators' new
    names, so these are numbered in one task."""
    name = F.nullif(F.trim("new_service"), F.lit(""))
    rows = decisions.withColumn("_new", name)
    have = services.groupBy(F.col("service_name").alias("_name")).agg(F.min("service_id").alias("_id"))
    fresh = rows.where("_new IS NOT NULL").select(F.col("_new").alias("_name")).distinct().join(have, "_name", "left_anti")
    base = services.agg(F.coalesce(F.max("service_id"), F.lit(0))).first()[0]
    made = fresh.select("_name", (F.row_number().over(Window.orderBy("_name")) + base).cast(services.schema["service_id"].dataType).alias("_id"))
    told = rows.join(have.unionByName(made), F.col("_new") == F.col("_name"), "left")
    given = {"service_id": F.when(F.col("_new").isNotNull(), F.col("_id")).otherwise(F.col("service_id")), "action": F.when(F.col("_new").isNotNull(), "create").otherwise(F.col("action"))}
    added = made.select(F.col("_id").alias("service_id"), F.col("_name").alias("service_name"), F.lit(True).alias("is_active"))
    return told.withColumns(given).drop("_new", "_name", "_id"), services.unionByName(added, allowMissingColumns=True)


def match_events(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """item_id, old_service_id, new_service_id, action, operator, decided_at of every decision on an item, for an audit.

    Each event starts from what the item's decision before it left; a rejection leaves the service as it was."""
    order = Window.partitionBy("item_id").orderBy(F.col("decided_at").asc_nulls_first(), F.col("action").desc())
    known = decisions.join(rows.select("item_id", F.col("service_id").alias("_now")), "item_id")
    chosen = F.when(F.col("action").isin("approve", "match", "create"), F.col("service_id"))
    before = F.last(chosen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = known.withColumn("old_service_id", F.coalesce(before, "_now"))
    return told.select("item_id", "old_service_id", F.coalesce(chosen, "old_service_id").alias("new_service_id"), "action", F.coalesce("operator", F.lit("operator")).alias("operator"), "decided_at")
