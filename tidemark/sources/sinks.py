"""Idempotent merges into stored tables. Each returns the new content or the rows to append;
`overwrite_slices` writes them with dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lookups import REFERENCE_TICKERS
from tidemark.operators.screener import sic_division

MIN_SNAPSHOT_RATIO = 0.5
FULL_YEAR_ROWS = 2000


def overwrite_slices(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Replace exactly the partitions present in `rows`."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition).parquet(path)


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Newest row per key across stored and incoming, by the version columns."""
    both = stored.unionByName(incoming)
    rest = [c for c in both.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return both.groupBy(*key).agg(newest).select(*key, "_row.*")


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key; null parts of a key match."""
    rest = [c for c in incoming.columns if c not in key]
    single = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")
    s = stored.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return single.join(s, same, "left_anti")


def replace_slice(stored: DataFrame, incoming: DataFrame, slice_key: list[str]) -> DataFrame:
    """Drop the stored slices that `incoming` covers, then add it."""
    slices = incoming.select(*slice_key).distinct()
    return stored.join(slices, slice_key, "left_anti").unionByName(incoming)


def directory_sync(snapshot: DataFrame, active: DataFrame) -> DataFrame:
    """Action per listing after a directory snapshot: created, reassigned, seen, deactivated,
    kept (missing, but not from this source, or the snapshot is suspiciously small).

    The first entry of a (ticker, exchange) counts; later ones are duplicates."""
    entries = snapshot.groupBy("ticker", "exchange").agg(
        F.min_by("cik", "ordinal").alias("cik"), (F.count(F.lit(1)) - 1).alias("duplicates")
    )
    sizes = entries.agg(F.count(F.lit(1)).alias("_seen")).crossJoin(
        active.agg(F.count_if("from_directory").alias("_listed"))
    )  # one row each
    old = active.select(
        F.col("ticker").alias("_t"), F.col("exchange").alias("_e"), F.col("cik").alias("old_cik"),
        "from_directory",
    )
    same = (F.col("ticker") == F.col("_t")) & F.col("exchange").eqNullSafe(F.col("_e"))
    merged = entries.join(old, same, "full_outer").crossJoin(F.broadcast(sizes))
    small = F.col("_seen") < F.col("_listed") * MIN_SNAPSHOT_RATIO
    action = (
        F.when(F.col("_t").isNull(), "created")
        .when(F.col("ticker").isNull() & F.col("from_directory") & ~small, "deactivated")
        .when(F.col("ticker").isNull(), "kept")
        .when(F.col("cik") != F.col("old_cik"), "reassigned")
        .otherwise("seen")
    )
    return merged.select(
        F.coalesce("ticker", "_t").alias("ticker"), F.coalesce("exchange", "_e").alias("exchange"),
        action.alias("action"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
    )


def provenance(fetches: DataFrame) -> DataFrame:
    """One row per fetch: counts, status and a hash of all that was received, in whatever order: it is taken over the number
    of records and the sum of their own hashes."""
    own = F.conv(F.substring(F.md5("content"), 1, 13), 16, 10).cast("decimal(38,0)")
    return fetches.groupBy("provider", "subject").agg(
        F.count_if("ok").alias("record_count"),
        F.count_if(~F.col("ok")).alias("rejected_count"),
        F.sha2(F.concat_ws("|", F.count("content"), F.coalesce(F.sum(own), F.lit(0)).cast("decimal(38,0)").cast("string")), 256).alias("content_sha256"),
        F.when(F.count_if("ok") > 0, "success").otherwise("error").alias("status"),
    )


def fetch_usage(fetches: DataFrame, now: Column) -> DataFrame:
    """Fetches per provider within the last hour and the last day."""
    within = lambda spec: F.count_if(
        (F.col("started_at") >= now - F.expr(f"INTERVAL {spec}")) & (F.col("started_at") <= now)
    )
    return fetches.groupBy("provider").agg(
        within("1 HOUR").alias("last_hour"), within("1 DAY").alias("last_day")
    )


def merge_coverage(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Widen price coverage: the earlier start, and the new end where a load gave one."""
    new = loaded.select(
        "security_id", F.col("loaded_from").alias("_from"), F.col("loaded_through").alias("_to"),
        F.col("status").alias("_status"),
    )
    both = stored.join(new, "security_id", "full_outer")
    return both.select(
        "security_id",
        F.coalesce("_status", "status").alias("status"),
        F.least("loaded_from", "_from").alias("loaded_from"),  # least skips nulls
        F.coalesce("_to", "loaded_through").alias("loaded_through"),
    )


def years_to_load(stored: DataFrame, wanted: DataFrame, current_year: int) -> DataFrame:
    """Years still to fetch: the current one, and past ones without a full year of rows."""
    full = (
        stored.groupBy(F.year("observed_on").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= FULL_YEAR_ROWS) & (F.col("year") < current_year))
    )
    return wanted.join(full, "year", "left_anti")


def missing_references(securities: DataFrame, tickers: tuple[str, ...] = REFERENCE_TICKERS) -> DataFrame:
    """Reference funds without an active listing."""
    table = securities.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    return table.join(securities.where("is_active"), "ticker", "left_anti")


def refresh_metrics(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """A refreshed company's metrics replace all it had."""
    return replace_slice(stored, fresh, ["company"])


def merge_profiles(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Apply submission profiles; companies without one keep what they have."""
    fresh = profiles.select(
        "company", F.lit(True).alias("_has"), F.col("name").alias("_name"),
        F.col("sic_code").alias("_sic"), "hq_is_foreign",
    )
    both = companies.join(fresh, "company", "left")
    applied = F.col("_has").isNotNull()
    return both.select(
        "company",
        F.coalesce("_name", "name").alias("name"),
        F.when(applied, F.col("_sic")).otherwise(F.col("sic_code")).alias("sic_code"),
        F.when(applied, sic_division(F.col("_sic"))).otherwise(F.col("sector")).alias("sector"),
        F.when(applied, F.when(~F.col("hq_is_foreign"), F.lit("US")))
        .otherwise(F.col("country"))
        .alias("country"),
    )


def load_insiders(transactions: DataFrame, filings: DataFrame) -> DataFrame:
    """Transactions with their filing's status: loaded when the issuer is the filing company,
    else not_issuer. The first owner is the primary one and roles hold when any owner has them."""
    joined = transactions.join(filings, "accession")
    any_role = lambda role: F.exists("owners", lambda o: o[role])
    return joined.select(
        "accession", "company", "is_derivative", "ordinal", "code", "shares", "price",
        F.when(F.col("issuer") == F.col("company"), "loaded").otherwise("not_issuer").alias("status"),
        F.try_element_at("owners", F.lit(1))["cik"].alias("owner_cik"),
        F.coalesce(F.try_element_at("owners", F.lit(1))["name"], F.lit("Unknown")).alias("owner_name"),
        any_role("is_director").alias("is_director"),
        any_role("is_officer").alias("is_officer"),
        any_role("is_ten_percent").alias("is_ten_percent"),
        F.try_element_at(F.filter(F.transform("owners", lambda o: o["title"]), lambda x: x.isNotNull()), F.lit(1)).alias("officer_title"),
        "owners",
    )


def load_outcomes(filings: DataFrame) -> DataFrame:
    return filings.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))
