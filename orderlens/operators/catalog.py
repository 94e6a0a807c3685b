"""Upload catalog and seller dimension maintenance.

The catalog holds one row per uploaded file: ``upload_id, seller_id,
filename, original_name, filepath, upload_date, row_count``.  A folder
listing is a DataFrame with at least ``filepath`` (``filename`` is derived
when missing), e.g. from :func:`orderlens.sources.files.list_files`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import allowed_file, basename, glob_to_regex, secure_filename
from orderlens.functions.dates import DISPLAY_DATE, DISPLAY_TIMESTAMP
from orderlens.operators.running import running_before
from orderlens.schema import UPLOAD_GLOB
from orderlens.session import ensure_checkpoint_dir

_UPLOAD_FIELDS = ["upload_id", "seller_id", "filename", "original_name", "filepath", "upload_date", "row_count"]
# Uploads of one seller and second (or time) that are ranked together, at most about.
UPLOADS_BUCKET = 10_000
# Bit mask keeping a 64-bit hash non-negative.
_ID_MASK = 0x7FFFFFFFFFFFFFFF


def _newest_first() -> list[Column]:
    return [F.desc_nulls_last("upload_date"), F.desc("upload_id")]


def uploads_list(uploads: DataFrame) -> DataFrame:
    """Each seller's uploads newest first with their list position (0 = newest)
    and the upload time as 'yyyy-MM-dd HH:mm:ss'.

    The position is computed in levels, so that no task holds all uploads of
    one seller even when a bulk load gives them one time: rows are counted in
    buckets, ranked inside a bucket, and what stands before a bucket is a
    running sum over the counts.  A bucket is a second; a second with more than
    UPLOADS_BUCKET uploads of the seller is cut at each time in it, and a time
    with more at ranges of the id.  The running sum itself goes by ranges of
    buckets (:func:`running_before`), so a seller with millions of buckets is
    spread as well; its bucket counts are written to the shared checkpoint
    folder when this is called.
    """
    time = F.coalesce("upload_date", F.lit("0001-01-01").cast("timestamp"))
    u = uploads.withColumn("_t", time)
    second = F.date_trunc("second", "_t").alias("_second")
    per_time = u.groupBy("seller_id", "_t").agg(F.count(F.lit(1)).alias("_c"), F.min("upload_id").alias("_lo"), F.max("upload_id").alias("_hi")).select("*", second)
    per_second = per_time.groupBy("seller_id", "_second").agg(F.sum("_c").alias("_cs"))
    hot = F.col("_cs") > UPLOADS_BUCKET
    marks = per_time.join(per_second, ["seller_id", "_second"]).select(
        "seller_id", "_t", F.when(hot, F.col("_t")).otherwise(F.col("_second")).alias("_from"), F.when(hot, F.ceil(F.col("_c") / UPLOADS_BUCKET)).otherwise(1).alias("_parts"), "_lo", "_hi")
    low, high = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    part = F.floor((F.col("upload_id").cast("double") - low) / (high - low + 1) * F.col("_parts"))
    u = u.join(marks, ["seller_id", "_t"]).withColumn("_part", F.when(F.col("_parts") > 1, part).otherwise(0).cast("int"))
    bucket = ["_from", "_part"]
    per_bucket = u.groupBy("seller_id", *bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_before(per_bucket, ["seller_id"], [F.desc(b) for b in bucket], "_n", "_before")
    within = Window.partitionBy("seller_id", *bucket).orderBy(*_newest_first())
    ranked = u.withColumn("_r", F.row_number().over(within) - 1)
    j = ranked.join(offsets, ["seller_id", *bucket], "inner")
    return j.select(
        "seller_id", "upload_id", "filename", "original_name", "filepath",
        F.date_format("upload_date", DISPLAY_TIMESTAMP).alias("upload_date"),
        "row_count",
        (F.col("_before") + F.col("_r")).cast("int").alias("position"),
    )


def uploads_by_date(uploads: DataFrame) -> DataFrame:
    """Number of uploads per seller and calendar day of the upload time."""
    return (uploads.groupBy("seller_id", F.date_format("upload_date", DISPLAY_DATE).alias("upload_day"))
            .agg(F.count(F.lit(1)).alias("uploads")))


def latest_upload(uploads: DataFrame) -> DataFrame:
    """The newest upload of every seller (ties: higher id).  An aggregate
    (max of a struct ordered by time, id), so a seller with very many
    uploads is reduced map-side instead of sorted in one task."""
    order_key = F.struct(F.col("upload_date"), F.col("upload_id"))
    payload = F.struct(*[F.col(c) for c in _UPLOAD_FIELDS])
    g = uploads.groupBy("seller_id").agg(
        F.max_by(payload, order_key).alias("u"))
    return g.select(*[F.col(f"u.{c}").alias(c) for c in _UPLOAD_FIELDS])


def upload_lookup(uploads: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve ``requests(seller_id, upload_id)``; a request only resolves
    when the upload belongs to the asking seller."""
    req = requests.select("seller_id", "upload_id").distinct()
    return uploads.join(req, ["seller_id", "upload_id"], "left_semi")


def matching_files(listing: DataFrame, pattern: str = UPLOAD_GLOB) -> DataFrame:
    """Listing rows whose file name matches the folder glob and has an
    allowed extension."""
    lst = listing if "filename" in listing.columns else listing.withColumn("filename", basename("filepath"))
    return lst.filter(F.col("filename").rlike(glob_to_regex(pattern)) & allowed_file("filename"))


def discover_uploads(listing: DataFrame, uploads: DataFrame, pattern: str = UPLOAD_GLOB) -> DataFrame:
    """Files in the folder whose name is not yet in the catalog."""
    files = matching_files(listing, pattern)
    known = uploads.select("filename").distinct()
    return files.join(known, "filename", "left_anti")


def existing_uploads(uploads: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalog entries whose file is present in the listing."""
    return uploads.join(listing.select("filepath").distinct(), "filepath", "left_semi")


def latest_existing_upload(uploads: DataFrame, listing: DataFrame) -> DataFrame:
    """Newest upload per seller among those whose file exists."""
    return latest_upload(existing_uploads(uploads, listing))


def upload_row_counts(listing: DataFrame, rows: DataFrame) -> DataFrame:
    """Data rows per listed file (0 for a file without rows, e.g. header
    only or unreadable).  ``rows`` has one row per data line with its
    ``filepath``."""
    counts = rows.groupBy("filepath").agg(F.count(F.lit(1)).alias("_n"))
    lst = listing.select("filepath").distinct()
    return (lst.join(counts, "filepath", "left")
            .select("filepath", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("row_count")))


def seller_from_filename(filename: Column | str) -> Column:
    """Owner of a dropped-in file: the numeric text before the first '_'."""
    f = F.col(filename) if isinstance(filename, str) else filename
    return F.substring_index(f, "_", 1).try_cast("bigint")


def seller_from_path(filepath: Column | str) -> Column:
    """Owner of a file: the ``seller_id=<n>`` folder on its path if any,
    else the numeric prefix of its name."""
    p = F.col(filepath) if isinstance(filepath, str) else filepath
    folder = F.regexp_extract(p, r"(^|/)seller_id=(\d+)/", 2)
    return F.coalesce(F.when(folder != "", folder.cast("bigint")), seller_from_filename(basename(p)))


def register_uploads(new_files: DataFrame, seller_id: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Catalog rows for new files ``(filename, filepath, row_count)``, with
    columns ``keep`` of the files.

    ``upload_id`` is a 63-bit hash of the path: deterministic, so a rerun
    after a lost task or a repeated scan yields the same id, and assigned
    without a global counter (no single-task numbering).
    """
    owner = seller_id if seller_id is not None else seller_from_path("filepath")
    return new_files.select(
        (F.xxhash64("filepath").bitwiseAND(F.lit(_ID_MASK))).alias("upload_id"),
        owner.cast("bigint").alias("seller_id"),
        "filename",
        F.col("filename").alias("original_name"),
        "filepath",
        F.current_timestamp().alias("upload_date"),
        F.coalesce(F.col("row_count"), F.lit(0)).cast("bigint").alias("row_count"),
        *keep,
    )


def stored_name(seller_id: Column | str, original_name: Column | str) -> Column:
    """Name under which an upload is stored: '<seller>_<original>' made safe."""
    s = F.col(seller_id) if isinstance(seller_id, str) else seller_id
    o = F.col(original_name) if isinstance(original_name, str) else original_name
    return secure_filename(F.concat(s.cast("string"), F.lit("_"), o))


def dedupe_uploads(uploads: DataFrame) -> DataFrame:
    """Keep one catalog row per file path (the newest), so re-uploading the
    same name is not counted twice.  Aggregate, not window."""
    order_key = F.struct(F.col("upload_date"), F.col("upload_id"))
    payload = F.struct(*[F.col(c) for c in _UPLOAD_FIELDS])
    return (uploads.groupBy("filepath").agg(F.max_by(payload, order_key).alias("u"))
            .select(*[F.col(f"u.{c}").alias(c) for c in _UPLOAD_FIELDS]))


def delete_uploads(uploads: DataFrame, upload_ids: DataFrame, orders: DataFrame | None = None):
    """Remove uploads (and, if given, their order rows) by ``upload_id``."""
    ids = upload_ids.select("upload_id").distinct()
    kept = uploads.join(ids, "upload_id", "left_anti")
    if orders is None:
        return kept
    return kept, orders.join(ids, "upload_id", "left_anti")


def purge_sellers(seller_ids: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """Remove every row of the given sellers from each frame (sellers,
    uploads, orders ...)."""
    ids = seller_ids.select("seller_id").distinct()
    return [f.join(ids, "seller_id", "left_anti") for f in frames]


def upsert_by_key(current: DataFrame, updates: DataFrame, key: str = "seller_id", order: str | None = None) -> DataFrame:
    """Apply ``updates`` to ``current`` by primary key: a NULL in an update
    keeps the old value; keys only in ``updates`` are inserted.

    A key may be updated several times: ``order`` (a column of ``updates``, such
    as the time of the update) then says which value of a column is the last one
    given.  One row comes out for each key.  Without ``order``, updates of one key
    that differ are taken as given at once, and the greatest value counts.  The
    updates are reduced on every map task before they meet the current rows."""
    cols = [c for c in current.columns if c != key]
    given = [c for c in cols if c in updates.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))) if order else F.max(c) for c in given]
    if given:
        upd = updates.groupBy(key).agg(*[x.alias(f"__new_{c}") for x, c in zip(last, given)])
    else:
        upd = updates.select(key).distinct()
    j = current.join(upd, key, "full_outer")
    return j.select(key, *[(F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in given else F.col(c)).alias(c) for c in cols])


def evolve_schema(df: DataFrame, columns: Sequence[tuple[str, T.DataType | str, object]]) -> DataFrame:
    """Add each ``(name, type, default)`` column that ``df`` lacks."""
    out = df
    for name, dtype, default in columns:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default).cast(dtype))
    return out


def unique_violations(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys (all non-null) that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return (df.filter(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def check_unique(new: DataFrame, current: DataFrame, keys: Sequence[str], row_id: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` to be registered, each with ``reason``: NULL for those that
    may be, else why not.

    Every column of ``keys`` must be unique by itself over ``current`` and the
    accepted new rows, as unique constraints enforce it on rows that come one by
    one (by ``order``, then ``row_id``, which tells the new rows apart): '<key>
    exists' if ``current`` has the value, '<key> repeated' if an accepted row before
    it has it; the first key that fails is named.  A NULL is never a repetition.

    With several keys a refused row may free a value for a later one, so rows are
    settled in rounds: a row that is the first of all its values is accepted, rows
    that share a value with it are refused, the others wait.  Each round is a few
    aggregates and joins by value, so a value that very many rows give is reduced
    on every map task; it is checkpointed, and at least the first row waiting is
    settled in it.
    """
    rows = new.withColumn("__place", F.struct(*[F.col(c) for c in ([order] if order else [])], F.col(row_id)))
    exists = F.lit(None).cast("string")
    for i, k in reversed(list(enumerate(keys))):
        rows = rows.join(current.filter(F.col(k).isNotNull()).select(k).distinct().withColumn(f"__held{i}", F.lit(True)), k, "left")
        exists = F.when(F.col(f"__held{i}"), F.lit(f"{k} exists")).otherwise(exists)
    rows = rows.withColumn("__exists", exists)
    accepted = _accepted(rows.filter("__exists is null").select("__place", *keys), keys)
    reason = F.lit(None).cast("string")
    for i, k in reversed(list(enumerate(keys))):
        rows = rows.join(accepted.filter(F.col(k).isNotNull()).select(k, F.col("__place").alias(f"__first{i}")), k, "left")
        reason = F.when(F.col(f"__first{i}") < F.col("__place"), F.lit(f"{k} repeated")).otherwise(reason)
    return rows.select(*new.columns, F.coalesce("__exists", reason).alias("reason"))


def _accepted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (``__place`` and keys) that a registration one by one accepts."""
    firsts = lambda df, k: df.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("__place").alias("__first"))
    if len(keys) == 1:
        (k,) = keys
        return rows.filter(F.col(k).isNull()).unionByName(firsts(rows, k).select(F.col("__first").alias("__place"), k))
    ensure_checkpoint_dir(rows.sparkSession)
    out, waiting = rows.limit(0), rows.checkpoint()
    while not waiting.isEmpty():
        marked, ahead = waiting, F.lit(True)
        for i, k in enumerate(keys):
            marked = marked.join(firsts(waiting, k).withColumnRenamed("__first", f"__first{i}"), k, "left")
            ahead = ahead & (F.col(k).isNull() | (F.col(f"__first{i}") == F.col("__place")))
        now = marked.filter(ahead).select("__place", *keys).checkpoint()
        out = out.unionByName(now)
        waiting = waiting.join(now, "__place", "left_anti")
        for k in keys:
            waiting = waiting.join(now.filter(F.col(k).isNotNull()).select(k), k, "left_anti")
        waiting = waiting.select("__place", *keys).checkpoint()
    return out


def select_uploads(requests: DataFrame, uploads: DataFrame, listing: DataFrame) -> DataFrame:
    """Which upload each request looks at.

    ``requests(seller_id, upload_id, sticky_path)``: an explicit
    ``upload_id`` wins when it is one of the seller's uploads (else nothing
    is selected); otherwise the remembered ``sticky_path`` if its file
    exists; otherwise the seller's newest upload whose file exists.
    """
    req = requests.select("seller_id", F.col("upload_id").alias("req_id"), "sticky_path")
    own = uploads.select(F.col("seller_id").alias("_own_seller"), F.col("upload_id").alias("exp_id"),
                         F.col("filepath").alias("exp_path"))
    step1 = (req.join(own, (F.col("seller_id") == F.col("_own_seller")) & (F.col("req_id") == F.col("exp_id")), "left")
             .drop("_own_seller"))
    present = listing.select(F.col("filepath").alias("sticky_path")).distinct().withColumn("_sticky_ok", F.lit(True))
    step2 = step1.join(present, "sticky_path", "left")
    latest = latest_existing_upload(uploads, listing).select(
        "seller_id", F.col("upload_id").alias("lat_id"), F.col("filepath").alias("lat_path"))
    step3 = step2.join(latest, "seller_id", "left")
    # Upload id of the sticky path: newest catalog row of the seller with that path.
    sticky_ids = (uploads.groupBy("seller_id", F.col("filepath").alias("sticky_path"))
                  .agg(F.max_by("upload_id", F.struct("upload_date", "upload_id")).alias("sticky_id")))
    step4 = step3.join(sticky_ids, ["seller_id", "sticky_path"], "left")
    explicit = F.col("req_id").isNotNull()
    sticky = ~explicit & F.col("_sticky_ok").isNotNull()
    source = (F.when(explicit, F.when(F.col("exp_id").isNotNull(), F.lit("explicit")))
              .when(sticky, F.lit("sticky"))
              .when(F.col("lat_id").isNotNull(), F.lit("latest")))
    return step4.select(
        "seller_id", "req_id", "sticky_path",
        source.alias("source"),
        F.when(explicit, F.col("exp_id")).when(sticky, F.col("sticky_id")).otherwise(F.col("lat_id")).alias("upload_id"),
        F.when(explicit, F.col("exp_path")).when(sticky, F.col("sticky_path")).otherwise(F.col("lat_path")).alias("filepath"),
    )


__all__ = [
    "uploads_list", "uploads_by_date", "latest_upload", "upload_lookup", "matching_files",
    "discover_uploads", "existing_uploads", "latest_existing_upload", "upload_row_counts",
    "seller_from_filename", "seller_from_path", "register_uploads", "stored_name", "dedupe_uploads", "delete_uploads",
    "purge_sellers", "upsert_by_key", "evolve_schema", "unique_violations", "check_unique", "select_uploads",
]
