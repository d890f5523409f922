"""Job state as event tables: status, progress, remaining time, retention, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions import text as X
from glossmill.operators.folding import fold_sorted

#: Share of the shorter text that two texts must have in common at their ends to be one draft.
SHARED = 0.8
TERMINAL = ("done", "error", "canceled")
#: Allowed moves of a job.
MOVES = {"queued": ("extracting", "canceled", "error"), "extracting": ("translating", "canceled", "error"), "translating": ("writing", "canceled", "error"), "writing": ("done", "canceled", "error")}


def current_status(events: DataFrame) -> DataFrame:
    """job, status, seq: the last event of each job (job, seq, status)."""
    return events.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def recovered(status: DataFrame) -> DataFrame:
    """After a restart unfinished jobs are errors."""
    return status.withColumn("status", F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise("error"))


def valid_moves(events: DataFrame) -> DataFrame:
    """events with ok: whether each follows from the one before."""
    last = F.lag("status").over(Window.partitionBy("job").orderBy("seq"))
    allowed = F.create_map(*(x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return events.withColumn("ok", F.when(last.isNull(), F.col("status") == "queued").otherwise(F.coalesce(F.array_contains(F.try_element_at(allowed, last), F.col("status")), F.lit(False))))


def percent(samples: DataFrame, job: str, order: str, done: str, total: str, status: str | None = None) -> DataFrame:
    """samples with percent: it never falls and is 99 at most, but 100 when done and 0 while queued (with a status column)."""
    raw = F.round(F.least(F.coalesce(F.try_divide(100.0 * F.col(done), F.col(total)), F.lit(0.0)), F.lit(99.0)), 1)
    if status:
        raw = F.when(~F.col(status).isin("queued", "done"), raw)
    shown = F.coalesce(F.max(raw).over(Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    if status:
        shown = F.when(F.col(status) == "done", 100.0).when(F.col(status) == "queued", 0.0).otherwise(shown)
    return samples.withColumn("percent", shown)


def eta(samples: DataFrame, job: str, ts: str, done: str, total: str, window_s: int = 120, status: str | None = None) -> DataFrame:
    """samples with eta_seconds by the rate since the first sample of the last seconds, or the very first one if the
    sample stands alone there; null without progress, under a second of it, or (with a status column) unless
    translating. ts: seconds."""
    order = Window.partitionBy(job).orderBy(ts)
    recent, every = order.rangeBetween(-window_s, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    alone = F.first(ts).over(recent) == F.col(ts)
    since = lambda c: F.col(c) - F.when(alone, F.first(c).over(every)).otherwise(F.first(c).over(recent))
    left = F.greatest(F.lit(0), F.col(total) - F.col(done))
    ok = (since(ts) >= 1) & (since(done) > 0) & (F.col(total) > 0)
    if status:
        ok = ok & (F.col(status) == "translating")
    return samples.withColumn("eta_seconds", F.when(ok, F.floor(left * since(ts) / since(done) + 0.5)).cast("long"))


def expired(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Finished jobs past their time."""
    return jobs.where(F.col("finished_at") + F.make_interval(hours=F.lit(hours)) <= now)


def throttled(events: DataFrame, job: str, ts: str, seconds: float = 2, force: str | None = None) -> DataFrame:
    """The events that are written: each job's first, then each that comes so many seconds after the last written one at least, and all that a boolean column forces."""

    def step(last: float | None, at: float, forced: bool = False) -> tuple[float | None, bool]:
        write = bool(forced) or last is None or at - last >= seconds
        return (at if write else last), write

    inputs = [ts, force] if force else [ts]
    return fold_sorted(events, [job], [ts], inputs, lambda: None, step, "_written", T.BooleanType()).where("_written").drop("_written")


def debounced(events: DataFrame, key: str, ts: str, delay: float) -> DataFrame:
    """Events with none of the same key after them within the delay: the last of each burst."""
    marked = events.withColumn("_next", F.lead(ts).over(Window.partitionBy(key).orderBy(ts)))
    return marked.where(F.col("_next").isNull() | (F.col("_next") - F.col(ts) >= delay)).drop("_next")


def history(edits: DataFrame, key: str, ts: str, text: str, target: str, gap_s: int = 300, keep: int = 50) -> DataFrame:
    """Drafts, the newest of each key: an edit within the gap, of the same target, where one text begins with the other or
    their shared start and end are 80 % of the shorter one at least, replaces the one before. A draft goes when its text
    and target are recorded again later."""
    w = Window.partitionBy(key).orderBy(ts)
    marked = edits.withColumns({"_before": F.lag(text).over(w), "_lang": F.lag(target).over(w), "_at": F.lag(ts).over(w)})
    begins = F.col(text).startswith(F.col("_before")) | F.col("_before").startswith(F.col(text))
    similar = begins | (shared_ends(F.col(text), F.col("_before")) >= SHARED * F.least(F.length(text), F.length("_before")))
    same = (F.col("_lang") == F.col(target)) & (F.col(ts) - F.col("_at") <= gap_s) & similar
    marked = marked.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("_before", "_lang", "_at")
    marked = marked.withColumn("draft", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_again", F.lead(ts).over(Window.partitionBy(key, text, target).orderBy(ts)).isNotNull())
    last = marked.groupBy(key, "draft").agg(F.max(ts).alias(ts), F.max_by(text, ts).alias(text), F.max_by(target, ts).alias(target), F.max_by("_again", ts).alias("_again"), F.count("*").alias("edits"))
    last = last.where("NOT _again").drop("_again")
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))).where(F.col("rank") <= keep)


def shared_ends(a: Column, b: Column) -> Column:
    """Characters that two texts share at their start, and at their end beside these."""
    limit = F.least(F.length(a), F.length(b))

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
        at = F.array_position(same, False)
        return F.when(at > 0, at - 1).otherwise(F.size(same))

    prefix = F.least(common(a, b), limit)
    return prefix + F.least(common(F.reverse(a), F.reverse(b)), limit - prefix)


def listed(jobs: DataFrame, ids: DataFrame, most: int = 100) -> DataFrame:
    """jobs for the asked ids (pos, job): known ones, the first mention of each, in the order asked."""
    first = ids.where(F.col("pos") < most).groupBy("job").agg(F.min("pos").alias("pos"))
    return first.join(jobs, "job").orderBy("pos")


def admission(requests: DataFrame, max_bytes: int, max_active: int, quota: int) -> DataFrame:
    """requests (known_type, size, active, used) with status: the HTTP code of the first rule that fails, else 202."""
    code = F.when(~F.col("known_type"), 415).when(F.col("size") == 0, 400).when(F.col("size") > max_bytes, 413).when(F.col("active") >= max_active, 429).when(F.col("used") + F.col("size") > quota, 507).otherwise(202)
    return requests.withColumn("status", code)


def merge_rows(local: DataFrame, server: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """local (key, rev, …) after a poll for asked (key, rev): where the revision is still the one that the poll began
    with, the server's row (key, …) takes the place of the local one, and a row that the server doesn't have goes."""
    s = server.select(*(F.col(c).alias(f"_{c}") for c in server.columns if c != "rev"), F.lit(True).alias("_has"))
    q = asked.select(F.col(key).alias("_asked"), F.col("rev").alias("_asked_rev"))
    both = local.join(q, (F.col(key) == F.col("_asked")) & (F.col("rev") == F.col("_asked_rev")), "left").join(s, F.col(key) == F.col(f"_{key}"), "left")
    current = F.col("_asked").isNotNull()
    own = [c for c in local.columns if f"_{c}" in s.columns]
    both = both.where(~current | F.col("_has"))
    return both.select(*(F.when(current, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in local.columns))


def revalidated(finished: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Finished jobs that the server still knows, as it knows them; the others are forgotten."""
    return finished.select(key).join(server, key)


def cleaned(jobs: DataFrame, partials: DataFrame, folders: DataFrame, now: Column, hours: int = 24, partial_hours: int = 6) -> DataFrame:
    """kind, name of all that a clean-up removes: finished jobs (job, status, expires_at) past their time, partial
    uploads (name, changed_at) of over six hours, folders (name, changed_at) of no job past the retention."""
    live = ("queued", "extracting", "translating", "writing")
    gone = jobs.where(~F.col("status").isin(*live) & (F.col("expires_at") <= now))
    left = jobs.join(gone.select("job"), "job", "left_anti").select(F.col("job").alias("name"))
    old = lambda df, h: df.where(F.col("changed_at") + F.make_interval(hours=F.lit(h)) < now)
    unknown = old(folders.join(left, "name", "left_anti"), hours).join(gone.select(F.col("job").alias("name")), "name", "left_anti")
    parts = ((gone, "job", "job"), (old(partials, partial_hours), "partial", "name"), (unknown, "folder", "name"))
    out = None
    for rows, kind, name in parts:
        rows = rows.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def warnings(events: DataFrame, job: str, order: str, message: str, most: int = 20) -> DataFrame:
    """job, warnings: the first distinct messages of each job, in order."""
    first = events.where(F.col(message) != "").groupBy(job, message).agg(F.min(order).alias("_o"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy("_o", message))).where(F.col("_n") <= most)
    return kept.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", message))), lambda x: x[message]).alias("warnings"))


def recent_samples(samples: DataFrame, job: str, order: str, keep: int = 400) -> DataFrame:
    """The last samples of each job."""
    return samples.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def text_chars(units: DataFrame, doc: str, text: str, most: int = 600_000) -> DataFrame:
    """doc, units, chars, allowed: distinct units that need translation, their characters without tags, and whether the limit holds."""
    kept = units.where(X.needs_translation_document(F.col(text))).select(doc, text).distinct()
    sums = kept.groupBy(doc).agg(F.count("*").alias("units"), F.sum(F.length(X.strip_tags(F.col(text)))).alias("chars"))
    return sums.withColumn("allowed", F.col("chars") <= most)


def disk_used(files: DataFrame, job: str = "job", size: str = "length") -> DataFrame:
    """job, bytes of files (path, length), as the binaryFile source lists them; the job is the folder under jobs."""
    rows = files if job in files.columns else files.withColumn(job, F.regexp_extract("path", r"jobs/([^/]+)/", 1)).where(F.col(job) != "")
    return rows.groupBy(job).agg(F.sum(size).alias("bytes"))


RECORD = "id string, filename string, size long, ext string, options map<string,string>, created_at string, expires_at string, status string, done long, total long, chars_done long, chars_total long, text_chars long, warnings array<string>, error string, finished_at string, output_file string, output_filename string, report_count long, detected_source_lang string"


def job_records(rows: DataFrame, text: str) -> DataFrame:
    """Job records of JSON texts, with their defaults; times are timestamps, one without a zone is UTC."""
    r = rows.select(F.from_json(text, RECORD).alias("r")).where("r.id IS NOT NULL").select("r.*")
    for c in ("size", "done", "total", "chars_done", "chars_total", "text_chars", "report_count"):
        r = r.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    for c in ("created_at", "expires_at", "finished_at"):
        r = r.withColumn(c, X.parse_iso(F.col(c)))
    none = F.expr("CAST(array() AS array<string>)")
    return r.withColumns(
        {"filename": F.coalesce(F.nullif("filename", F.lit("")), F.lit("document")), "ext": F.coalesce("ext", F.lit("")), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("error")), "expires_at": F.coalesce("expires_at", "created_at"), "warnings": F.coalesce("warnings", none)}
    )


def public_view(records: DataFrame) -> DataFrame:
    """What a client sees of job records."""
    done = F.col("status") == "done"
    share = F.coalesce(F.try_divide(100.0 * F.col("chars_done"), F.col("chars_total")), F.try_divide(100.0 * F.col("done"), F.col("total")), F.lit(0.0))
    percent_ = F.when(done, 100.0).when(F.col("status") == "queued", 0.0).otherwise(F.round(F.least(share, F.lit(99.0)), 1))
    option = lambda k, d: F.coalesce(F.try_element_at("options", F.lit(k)), F.lit(d)).alias(k)
    return records.select(
        "id", "filename", "size", F.col("ext").alias("format"), option("source_lang", "auto"), option("target_lang", "ko"), "status", "done", "total", percent_.alias("percent"),
        F.when(done, F.col("output_filename")).alias("output_filename"), "warnings", "error", *(X.iso(F.col(c)).alias(c) for c in ("created_at", "finished_at", "expires_at")),
        F.when(F.col("text_chars") > 0, F.col("text_chars")).alias("chars"), "report_count", option("output", "translated"), option("pdf_mode", "layout"), "detected_source_lang",
    )
