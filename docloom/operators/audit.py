"""The audit log: latest entry of each page, tail, hash chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontext, signing
from ..functions.jsontext import canonical_json  # noqa: F401  part of this module's interface
from ..sources.scratch import new_folder


def since_commit(log: DataFrame, commit: str) -> DataFrame:
    """The log from the first entry of ``commit`` on; empty if it has none."""
    first = log.where(F.col("commit") == commit).agg(F.min("seq").alias("first"))
    return log.join(F.broadcast(first), log["seq"] >= first["first"]).drop("first")  # the broadcast is one row


def latest_by_page(log: DataFrame) -> DataFrame:
    """The last entry of each page that generated content. Partial aggregates: no page is gathered."""
    good = log.where((F.col("operation") == "generate") & (F.coalesce("content_hash", F.lit("")) != "") & (F.col("outcome") != "error"))
    return good.groupBy("page").agg(F.max(F.struct("seq", "commit", "outcome", "content_hash")).alias("e")).select("page", "e.*")


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries, oldest first. A top-k: each task keeps n rows."""
    return log.orderBy(F.desc("seq")).limit(max(n, 0)).orderBy("seq")


def newest_pages(log: DataFrame, n: int | None) -> DataFrame:
    """The latest entry of each page, of the ``n`` pages with the newest ones (all if there is no limit)."""
    latest = latest_by_page(log)
    return latest if not n else latest.orderBy(F.desc("seq")).limit(n)


#: Fields that an entry gets after it is hashed.
UNHASHED = ("entry_hash", "signature", "timestamp_token")


def sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def chain(log: DataFrame, by: str = "log", order: str = "seq", fields: list[str] | None = None, after: DataFrame | None = None) -> DataFrame:
    """``log`` with ``prev_hash`` and ``entry_hash``, chained by ``order`` within each log ``by``.

    The entry that is hashed, as canonical JSON, has ``fields`` (all columns but these
    two by default), of any type, nulls kept, and the hash before. One log is sequential
    by nature, so it is one task's work; logs are dealt over tasks and sorted there, and a
    task reads its rows as a stream with one hash in hand, so a long log takes no more
    memory. ``after`` (by, entry_hash) has the last hash of logs that go on.
    """
    from pyspark.sql import types as T

    fields = fields or [c for c in log.columns if c not in (by, order)]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    ready = log.select(F.struct(*log.columns).alias("row"), F.col(by).alias("by"), F.col(order).alias("order"), body.alias("body"))
    if after is not None:
        ready = ready.join(after.select(F.col(by).alias("by"), F.col("entry_hash").alias("before")), "by", "left")
    else:
        ready = ready.withColumn("before", F.lit(None).cast("string"))
    ready = ready.select("row", "by", "order", "body", "before").repartition("by").sortWithinPartitions("by", "order")

    def run(batches):
        import pyarrow as pa

        log_id, last = None, None
        for batch in batches:
            prevs, hashes = [], []
            for who, text, before in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                if who != log_id:
                    log_id, last = who, before
                prevs.append(last)
                last = entry_hash(jsontext.parsed(text) | {"prev_hash": last})
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=["row", "prev_hash", "entry_hash"])

    schema = T.StructType([ready.schema["row"], T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    return ready.mapInArrow(run, schema).select("row.*", "prev_hash", "entry_hash")


def entry_hash(entry: dict) -> str:
    """The hash of an entry, without what it gets after it is hashed."""
    import hashlib

    text = jsontext.canonical({k: v for k, v in entry.items() if k not in UNHASHED})
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


ALGORITHM = "Ed25519"


def signed(log: DataFrame, seeds: dict[str, bytes], **options) -> DataFrame:
    """``log`` chained as by ``chain`` and signed: ``alg`` and ``signing_key_id`` are part of what is hashed, ``signature`` is that of the hash.

    Rows name their key in ``signing_key_id``; those that name none, or one that ``seeds`` (id -> private key) lacks, stay unsigned.
    """
    named = log.withColumn("signing_key_id", F.when(F.col("signing_key_id").isin(*seeds), F.col("signing_key_id")))
    named = named.withColumn("alg", F.when(F.col("signing_key_id").isNotNull(), ALGORITHM))
    if "fields" in options:
        options = options | {"fields": [*options["fields"], "alg", "signing_key_id"]}
    return chain(named, **options).withColumn("signature", signing.signature(F.col("entry_hash"), F.col("signing_key_id"), seeds))


def lines(entries: DataFrame, fields: list[str]) -> Column:
    """Entries as JSON lines, with ``prev_hash`` and ``entry_hash``; nulls are kept."""
    return F.to_json(F.struct(*sorted([*fields, "prev_hash", "entry_hash"])), {"ignoreNullFields": "false"})


#: Keys of a registry (some 250 bytes each) that may be broadcast.
BROADCAST_KEYS = 40_000

#: What verifying needs of an entry.
CLAIMS = ("entry_hash", "prev_hash", "signature", "signing_key_id")


def claims(raw: Column) -> Column:
    """A struct of what a JSON line claims and of the hash that it should have (``recomputed``); null if the line is no JSON object.

    The line is read once. What should be a text and isn't counts as its JSON.
    """

    @F.arrow_udf("struct<" + ",".join(f"{c}:string" for c in (*CLAIMS, "recomputed")) + ">")
    def run(texts):
        import pyarrow as pa

        rows = []
        for text in texts.to_pylist():
            try:
                entry = jsontext.parsed(text) if text is not None else None
                rows.append({c: v if (v := entry.get(c)) is None or isinstance(v, str) else jsontext.canonical(v) for c in CLAIMS} | {"recomputed": entry_hash(entry)} if isinstance(entry, dict) else None)
            except (ValueError, UnicodeError):
                rows.append(None)
        return pa.array(rows, pa.struct([(c, pa.string()) for c in (*CLAIMS, "recomputed")]))

    return run(raw)


def parsed_lines(log: DataFrame, raw: str = "raw") -> DataFrame:
    """``log`` with the parts of its JSON lines that verifying needs; all null where a line is no JSON object. Blank lines are dropped."""
    out = log.where(F.col(raw) != "").withColumn("__c", claims(F.col(raw)))
    return out.select(*log.columns, F.col("__c").isNotNull().alias("is_json"), *(F.col(f"__c.{c}").alias(c) for c in (*CLAIMS, "recomputed")))


def verify(log: DataFrame, by: str = "log", raw: str = "raw", keys: DataFrame | None = None, require_signed: bool = False, width: int = 4096) -> DataFrame:
    """(by, seq, valid, signed, reasons) of the entries of ``log`` (by, seq, raw), each by itself.

    A line that is no JSON is an error and leaves the hash before as it is; an entry
    whose hash does not fit is tampered and not valid; one that does not follow the
    claimed hash before it breaks the chain but is valid. A signature is verified with
    its key of ``keys`` (signing_key_id, public_key_pem); one that fails, and one whose
    key isn't there, is an error, and the entry isn't signed.
    Windows hold a range of a log; the last hash of the ranges before comes from one row
    for each range. What the lines say is written to the shared folder, as ranges and
    windows both read it: making and reading the lines is done once.
    """
    tampered = ~F.col("recomputed").eqNullSafe(F.col("entry_hash"))
    folder = new_folder(log.sparkSession, "verified")
    parsed_lines(log.select(by, "seq", raw), raw).select(by, "seq", "is_json", *CLAIMS, tampered.alias("tampered")).write.parquet(folder)
    got = log.sparkSession.read.parquet(folder).withColumn("range", F.floor(F.col("seq") / width))
    # a claimed hash may be null: the struct says that there was an entry
    claim = F.when(F.col("is_json"), F.struct("entry_hash"))
    ends = got.groupBy(by, "range").agg(F.max_by(claim, F.when(F.col("is_json"), F.col("seq"))).alias("end"))
    carry = ends.select(by, "range", F.last("end", ignorenulls=True).over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    within = Window.partitionBy(by, "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("last", F.last(claim, ignorenulls=True).over(within)).join(carry, [by, "range"])
    tampered = F.col("tampered")
    claims_one = F.coalesce(F.col("signature") != "", F.lit(False))
    if keys is not None:
        one = keys.groupBy("signing_key_id").agg(F.min(F.struct(F.col("public_key_pem"))).alias("key"))
        # few keys would gather all their entries in as few tasks
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        got = got.join(F.broadcast(one) if few else one, "signing_key_id", "left")
    else:
        got = got.withColumn("key", F.lit(None).cast("struct<public_key_pem:string>"))
    known = F.col("key").isNotNull()
    checked = F.when(F.col("is_json") & ~tampered & claims_one & known, F.col("signature"))
    got = got.withColumn("fits", F.coalesce(signing.signature_fits(F.col("entry_hash"), checked, F.coalesce("key.public_key_pem", F.lit(""))), F.lit(False)))
    broken = ~F.col("prev_hash").eqNullSafe(F.coalesce("last", "carry")["entry_hash"])
    signed = claims_one
    checks = [
        F.when(~F.col("is_json"), "not valid JSON"),
        F.when(F.col("is_json") & tampered, "tampered"),
        F.when(F.col("is_json") & ~tampered & broken, "chain break"),
        F.when(F.col("is_json") & ~tampered & signed & ~known, "unknown signing key"),
        F.when(F.col("is_json") & ~tampered & signed & known & ~F.col("fits"), "signature verification failed"),
        F.when(F.col("is_json") & ~tampered & ~signed, "unsigned") if require_signed else F.lit(None).cast("string"),
    ]
    valid = F.col("is_json") & ~tampered
    return got.select(by, "seq", valid.alias("valid"), (valid & F.col("fits")).alias("signed"), (valid & ~signed).alias("unsigned"), F.array_compact(F.array(*checks)).alias("reasons"))


KEYS = "signing_key_id string, public_key_pem string, created_at string, valid_from string, valid_until string, revoked_at string"


def registry_rows(spark, publics: list[bytes], now: str) -> DataFrame:
    """A registry's rows for new public keys, valid from ``now`` on."""
    return spark.createDataFrame([(signing.key_id(p), signing.public_pem(p), now, now, None, None) for p in publics], KEYS)


def tallies(verified: DataFrame, by: str = "log") -> DataFrame:
    """One row for each log: entries, valid, signed and unsigned ones, and errors; ``ok`` without errors."""
    out = verified.groupBy(by).agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if("signed").alias("signed"), F.count_if("unsigned").alias("unsigned"), F.sum(F.size("reasons")).cast("long").alias("errors"))
    return out.withColumn("ok", F.col("errors") == 0)


# What an entry may say that was done, and how it ended.
OPERATIONS = ("generate", "publish", "regenerate-skip", "manual", "claim", "claim_aborted", "retried", "calibration_recomputed")
OUTCOME_SIGNS = {"created": "+", "updated": "~", "unchanged": "·", "skipped": "○", "error": "✗", "recovered": "↻", "no_help": "⊘", "fitted": "⊕"}


def known_kinds(log: DataFrame) -> DataFrame:
    """The entries whose operation and outcome are among the known ones."""
    return log.where(F.col("operation").isin(*OPERATIONS) & F.col("outcome").isin(*OUTCOME_SIGNS))


def outcome_sign(outcome: Column) -> Column:
    out = F.lit("?")
    for name, sign in OUTCOME_SIGNS.items():
        out = F.when(outcome == name, sign).otherwise(out)
    return out


def shown(entries: DataFrame, least: int = 9) -> DataFrame:
    """(seq, line): entries as lines of a table whose column of operations is as wide as the longest one shown."""
    width = entries.agg(F.greatest(F.lit(least), F.max(F.char_length("operation"))).alias("width"))
    time = F.substring(F.replace("timestamp", F.lit("T"), F.lit(" ")), 1, 19)
    wide = entries.join(F.broadcast(width))  # one row
    line = F.concat(F.lit("  "), time, F.lit("  "), F.substring("commit", 1, 7), F.lit("  "), outcome_sign(F.col("outcome")), F.lit(" "), F.rpad("operation", F.col("width"), F.lit(" ")), F.lit(" "), "page")
    return wide.select("seq", line.alias("line"))


REPLAY_SIGNS = {"unchanged": "·", "changed": "~", "skipped": "○", "error": "✗"}


def replay_results(latest: DataFrame, matched: DataFrame, rendered: DataFrame) -> DataFrame:
    """(seq, page, status, reason, lines, sections): the latest entries (seq, page, source, body_hash, n_lines, n_sections) rendered again.

    ``matched`` (seq, name, found_file) has the candidate of each entry, ``rendered`` (seq, body_hash, n_lines, n_sections) the new pages.
    """
    new = rendered.select("seq", F.col("body_hash").alias("new_hash"), F.col("n_lines").alias("new_lines"), F.col("n_sections").alias("new_sections"))
    both = latest.join(matched, "seq", "left").join(new, "seq", "left")
    reason = F.when(F.coalesce("source", F.lit("")) == "", "no source in the entry").when(~F.coalesce("found_file", F.lit(False)), "the source file is gone").when(F.col("name").isNull(), "no candidate fits").when(F.col("new_hash").isNull(), "rendering failed")
    status = F.when(F.col("new_hash").isNull() & F.col("name").isNotNull(), "error").when(reason.isNotNull(), "skipped").when(F.col("new_hash") == F.col("body_hash"), "unchanged").otherwise("changed")
    delta = lambda new, old: F.when(reason.isNull(), F.col(new) - F.col(old))
    return both.select("seq", "page", status.alias("status"), reason.alias("reason"), delta("new_lines", "n_lines").alias("lines"), delta("new_sections", "n_sections").alias("sections"))


def replay_totals(results: DataFrame) -> DataFrame:
    """One row: pages replayed and the count of each status, zero where there is none."""
    return results.agg(F.count("*").alias("pages"), *(F.count_if(F.col("status") == s).alias("errors" if s == "error" else s) for s in REPLAY_SIGNS))


def delta_text(d: Column) -> Column:
    """A difference with its sign; ``?`` for null."""
    return F.when(d.isNull(), "?").when(d > 0, F.concat(F.lit("+"), d)).otherwise(d.cast("string"))
