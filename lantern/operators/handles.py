"""Signed handles on observed threads, digests of their maps, keys of caches: all by Spark's own hash functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, TTL_SECONDS, DIGEST_CHARS = 2, 900, 32
FENCE = "mw-"


def hmac_sha256(key: bytes, text: Column) -> Column:
    """The HMAC of a text as bytes: two nested hashes, with the key's pads as literals, so no Python is needed."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    return digest(F.concat(outer, digest(F.concat(inner, F.encode(text, "UTF-8")))))


def base64url(raw: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(raw), r"\s", ""), "+/", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    """The bytes, or null for what is no base64url."""
    return F.try_to_binary(F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


def map_digest(maps: DataFrame, by: str) -> DataFrame:
    """by, digest of the threads of a handle (thread_id, message_id, position, parent_id, linkage), in whatever order they came."""
    row = F.concat_ws("\x1f", "message_id", F.col("position").cast("string"), F.coalesce("parent_id", F.lit("")), F.coalesce("linkage", F.lit("")))
    per = maps.groupBy(by, "thread_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", row.alias("r")))), lambda x: x["r"]), "\n"), 256).alias("h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("thread_id", "h"))), lambda x: F.concat_ws("\x1f", x["thread_id"].cast("string"), x["h"])), "\n")
    return per.groupBy(by).agg(F.substring(F.sha2(joined, 256), 1, DIGEST_CHARS).alias("digest"))


def mint(key: bytes, epoch: int, account: Column, digest: Column, threads: Column, fetched_at: Column, ttl: int = TTL_SECONDS) -> Column:
    """A handle: the facts as JSON with sorted keys, in base64url, a dot, their signature. threads: array of (id, history, width)."""
    facts = F.struct(
        account.alias("account_hash"), fetched_at.cast("long").alias("fetched_at"), F.lit(epoch).alias("key_epoch"), digest.alias("mapping_digest"),
        F.array_sort(threads).alias("threads"), F.lit(ttl).alias("ttl"), F.lit(VERSION).alias("v"),
    )
    body = base64url(F.encode(F.to_json(facts), "UTF-8"))
    return F.concat_ws(".", body, base64url(hmac_sha256(key, body)))


FACTS = "account_hash string, fetched_at long, key_epoch int, mapping_digest string, threads array<struct<id: string, history: long, width: int>>, ttl int, v int"


def opened(handle: Column) -> Column:
    return F.from_json(from_base64url(F.substring_index(handle, ".", 1)).cast("string"), FACTS)


def verify(handle: Column, key: bytes, epoch: int, account: Column, now: Column) -> Column:
    """null for a good handle, else key_rotated, invalid or expired: the epoch is read first, then the signature and the
    account, then the age, which counts from the fetch."""
    shaped = handle.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$")
    body = F.substring_index(handle, ".", 1)
    facts = F.when(shaped, opened(handle))
    signed = base64url(hmac_sha256(key, body)) == F.substring_index(handle, ".", -1)
    return (
        F.when(~F.coalesce(shaped, F.lit(False)) | facts["key_epoch"].isNull(), "handle_invalid")
        .when(facts["key_epoch"] != epoch, "handle_key_rotated")
        .when(~signed | ~facts["account_hash"].eqNullSafe(account), "handle_invalid")
        .when(now.cast("long") >= facts["fetched_at"] + facts["ttl"], "handle_expired")
    )


def redeem(handles: DataFrame, changes: DataFrame, oldest: int, refetched: DataFrame, key: bytes, epoch: int, account: Column, now: Column) -> DataFrame:
    """handle_id, state for handles (handle_id, handle): an error of verify(), or stale, stale_unverifiable, or verified.

    changes: thread_id, history_id above what the feed's oldest record reaches; refetched: handle_id, digest of the threads as
    they are now. A handle is stale if one of its threads changed after its own offset, or if the digests differ; if the
    feed begins after an offset, silence shows nothing.
    """
    x = handles.select("handle_id", "handle", verify(F.col("handle"), key, epoch, account, now).alias("error"), opened(F.col("handle")).alias("f"))
    each = x.filter("error is null").select("handle_id", F.explode("f.threads").alias("t")).select("handle_id", F.col("t.id").alias("thread_id"), F.col("t.history").alias("since"))
    moved = changes.select(F.col("thread_id").cast("string").alias("thread_id"), "history_id")
    j = each.join(moved.groupBy("thread_id").agg(F.max("history_id").alias("latest")), "thread_id", "left")
    j = j.groupBy("handle_id").agg(F.max(F.coalesce(F.col("latest") > F.col("since"), F.lit(False))).alias("changed"), F.min("since").alias("since"))
    out = x.join(j, "handle_id", "left").join(refetched.select("handle_id", F.col("digest").alias("now_digest")), "handle_id", "left")
    differs = ~F.col("f.mapping_digest").eqNullSafe(F.col("now_digest"))
    state = F.coalesce("error", F.when(F.col("changed") | differs, "handle_stale").when(F.col("since") < oldest - 1, "handle_stale_unverifiable").otherwise("verified"))
    return out.select("handle_id", state.alias("state"))


def account_hash(address: Column) -> Column:
    return F.sha2(F.lower(F.trim(address)), 256)


def salted(value: Column, salt: bytes) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), F.encode(value, "UTF-8")), 256), 1, 16)


def joined_digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


KEY = ("connector", "content_version", "extraction_schema_version", "kind", "model_id", "native_id", "permission_hash", "principal", "redaction_policy")


def cache_key(**parts: Column) -> Column:
    """The hash of the nine dimensions of an entry as JSON; null if one but model_id is null or empty, or a vector has no model."""
    if set(parts) != set(KEY):
        raise ValueError(f"a key has the dimensions {', '.join(KEY)}")
    value = lambda n: F.concat(F.lit('"'), parts[n].cast("string"), F.lit('"'))
    text = F.concat(F.lit("{"), F.array_join(F.array(*(F.concat(F.lit(f'"{n}": '), F.coalesce(value(n), F.lit("null"))) for n in KEY)), ", "), F.lit("}"))
    whole = F.lit(True)
    for n in KEY:
        if n != "model_id":
            whole = whole & (F.length(F.coalesce(parts[n].cast("string"), F.lit(""))) > 0)
    return F.when(whole & ((parts["kind"] != "vector") | parts["model_id"].isNotNull()), F.sha2(text, 256))


def fence(nonce: Column, text: Column) -> Column:
    """The text between markers that carry the nonce; null if the text holds the nonce and could close its own fence."""
    return F.when(~text.contains(nonce), F.concat(F.lit("<<<"), nonce, F.lit(" "), text, F.lit(" "), nonce, F.lit(">>>")))


def unfenced(c: Column) -> Column:
    """The text of a fence, or null for anything else."""
    whole = rf"(?s)^<<<({FENCE}[0-9a-f]{{16}}) (.*) \1>>>$"
    nonce, text = F.regexp_extract(c, whole, 1), F.regexp_extract(c, whole, 2)
    return F.when(c.rlike(whole) & ~text.contains(nonce), text)


def json_chars(text: Column) -> Column:
    """How many characters a text takes in JSON that is ASCII alone, without its quotes."""
    plain = F.length(text) + F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\f]'))
    control = F.regexp_count(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    wide = F.regexp_count(text, F.lit(r"[\x{7F}-\x{FFFF}]"))
    astral = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return (plain + 5 * control + 5 * wide + 11 * astral).cast("long")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def slash_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")
