"""Taxonomies (genres and tags) and the executable subset of tags: documents in canonical form, and tables of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.records import RecordError, load_strict, utc_timestamp, write_bundle

# Keys of the documents in the order in which they are written, and a tag's fields as a service names them.
SNAPSHOT = ("snapshot_schema_version", "genres", "tags")
TAG = {"id": "id", "name": "name", "description": "description", "category": "category", "is_general_spoiler": "isGeneralSpoiler", "is_adult": "isAdult"}
SNAPSHOT_VERSION = "taxonomy-snapshot-1"
SUBSET = ("subset_version", "derived_from_snapshot_hash", "tags")
SUBSET_TAG = ("tag_id", "tag_name", "category", "aliases", "is_general_spoiler", "is_adult")
AUDIT = ("tag_id", "tag_name", "category", "approved", "reason", "aliases", "is_general_spoiler", "is_adult", "source_snapshot_hash")
COLLECTIONS = ("GenreCollection", "MediaTagCollection")


def _trimmed(value) -> bool:
    return isinstance(value, str) and value != "" and value == value.strip()


_KINDS: dict[str, Callable] = {
    "id": lambda v: type(v) is int and v > 0, "tag_id": lambda v: type(v) is int and v > 0, "name": _trimmed, "tag_name": _trimmed, "category": _trimmed, "reason": _trimmed,
    "description": lambda v: v is None or isinstance(v, str), "is_general_spoiler": lambda v: type(v) is bool, "is_adult": lambda v: type(v) is bool, "approved": lambda v: type(v) is bool,
    "aliases": lambda v: isinstance(v, list) and all(map(_trimmed, v)) and len(set(v)) == len(v),
    "source_snapshot_hash": lambda v: isinstance(v, str) and len(v) == 64 and not set(v) - set("0123456789abcdef"),
}


def _checked(rows, keys: tuple[str, ...], name: str, unique: tuple[str, ...]) -> None:
    """Each row has just these keys with values of their kinds, and no two rows share a value of `unique`."""
    if not isinstance(rows, list):
        raise RecordError(f"{name} is no list")
    for i, row in enumerate(rows):
        if not isinstance(row, dict) or set(row) != set(keys):
            raise RecordError(f"{name}[{i}] has other keys than {list(keys)}")
        if wrong := [k for k in keys if not _KINDS[k](row[k])]:
            raise RecordError(f"{name}[{i}] has wrong values of {wrong}")
    for k in unique:
        if len({row[k] for row in rows}) < len(rows):
            raise RecordError(f"{name} has a {k} twice")


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


# --- snapshot -----------------------------------------------------------------------------------------------------


def check_snapshot(snapshot: dict) -> None:
    """Raises RecordError unless keys, types and orders are those of a canonical snapshot."""
    if tuple(snapshot) != SNAPSHOT or not _trimmed(snapshot["snapshot_schema_version"]):
        raise RecordError("no snapshot: other keys, or no version")
    genres = snapshot["genres"]
    if not isinstance(genres, list) or not all(map(_trimmed, genres)) or any(a >= b for a, b in zip(genres, genres[1:], strict=False)):
        raise RecordError("genres are not sorted, unique and trimmed")
    tags = snapshot["tags"]
    _checked(tags, tuple(TAG), "tags", ("id", "name"))
    if any(tuple(t) != tuple(TAG) for t in tags) or tags != sorted(tags, key=lambda t: (t["id"], t["name"])):
        raise RecordError("tags, or their keys, are not in order")


def snapshot_of(payload: dict, version: str = SNAPSHOT_VERSION) -> dict:
    """The canonical snapshot of a service's answer, of the version given (its digest covers it); fields it doesn't need are left out, faults are errors."""
    data = payload.get("data") if isinstance(payload, dict) else None
    if not isinstance(data, dict) or not all(isinstance(data.get(c), list) for c in COLLECTIONS):
        raise RecordError("the answer has no collections of genres and tags")
    genres, tags = (data[c] for c in COLLECTIONS)
    if not all(isinstance(t, dict) and set(TAG.values()) <= set(t) for t in tags):
        raise RecordError("a tag has not all fields")
    if not all(map(_trimmed, genres)):
        raise RecordError("a genre is no text, or empty, or has outer white space")
    made = [{k: t[source] for k, source in TAG.items()} for t in tags]
    _checked(made, tuple(TAG), "tags", ("id", "name"))
    snapshot = {"snapshot_schema_version": version, "genres": sorted(genres), "tags": sorted(made, key=lambda t: (t["id"], t["name"]))}
    check_snapshot(snapshot)
    return snapshot


def dumps_snapshot(snapshot: dict) -> str:
    check_snapshot(snapshot)
    return _compact(snapshot)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def load_snapshot(text: str) -> dict:
    """A snapshot that is canonical already: nothing is sorted, trimmed or repaired, and no key comes twice."""
    snapshot = load_strict(text, SNAPSHOT, in_order=True)
    check_snapshot(snapshot)
    return snapshot


def fetch_payload(send: Callable[[dict], tuple[int, dict, dict]], query: str) -> dict:
    """The whole answer of a service to one query, tried once."""
    status, _, answer = send({"query": query})
    if status != 200 or not isinstance(answer, dict) or answer.get("errors"):
        raise RuntimeError(f"the service answers {status}: {answer.get('errors') if isinstance(answer, dict) else 'no object'}")
    return answer


def write_snapshot(payload: dict, folder: str, fetched_at: str, source: str, version: str = SNAPSHOT_VERSION) -> dict:
    """source.json, canonical.json and manifest.json below folder, or nothing if one exists; gives the manifest."""
    snapshot = snapshot_of(payload, version)
    text = dumps_snapshot(snapshot)
    manifest = {
        "source": source, "resource": list(COLLECTIONS), "fetched_at_utc": utc_timestamp(fetched_at), "genre_count": len(snapshot["genres"]),
        "tag_count": len(snapshot["tags"]), "canonical_sha256": sha256(text), "snapshot_schema_version": snapshot["snapshot_schema_version"],
    }
    pretty = lambda v: json.dumps(v, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    write_bundle({f"{folder}/source.json": pretty(payload), f"{folder}/canonical.json": text, f"{folder}/manifest.json": pretty(manifest)})
    return manifest


TAG_DDL = "id long, name string, description string, category string, is_general_spoiler boolean, is_adult boolean"


def tags_table(spark: SparkSession, snapshot: dict) -> DataFrame:
    return spark.createDataFrame([tuple(t[k] for k in TAG) for t in snapshot["tags"]], TAG_DDL)


def projected(tags: DataFrame) -> DataFrame:
    """Raw tag rows (fields as a service names them) with the canonical fields alone, in order of id and name; a repeated id or name, or a missing field, is an error.

    Repeats are found by two aggregations by key, not by a comparison of rows.
    """
    made = tags.select(*[F.col(source).alias(k) for k, source in TAG.items()])
    none = F.col("id").isNull() | (F.col("id") < 1) | F.col("category").isNull() | (
        F.trim("category") != F.col("category")
    ) | F.col("is_general_spoiler").isNull() | F.col("is_adult").isNull()
    twice = [made.groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(f"_{k}")) for k in ("id", "name")]
    faults = made.agg(
        F.count_if(none | F.col("name").isNull() | (F.trim("name") != F.col("name"))).alias("_bad")
    ).crossJoin(twice[0]).crossJoin(twice[1])  # one row each
    fault = F.when(
        F.col("_bad") > 0, "a tag has a wrong field"
    ).when(F.col("_id") > 1, "a tag id comes twice").when(F.col("_name") > 1, "a tag name comes twice")
    checked = made.crossJoin(F.broadcast(faults)).withColumn("id", F.when(fault.isNull(), F.col("id")).otherwise(F.raise_error(fault).cast("long")))
    return checked.select(*TAG).orderBy("id", "name")


# --- audit and executable subset ----------------------------------------------------------------------------------


def load_audit(text: str) -> list[dict]:
    """Reviewed tags; approval is never assumed."""
    rows = load_strict('{"rows":' + text + "}", ("rows",))["rows"]
    _checked(rows, AUDIT, "audit", ("tag_id", "tag_name"))
    return rows


AUDIT_DDL = "tag_id long, tag_name string, category string, approved boolean, reason string, aliases array<string>, is_general_spoiler boolean, is_adult boolean, source_snapshot_hash string"


def audit_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[k] for k in AUDIT) for r in rows], AUDIT_DDL)


def subset_document(executable: DataFrame, version: str, snapshot_sha256: str) -> dict:
    """The document of executable tags (a vocabulary, so it fits the driver), in order of id and name."""
    tags = [{k: list(r[k]) if k == "aliases" else r[k] for k in SUBSET_TAG} for r in executable.select(*SUBSET_TAG).orderBy("tag_id", "tag_name").collect()]
    subset = {"subset_version": version, "derived_from_snapshot_hash": snapshot_sha256, "tags": tags}
    check_subset(subset)
    return subset


def check_subset(subset: dict) -> None:
    if tuple(subset) != SUBSET or not _trimmed(subset["subset_version"]) or not _KINDS["source_snapshot_hash"](subset["derived_from_snapshot_hash"]):
        raise RecordError("no subset: other keys, no version, or no digest")
    tags = subset["tags"]
    _checked(tags, SUBSET_TAG, "tags", ("tag_id", "tag_name"))
    aliases = [a for t in tags for a in t["aliases"]]
    if len(set(aliases)) < len(aliases) or set(aliases) & {t["tag_name"] for t in tags}:
        raise RecordError("an alias comes twice, or is a tag's name")
    if any(t["is_adult"] or t["is_general_spoiler"] for t in tags):
        raise RecordError("an executable tag is adult or a spoiler")
    if any(tuple(t) != SUBSET_TAG or t["aliases"] != sorted(t["aliases"]) for t in tags) or tags != sorted(tags, key=lambda t: (t["tag_id"], t["tag_name"])):
        raise RecordError("tags, their keys or aliases are not in order")


def dumps_subset(subset: dict) -> str:
    check_subset(subset)
    return _compact(subset)


def load_subset(text: str) -> dict:
    subset = load_strict(text, SUBSET, in_order=True)
    check_subset(subset)
    return subset


def write_subset(subset: dict, folder: str) -> dict:
    """executable_tags.json and manifest.json below folder, or nothing if one exists; gives the manifest."""
    text = dumps_subset(subset)
    manifest = {
        "subset_version": subset["subset_version"], "subset_hash": sha256(text), "derived_from_snapshot_hash": subset["derived_from_snapshot_hash"],
        "approved_tag_count": len(subset["tags"])
    }
    write_bundle({f"{folder}/executable_tags.json": text, f"{folder}/manifest.json": json.dumps(manifest, ensure_ascii=False, indent=2) + "\n"})
    return manifest
