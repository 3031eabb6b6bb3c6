"""Model ids: what a provider's spelling names, and whether a request was served by it (FLT5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families that are asked for by their bare name, and the two orders of a full id.
FAMILIES = ("haiku", "sonnet", "opus", "fable", "mythos")
FULL_ID = r"^claude-(?:([a-z]+)-(\d{1,2}(?:-\d{1,2})?)|(\d{1,2}(?:-\d{1,2})?)-([a-z]+))(?:-(\d{8}))?$"
LATEST = r"-latest$"


def bare_id(name: Column) -> Column:
    """The id without routing prefix, context-window suffix, Bedrock prefix and version, with a dash before a Vertex date."""
    n = F.regexp_replace(F.lower(F.btrim(name)), r"\[[^\]]*\]$", "")
    n = F.regexp_replace(n, r"^.*/", "")
    n = F.regexp_replace(n, r"^(?:[a-z]+(?:-[a-z]+)*\.)?anthropic\.", "")
    return F.regexp_replace(F.regexp_replace(n, r"-v\d+:\d+$", ""), r"@(\d{8})$", "-$1")


def model_id(name: Column) -> Column:
    """struct(name, latest, family, version, snapshot); the last three are null where the id is of no known order. 4-0 is version 4."""
    bare = bare_id(name)
    tail = F.regexp_replace(bare, LATEST, "")
    group = lambda i: F.nullif(F.regexp_extract(tail, FULL_ID, i), F.lit(""))
    known = F.rlike(tail, F.lit(FULL_ID))
    version = F.regexp_replace(F.coalesce(group(2), group(3)), r"-0+$", "")
    return F.struct(
        tail.alias("name"),
        (F.rlike(bare, F.lit(LATEST))).alias("latest"),
        F.when(known, F.coalesce(group(1), group(4))).alias("family"),
        F.when(known, F.transform(F.split(version, "-"), lambda x: x.cast("int"))).alias("version"),
        F.when(known, group(5)).alias("snapshot"),
    )


def _blank(name: Column) -> Column:
    return F.coalesce(F.btrim(name), F.lit("")) == ""


def one_served(requested: Column, served: Column) -> Column:
    """match, mismatch, unverifiable, unavailable or not_requested for one served name.

    What cannot be resolved (`-latest`, a dated request served undated, an unknown alias) is unverifiable and stays scorable.
    """
    want, got = model_id(requested), model_id(served)
    latest = want.latest | got.latest
    soft = F.when(latest, "unverifiable").otherwise("match")
    alias = F.when(got.family.isNotNull(), F.when(got.family == want["name"], "match").otherwise("mismatch")).otherwise(
        F.when(F.array_contains(F.split(got["name"], "[-_.@]"), want["name"]), "match").otherwise("unverifiable")
    )
    full = (
        F.when((want.family != got.family) | (want.version != got.version), "mismatch")
        .when(latest, "unverifiable")
        .when(want.snapshot.isNull() | want.snapshot.eqNullSafe(got.snapshot), "match")
        .when(got.snapshot.isNull(), "unverifiable")
        .otherwise("mismatch")
    )
    dated = F.startswith(got["name"], want["name"]) & F.rlike(F.substr(got["name"], F.length(want["name"]) + 1), F.lit(r"^[-@]\d{8}$"))
    return (
        F.when(_blank(served), "unavailable")
        .when(_blank(requested), "not_requested")
        .when(bare_id(requested) == bare_id(served), "match")
        .when(want["name"] == got["name"], "unverifiable")
        .when(want["name"].isin(*FAMILIES), alias)
        .when(want.family.isNotNull() & got.family.isNotNull(), full)
        .when(want.family.isNotNull() | got.family.isNotNull(), "unverifiable")
        .when(dated, soft)
        .when(~F.rlike(want["name"], F.lit(r"\d")), "unverifiable")
        .otherwise("mismatch")
    )


def served_model_check(requested: Column, served: Column) -> Column:
    """FLT5 on an array of reported names: one name is compared, of several the request among them is `mixed`."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(served, F.array().cast("array<string>")), lambda s: F.btrim(s)), lambda s: F.coalesce(s, F.lit("")) != ""))
    checks = F.transform(names, lambda s: one_served(requested, s))
    among = F.exists(checks, lambda c: c.isin("match", "unverifiable"))
    return (
        F.when(F.size(names) == 0, "unavailable")
        .when(_blank(requested), "not_requested")
        .when(F.size(names) == 1, F.element_at(checks, 1))
        .when(among, "mixed")
        .otherwise("mismatch")
    )
