"""Catalogue upkeep: headings, sources, new entries, accounts and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_slug(url: Column) -> Column:
    """Last part of a URL's path; null stays null, a URL without one gives ''."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "[^/]*$", 0)


def headings(subject: Column) -> Column:
    """Parts of a subject heading between `--` or an em-dash, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(subject, "--|—"), lambda x: F.trim(x)), lambda x: x != "")


def with_source(source: Column, name: str) -> Column:
    """`source + name`, once; a null or blank source becomes the name."""
    blank = source.isNull() | (F.trim(source) == "")
    return F.when(blank, name).when(F.contains(source, F.lit(name)), source).otherwise(F.concat(source, F.lit(f" + {name}")))


def implied(slugs: Column, identity: Sequence[str], umbrella: str, limit: int) -> Column:
    """Slugs with the umbrella slug last where one of the identity slugs is there; the first `limit` of them."""
    found = F.arrays_overlap(slugs, F.array(*(F.lit(x) for x in identity)))
    return F.slice(F.when(found, F.array_union(slugs, F.array(F.lit(umbrella)))).otherwise(slugs), 1, limit)


def new_entries(found: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of found whose keys no row of have has; null keys are equal to nothing, so such rows are new."""
    return found.join(have.select(*keys), list(keys), "left_anti")


def by_kind(vocabulary: DataFrame) -> DataFrame:
    """kind and its slugs in order, each once; the vocabulary's size bounds a group."""
    return vocabulary.groupBy("kind").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def run_report(promoted: DataFrame) -> DataFrame:
    """run, rows and the first time of each promotion run."""
    return promoted.groupBy("run").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def directions(changes: DataFrame, n: int = 12) -> DataFrame:
    """The n most frequent (was, becomes) of changes; of equal counts the first by name."""
    return changes.groupBy("was", "becomes").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "was", "becomes").limit(n)


def link_accounts(logins: DataFrame, accounts: DataFrame) -> DataFrame:
    """login_id, account_id and how (`subject`, `email` or `insert`) of each login.

    logins: login_id, provider, sub, email; accounts: account_id, provider, sub, email. A login is linked by provider and
    sub, else by email, else it is a new account. Of several accounts the smallest account_id counts.
    """
    by_sub = accounts.groupBy("provider", "sub").agg(F.min("account_id").alias("_by_sub"))
    by_email = accounts.filter("email is not null").groupBy("email").agg(F.min("account_id").alias("_by_email"))
    joined = logins.join(by_sub, ["provider", "sub"], "left").join(by_email, "email", "left")
    how = F.when(F.col("_by_sub").isNotNull(), "subject").when(F.col("_by_email").isNotNull(), "email").otherwise("insert")
    return joined.select("login_id", F.coalesce("_by_sub", "_by_email").alias("account_id"), how.alias("how"))
