"""Conversations and repositories as rows: who may see them, pages of them, what is remembered, what goes when they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.config import SETTINGS


def visible_to(user: str | Column, owner: str = "user_id") -> Column:
    """Reading by id: rows of the user, and rows without an owner."""
    return F.col(owner).isNull() | (F.col(owner) == (user if isinstance(user, Column) else F.lit(user)))


def owned_by(user: str | Column, owner: str = "user_id") -> Column:
    """Lists: rows of the user only. Ownerless rows can be read but are never listed."""
    return F.col(owner) == (user if isinstance(user, Column) else F.lit(user))


def ready() -> Column:
    return F.col("status") == "ready"


def holds(given: Column, stored: Column, expires: Column, now: Column) -> Column:
    """Whether a given token is the stored one and hasn't expired. A null expiry never comes; a null token is none."""
    return F.coalesce(given == stored, F.lit(False)) & ~F.coalesce(expires < now, F.lit(False))


def last_n(messages: DataFrame, n: int = SETTINGS.history, key: str = "conversation_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """The last n rows of each key with turn, from 1, in their order. Null times come first, ties go by id. The window keeps n rows a key and task before its exchange."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()))
    kept = messages.withColumn("_back", newest).filter(F.col("_back") <= n)
    oldest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_back").desc()))
    return kept.withColumn("turn", oldest).drop("_back")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = SETTINGS.page_size) -> DataFrame:
    """One page of rows. order must be total. Only offset + size rows of each task are kept and sorted."""
    if number < 1 or not 1 <= size <= SETTINGS.max_page_size:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_envelope(rows: DataFrame, number: int = 1, size: int = SETTINGS.page_size) -> DataFrame:
    """total, page, per_page, items on the page, has_more: one aggregate, without a sort."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    start = (number - 1) * size
    items = F.greatest(F.least(F.col("total") - start, F.lit(size)), F.lit(0))
    return total.select("total", F.lit(number).alias("page"), F.lit(size).alias("per_page"), items.alias("items"), (start + items < F.col("total")).alias("has_more"))


def fact_set(facts: DataFrame, key: str = "repo_id", fact: str = "fact") -> DataFrame:
    """Each fact of a key once. Case and blanks count; nulls are no facts."""
    return facts.filter(F.col(fact).isNotNull() & F.col(key).isNotNull()).select(key, fact).distinct()


def facts_text(facts: DataFrame, most: int = SETTINGS.facts, key: str = "repo_id", fact: str = "fact") -> DataFrame:
    """key, text: the first facts by the alphabet as bullets. Only so many rows of a key are brought together."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(fact))
    few = fact_set(facts, key, fact).withColumn("_n", first).filter(F.col("_n") <= most)
    return few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(fact)), lambda f: F.concat(F.lit("- "), f)), "\n").alias("text"))


def alive(writes: DataFrame, now: Column, ttl_s: int = SETTINGS.memory_ttl_s, key: tuple[str, ...] = ("repo_id", "key"), value: str = "value", at: str = "written_at", tie: str | None = None) -> DataFrame:
    """key, value, expires_at of what is remembered at a time: the last write of each key that isn't in the future, if its lifetime isn't over. Each write starts the lifetime again."""
    past = writes.filter(F.col(at) <= now)
    last = past.groupBy(*key).agg(F.max_by(F.struct(F.col(value), F.col(at).alias("_at")), F.struct(at, tie or value)).alias("_last"))
    expires = F.col("_last._at") + F.expr(f"INTERVAL {ttl_s} SECONDS")
    return last.select(*key, F.col(f"_last.{value}").alias(value), expires.alias("expires_at")).filter(F.col("expires_at") > now)


def cascade_delete(tables: dict[str, DataFrame], roots: DataFrame, links: list[tuple[str, str, str, str]], root: str, root_key: str = "id") -> dict[str, DataFrame]:
    """tables after the rows of root whose key is in roots are deleted, and all that hangs on them. links: (child, foreign key, parent, key), parents before children. Rows whose foreign key is null or dangling stay."""
    gone = {root: tables[root].join(roots.select(F.col(root_key)).distinct(), root_key, "left_semi")}
    left = dict(tables)
    left[root] = tables[root].join(roots.select(F.col(root_key)).distinct(), root_key, "left_anti")
    for child, foreign, parent, key in links:
        if parent not in gone:
            continue
        lost = gone[parent].select(F.col(key).alias(foreign)).distinct()
        gone[child] = tables[child].join(lost, foreign, "left_semi")
        left[child] = tables[child].join(lost, foreign, "left_anti")
    return left


def linked_account(users: DataFrame, logins: DataFrame) -> DataFrame:
    """login_id, user_id: the account of an outside login, by provider and id, else by mail address; null if there's none."""
    by_id = users.filter(F.col("oauth_id").isNotNull()).select(F.col("id").alias("_a"), "oauth_provider", "oauth_id")
    by_mail = users.filter(F.col("email").isNotNull()).select(F.col("id").alias("_b"), "email")
    joined = logins.join(by_id, ["oauth_provider", "oauth_id"], "left").join(by_mail, "email", "left")
    return joined.groupBy("login_id").agg(F.coalesce(F.min("_a"), F.min("_b")).alias("user_id"))
