"""Which articles are copies of earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..scale import settle


def fingerprint_articles(articles: DataFrame) -> DataFrame:
    """Add the four hashes to ``(id, title, body, url, …)``."""
    url = F.col("url") if "url" in articles.columns else F.lit("")
    return articles.withColumns({
        "exact_hash": H.exact_hash(F.col("title"), F.col("body")), "norm_hash": H.norm_hash(F.col("title"), F.col("body")),
        "title_hash": H.title_hash(F.col("title")), "url_hash": H.url_hash(url),
    })


def first_writer(df: DataFrame, key: str, order: str = "published_at", id_col: str = "id") -> DataFrame:
    """``(key, first_id)``: the earliest row of each non-blank key."""
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min_by(id_col, F.struct(order, id_col)).alias("first_id"))


def mark_copies(df: DataFrame, key: str, order: str = "published_at", id_col: str = "id") -> DataFrame:
    """Add ``matched_id`` and ``decision``: rows after the first of their key are DUPLICATE."""
    firsts = first_writer(df, key, order, id_col)
    out = df.join(firsts, key, "left")
    copy = F.coalesce(F.col("first_id") != F.col(id_col), F.lit(False))
    return out.withColumn("matched_id", F.when(copy, F.col("first_id"))).withColumn("decision", F.when(copy, "DUPLICATE").otherwise("NEW")).drop("first_id")


def greedy_dedup(df: DataFrame, keys: list[str], order: str, id_col: str = "id", rounds: int = 1_000) -> DataFrame:
    """Add ``kept``: a row is dropped if an earlier *kept* row shares any of its keys.

    Blank keys never match, and dropped rows leave no keys, so chains don't collapse. Each
    round decides, in parallel, every row that is the earliest undecided one of all its keys,
    and drops the undecided rows that share a key with one kept. The number of rounds is the
    longest chain of such decisions. ``(order, id)`` must be unique.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])
    rows = df.select(F.col(id_col).alias("_id"), F.struct(order, id_col).alias("_at"), F.filter(parts, lambda x: F.coalesce(x["v"], F.lit("")) != "").alias("_keys"))
    undecided = settle(rows)
    kept = None
    for _ in range(rounds):
        each = undecided.select("_id", "_at", F.explode("_keys").alias("_key"))
        first = each.groupBy("_key").agg(F.min("_at").alias("_first"))
        behind = each.join(first, "_key").where("_at > _first").select("_id").distinct()
        winners = settle(undecided.join(behind, "_id", "left_anti"))
        kept = winners.select("_id") if kept is None else kept.unionAll(winners.select("_id"))
        taken = winners.select(F.explode("_keys").alias("_key")).distinct()
        lost = each.join(taken, "_key", "left_semi").select("_id").distinct()
        undecided = settle(undecided.join(winners.select("_id"), "_id", "left_anti").join(lost, "_id", "left_anti"))
        if undecided.isEmpty():
            break
    else:
        raise RuntimeError("chains of copies longer than the given rounds")
    marks = settle(kept).withColumn("kept", F.lit(True))
    out = df.join(marks, df[id_col] == F.col("_id"), "left").drop("_id")
    return out.withColumn("kept", F.coalesce("kept", F.lit(False)))


def order_cap(df: DataFrame, most: int, published: str = "published_at", fetched: str = "fetched_at", id_col: str = "id") -> DataFrame:
    """The oldest rows by publication, else fetch time."""
    return df.orderBy(F.coalesce(published, fetched), id_col).limit(most)


def known_copy(news: DataFrame, store: DataFrame, order: str = "published_at", id_col: str = "id") -> DataFrame:
    """Add ``matched_id`` and ``reason``: the first stored article of the same exact, URL or normal hash, in that order.

    Only articles that stand before it, by ``order`` and id, are matches, so ``store`` may hold ``news`` itself. Blank hashes match nothing.
    """
    out = news
    for key in ("exact_hash", "url_hash", "norm_hash"):
        firsts = store.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias(f"_{key}")).agg(F.min(F.struct(F.col(order).alias("at"), F.col(id_col).alias("id"))).alias(f"_by_{key}"))
        earlier = (F.col(key) == F.col(f"_{key}")) & (F.col(f"_by_{key}") < F.struct(F.col(order).alias("at"), F.col(id_col).alias("id")))
        out = out.join(firsts, earlier, "left").drop(f"_{key}")
    by = {k: F.col(f"_by_{k}_hash") for k in ("exact", "url", "norm")}
    reason = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in by.items()])
    return out.withColumn("matched_id", F.coalesce(*by.values())["id"]).withColumn("reason", reason).drop(*[f"_by_{k}_hash" for k in by])


def unseen(df: DataFrame, seen: DataFrame, key: str = "url_key", content: str = "content_hash") -> DataFrame:
    """Rows whose (key, content) wasn't seen; a seen key with new content passes."""
    return df.join(seen.select(key, content).distinct(), [key, content], "left_anti")
