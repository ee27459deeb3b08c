"""Counterparty spellings resolved to parties, within a scope (a case, or everything)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.functions.names import names_likely_same, parsed_names
from tallyrock.operators.components import connected_components
from tallyrock.sources.shared import cut


def spellings(txns: DataFrame, scope: str | None = "case_id", name: str = "counterparty_name") -> DataFrame:
    """(scope, spelling, n, kind, key, display, tokens): the usable spellings of a scope; each distinct one is parsed once, however many rows have it.

    ``txns`` is read once, and of it only the scope and the name, so it need not be written before.
    """
    said = txns.select((F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(name).alias("spelling"))
    said = cut(said.groupBy("scope", "spelling").agg(F.count(F.lit(1)).alias("n")), "spelled")
    known = cut(parsed_names(said.select("spelling")), "spellings").where("who is not null")
    return said.where("spelling is not null").join(known, "spelling").select("scope", "spelling", "n", "who.*")


def _identities(said: DataFrame) -> DataFrame:
    return said.groupBy("scope", "key", "kind", "tokens", "display").agg(F.sum("n").alias("n"))


def identities(txns: DataFrame, scope: str | None = "case_id", name: str = "counterparty_name") -> DataFrame:
    """(scope, key, kind, tokens, display, n): the distinct identities of a scope and their spellings' counts."""
    return _identities(spellings(txns, scope, name))


def variant_edges(names: DataFrame) -> DataFrame:
    """Pairs of distinct name keys of a scope that likely are one party.

    Two facts keep blocks small and lose no pair. Where each token of either name is matched
    by the other, both have the same set of first letters, so that set and a shared token of
    three letters or more make the block. And where neither name has a token of at most two
    letters, they match only with equal token sets, so a block joins names that have such a
    token with all its names, while equal sets meet by grouping.
    """
    base = names.where("kind = 'name'").select("scope", "key", "tokens").distinct()
    base = base.withColumns({"same": F.array_join(F.array_sort(F.array_distinct("tokens")), " "), "short": F.exists("tokens", lambda t: F.length(t) <= 2)})
    base = base.withColumn("letters", F.array_join(F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.substring(t, 1, 1)))), ""))
    strong = F.exists("tokens", lambda t: F.length(t) >= 3)
    equal = base.where(strong).withColumn("least", F.min("key").over(Window.partitionBy("scope", "same"))).where("key <> least").select("scope", F.col("least").alias("a"), F.col("key").alias("b"))
    blocks = base.withColumn("block", F.explode(F.array_distinct(F.filter("tokens", lambda t: F.length(t) >= 3))))
    left = blocks.where("short").select("scope", "block", "letters", F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = blocks.select("scope", "block", "letters", F.col("key").alias("b"), F.col("tokens").alias("tb"))
    near = left.join(right, ["scope", "block", "letters"]).where("a <> b").where(names_likely_same(F.col("ta"), F.col("tb")))
    return equal.union(near.select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def resolve(names: DataFrame) -> DataFrame:
    """(scope, key, cluster): cluster is the least key of the names joined to one party."""
    end = lambda c: F.concat_ws("|", F.col("scope").cast("string"), F.col(c))
    key = lambda c: F.regexp_extract(c, r"^[^|]*\|(.*)$", 1)
    found = connected_components(variant_edges(names).select(end("a").alias("a"), end("b").alias("b")), "a", "b")
    found = found.select(F.split("node", r"\|", 2)[0].cast(dict(names.dtypes)["scope"]).alias("scope"), key("node").alias("key"), key("component").alias("cluster"))
    return names.select("scope", "key").distinct().join(found, ["scope", "key"], "left").withColumn("cluster", F.coalesce("cluster", "key"))


def cluster_display(names: DataFrame, clusters: DataFrame) -> DataFrame:
    """(scope, cluster, display, kind): most tokens of three letters, then longest, then most frequent, then first spelling."""
    order = [F.desc(F.size(F.filter("tokens", lambda t: F.length(t) >= 3))), F.desc(F.length("display")), F.desc("n"), "display"]
    ranked = names.join(clusters, ["scope", "key"]).withColumn("r", F.row_number().over(Window.partitionBy("scope", "cluster").orderBy(*order)))
    return ranked.where("r = 1").select("scope", "cluster", "display", "kind")


def party_spellings(txns: DataFrame, scope: str | None = "case_id", name: str = "counterparty_name") -> DataFrame:
    """(scope, spelling, cluster): the party of each usable spelling of a scope, written once."""
    said = cut(spellings(txns, scope, name), "said")
    clusters = cut(resolve(cut(_identities(said), "identities")), "clusters")
    return cut(said.select("scope", "spelling", "key").join(clusters, ["scope", "key"]).select("scope", "spelling", "cluster"), "parties")


def _with_cluster(txns: DataFrame, said: DataFrame, clusters: DataFrame, scope: str | None, name: str) -> DataFrame:
    of = said.select("scope", F.col("spelling").alias("_spelling"), "key").join(clusters, ["scope", "key"]).select(F.col("scope").alias("_scope"), "_spelling", "cluster")
    keyed = txns.withColumn("_in", F.col(scope) if scope else F.lit(0))
    return keyed.join(of, (F.col("_in") == F.col("_scope")) & (F.col(name) == F.col("_spelling")), "left").drop("_in", "_scope", "_spelling")


def with_cluster(txns: DataFrame, clusters: DataFrame, scope: str | None = "case_id", name: str = "counterparty_name") -> DataFrame:
    """``txns`` with ``cluster``, null where a name is unusable."""
    return _with_cluster(txns, spellings(txns, scope, name), clusters, scope, name)


def resolved(txns: DataFrame, scope: str | None = "case_id", name: str = "counterparty_name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identities, their clusters, ``txns`` with ``cluster``); each is written once, as all steps read them."""
    said = cut(spellings(txns, scope, name), "said")
    names = cut(_identities(said), "identities")
    clusters = cut(resolve(names), "clusters")
    return names, clusters, cut(_with_cluster(txns, said, clusters, scope, name), "clustered")
