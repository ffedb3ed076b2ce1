"""Secret scans with corpus-wide ownership frequency, in column expressions throughout.

Base rules find assignments of passwords and tokens, access key ids and long hex
strings; a generator proposes other long tokens of mixed characters, of any length
and with dots inside. Every candidate value is hashed, and the hashes are counted
over the whole corpus by distinct repositories and distinct owners. A value that
several owners hold, or that is in most repositories of its owner and in more than
a few, is a copied example; one of a single owner that looks random is live. Live candidates are added as spans
of kind ``assign``; base spans stay, whatever their verdict.

A value that a third of all rows hold is counted by partial sums (repository,
owner, value, from the inside out), and the join with the counts is a plain one
that adaptive execution can split. Texts are read once and never shuffled.

Defined results: a null text is an empty one (no spans); a null owner or
repository is one of its own; a value that a repository repeats counts once
there; repeated rows of one id are one repository; added spans touch no base
span; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteward.llm.batches import numbered, sha256_hex, table
from tablesteward.llm.spans import kind_counts, listed, matches, places, touches

KINDS = ("assign", "access", "hex")

# The base patterns and their lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]++", "hex": rf"[0-9a-f]{{{HEX_LENGTH},}}+"}

# The generator: long unbroken tokens, single dots inside them included. The look
# ahead only spares short words; the length is tested on the match.
TOKEN_LENGTH = 20
GENERATOR = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=.-]{{{TOKEN_LENGTH}}})[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+"

# Production settings: owners that may share a live credential, repositories that
# always may, the share of its owner's repositories that may, and the distinct
# characters it needs.
MOST_OWNERS, MOST_REPOSITORIES, MOST_SHARE = 1, 5, 0.5
LEAST_CHARACTERS = 12


def base_hits(text: Column) -> dict[str, Column]:
    found = {kind: matches(text, pattern) for kind, pattern in BASE.items()}
    return {
        "assign": F.filter(found["assign"], lambda h: F.length(assigned_value(h["hit"])) >= ASSIGN_VALUE),
        "access": F.filter(found["access"], lambda h: F.length(h["hit"]) >= ACCESS_LENGTH),
        "hex": found["hex"],
    }


def assigned_value(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 1)


def looks_random(value: Column) -> Column:
    """Digits, letters, and many different characters."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (different >= LEAST_CHARACTERS)


def scanned(docs: DataFrame, id_column: str, text_column: str, owner_column: str, repository_column: str) -> DataFrame:
    """``row_id, id, owner, repository, base, candidates``; texts are left behind."""
    text = F.coalesce(F.col(text_column), F.lit(""))

    def told(hits: Column, kind: str, value, from_base: bool) -> Column:
        def one(hit: Column) -> Column:
            return F.struct(
                hit["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind_no"),
                hit["end"].alias("end"),
                F.lit(kind).alias("kind"),
                F.xxhash64(value(hit["hit"])).alias("value_hash"),
                looks_random(value(hit["hit"])).alias("random"),
                F.lit(from_base).alias("from_base"),
            )

        return F.transform(hits, one)

    def whole(hit: Column) -> Column:
        return hit

    own = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_column).cast("string")), F.lit("")).alias("owner"),
        F.coalesce(F.concat(F.lit("="), F.col(repository_column).cast("string")), F.lit("")).alias("repository"),
        text.alias("text"),
    )
    text = F.col("text")
    hits = own.withColumn("hits", F.struct(*[h.alias(kind) for kind, h in base_hits(text).items()]))
    based = hits.withColumn("base", F.sort_array(F.concat(*[places(F.col("hits")[k], k, i) for i, k in enumerate(KINDS)])))
    others = F.filter(
        told(F.filter(matches(text, GENERATOR), lambda h: F.length(h["hit"]) >= TOKEN_LENGTH), "assign", whole, False),
        lambda c: c["random"] & ~reduce(or_, [touches(F.col("hits")[kind], c) for kind in KINDS]),
    )
    values = F.concat(
        told(F.col("hits")["assign"], "assign", lambda h: F.rtrim(assigned_value(h), F.lit(".")), True),
        told(F.col("hits")["access"], "access", whole, True),
        told(F.col("hits")["hex"], "hex", whole, True),
        others,
    )
    return numbered(based.select("id", "owner", "repository", "base", values.alias("candidates")), "secret-candidates")


def ownership(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``value_hash, owned``: distinct owners and repositories over the corpus, from the inside out.

    Only values of more than a few repositories look up how many their owner has.
    """
    counts = (
        candidates.groupBy("value_hash", "owner", "repository")
        .agg(F.lit(1).alias("held"))
        .groupBy("value_hash", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value_hash")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.min("owner").alias("owner"))
    )
    kept_by = rows.groupBy("owner", "repository").agg(F.lit(1).alias("held")).groupBy("owner").agg(F.count("*").alias("total"))
    in_most = (
        counts.where((F.col("owners") <= MOST_OWNERS) & (F.col("repositories") > MOST_REPOSITORIES))
        .join(kept_by, "owner")
        .where(F.col("repositories") > MOST_SHARE * F.col("total"))
        .select("value_hash", F.lit(True).alias("in_most"))
    )
    owned = (F.col("owners") <= MOST_OWNERS) & F.col("in_most").isNull()
    return counts.join(in_most, "value_hash", "left").select("value_hash", owned.alias("owned"))


def secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    repository_column: str | None = None,
) -> DataFrame:
    """``id, base, spans, n_live, n_copied`` for each row; a repository is a document unless a column names it."""
    rows = scanned(docs, id_column, text_column, owner_column, repository_column or id_column)
    candidates = rows.select("row_id", "owner", "repository", F.inline("candidates"))
    owned = F.col("owned")
    place = F.struct("start", "kind_no", "end", "kind")
    judged = (
        candidates.join(ownership(rows, candidates), "value_hash")
        .groupBy("row_id")
        .agg(
            F.collect_list(F.when(~F.col("from_base") & owned, place)).alias("added"),
            F.count(F.when(owned & F.col("random"), 1)).alias("n_live"),
            F.count(F.when(~owned, 1)).alias("n_copied"),
        )
    )
    none = F.lit(0).cast("long")
    added = F.coalesce("added", F.filter("base", lambda b: F.lit(False)))
    return rows.join(judged, "row_id", "left").select(
        "id",
        "base",
        F.sort_array(F.concat("base", added)).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_copied", none).alias("n_copied"),
    )


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *kind_counts(KINDS),
        sha256_hex(listed(F.col("base"))).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


QUERIES = {"op6_secrets": op6_secrets}
