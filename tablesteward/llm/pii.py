"""Personal data by candidate gradient boosting, in column expressions throughout.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone
numbers. High-recall generators propose further, overlapping spans: addresses
that are spelled out, loosely grouped digits, dotted or coloned numbers, phone
numbers without a country code. Boosted trees score a candidate by its format
(lengths, groups, separators) and context (what touches it, words before it). One
model covers all kinds, the kind being a feature. It learns from two sources. In
the corpus, candidates that overlap a base span of their kind are examples;
candidates inside longer tokens, or that fail their kind's check, are
counterexamples; all others are unknown and are what the trees decide on. The
fixed rows of ``TAUGHT`` give every kind both sides at any size of the corpus, forms
that no base rule finds among them, and weigh as much as all corpus rows together.
Thresholds are calibrated per kind: the lowest score at which held-back corpus
rows and taught rows reach the wanted precision, or that of all kinds together
where a kind alone reaches it nowhere.

All labelled candidates of the corpus count: three quarters, told apart by hash, fit the
trees, the others the thresholds. Equal ones are one row with their number as its weight,
so what is fitted grows with the forms that occur, not with the texts. Fitted trees become
nested conditions, so scoring runs where the candidates are, without a join or a shuffle of
texts.

Defined results: a null text is an empty one (no spans); base spans stay and
added ones never overlap them; repeated rows are judged alike; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesteward.llm.batches import fresh_names, sha256_hex, table
from tablesteward.llm.spans import bound, digits, kind_counts, listed, matches, places, redacted, touches
from tablesteward.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Starts are pinned to the start of a run and runs
# are possessive where that changes no match, so long runs are read once.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Generators: anything that could be one of a kind.
GENERATORS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(](?:at|AT)[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f.:])[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}",
    "card": r"[0-9](?:[\x20./-]?[0-9]){11,18}",
    "phone": r"[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}",
}
CUES = {
    "email": "(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|addr|host|server",
    "card": "(?i)card|visa|master|pay",
    "phone": "(?i)phone|tel|call|fax|mobile",
}

# Forms that features tell apart.
SPELLED = r"(?i)[\[(](?:at|dot)[\])]|\x20dot\x20"
ENDINGS = r"(?i)[.\x20\])](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
EIGHT_GROUPS = "^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$"
CARD_GROUPS = "^(?:[0-9]{4}([./-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{4}([./-])[0-9]{6}\\2[0-9]{5})$"
PHONE_GROUPS = r"^\(?0?[2-9]?[0-9]{2,3}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}$"

# Labelled texts with a candidate of the kind in each: 1 is personal data, 0 is not.
TAUGHT = (
    ("email", 1, (
        "write to joe [at] mail [dot] com today", "contact ann.lee(at)example(dot)org", "mail: kim at example dot net", "reach me: bo [at] shop.de",
        "mail pat at corp.com please", "e-mail max(at)web.fr", "send it to lu [at] uni [dot] edu", "contact: eva at mail dot es",
    )),
    ("email", 0, (
        "we met at noon.Then we left", "look at this.That is all", "stay at home dot by dot", "arrive at five.thirty", "stop at gate.Go left",
        "sold at cost.No refunds", "sat at ease.Nobody spoke", "shown at point dot one", "stand at 3.5", "at least at v2.10 or later",
    )),
    ("ip", 1, (
        "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "addr fe80:0:0:0:1ff:fe23:4567:890a", "server 2001:db8:1:2:3:4:5:6 answered",
        "from 2001:db8:0:0:8:800:200c:417a port 80", "ip 2620:0:2d0:200:0:0:0:7", "ping 2a00:1450:4001:81a:0:0:0:200e",
    )),
    ("ip", 0, (
        "at 12:30:45:10 sharp", "ratio 1:2:3:4", "verse 3:16:18:20", "version 4.10.2.300", "section 2.3.4.5.6", "mac 00:1b:44:11:3a:b7", "score 21:19:21:17:15",
        "tag ab.cd.ef.ad", "timer 00:00:12:59", "build 10.0.19041.1288",
    )),
    ("card", 1, (
        "card 4111.1111.1111.1111 was charged", "pay with 5500/0000/0000/0004", "visa 4012.8888.8888.1881", "my card: 3782.822463.10005",
        "master 5105.1051.0510.5100 expires", "pay by 6011/1111/1111/1117",
    )),
    ("card", 0, (
        "dates 2024.01.15 2024.01.16 2024", "parts 12/345/6789/01234", "phone 555.0100.0199.02", "isbn 978.3.16.148410.0", "ref 1234.5678.9012.3456",
        "sum 1.000.000.000.000", "log 20240115/103000/001", "id 0000.0000.0000.0001",
    )),
    ("phone", 1, (
        "call (547) 555-3286 now", "phone 547-555-3286", "tel. 547.555.3286", "call me: 547 555 3286", "fax (212) 555 0199", "mobile 5475553286",
        "call 5551234567 today", "phone (030) 901820", "tel 020 7946 0018", "my phone is 0171-2345678",
    )),
    ("phone", 0, (
        "order 5551234567 shipped", "total 1234567", "in 2019-2020 (12)", "pages 100-200 300", "id 123456789", "between 1990-01-02 and", "row 10 20 30 40",
        "sku 000-111-2222", "hash 98765432101", "1 2 3 4 5 6 7", "population 8 336 817", "sum 12.500.000",
    )),
)

# Production settings.
ROUNDS, DEPTH = 12, 4
HELD_BACK = 0.25
# Spark looks for splits in all rows up to the larger of these and the square of the bins.
BINS_OF_FEATURE, SPLIT_ROWS = 32, 10_000
PRECISION = 0.98
BINS = 50
SEED = 5


def base_hits(text: Column) -> dict[str, Column]:
    """The base spans of each kind, with failing matches dropped."""
    found = {kind: matches(text, pattern) for kind, pattern in BASE.items()}

    def counted(low: int, high: int):
        return lambda hit: F.length(digits(hit["hit"])).between(low, high)

    return {
        "email": found["email"],
        "ip": F.filter(found["ip"], lambda hit: F.rlike(hit["hit"], F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        "card": F.filter(
            F.filter(found["card"], counted(12, 19)), lambda hit: F.call_function("luhn_check", digits(hit["hit"]))
        ),
        "phone": F.filter(found["phone"], counted(9, 15)),
    }


def features(hit: Column, kind: str) -> Column:
    """Format and context of a candidate as numbers."""
    text, before, after = hit["hit"], F.coalesce(hit["before"], F.lit("")), F.coalesce(hit["after"], F.lit(""))
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    sized = kind in ("ip", "card")  # of other kinds the base rule fixes the size, which would only be learned again
    numbers = [
        F.lit(KINDS.index(kind)),
        F.length(text) if sized else F.lit(0),
        F.length(digits(text)) if sized else F.lit(0),
        F.length(F.regexp_replace(text, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(text, "[A-Za-z0-9]", "")) if sized else F.lit(0),
        F.size(groups) if sized else F.lit(0),
        F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))),
        F.array_max(F.transform(F.concat(groups, F.array(F.lit(""))), lambda g: F.length(g))),
        F.rlike(text, F.lit("[()]")).cast("int"),
        F.rlike(text, F.lit(r"[.:/]")).cast("int"),
        F.rlike(before, F.lit("[A-Za-z0-9.:/-]$")).cast("int"),
        F.rlike(after, F.lit("[A-Za-z0-9]")).cast("int"),
        F.rlike(before, F.lit(CUES[kind])).cast("int"),
        F.rlike(text, F.lit(SPELLED)).cast("int"),
        F.rlike(text, F.lit(ENDINGS)).cast("int") if kind == "email" else F.lit(0),
        F.rlike(text, F.lit(EIGHT_GROUPS)).cast("int") if kind == "ip" else F.lit(0),
        F.rlike(text, F.lit(CARD_GROUPS)).cast("int") if kind == "card" else F.lit(0),
        F.rlike(text, F.lit(PHONE_GROUPS)).cast("int") if kind == "phone" else F.lit(0),
    ]
    return F.array(*[n.cast("double") for n in numbers])


def fails(hit: Column, kind: str) -> Column:
    """Whether a candidate cannot be one of its kind."""
    text = hit["hit"]
    inside = F.rlike(F.coalesce(hit["before"], F.lit("")), F.lit("[A-Za-z0-9]$")) | F.rlike(
        F.coalesce(hit["after"], F.lit("")), F.lit("[A-Za-z0-9]")
    )
    wrong = {
        "email": ~F.rlike(text, F.lit("[A-Za-z]{2,}$")),
        "ip": ~F.rlike(text, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")) & ~F.rlike(text, F.lit(EIGHT_GROUPS)),
        "card": ~F.call_function("luhn_check", digits(text)),
        "phone": ~F.length(digits(text)).between(9, 15),
    }[kind]
    return inside | wrong


def candidates(text: Column, hits: Column) -> Column:
    """``array<struct<start, kind_no, end, kind, features, label, free>>``: 1 example, 0 counterexample, null unknown.

    ``hits`` are the base spans by kind; a ``free`` candidate touches none of any kind.
    """

    def judged(kind: str):
        def told(hit: Column, touched: Column) -> Column:
            return F.struct(
                hit["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind_no"),
                hit["end"].alias("end"),
                F.lit(kind).alias("kind"),
                features(hit, kind).alias("features"),
                F.when(F.get(touched, F.lit(KINDS.index(kind))), 1).when(fails(hit, kind), 0).alias("label"),
                (~F.array_contains(touched, True)).alias("free"),
            )

        def one(hit: Column) -> Column:
            return bound(F.array(*[touches(hits[k], hit) for k in KINDS]), lambda touched: told(hit, touched))

        return one

    return F.concat(*[F.transform(matches(text, GENERATORS[kind]), judged(kind)) for kind in KINDS])


def with_candidates(docs: DataFrame, text_column: str, names: list[str] | None = None) -> DataFrame:
    """``docs`` with a key of the text, sorted base spans and candidates, in columns of these names."""
    key, base, found = names or fresh_names(docs, "key", "base", "candidates")
    (hits,) = fresh_names(docs, "hits")
    text = F.coalesce(F.col(text_column), F.lit(""))
    by_kind = F.struct(*[places(spans, kind, KINDS.index(kind)).alias(kind) for kind, spans in base_hits(text).items()])
    based = docs.withColumn(key, F.xxhash64(text)).withColumn(hits, by_kind)
    based = based.withColumn(base, F.sort_array(F.concat(*[F.col(hits)[kind] for kind in KINDS])))
    return based.withColumn(found, candidates(text, F.col(hits))).drop(hits)


@dataclass
class Scorer:
    """Trees as nested tuples ``(feature, threshold, left, right)`` or leaves, their weights, and thresholds by kind."""

    trees: list
    weights: list[float]
    thresholds: dict[str, float]

    def score(self, values: Column) -> Column:
        def grown(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.get(values, F.lit(feature)) <= threshold, grown(left)).otherwise(grown(right))

        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + grown(tree) * F.lit(weight)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    def added(self, found: Column) -> Column:
        """Spans of the unknown candidates that pass, none of which touches a base span."""

        def passes(c: Column) -> Column:
            wanted = F.lit(2.0)
            for kind, limit in self.thresholds.items():
                wanted = F.when(c["kind"] == kind, F.lit(limit)).otherwise(wanted)
            return c["label"].isNull() & c["free"] & (self.score(c["features"]) >= wanted)

        kept = F.filter(found, passes)
        return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"), c["kind"].alias("kind")))


def tree_of(node):
    """A fitted tree's node as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), tree_of(node.leftChild()), tree_of(node.rightChild())


# The taught rows as SQL values, once they are known: they depend on nothing but ``TAUGHT``.
_taught_values: list[str] = []


def taught_rows(spark) -> DataFrame:
    """``kind, features, label`` of the fixed rows, by the same expressions as those of the corpus."""
    if not _taught_values:
        rows = [F.struct(F.lit(kind).alias("of"), F.lit(label).alias("taught"), F.lit(text).alias("text")) for kind, label, texts in TAUGHT for text in texts]
        shown = with_candidates(spark.range(1).select(F.inline(F.array(*rows))), "text", ["__key", "__base", "__candidates"])
        found = shown.select("of", "taught", F.inline("__candidates")).where("kind = of").select("kind", "features", "taught")
        _taught_values.extend(f"('{r.kind}', array({', '.join(f'{x}D' for x in r.features)}), {r.taught})" for r in found.collect())
    return spark.sql(f"SELECT * FROM VALUES {', '.join(_taught_values)} AS taught(kind, features, label)")


def examples(found: DataFrame, key: str, candidates_column: str) -> DataFrame:
    """``kind, features, label, held_back, taught, n``: every labelled candidate of a frame, equal ones counted, and the taught rows."""
    every = found.select(F.col(key).alias("key"), F.inline(candidates_column))
    labelled = every.where(F.col("label").isNotNull()).select("key", "kind", "start", "end", "features", "label")
    draw = F.pmod(F.xxhash64("key", "kind", "start", "end", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    told = labelled.select("kind", "features", "label", (draw >= 1 - HELD_BACK).alias("held_back"))
    corpus = told.groupBy("kind", "features", "label", "held_back").agg(F.count(F.lit(1)).alias("n"))
    taught = taught_rows(found.sparkSession).select("kind", "features", "label", F.lit(False).alias("held_back"))
    return corpus.withColumn("taught", F.lit(False)).unionByName(taught.withColumns({"taught": F.lit(True), "n": F.lit(1).cast("long")}))


def fitted(found: DataFrame, key: str, candidates_column: str) -> Scorer:
    """Trees and thresholds out of all labelled candidates of a frame, and the taught ones."""
    known = materialize(examples(found, key, candidates_column), "pii-examples")
    sums = known.agg(
        F.count("*").alias("rows"), F.count_if("taught").alias("taught"), F.sum(F.when(~F.col("taught"), F.col("n"))).alias("corpus")
    ).first()
    weight = F.when(F.col("taught"), F.lit(max(1.0, (sums["corpus"] or 0) / sums["taught"]))).otherwise(F.col("n").cast("double"))
    known = known.withColumn("weight", weight)
    learned = known.where(~F.col("held_back")).select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "weight"
    )
    bins = BINS_OF_FEATURE if sums["rows"] <= SPLIT_ROWS else max(BINS_OF_FEATURE, math.isqrt(sums["rows"]) + 1)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=SEED, weightCol="weight", maxBins=bins).fit(learned)
    trees = [tree_of(tree._call_java("rootNode")) for tree in model.trees]
    scorer = Scorer(trees, list(model.treeWeights), {})
    binned = (
        known.where(F.col("held_back") | F.col("taught"))
        .select("kind", "label", "weight", F.least(F.floor(scorer.score(F.col("features")) * BINS), F.lit(BINS - 1)).alias("bin"))
        .groupBy("kind", "bin")
        .agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all"))
        .collect()
    )

    def lowest(rows: list) -> float | None:
        good, every, limit = 0.0, 0.0, None
        for at in sorted({r["bin"] for r in rows}, reverse=True):
            good += sum(r["good"] for r in rows if r["bin"] == at)
            every += sum(r["all"] for r in rows if r["bin"] == at)
            if good >= PRECISION * every:
                limit = at / BINS
        return limit

    pooled = lowest(binned)
    for kind in KINDS:
        limit = lowest([r for r in binned if r["kind"] == kind])
        limit = pooled if limit is None else limit
        if limit is not None:
            scorer.thresholds[kind] = limit
    return scorer


def all_spans(scorer: Scorer, base: str, candidates_column: str) -> Column:
    return F.sort_array(F.concat(F.col(base), scorer.added(F.col(candidates_column))))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, base, spans`` for each row: arrays of ``struct<start, kind_no, end, kind>`` in listed order."""
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = materialize(with_candidates(own, "text", ["key", "base", "found"]).drop("text"), "pii-candidates")
    return found.select("id", "base", all_spans(fitted(found, "key", "found"), "base", "found").alias("spans"))


def redact_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    Texts and their candidates are written once; the trees are fitted on the
    candidates, and what they decide is cut out beside the texts. The table stays
    on disk under all that follows, so it is packed tighter than others.
    """
    names = fresh_names(docs, "key", "base", "candidates")
    found = materialize(with_candidates(docs, text_column, names), "pii-candidates", compression="zstd")
    spans = all_spans(fitted(found, names[0], names[2]), names[1], names[2])
    (own,) = fresh_names(found, "spans")
    text = redacted(F.col(text_column), F.col(own)).alias(text_column)
    return found.withColumn(own, spans).select(*[text if name == text_column else F.col(f"`{name}`") for name in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), *kind_counts(KINDS), sha256_hex(listed(F.col("base"))).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


QUERIES = {"op5_pii": op5_pii}
