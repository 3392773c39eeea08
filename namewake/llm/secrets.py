"""Secret scans: candidates by pattern, false positives removed by a random forest. Native functions and Spark ML only.

A candidate is a long run of key characters with a digit in it, a value of a format whose prefix names the issuer, or any
value of six characters or more that is assigned to, or stands in quotes after, a credential's name. Its features are its length, its character transitions
(classes that alternate, and how usual its character pairs are in the corpus's words), how much of it is made of
dictionary words, its path, and the words next to it. The forest learns from labelled findings; where nobody has labelled
any, findings that a plain rule can tell for sure are the labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# The look-behind keeps a search from starting again inside a run, the look-ahead asks for a digit.
RUN = r"(?<![A-Za-z0-9_+/.~-])(?=[A-Za-z_+/.~-]*[0-9])[A-Za-z0-9_+/.~-]{15,}[A-Za-z0-9_+/~-]={0,2}"
# Formats whose prefix names the issuer.
FORMATS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
# Names of credentials with what may follow in the same name, and values after them: a short look-behind comes first, as the long one costs more.
NAME = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)s?(?:[_A-Z0-9-][\w-]{0,16})?"
SIGN = r"[\"'`\]]{0,2}[ \t]{0,4}(?:=>|:=|==?|:)[ \t]{0,4}"
QUOTED = [rf"(?<={q})(?<={NAME}(?:{SIGN}|[ \t]{{1,4}}){q})(?=\S)[^{q}\r\n]{{6,512}}(?={q})" for q in "\"'`"]
BARE = rf"(?<=[=:>][ \t]{{0,4}})(?<={NAME}{SIGN})(?![=\s])(?:[^\s\"'`&,;<>(){{}}\[\]]|&(?!\w+=)){{5,512}}[^\s\"'`&,;.<>(){{}}\[\]]"
CANDIDATE = "|".join([*QUOTED, BARE, RUN, rf"(?<![A-Za-z0-9_+/.~-])(?:{FORMATS})(?![A-Za-z0-9_])"])
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
WIDTH = len(ALPHABET) + 1
# Words near a credential, words of placeholders, and names that stand for a value kept elsewhere.
CREDENTIAL = NAME + r"[\"':=]*$"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test[_-]?key|0{8}|1234567890)"
ISSUED = rf"^(?:{FORMATS})(?<!=)={{0,2}}$"
REFERENCE = r"^[$%<{]|\$\{|\{\{|\(|://|(?i)\benv\b"
TEST_PATH = r"(?i)(^|[^a-z])(tests?|examples?|samples?|mocks?|fixtures?|docs?)([^a-z]|$)"
FEATURES = ["length", "digits", "uppers", "symbols", "distinct", "switches", "hex_only", "transitions", "dictionary", "test_path", "credential_before", "assigned", "quoted", "placeholder", "neighbours_plain"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, place, secret, before, before2, after, tight): each candidate of ``docs`` with what is next to it.

    A text is cut at its candidates; ``place`` numbers them from 0, and the words around one are taken from the cuts.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.regexp_extract_all(F.col("text").cast("string"), F.lit(CANDIDATE), 0).alias("secrets"),
        F.split(F.col("text").cast("string"), CANDIDATE, -1).alias("cuts"),
    )
    zipped = F.arrays_zip(F.col("secrets").alias("secret"), F.col("cuts").alias("left"), F.slice("cuts", 2, F.greatest(F.size("cuts") - 1, F.lit(1))).alias("right"))
    each = rows.select("doc_id", "source", F.posexplode(zipped).alias("place", "c")).where("c.secret is not null")
    apart = each.select("doc_id", "source", "place", F.col("c.secret").alias("secret"), F.split("c.left", r"\s+").alias("left"), F.split("c.right", r"\s+", 3).alias("right"))
    word = lambda side, at: F.coalesce(F.get(side, at), F.lit(""))
    back = lambda n: word("left", F.size("left") - n)
    return apart.select("doc_id", "source", "place", "secret", back(2).alias("before"), back(3).alias("before2"), word("right", F.lit(1)).alias("after"), F.concat(back(1), F.lit("\u2026"), word("right", F.lit(0))).alias("tight"))


def corpus_words(docs: DataFrame, least: int = 5) -> DataFrame:
    """(entry, n): words of letters, as often as they stand in all documents, ``least`` times or more."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"([a-z]{3,})"), 1)).alias("entry")
    return docs.select(words).groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def transition_costs(words: DataFrame) -> list[float]:
    """For each pair of alphabet places, minus the log of the share of the second after the first in the corpus's words."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("entry") - 1), lambda i: F.substring("entry", i, F.lit(2))))
    pairs = words.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = {r.pair: r.n for r in pairs.collect()}  # at most one row for each two letters
    chars = "?" + ALPHABET
    costs = []
    for a in chars:
        total = sum(counts.get(a + b, 0) for b in chars) + WIDTH
        costs += [-math.log((counts.get(a + b, 0) + 1) / total) for b in chars]
    return costs


def features(found: DataFrame, words: DataFrame, costs: list[float]) -> DataFrame:
    """The candidates with their feature columns, all doubles."""
    secret, size = F.col("secret"), F.length("secret").cast("double")
    kept = lambda pattern: F.length(F.regexp_replace(secret, pattern, ""))
    classes = F.regexp_replace(F.translate(secret, "bcdefghijklmnopqrstuvwxyzBCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "a" * 25 + "A" * 25 + "0" * 9), r"(.)\1+", "$1")
    letters = F.split(F.lower(secret), "")
    codes = F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)))
    table = F.array(*[F.lit(c) for c in costs])
    cost = F.aggregate(
        F.sequence(F.lit(0), F.size("codes") - 2),
        F.lit(0.0),
        lambda total, i: total + F.get("costs", F.get("codes", i) * WIDTH + F.get("codes", i + 1)),
    )
    plain = lambda word: word.rlike(r"^\p{L}+[.,;:]?$").cast("double")
    out = found.withColumn("row", F.xxhash64("doc_id", "place", "secret")).withColumn("codes", codes).withColumn("costs", table)
    out = out.select(
        "doc_id",
        "source",
        "place",
        "secret",
        "row",
        "before",
        "before2",
        size.alias("length"),
        (kept(r"\D") / size).alias("digits"),
        (kept(r"[^A-Z]") / size).alias("uppers"),
        (kept(r"[A-Za-z0-9]") / size).alias("symbols"),
        (F.size(F.array_distinct(letters)) / F.least(size, F.lit(64.0))).alias("distinct"),
        (F.length(classes) / size).alias("switches"),
        secret.rlike(r"^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex_only"),
        (cost / size).alias("transitions"),
        F.coalesce(F.col("source").rlike(TEST_PATH), F.lit(False)).cast("double").alias("test_path"),
        (F.col("before").rlike(CREDENTIAL) | F.col("before2").rlike(CREDENTIAL) | F.col("tight").rlike(r"(?i)^[\"']?\w*(token|secret|passw|key)\w*[\"']?[:=]")).cast("double").alias("credential_before"),
        (F.col("before").rlike(r"^(=|:|:=|=>)$") | F.col("before").rlike(r"[=:]$") | F.col("tight").rlike(r"^\w+[:=]")).cast("double").alias("assigned"),
        F.col("tight").rlike(r"[\"'`]").cast("double").alias("quoted"),
        (secret.rlike(PLACEHOLDER) | F.col("before").rlike(PLACEHOLDER)).cast("double").alias("placeholder"),
        (plain(F.col("before")) + plain(F.col("after"))).alias("neighbours_plain"),
    )
    runs = out.select("row", "length", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("secret"), F.lit(r"([a-z]{3,})"), 1))).alias("entry"))
    covered = runs.distinct().join(words.select("entry"), "entry").groupBy("row").agg((F.sum(F.length("entry")) / F.max("length")).alias("dictionary"))
    return out.join(covered, "row", "left").withColumn("dictionary", F.least(F.coalesce("dictionary", F.lit(0.0)), F.lit(1.0)))


def labelled_findings(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows for ``train`` and ``scan`` from findings (doc_id, secret, label) that somebody has judged in ``docs``; what is no candidate is left out."""
    words = saved(corpus_words(docs))
    found = features(saved(candidates(docs)), words, transition_costs(words))
    judged = findings.groupBy("doc_id", "secret").agg(F.max(F.col("label").cast("double")).alias("label"))
    return found.join(judged, ["doc_id", "secret"])


def sure_labels(found: DataFrame) -> DataFrame:
    """``label`` 1 for issued formats and for quoted values assigned to a credential's name that no single word or sentence would be;
    0 for plain numbers, words, placeholders and values in running text; null where the rule can't tell."""
    one = ~F.col("secret").rlike(r"\s") & ((F.col("digits") > 0) | F.col("secret").rlike(r"[A-Za-z][!@#$%^&*?+~|]+\w|([a-z][A-Z].*){2}") | ((F.col("length") >= 16) & (F.col("dictionary") == 0)))
    several = F.col("secret").rlike(r"^[a-z]{3,}([ _.-][a-z]{3,}){2,}$")
    named = (F.col("credential_before") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1)
    yes = F.col("secret").rlike(ISSUED) | (named & (one | several) & (F.col("digits") < 0.95) & (F.col("distinct") > 0.2) & ~F.col("secret").rlike(REFERENCE))
    word = F.col("secret").rlike(r"^[A-Za-z_.]{1,15}$") & (F.col("quoted") == 0)
    prose = F.col("secret").rlike(r"\s") & (F.col("assigned") == 0)
    no = word | prose | F.col("secret").rlike(r"\$\{|\{\{|^<.*>$") | ((F.col("digits") >= 0.95) & ~named) | (F.col("dictionary") >= 0.6) | ((F.col("neighbours_plain") == 2) & (F.col("credential_before") == 0) & (F.col("quoted") == 0))
    return found.withColumn("label", F.when(F.col("placeholder") == 1, 0.0).when(yes, 1.0).when(no, 0.0))


@dataclass
class SecretModel:
    forest: RandomForestClassificationModel | None
    share: float  # of positive labels; the probability of everything when only one label was there

    def apply(self, found: DataFrame) -> DataFrame:
        if self.forest is None:
            return found.withColumn("probability", F.lit(self.share))
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(found)
        scored = self.forest.transform(ready)
        return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("p", "probability")


def train(labelled: DataFrame, *, bound: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 7) -> SecretModel:
    """Fit the forest on at most ``bound`` labelled findings (the FEATURES and ``label``), the first by a hash of the row."""
    rows = saved(labelled.where("label is not null").select("row", "label", *FEATURES).orderBy(F.xxhash64("row", F.lit(seed)), "row", "label").limit(bound))
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return SecretModel(None, float(1.0 in seen))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    return SecretModel(forest, seen[1.0] / sum(seen.values()))


def scan(docs: DataFrame, *, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, place, secret, probability, is_secret): every candidate in whole texts of ``docs`` (doc_id, source, text).

    ``place`` numbers a text's candidates from 0. ``labelled`` are findings with the FEATURES, ``row`` and a
    ``label``; without it ``sure_labels`` of these documents are learned. If they are all of one kind there is no forest and
    every candidate has that kind. What ``sure_labels`` calls a secret is one, however few of its like the forest has seen; what it
    calls none is none unless a long run is in it.

    A null or empty text has no candidates; a null source is no path. Rows with a null or repeated doc_id are scanned each. A
    value that stands several times is reported each time. An empty table gives no rows. Other columns are not read.
    """
    words = saved(corpus_words(docs))
    found = saved(features(saved(candidates(docs)), words, transition_costs(words)))
    if labelled is None:
        found = sure_labels(found)
    scored = train(found if labelled is None else labelled).apply(found)
    learned = F.col("probability") >= threshold
    sure = F.when(F.col("label") == 1, True).when((F.col("label") == 0) & ~F.col("secret").rlike(RUN), False).otherwise(learned)
    return scored.select("doc_id", "place", "secret", "probability", (sure if labelled is None else learned).alias("is_secret"))


def redact(docs: DataFrame, *, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret found by ``scan`` replaced in the text; all rows and columns stay, n_chars is counted anew.

    Documents without a secret are unchanged. Rows that share a doc_id share their secrets; rows with a null doc_id are one such group.
    """
    secrets = scan(docs).where("is_secret").groupBy(F.col("doc_id").alias("_secret_doc_id")).agg(F.collect_set("secret").alias("_secret_values"))
    longest_first = F.array_sort("_secret_values", lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(longest_first, F.col("text"), lambda text, s: F.replace(text, s, F.lit(mark)))
    hit = docs.join(secrets, docs["doc_id"].eqNullSafe(secrets["_secret_doc_id"]), "left")
    changed = F.when(F.col("_secret_values").isNotNull(), clean).otherwise(F.col("text"))
    columns = [changed.alias("text") if c == "text" else F.when(F.col("_secret_values").isNotNull(), F.length(changed).cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else docs[c] for c in docs.columns]
    return hit.select(*columns)
