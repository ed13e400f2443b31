"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Any run of 16 or more key characters inside a word is a candidate finding.  A forest judges each by
its length, the changes between kinds of characters, the share of its three-letter pieces that are
in a dictionary, the path it was found in, and the words around it.  It is trained on labelled
findings.  Where no labels are given, strict formats label some: values of a known key format or
assigned to a key word are secrets; values of letters alone and digits alone are not.  The rest is
left to the forest.

The dictionary is the three-letter pieces that make up at least 1/``DICTIONARY`` of all pieces in
the candidates' neighbouring words, so it has at most ``DICTIONARY`` entries.  The forest is fitted
on at most ``FIT_ROWS`` labelled findings of each class, those with the smallest hashes.  All else
runs over all rows.  DataFrame operations and Spark ML only.

Defined cases: null text has no candidates; several candidates in one word are numbered; repeated
documents give their findings each; without labelled findings of both classes every candidate is
reported with a null score and counts as a secret (nothing is removed); an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import LOWER, UPPER, stash

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: Words that name a key, and a public key format.
KEY_WORDS = r"(?i)(password|passwd|pwd|token|secret|api_?key|credential|auth)"
KNOWN = r"^AKIA[0-9A-Z]{16}$"
DIGITS = "0123456789"

DICTIONARY = 2000
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 24, 8, 7
#: Values that hashed words and paths may take in the forest.
BUCKETS = 64

FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "kinds", "changes", "distinct", "coverage",
    "path", "before", "before_2", "after", "inside", "assigned", "quoted",
)


def pieces(text: Column) -> Column:
    """The three-letter pieces of a text, lower-cased: one pass, however long the text is."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, path, word_no, nth, value and the words around it, one row per candidate."""
    words = F.split(F.col(text_col), r"[ \t\n\x0B\f\r]+")
    found = F.filter(
        F.transform(
            "words",
            lambda w, i: F.when(
                (F.length(w) >= 16) & w.rlike(CANDIDATE),
                F.struct(
                    i.alias("word_no"),
                    w.alias("word"),
                    F.when(i > 1, F.get("words", i - 2)).alias("before_2"),
                    F.when(i > 0, F.get("words", i - 1)).alias("before"),
                    F.get("words", i + 1).alias("after"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), words.alias("words")
    ).select("doc_id", "path", F.explode(found).alias("at"))
    values = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    return rows.select("doc_id", "path", "at.*").select("*", F.posexplode(values).alias("nth", "value"))


def share(value: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kind}]", "")) / F.length(value)


def bucket(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), r"[^\p{L}]", "")
    return F.pmod(F.xxhash64(letters), F.lit(BUCKETS)).cast("double")


def coverage(rows: DataFrame) -> DataFrame:
    """(value, coverage): the share of a value's pieces in the dictionary."""
    near = rows.select(F.explode(F.array("before_2", "before", "after")).alias("word"))
    counted = near.select(F.explode(pieces(F.col("word"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    counted = stash(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = counted.where(F.col("n") * DICTIONARY >= total).select("piece", F.lit(1.0).alias("known"))
    own = rows.select("value").distinct().select("value", F.explode(pieces(F.col("value"))).alias("piece"))
    return (
        own.join(F.broadcast(common), "piece", "left")  # at most DICTIONARY rows
        .groupBy("value")
        .agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage"))
    )


def described(rows: DataFrame) -> DataFrame:
    """Candidates with the columns ``FEATURES``."""
    value = F.col("value")
    kinds = F.translate(
        F.translate(F.translate(value, DIGITS, "0" * 10), UPPER, "A" * 26), LOWER, "a" * 26
    )
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1"))
    stem = F.split_part("word", "value", F.lit(1))
    around = F.concat_ws(" ", "before_2", "before", stem)
    return rows.withColumns(
        {
            "length": F.length(value).cast("double"),
            "digits": share(value, "0-9"),
            "uppers": share(value, "A-Z"),
            "lowers": share(value, "a-z"),
            "others": share(value, "+/_-"),
            "kinds": F.size(F.array_distinct(F.split(kinds, ""))).cast("double"),
            "changes": (runs - 1) / F.length(value),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
            "path_no": F.pmod(F.xxhash64(F.coalesce("path", F.lit(""))), F.lit(BUCKETS)).cast("double"),
            "before_no": bucket(F.col("before")),
            "before_2_no": bucket(F.col("before_2")),
            "after_no": bucket(F.col("after")),
            "inside_no": bucket(stem),
            "assigned": F.coalesce(F.endswith(F.rtrim(F.regexp_replace(around, "[\"']", "")), F.lit("=")), F.lit(False)).cast("double"),
            "quoted": F.coalesce(F.col("word").rlike("[\"']"), F.lit(False)).cast("double"),
            "near": around,
        }
    )


def strict_label(value: Column, near: Column) -> Column:
    """1 for known formats and assignments to key words, 0 for letters or digits alone, else null."""
    return (
        F.when(value.rlike(KNOWN), 1)
        .when(near.rlike(KEY_WORDS + r"\W*[=:]\W*$"), 1)
        .when(value.rlike(r"^[a-z]+$|^[A-Z]+$|^[A-Z][a-z]+$|^[0-9]+$"), 0)
    )


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """One row per candidate: doc_id, word_no, nth, length, value_sha256, label, score, secret.

    ``labelled`` findings are (doc_id, word_no, nth, label); without them, strict formats label.
    """
    rows = stash(candidates(docs, id_col, text_col, path_col))
    known = described(rows).join(coverage(rows), "value", "left")
    if labelled is None:
        known = known.withColumn("label", strict_label(F.col("value"), F.col("near")))
    else:
        one = labelled.groupBy("doc_id", "word_no", "nth").agg(F.max("label").alias("label"))
        known = known.join(one, ["doc_id", "word_no", "nth"], "left")
    inputs = [f"{c}_no" if c in ("path", "before", "before_2", "after", "inside") else c for c in FEATURES]
    known = known.fillna(0.0, ["coverage"]).select(
        "doc_id", "word_no", "nth", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.col("label").cast("int").alias("label"), *inputs,
    )
    known = stash(known)
    order = [F.xxhash64("value_sha256"), "doc_id", "word_no", "nth"]
    fitted = [known.where(F.col("label") == c).orderBy(*order).limit(FIT_ROWS) for c in (0, 1)]
    result = ["doc_id", "word_no", "nth", F.col("length").cast("int").alias("length"), "value_sha256", "label"]
    if any(f.isEmpty() for f in fitted):
        return known.select(*result, F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    sample = stash(fitted[0].union(fitted[1]).orderBy(*order)).repartition(1).sortWithinPartitions(*order)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    )
    model = forest.fit(assemble.transform(sample))
    scored = model.transform(assemble.transform(known)).withColumn(
        "score", vector_to_array("probability")[1]
    )
    return scored.select(*result, "score", (F.col("score") >= threshold).alias("secret"))
