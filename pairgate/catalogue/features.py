"""Sequence and embedding features, and frozen linear models applied as column expressions."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pairgate import scoring
from pairgate.catalogue import query, rounded, table
from pairgate.functions import vectors as V
from pairgate.functions.sequence import pair_features
from pairgate.operators.linear import LinearGate
from pairgate.operators.ml import GateModel
from pairgate.operators.pooling import pool_windows


def _frac(s: str, letters: str) -> str:
    return f"(CASE WHEN length({s}) > 0 THEN ROUND((length({s}) - length(translate({s}, '{letters}', ''))) / length({s})::DOUBLE, 6) ELSE 0.0 END)::DOUBLE"


def _chain_sql(s: str, name: str) -> str:
    count = lambda letters: f"(length({s}) - length(translate({s}, '{letters}', '')))"
    return f"""length({s})::DOUBLE AS {name}_length, ({count('KR')} - {count('DE')})::DOUBLE AS {name}_net_charge,
  {_frac(s, 'FWY')} AS {name}_aromatic_frac, {_frac(s, 'AVLIMFWC')} AS {name}_hydrophobic_frac,
  {_frac(s, 'STNQ')} AS {name}_polar_frac, {_frac(s, 'C')} AS {name}_cysteine_frac"""


@query(
    "composition_features",
    f"""SELECT doc_id, {_chain_sql('b', 'binder')}, {_chain_sql('t', 'target')},
  CASE WHEN length(t) > 0 THEN ROUND(length(b) / length(t)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS length_ratio
FROM (SELECT doc_id, upper(replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 'ß', 'SS')) AS b, upper(source || lang) AS t FROM documents)""",
)
def composition_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    target = F.concat("source", "lang")
    return rounded(docs.select("doc_id", *pair_features("text", target)))


@query(
    "first_chain_length",
    """SELECT conv_id, turn, length(string_split(text, ' ')[1])::DOUBLE AS value, len(string_split(text, ' '))::INT AS chain_count FROM conversations""",
)
def first_chain_length(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    examples = turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.split("text", " ").alias("binder_chains"))
    name = F.split("example_id", ":")
    return scoring.length(examples).select(
        name[0].cast("long").alias("conv_id"),
        name[1].cast("long").alias("turn"),
        "value",
        F.col("notes")["binder_chain_count"].cast("int").alias("chain_count"),
    )


def _neighbours(spark, sf_dir):
    """Embedding pairs (v, v + 1) by a strict lookup of both sides."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    left = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    right = e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("eb"))
    return left.join(right, "a")


@query(
    "embedding_concat_norm",
    """WITH e AS (SELECT x.vec_id AS a, x.embedding::DOUBLE[] AS ea, y.embedding::DOUBLE[] AS eb FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
SELECT a, (len(ea) + len(eb))::INT AS width, ROUND(list_sum(list_transform(list_concat(ea, eb), lambda v: v * v)), 6) AS norm2 FROM e""",
)
def embedding_concat_norm(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).withColumn("x", V.concat_pair("ea", "eb"))
    return rounded(pairs.select("a", F.size("x").alias("width"), V.dot("x", "x").alias("norm2")))


@query(
    "hadamard_dot",
    """WITH e AS (SELECT x.vec_id AS a, x.embedding::DOUBLE[] AS ea, y.embedding::DOUBLE[] AS eb FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
SELECT a, ROUND(list_sum(list_transform(range(1, len(ea) + 1), lambda i: ea[i] * eb[i])), 6) AS dot, ROUND(list_max(list_transform(range(1, len(ea) + 1), lambda i: ea[i] * eb[i])), 6) AS largest FROM e""",
)
def hadamard_dot(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).withColumn("h", V.hadamard("ea", "eb"))
    return rounded(pairs.select("a", V.total("h").alias("dot"), F.array_max("h").alias("largest")))


@query(
    "weighted_mean_pooling",
    """WITH w AS (SELECT label, vec_id % 5 + 1 AS w, UNNEST(embedding::DOUBLE[]) AS x, UNNEST(range(64)) AS dim FROM embeddings)
SELECT label, dim::INT AS dim, ROUND(SUM(x * w) / SUM(w), 6) AS value FROM w GROUP BY ALL""",
)
def weighted_mean_pooling(spark, sf_dir):
    windows = table(spark, sf_dir, "embeddings").select("label", "embedding", (F.col("vec_id") % 5 + 1).alias("length"))
    pooled = pool_windows(windows, ["label"])
    return rounded(pooled.select("label", F.posexplode("embedding").alias("dim", "value")))


_GATE = (["l_quantity", "l_extendedprice", "l_discount"], [25.0, 38000.0, 0.05], [14.0, 23000.0, 0.03], -0.25, [0.8, -0.4, 0.6])


_GATE_SQL = """SELECT l_orderkey, l_linenumber, ROUND(z, 6) AS logit, (z >= 0.3)::BOOLEAN AS called FROM (SELECT *,
  -0.25::DOUBLE + (l_quantity - 25) / 14 * 0.8::DOUBLE + (l_extendedprice - 38000) / 23000 * (-0.4)::DOUBLE + (l_discount - 0.05::DOUBLE) / 0.03::DOUBLE * 0.6::DOUBLE AS z FROM lineitem)"""


@query("frozen_linear_apply", _GATE_SQL)
def frozen_linear_apply(spark, sf_dir):
    logit = V.linear_logit(*_GATE)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.round(logit, 6) + 0.0).alias("logit"), (logit >= 0.3).alias("called")
    )


@query("saved_gate_apply", _GATE_SQL)
def saved_gate_apply(spark, sf_dir):
    """The same gate as a stage of a saved and loaded pipeline."""
    gate = LinearGate(*[list(v) if isinstance(v, list) else v for v in _GATE], threshold=0.3, target_precision=0.9)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/pairgate-gate-{uuid.uuid4().hex}"
    PipelineModel(stages=[GateModel.of(gate)]).write().save(path)
    scored = PipelineModel.load(path).transform(table(spark, sf_dir, "lineitem"))
    return scored.select(
        "l_orderkey", "l_linenumber", (F.round("logit", 6) + 0.0).alias("logit"), (F.col("prediction") == 1.0).alias("called")
    )
