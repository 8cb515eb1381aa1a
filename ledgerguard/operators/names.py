"""The name-detector slot.

Interface: a DataFrame of entity spans ``(row keys, start, end, label, score)``; labels are mapped to policy
entity types (LOCATION -> ADDRESS, ...) and spans under the minimum score are dropped. The default
implementation is a gazetteer join (no model in the container): names are keyed by their words and matched against each
text's runs of words by an equi-join, and only matching (text, name) pairs are located with the
name's word-bounded pattern. Any other detector that gives the same DataFrame can take its place in front of ``finalize_names``;
``with_name_spans`` hands the spans to masking (``extra_spans_col``), where they rank behind known values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.operators.masking import text_keys, value_keys
from ledgerguard.session import written
from ledgerguard.sources.policy import DEFAULT, Policy

# Gazetteer labels and scores of the default plug-in
GAZETTEER_COLUMNS = (("FirstName", "PERSON", 0.85), ("LastName", "PERSON", 0.85), ("AddressLine1", "LOCATION", 0.7),
                     ("AddressLine2", "LOCATION", 0.5))


def gazetteer_from_customers(customers: DataFrame) -> DataFrame:
    parts = [customers.select(F.col(c).alias("name"), F.lit(label).alias("label"), F.lit(score).alias("score"))
             for c, label, score in GAZETTEER_COLUMNS]
    g = parts[0]
    for p in parts[1:]:
        g = g.unionByName(p)
    return (g.where(F.col("name").isNotNull() & (F.length(S.display_value(F.col("name"))) >= P.KNOWN_VALUE_MIN_LENGTH))
            .select(S.display_value(F.col("name")).alias("name"), "label", "score")
            .groupBy("name", "label").agg(F.max("score").alias("score")))


def finalize_names(spans: DataFrame, min_score: float = P.NER_MIN_SCORE) -> DataFrame:
    mapping = F.create_map(*[x for k, v in P.NER_TYPE_MAP.items() for x in (F.lit(k), F.lit(v))])
    return (spans.where(F.col("score") >= min_score)
            .withColumn("entity", F.coalesce(F.try_element_at(mapping, F.col("label")), F.col("label"))).drop("label"))


def detect_names(texts: DataFrame, text_col: str, keys: list[str], gazetteer: DataFrame,
                 min_score: float = P.NER_MIN_SCORE) -> DataFrame:
    first = value_keys(written(gazetteer.select("name", "label", "score"), "names"), "name")
    texts = texts.select(*keys, text_col).repartition(*keys)
    cand = (text_keys(texts, text_col, keys, first).join(first, "key").groupBy(*keys)
            .agg(F.collect_set(F.struct("name", "label", "score", S.known_value_pattern(F.col("name")).alias("pattern"))).alias("_c")))
    j = texts.join(cand, keys)
    spans = j.select(*keys, text_col, F.explode("_c").alias("g")).select(
        *keys, text_col, "g.name", "g.label", "g.score", F.explode(S.match_offsets(F.col(text_col), F.col("g.pattern"))).alias("o"))
    out = spans.select(*keys, F.col("o.start").alias("start"), F.col("o.end").alias("end"),
                       S.span_text(F.col(text_col), F.col("o")).alias("value"), "label", "score")
    return finalize_names(out, min_score)


def with_name_spans(texts: DataFrame, text_col: str, keys: list[str], gazetteer: DataFrame, policy: Policy = DEFAULT,
                    out_col: str = "name_spans") -> DataFrame:
    """``texts`` with the policy's name entities found in them as an array of spans (unique, non-null keys)."""
    found = detect_names(texts, text_col, keys, gazetteer, policy.detectors.name_score)
    found = found.where(F.col("entity").isin(*policy.detectors.name_entities))
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity",
                    F.lit("ner").alias("source"), F.lit(P.entity_rank("PERSON", "ner")).cast("int").alias("rank"))
    per_text = found.groupBy(*keys).agg(F.collect_set(span).alias(out_col))
    return texts.join(per_text, keys, "left")
