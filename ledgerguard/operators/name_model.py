"""D6, the model slot: names in free text by a trained tagger that runs inside an iterator pandas UDF.

``NameTagger`` is the tagger shipped with the package (``models/<name>.json``): a multinomial logistic model over
a word, its shape and affixes, and the two words on either side. The policy's ``ner.model`` names the model (or is the path
of such a file); where there is none, the detector is off, as with any other optional detector.

On the workers a model is loaded once for each process and kept for all batches and tasks. It tags many texts at
a time: what a word adds by itself is computed once for each distinct word of a batch, the rest is array work.
Spans come back with scores and are checked against the text in the JVM: a model whose spans lie outside of the
text, or whose scores are no probabilities, stops the job instead of leaving names in clear.

A model of another kind plugs in by ``register_loader``: any object with ``tag(texts) -> [[(start, end, label, score)]]``.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.functions import patterns as P
from ledgerguard.functions import spans as S
from ledgerguard.session import ship_package
from ledgerguard.sources.policy import DEFAULT, Policy

log = logging.getLogger(__name__)

MODEL_FOLDER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "models")
LARGEST_MODEL = 64 << 20  # bytes of a model that are sent to the workers; beyond it a job is refused
NAME_SPANS = "array<struct<start:int,end:int,label:string,score:double>>"

_TOKEN = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
LABELS = ("", "PERSON", "LOCATION")
PLACES = {"<": -1, ">": 1, "<<": -2, ">>": 2}  # the words beside a word that count


def shape(word: str) -> str:
    """Upper, lower, digit and other characters, runs shortened."""
    kinds = ["X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in word[:24]]
    return "".join(k for i, k in enumerate(kinds) if i < 2 or not (k == kinds[i - 1] == kinds[i - 2]))


def _hash(feature: str, size: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % size


def word_features(word: str, size: int) -> list[int]:
    low = word.lower()
    return [_hash(f, size) for f in (f"w={low}", f"s={shape(word)}", f"p={low[:3]}", f"e={low[-3:]}", f"e2={low[-2:]}", f"n={min(len(word), 9)}", "all")]


def beside_features(word: str, place: str, size: int) -> list[int]:
    return [_hash(f, size) for f in (f"{place}w={word.lower()}", f"{place}s={shape(word)}")]


class NameTagger:
    """Labels of words by hashed features; a run of words with one label, apart by one space, is a span."""

    def __init__(self, weights: np.ndarray, labels: tuple[str, ...]) -> None:
        self.weights, self.labels, self.size = weights, labels, len(weights)

    @staticmethod
    def parse(raw: bytes) -> NameTagger:
        doc = json.loads(raw)
        weights = np.zeros((doc["size"], len(doc["labels"])))
        for row, values in doc["weights"].items():
            weights[int(row)] = values
        return NameTagger(weights, tuple(doc["labels"]))

    def _sums(self, words: list[str], features: Callable[[str], list[int]]) -> np.ndarray:
        return np.array([self.weights[features(w)].sum(axis=0) for w in words]).reshape(len(words), len(self.labels))

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        found = [[(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(t or "")] for t in texts]
        number: dict[str, int] = {"": 0}
        ids = np.array([number.setdefault(w, len(number)) for ms in found for w, _, _ in ms], np.int64)
        if not len(ids):
            return [[] for _ in texts]
        words = list(number)
        own = self._sums(words, lambda w: word_features(w, self.size))
        text = np.repeat(np.arange(len(texts)), [len(ms) for ms in found])
        logits = own[ids]
        for place, at in PLACES.items():
            beside = np.zeros_like(ids)  # the number of the word there, or of none
            here, there = (slice(0, -at), slice(at, None)) if at > 0 else (slice(-at, None), slice(0, at))
            beside[here] = np.where(text[there] == text[here], ids[there], 0)
            logits += self._sums(words, lambda w, place=place: beside_features(w, place, self.size))[beside]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best, sure = odds.argmax(axis=1).tolist(), odds.max(axis=1).tolist()
        out, at = [], 0
        for t, ms in zip(texts, found):
            spans: list[list] = []
            for (_, start, end), label, score in zip(ms, best[at:at + len(ms)], sure[at:at + len(ms)]):
                if not label:
                    continue
                if spans and spans[-1][2] == self.labels[label] and t[spans[-1][1]:start] == " ":
                    spans[-1][1], spans[-1][3] = end, min(spans[-1][3], score)
                else:
                    spans.append([start, end, self.labels[label], score])
            at += len(ms)
            out.append([tuple(s) for s in spans])
        return out


_loaders: dict[str, Callable[[bytes], object]] = {".json": NameTagger.parse}


def register_loader(suffix: str, load: Callable[[bytes], object]) -> None:
    """Models in files that end in ``suffix`` are made by ``load(bytes)`` (an importable function)."""
    _loaders[suffix] = load


def model_file(name: str) -> str | None:
    """The file of the model that a policy names: a path, or the name of a model of this package; None if absent."""
    for path in (name, *(os.path.join(MODEL_FOLDER, name + suffix) for suffix in _loaders)):
        if os.path.isfile(path) and os.path.splitext(path)[1] in _loaders:
            return path
    return None


@lru_cache(maxsize=4)
def _model(digest: str, suffix: str, raw: bytes) -> object:
    return _loaders[suffix](raw)


def load_model(name: str) -> object | None:
    """The model on the driver; None if absent."""
    path = model_file(name)
    if path is None:
        return None
    with open(path, "rb") as f:
        raw = f.read()
    return _model(hashlib.sha256(raw).hexdigest(), os.path.splitext(path)[1], raw)


def _tagger_udf(spark: SparkSession, path: str):
    """An iterator pandas UDF over texts. The model goes to the workers as a broadcast of bounded size."""
    if os.path.getsize(path) > LARGEST_MODEL:
        raise ValueError(f"the name model {path} has more than {LARGEST_MODEL} bytes")
    with open(path, "rb") as f:
        raw = f.read()
    digest, suffix = hashlib.sha256(raw).hexdigest(), os.path.splitext(path)[1]
    ship_package(spark)
    sent = spark.sparkContext.broadcast(raw)

    @F.pandas_udf(NAME_SPANS)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ledgerguard.operators.name_model import _model as load
        model = load(digest, suffix, sent.value)  # kept by the process: later batches and tasks find it there
        for texts in batches:
            spans = model.tag(["" if t is None else t for t in texts])
            yield pd.Series([[{"start": s, "end": e, "label": lab, "score": float(p)} for s, e, lab, p in per] for per in spans])

    return tag


def checked_spans(text: Column, spans: Column) -> Column:
    """``spans`` of a model, or an error if one does not lie in the text or has no probability as its score."""
    def wrong(s: Column) -> Column:
        return ~F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (s["score"] >= 0) & (s["score"] <= 1)
                           & s["label"].isNotNull(), F.lit(False))

    n = F.size(F.filter(spans, wrong))
    return F.when(n == 0, spans).when(n > 0, F.raise_error(F.concat(F.lit("name model: spans outside of the text or without a score: "), n.cast("string"))))


def entity_of(label: Column) -> Column:
    """The entity type of a model's label."""
    mapping = F.create_map(*[x for k, v in P.NER_TYPE_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(mapping, label), label)


def add_model_spans(df: DataFrame, text_col: str, policy: Policy = DEFAULT, out_col: str = "name_spans") -> DataFrame:
    """``df`` with the names that the policy's model finds in a text, as spans for masking (``extra_spans_col``).
    One pass in the row: no join, no shuffle. Without a model, or with names switched off, there are no spans."""
    path = model_file(policy.detectors.name_model) if policy.detectors.names else None
    if path is None:
        if policy.detectors.names:
            log.warning("no name model %r: the name detector is off", policy.detectors.name_model)
        return df.withColumn(out_col, F.array().cast(S.SPANS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = df.withColumn("__tagged", _tagger_udf(df.sparkSession, path)(text))
    rank = P.entity_rank("PERSON", "ner")
    kept = F.filter(checked_spans(text, F.col("__tagged")),
                    lambda s: (s["score"] >= policy.detectors.name_score) & entity_of(s["label"]).isin(*_wanted(policy)))
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), entity_of(s["label"]).alias("entity"),
                                                 F.lit("ner").alias("source"), F.lit(rank).cast("int").alias("rank")))
    return tagged.withColumn(out_col, spans).drop("__tagged")


def _wanted(policy: Policy) -> list[str]:
    return [P.NER_TYPE_MAP.get(e, e) for e in policy.detectors.name_entities]


def detect_names_model(texts: DataFrame, text_col: str, keys: list[str], policy: Policy = DEFAULT) -> DataFrame:
    """(keys, start, end, value, entity): one row for each name that the policy's model finds."""
    found = add_model_spans(texts.select(*keys, text_col), text_col, policy, "__names")
    return (found.select(*keys, text_col, F.explode("__names").alias("__n"))
            .select(*keys, F.col("__n.start").alias("start"), F.col("__n.end").alias("end"),
                    S.span_text(F.col(text_col), F.col("__n")).alias("value"), F.col("__n.entity").alias("entity")))
