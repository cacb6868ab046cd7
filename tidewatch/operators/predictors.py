"""Predictors: persistable transformers that add <prefix>_label and <prefix>_score to flows.

The rule detector and every fitted pipeline keep this contract, so a batch or a stream scores
with either, saved and loaded as Spark ML models are.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import severity


class _Predictor(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    prefix = Param(Params._dummy(), "prefix", "what the added columns' names start with", TypeConverters.toString)

    def _named(self, name: str) -> str:
        return f"{self.getOrDefault('prefix')}_{name}"


class Decision(_Predictor):
    """The last stage of a fitted pipeline: from a classifier's margins to probabilities, the label and its score.

    Without sigmoids the probabilities are the classifier's own. With them each class has one, over its
    margin, and they are scaled to sum to 1; with two classes the second one's decides. A row that no class claims is
    shared evenly. Of equal probabilities the first label's wins.
    """

    labels = Param(Params._dummy(), "labels", "in the order of the classifier's classes", TypeConverters.toListString)
    margins = Param(Params._dummy(), "margins", "the column of margins", TypeConverters.toString)
    slopes = Param(Params._dummy(), "slopes", "of each class's sigmoid, or none", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "of each class's sigmoid, or none", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, labels=None, margins="probability", slopes=None, intercepts=None, prefix="m"):
        super().__init__()
        self._setDefault(margins="probability", slopes=[], intercepts=[], prefix="m")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _probabilities(self) -> Column:
        margins, slopes = vector_to_array(self.getOrDefault("margins")), self.getOrDefault("slopes")
        if not slopes:
            return margins
        intercepts = self.getOrDefault("intercepts")
        sigmoid = lambda k: 1 / (1 + F.exp(-(F.get(margins, F.lit(k)) * slopes[k] + intercepts[k])))
        if len(slopes) == 2:
            return F.array(1 - sigmoid(1), sigmoid(1))
        every = F.array(*[sigmoid(k) for k in range(len(slopes))])
        total = F.aggregate(every, F.lit(0.0), lambda a, p: a + p)
        return F.transform(every, lambda p: F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(slopes))))

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self._named("probability")
        out = df.withColumn(p, self._probabilities()).withColumn(self._named("score"), F.array_max(p))
        names = F.array(*[F.lit(x) for x in self.getOrDefault("labels")])
        return out.withColumn(self._named("label"), F.get(names, (F.array_position(p, F.col(self._named("score"))) - 1).cast("int")))


class RuleDetector(_Predictor):
    """The detector without a model: attacks are told by the counts of two flags and the rate of packets. score is the
    label's own, so at least one half."""

    syn = Param(Params._dummy(), "syn", "column of SYN flags", TypeConverters.toString)
    rst = Param(Params._dummy(), "rst", "column of RST flags", TypeConverters.toString)
    rate = Param(Params._dummy(), "rate", "column of packets a second", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, syn="flow_SYN_flag_count", rst="flow_RST_flag_count", rate="flow_pkts_per_sec", prefix="m"):
        super().__init__()
        self._setDefault(syn="flow_SYN_flag_count", rst="flow_RST_flag_count", rate="flow_pkts_per_sec", prefix="m")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = severity.rule_score(*[F.col(self.getOrDefault(c)) for c in ("syn", "rst", "rate")])
        label = severity.rule_label(s)
        return df.withColumns({self._named("label"): label, self._named("score"): F.when(label == "attack", s).otherwise(1 - s)})
