"""The checks of learned queries fail for a model that has not learned."""

import numpy as np
from pyspark.sql import functions as F

from sigframe.catalog import learning
from sigframe.plans import quantizer


class Constant:
    def transform(self, df):
        return df.withColumn("prediction", F.lit(0.0))


class Right:
    def transform(self, df):
        return df.withColumn("prediction", F.col("label").cast("double"))


def test_a_constant_classifier_is_not_known(frame):
    df = frame([(i, i % 4) for i in range(40)], "vec_id long, label int")
    assert not any(r["known"] for r in learning._predicted(Constant(), df, df).collect())
    assert all(r["known"] for r in learning._predicted(Right(), df, df).collect())


def test_an_untrained_rotated_codebook_is_not_better(spark):
    draws = np.random.default_rng(3).normal(size=(200, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in draws], "mfcc array<double>")
    trained = quantizer.build_pca_tokenizer(df, "mfcc", k=4, iters=5)
    far = quantizer.codebook_of(spark, [np.full(3, 50.0 + i) for i in range(4)])
    untrained = quantizer.Tokenizer(far, trained.rotation)
    assert all(r["better"] for r in learning._codebook_facts(spark, trained, df, 4).collect())
    assert not any(r["better"] for r in learning._codebook_facts(spark, untrained, df, 4).collect())
