"""Training rows of a forest are dealt over tasks, each row once."""

from pyspark.sql import functions as F

from cadenza.operators import models


class Watch:
    """Stands in for an estimator and its model; notes what it is fitted on."""

    def fit(self, df):
        self.partitions = df.rdd.glom().map(len).collect()
        return self

    def transform(self, df):
        return df.withColumn("prediction", F.col("label"))


def test_training_rows_are_dealt_by_id(spark):
    rows = spark.createDataFrame([(i % 190, i % 3, [float(i), 1.0]) for i in range(200)], "vec_id bigint, label int, x array<double>").coalesce(1)
    dealt, plain = Watch(), Watch()
    _, out = models.fit_predict(dealt, rows, rows, tasks=7)
    models.fit_predict(plain, rows, rows)
    assert len(dealt.partitions) == 7 and min(dealt.partitions) > 0 and sum(dealt.partitions) == 200
    assert plain.partitions == [200]
    assert out.count() == 200 and out.where("truth <> pred").count() == 0
